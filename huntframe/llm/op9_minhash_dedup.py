"""Near-duplicates by bottom-k sketches of word shingles.

A document's set is its distinct shingles, hashed once to 63 bits; its sketch is the set's k lowest
hashes. Documents of one set are one class, judged by its smallest doc_id. Inverted lists over the
`listed` lowest retained values bring classes together:

* Values are ordered rarest first. Sketches of two documents at the threshold share `least_listed` of
  the listed values but for a chance below one in ten million, so they share a value among each one's
  listed - least_listed + 1 rarest; only those enter lists, and a passage that many quote does not.
* First every document meets only the leaders of its few longest lists. Once the links found are joined
  into components, a list whose members are all in one is done with. In the others, pairs of different
  components are compared by 256-bit marks of their listed values: inside the list while it is short,
  in blocks of members beyond. So a list of thousands of copies costs its length, and no pair is skipped.
* The union-sketch estimate drops pairs far below the threshold; the rest is verified on full sets.

No text, set or sketch is shuffled but those of documents in a pair, and joins deal a hub's rows to several
tasks. Components are the smallest doc_id that can be reached (see graph.py); nothing but small counts meets
the driver. Intermediate tables are removed at the end; the groups themselves are a table in the shared folder.

Defined results: fewer words than a shingle: the whole sequence is the one shingle; no words or null
text: an empty set, linked with nothing, its own component. Rows with the same doc_id are one document,
linked whatever their texts. A null doc_id takes part in no link (component null, kept). Extra columns
are ignored (components) or kept (deduplicate).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.llm.common import LOWER, SPACES, class_table, cut, discard, join_dealt, mix, only, row_sums, span_hashes, table, text_blocks, word_spans
from huntframe.llm.graph import components as connected

NAME = "op9_minhash_dedup"
K, LISTED = 64, 32
LEAST, LEAST_LISTED = 36, 12  # shared retained values at the threshold, five deviations below the mean and more
_IS_WORD = class_table(SPACES)
_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (63 bits, ascending within a row) of a block of texts, and where each row's begin."""
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, _IS_WORD)
    hashes = span_hashes(data, starts, ends)
    counts = np.diff(bounds)
    lengths = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    first = np.repeat(bounds[:-1] - begins[:-1], lengths) + np.arange(begins[-1])  # first word of each shingle
    size = np.repeat(np.minimum(counts, words), lengths)
    out = size.astype(np.uint64)
    for i in range(words):
        inside = size > i
        out = np.where(inside, out * _M + hashes[np.minimum(first + i, max(len(hashes) - 1, 0))], out) if len(hashes) else out
    out = mix(out) >> np.uint64(1)
    for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist()):
        out[lo:hi].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[begins[:-1][lengths > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return out[fresh], kept[begins]


MARKS = ("m0", "m1", "m2", "m3")
MEMBER = ("rep", "n", *MARKS)
SKETCHES = "doc_id long, n long, key1 long, key2 long, m0 long, m1 long, m2 long, m3 long, sketch array<long>"


def sketches(docs: DataFrame, words: int, k: int, listed: int) -> DataFrame:
    """Set size, a 128-bit key of the whole set, marks of the listed values and the bottom-k sketch of every text. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                values, bounds = shingle_sets(data, offsets, words)
                n = np.diff(bounds)
                row = np.repeat(np.arange(hi - lo), n)
                rank = np.arange(len(values)) - bounds[:-1][row]
                with np.errstate(over="ignore"):
                    keys = [row_sums(mix(values ^ salt).view(np.int64), bounds) for salt in (np.uint64(0x51), _M)]
                keys[0][n == 0] = np.arange(lo, hi)[n == 0]  # empty sets are never one class; spread them
                marked = rank < listed
                at = (mix(values[marked]) & np.uint64(255)).astype(np.int64)
                flags = np.zeros((hi - lo, 256), np.uint8)
                flags[row[marked], at] = 1
                marks = np.packbits(flags, axis=1).view(np.int64)
                blocks.append((n, *keys, *marks.T, values[rank < k].view(np.int64), np.minimum(n, k)))
            *columns, low, sizes = (np.concatenate(x) for x in zip(*blocks)) if blocks else [np.zeros(0, np.int64)] * 9
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(low))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns), lists], ["doc_id", "n", "key1", "key2", *MARKS, "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCHES)


def rare_posts(classes: DataFrame, listed: int, least: int) -> DataFrame:
    """(v, rep, n, marks, place, hub): for each class those of its rarest listed values that another class has too; place counts from the commonest."""
    posts = cut(classes.select("rep", F.explode(F.slice("sketch", 1, listed)).alias("v")))
    shared = cut(posts.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1"))  # what no other has need not be listed
    met = join_dealt(posts, shared.withColumnRenamed("n", "df"), "v", "rep", shared)
    own = Window.partitionBy("rep")
    place = F.row_number().over(own.orderBy(F.desc("df"), F.desc("v")))
    hub = F.sum(F.log2("df")).over(own).cast("float")  # high for what most others were made from
    # of a sketch at the threshold so many values are shared; a whole set (small enough) must share four fifths
    skipped = F.when(5 * F.col("n") <= 4 * listed, F.ceil(0.8 * F.col("n") - 1e-9)).otherwise(F.lit(least)) - 1
    found = met.select("v", "rep", place.alias("place"), hub.alias("hub")).join(classes.select(*MEMBER), "rep").withColumn("place", F.col("place") - skipped)
    kept = cut(found.filter("place > 0"))
    discard(posts, shared)
    return kept


def _may_match(x, y, listed: int):
    """Sizes and marks of two classes do not rule the threshold out."""
    small, large = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
    both = sum((F.bit_count(x[m].bitwiseAND(y[m])) for m in MARKS[1:]), F.bit_count(x[MARKS[0]].bitwiseAND(y[MARKS[0]])))
    return (5 * small >= 4 * large) & (both >= _least_marks(small, listed))


def _least_marks(n, listed: int):
    return F.when(5 * n <= 4 * listed, F.greatest(F.lit(1), F.floor(n / 2))).otherwise(F.lit(10))


def leader_pairs(posts: DataFrame, listed: int, lists: int) -> DataFrame:
    """Pairs (a, b), a < b: each class with the leaders of its `lists` commonest values. A leader is the member with most of what others share."""
    few = posts.filter(F.col("place") <= lists).select("v", *MEMBER)
    leaders = posts.groupBy("v").agg(F.max(F.struct("hub", (-F.col("rep")).alias("draw"), *MEMBER)).alias("l"))
    met = join_dealt(few, leaders, "v", "rep").withColumn("x", F.struct(*MEMBER)).filter((F.col("x.rep") != F.col("l.rep")) & _may_match(F.col("x"), F.col("l"), listed))
    return cut(met.select(F.least("x.rep", "l.rep").alias("a"), F.greatest("x.rep", "l.rep").alias("b")).distinct())


def open_lists(posts: DataFrame, found: DataFrame) -> DataFrame:
    """The posts of lists that hold more than one component, with their component, the list's size and its commonest component."""
    placed = cut(posts.drop("place", "hub").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    by = placed.groupBy("v", "component").agg(F.count("*").alias("c"))
    lists = cut(by.groupBy("v").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("main")).filter(F.col("size") > F.col("main.c")))
    opened = cut(join_dealt(placed, lists.select("v", "size", F.col("main.component").alias("main"), (F.col("size") - F.col("main.c")).alias("minor")), "v", "rep", lists.select("v", F.col("size").alias("n"))))
    discard(placed, lists)
    return opened


def short_list_pairs(members: DataFrame, listed: int) -> DataFrame:
    """Pairs of different components within each list; the lists are short, so gathering one is bounded."""
    gathered = members.groupBy("v").agg(F.collect_list(F.struct(*MEMBER, "component")).alias("l"))
    pairs = F.flatten(
        F.transform(
            "l",
            lambda x: F.transform(F.filter("l", lambda y: (y["rep"] > x["rep"]) & (y["component"] != x["component"]) & _may_match(x, y, listed)), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b"))),
        )
    )
    return cut(gathered.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct())


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of the documents listed in ids (rep): whole sets as bytes of their ascending hashes."""
    texts = only(docs.select(F.col("doc_id").alias("rep"), "text"), ids, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = []
            for _, _, data, offsets in text_blocks(batch.column("text")):
                values, bounds = shingle_sets(data, offsets, words)
                sets += [values[lo:hi].tobytes() for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "shingles"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, shingles binary").dropDuplicates(["rep"])


def _intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of 0/1 matrices over the values both lists hold."""
    flat = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*flat)
    at = []
    for sets, values in zip((left, right), flat):
        column = np.searchsorted(common, values)
        held = (column < len(common)) & (common[np.minimum(column, max(len(common) - 1, 0))] == values) if len(common) else np.zeros(len(values), bool)
        at.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets])[held], column[held]))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(common), columns):
        flags = []
        for (row, column), n in zip(at, out.shape):
            now = (column >= lo) & (column < lo + columns)
            marks = np.zeros((n, min(columns, len(common) - lo)), np.float32)
            marks[row[now], column[now] - lo] = 1
            flags.append(marks)
        out += flags[0] @ flags[1].T
    return out.astype(np.int64)


def long_list_links(members: DataFrame, docs: DataFrame, words: int, listed: int, block: int = 256) -> DataFrame:
    """Links between different components within each long list, found block against block.

    A class's home is its longest open list. Two classes of one home meet there alone. In any list the
    commonest kind of members, those of one component or of one home elsewhere, need not meet each other;
    every other member meets all. The blocks meet by sizes and marks first (56 bytes a member and cell); only members that
    some other one in the cell may match come again with their full sets. Only links come out, one for each
    member and component it is linked to.
    """
    homes = members.groupBy("rep").agg(F.max(F.struct("size", "v"))["v"].alias("home"))
    placed = members.select("v", *MEMBER, "component").join(homes, "rep")
    placed = cut(placed.withColumn("kind", F.when(F.col("home") == F.col("v"), F.struct(F.lit(0).alias("k"), F.col("component").alias("x"))).otherwise(F.struct(F.lit(1).alias("k"), F.col("home").alias("x")))))
    by = placed.groupBy("v", "kind").agg(F.count("*").alias("c"))
    lists = cut(by.groupBy("v").agg(F.sum("c").alias("size"), F.max(F.struct("c", "kind")).alias("main")).filter(F.col("size") > F.col("main.c")))
    plan = lists.select("v", F.col("main.kind").alias("main"), F.ceil(F.col("size") / block).alias("cols"), F.ceil((F.col("size") - F.col("main.c")) / block).alias("rows"))
    cells = cut(join_dealt(placed, plan, "v", "rep", lists.select("v", F.col("size").alias("n"))).withColumn("minor", F.col("kind") != F.col("main")).drop("kind", "main"))
    cell = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = (*MEMBER, "component", "home", "minor")
    minors = cells.filter("minor").select("v", cell(F.col("rows"), 1).alias("i"), spread(F.col("cols")).alias("j"), *own)
    others = cells.select("v", spread(F.col("rows")).alias("i"), cell(F.col("cols"), 2).alias("j"), *own)

    def open_pairs(v: int, left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        """Which of left may match which of right, by all that is known without their sets."""
        x, y = left[list(MARKS)].to_numpy(), right[list(MARKS)].to_numpy()
        both = sum(np.bitwise_count(x[:, None, m] & y[None, :, m]).astype(np.int16) for m in range(len(MARKS)))
        pick = lambda c: (left[c].to_numpy()[:, None], right[c].to_numpy()[None, :])
        (n, m), (a, b), (ca, cb), (ha, hb) = map(pick, ("n", "rep", "component", "home"))
        small = np.minimum(n, m)
        need = np.where(5 * small <= 4 * listed, np.maximum(1, small // 2), 10)
        return (both >= need) & (5 * small >= 4 * np.maximum(n, m)) & (ca != cb) & ~((ha == hb) & (ha != v)) & ~(right["minor"].to_numpy()[None, :] & (a > b))

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            open_ = open_pairs(key[0], left, right)
            for side, (rows, at) in enumerate(((left, open_.any(1)), (right, open_.any(0)))):
                found.append(rows[at].rename(columns={"v2": "v", "i2": "i", "j2": "j"}).assign(side=side))
        return (pd.concat(found) if found else left.head(0).assign(side=0))[["v", "i", "j", *own, "side"]]

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        open_ = open_pairs(key[0], left, right)
        shared = _intersections(*([np.frombuffer(s, np.uint64) for s in side["shingles"]] for side in (left, right)))
        total = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :] - shared
        p, q = np.nonzero(open_ & (100 * shared >= 80 * total))
        links = pd.DataFrame({"x": left["rep"].to_numpy()[p], "y": right["rep"].to_numpy()[q], "c": right["component"].to_numpy()[q]}).drop_duplicates(["x", "c"])
        return pd.DataFrame({"a": links[["x", "y"]].min(axis=1), "b": links[["x", "y"]].max(axis=1)})

    schema = "v long, i long, j long, rep long, n long, m0 long, m1 long, m2 long, m3 long, component long, home long, minor boolean, side int"
    other = others.toDF("v2", "i2", "j2", *own)  # columns of their own, beside minors
    likely_rows = cut(minors.groupBy("v", "i", "j").cogroup(other.groupBy("v2", "i2", "j2")).applyInPandas(meet, schema))
    sets = full_sets(docs, likely_rows.select("rep").distinct(), words)
    again = join_dealt(likely_rows, sets, "rep", "i")
    links = cut(again.groupBy("v", "i", "j").applyInPandas(compare, "a long, b long").distinct())
    discard(placed, lists, cells, likely_rows)
    return links


def likely(pairs: DataFrame, classes: DataFrame, k: int, least: int) -> DataFrame:
    """The pairs whose union-sketch estimate does not rule the threshold out."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    side = only(classes.select("rep", "sketch"), needed, "rep")
    both = join_dealt(pairs, side.toDF("a", "sa"), "a", "b")
    both = both.join(side.toDF("b", "sb"), "b")  # b is the larger id: seldom a leader, and AQE splits what is skewed
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb"))
    return cut(both.withColumn("u", F.size(union)).filter(F.size(shared) * k >= least * F.col("u")).select("a", "b"))


def verified(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs whose full sets meet the threshold: 100 * intersection >= 80 * union. Only texts of a pair are shuffled, and the text of a document with many partners once a share of them."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = only(docs.select("doc_id", "text"), needed, "doc_id")
    near = pairs.groupBy("a").agg(F.count("*").alias("na")).join(pairs.groupBy("b").agg(F.count("*").alias("nb")), F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("doc_id"), (F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0))).alias("partners"))
    # each pair under its end of more partners, so that the texts of a star travel by its rays
    ends = pairs.join(near.toDF("a", "pa"), "a").join(near.toDF("b", "pb"), "b")
    turned = cut(ends.select(F.when(F.col("pa") >= F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(F.col("pa") >= F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("ray")))
    rays = turned.join(texts.toDF("ray", "text_r"), "ray")
    both = join_dealt(rays, texts.toDF("hub", "text_h"), "hub", "ray", turned.groupBy("hub").agg(F.count("*").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # the last hub's set: its pairs follow each other

        def sets_of(column: pa.Array) -> list[np.ndarray]:
            out = []
            for _, _, data, offsets in text_blocks(column):
                values, bounds = shingle_sets(data, offsets, words)
                out += [values[lo:hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            return out

        for batch in batches:
            rays_ = sets_of(batch.column("text_r"))
            texts_ = batch.column("text_h")
            good = np.zeros(len(rays_), bool)
            for at, (hub, ray) in enumerate(zip(batch.column("hub").to_pylist(), rays_)):
                text = texts_[at]
                if held.get("hub") != hub or held["text"] != text:
                    held.update(hub=hub, text=text, set=sets_of(texts_.slice(at, 1))[0])
                shared = len(np.intersect1d(held["set"], ray, assume_unique=True))
                good[at] = shared > 0 and 100 * shared >= 80 * (len(held["set"]) + len(ray) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("hub", "ray")], ["a", "b"])

    found = both.select("hub", "ray", "text_h", "text_r").mapInArrow(run, "a long, b long")
    links = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    discard(turned)
    return links


def near_duplicates(docs: DataFrame, words: int = 5, k: int = K, listed: int = LISTED, least: int = LEAST, least_listed: int = LEAST_LISTED, lists: int = 3, short: int = 40) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the smallest doc_id reachable over links of similarity 0.8 or more."""
    every = cut(sketches(docs, words, k, listed))
    some = every.filter("n > 0 AND doc_id IS NOT NULL")
    reps = cut(some.groupBy("n", "key1", "key2").agg(F.min("doc_id").alias("rep")))
    of_reps = only(some.select(F.col("doc_id").alias("rep"), "n", "key1", "key2", *MARKS, "sketch"), reps.select("rep").distinct(), "rep")
    classes = cut(of_reps.join(reps, ["rep", "n", "key1", "key2"], "left_semi").select(*MEMBER, "sketch").dropDuplicates(["rep", "n"]))
    posts = rare_posts(classes, listed, least_listed)
    met = leader_pairs(posts, listed, lists)
    near = likely(met, classes, k, least)
    links = verified(near, docs, words)
    found = connected(links)
    members = open_lists(posts, found)
    gathered = short_list_pairs(members.filter(F.col("size") <= short), listed)
    nearer = likely(gathered, classes, k, least)
    short_links, long_links = verified(nearer, docs, words), long_list_links(members.filter(F.col("size") > short), docs, words, listed)
    across = short_links.unionByName(long_links)
    if not across.isEmpty():
        discard(found)
        found = connected(links.unionByName(across))
    named = every.select("doc_id", "n", "key1", "key2").join(reps, ["n", "key1", "key2"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    groups = cut(named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")))
    discard(every, reps, classes, posts, met, near, links, members, gathered, nearer, short_links, long_links, found)
    return groups


def deduplicate(docs: DataFrame, words: int = 5, **options) -> DataFrame:
    """One document of each group, the one of smallest doc_id; all of its columns. Repeated rows of a document become one, the first by hash of the text, then of the whole row. A null doc_id is in no group and stays."""
    groups = near_duplicates(docs, words, **options)
    gone = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    repeated = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    kept = only(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    whole = F.struct(*docs.columns)
    again = only(kept, repeated, "doc_id").select(whole.alias("row"), F.struct(F.xxhash64("text"), F.xxhash64(F.to_json(whole))).alias("order"))
    one = again.groupBy("row.doc_id").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return only(kept, repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on four-word shingles."""
    groups = near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return groups.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
