"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Everything is DataFrame columns. The trees are fitted on labelled URLs, in jobs that sum gradients by
leaf, feature and bin; they are scored as CASE expressions in one projection, with no shuffle. Features:
lengths, path depth, digit ratio, character entropy, parameter count, hyphens, host labels, and suffix
statistics (the smoothed share of blocked URLs among the labelled ones of the host's last label, its last
two labels and the path's first segment).

The fit reads a bounded sample of the labelled rows: about sample_rows of them, and of the rows of a
repeated URL its share. The suffix statistics count every labelled row and are kept for every suffix, as
tables that are joined to the pages; a suffix without labels has the share among all labelled rows. Every
URL is judged.

Defined results: a null URL, or one without `://`, has an empty host and path, meets no rule and goes to
the trees. No labelled URLs: the trees allow. Only one kind of label: that verdict. Repeated URLs agree.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.llm.common import cut, table

NAME = "op6_url_filters"

# The rules of the query, (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

# Suffix statistics that are broadcast at most, of a kind: some MB.
FEW_RATES = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple) -> Column:
    """The longest rule that fits the host or a domain above it and begins the path, as struct(rule, verdict); else null."""
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # a longer rule stands outside, so it is asked first
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        choice = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    return choice


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a URL by name."""
    url = F.coalesce(url, F.lit(""))
    size = F.length(url)
    share = lambda c: (size - F.length(F.replace(url, c))) / size
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return {
        "length": size.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(size, F.lit(1)),
        "entropy": F.when(size > 0, entropy).otherwise(0.0),
        "parameters": F.regexp_count(url, F.lit("[?&][^=&#]+=")).cast("double"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "marked": F.regexp_count(url, F.lit("[#%@~]")).cast("double"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """What the suffix statistics are kept for: the host's last label and last two, and the path's first segment."""
    return {"suffix1": F.substring_index(host, ".", -1), "suffix2": F.substring_index(host, ".", -2), "segment": F.regexp_extract(path, "^/([^/.]*)", 1)}


def with_rate(rows: DataFrame, name: str, suffix: Column, rates: DataFrame, unseen: float, few: int) -> DataFrame:
    """rows with the column name: the rate of their suffix in rates (suffix, rate), unseen where it has none.

    Up to few rates are broadcast. More are joined in a shuffle, where the suffixes that hold more than
    1 of 500 rows (fewer than 500, whatever the table) are broadcast and their rows dealt to all tasks.
    """
    rows = rows.withColumn("_suffix", suffix)
    if rates.limit(few + 1).count() <= few:
        joined = rows.join(F.broadcast(rates.select(F.col("suffix").alias("_suffix"), F.col("rate").alias("_rate"))), "_suffix", "left")
        return joined.withColumn(name, F.coalesce("_rate", F.lit(unseen))).drop("_suffix", "_rate")
    sizes = rows.groupBy("_suffix").agg(F.count("*").alias("n"))
    hot = [r["_suffix"] for r in sizes.filter(F.col("n") * 500 > rows.count()).collect()]
    is_hot = F.col("_suffix").isin(hot) if hot else F.lit(False)
    of_hot = rates.filter(F.col("suffix").isin(hot) if hot else F.lit(False)).select(F.col("suffix").alias("_suffix"), F.col("rate").alias("_hot_rate"))
    dealt = rows.join(F.broadcast(of_hot), "_suffix", "left").withColumn("_deal", F.when(is_hot, 1 + F.pmod(F.xxhash64("url", *_ids(rows)), F.lit(1 << 20))).otherwise(0))
    others = rates.select(F.col("suffix").alias("_suffix"), F.lit(0).cast("long").alias("_deal"), F.col("rate").alias("_rate"))
    joined = dealt.join(others, ["_suffix", "_deal"], "left")
    return joined.withColumn(name, F.coalesce("_hot_rate", "_rate", F.lit(unseen))).drop("_suffix", "_deal", "_rate", "_hot_rate")


def _ids(rows: DataFrame) -> list[str]:
    return ["page_id"] if "page_id" in rows.columns else []


class BoostedTrees:
    """Trees of (feature, threshold, below, above) or leaf values; margin(features) is their sum as a column."""

    def __init__(self, start: float, trees: list, rates: dict[str, DataFrame], unseen: float = 0.0, few: int = FEW_RATES):
        self.start, self.trees, self.rates, self.unseen, self.few = start, trees, rates, unseen, few

    def with_features(self, rows: DataFrame) -> DataFrame:
        """rows, which have url, host and path, with the lexical features and, for each kind of suffix, its share of blocked URLs."""
        host, path = F.col("host"), F.col("path")
        for name, suffix in suffixes(host, path).items():
            rows = with_rate(rows, name, suffix, self.rates[name], self.unseen, self.few) if name in self.rates else rows.withColumn(name, F.lit(self.unseen))
        return rows.withColumns(lexical(F.col("url"), host, path))

    def margin(self) -> Column:
        """Log odds of `block`, from columns named as the features."""
        return reduce(lambda a, b: a + b, (_as_case(t) for t in self.trees), F.lit(self.start))


def _as_case(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, below, above = tree
    return F.when(F.col(feature) <= threshold, _as_case(below)).otherwise(_as_case(above))


def _grow(tree, splits: dict[int, tuple | float], path: int = 1):
    """The tree with its open leaves split, or closed by a value."""
    if tree is None:
        chosen = splits.get(path, 0.0)
        return chosen if isinstance(chosen, float) else (*chosen, None, None)
    if isinstance(tree, float):
        return tree
    feature, threshold, below, above = tree
    return (feature, threshold, _grow(below, splits, 2 * path), _grow(above, splits, 2 * path + 1))


def _leaf_of(tree, path: int = 1) -> Column:
    """Number of the open leaf (None) that a row falls in; null in leaves that are closed by a value."""
    if isinstance(tree, float):
        return F.lit(None).cast("int")
    if tree is None:
        return F.lit(path)
    feature, threshold, below, above = tree
    return F.when(F.col(feature) <= threshold, _leaf_of(below, 2 * path)).otherwise(_leaf_of(above, 2 * path + 1))


def sampled(labelled: DataFrame, share: float) -> DataFrame:
    """A share of the labelled rows, by hash; a repeated URL gives its share of its rows, not all or none."""
    luck = F.pmod(F.xxhash64("url", "blocked"), F.lit(1 << 20)) / (1 << 20)
    counted = labelled.groupBy("url", "host", "path", "blocked").agg(F.count("*").alias("n"))
    drawn = counted.withColumn("copies", F.floor(F.col("n") * share + luck).cast("int")).filter("copies > 0")
    return drawn.select("url", "host", "path", "blocked", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def fit(labelled: DataFrame, trees: int = 6, depth: int = 3, bins: int = 16, rate: float = 0.4, ridge: float = 1.0, sample_rows: int = 20_000, few_rates: int = FEW_RATES) -> BoostedTrees:
    """Boosted trees for labelled (url, host, path, blocked 0/1), by second-order logistic boosting on binned features."""
    counts = labelled.agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked")).first()
    n, blocked = counts["n"], counts["blocked"] or 0
    base = (blocked + 0.5) / (n + 1)
    if not n:
        return BoostedTrees(-1.0, [], {})
    if blocked in (0, n):
        return BoostedTrees(9.0 if blocked else -9.0, [], {})
    rates = {}
    for name, suffix in suffixes(F.col("host"), F.col("path")).items():
        of_suffix = labelled.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
        rates[name] = cut(of_suffix.select("suffix", ((F.col("b") + 10 * base) / (F.col("n") + 10)).alias("rate")))
    model = BoostedTrees(math.log(base / (1 - base)), [], rates, base, few_rates)
    copies = sampled(labelled, min(1.0, sample_rows / n))
    columns = [*lexical(F.col("url"), F.col("host"), F.col("path")), *rates]
    sample = cut(model.with_features(copies).select("blocked", *columns))
    cuts = sample.agg(*(F.percentile_approx(name, [i / bins for i in range(1, bins)], 1000).alias(name) for name in columns)).first()
    edges = {name: sorted(set(cuts[name] or [])) for name in columns}
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin()))
        rows = sample.withColumn("g", F.round((F.col("blocked") - p) * 1e6).cast("long")).withColumn("h", F.round(p * (1 - p) * 1e6).cast("long"))  # whole numbers: sums do not hang on the order of tasks
        tree = None
        for level in range(depth + 1):
            leaves = rows.withColumn("leaf", _leaf_of(tree)).filter("leaf IS NOT NULL")
            if level < depth:
                tree = _grow(tree, _best_splits(leaves, edges, rate, ridge))
            else:
                sums = leaves.groupBy("leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
                tree = _grow(tree, {r["leaf"]: rate * r["g"] / (r["h"] + ridge * 1e6) for r in sums})
        model.trees.append(tree)
    return model


def _best_splits(leaves: DataFrame, edges: dict[str, list], rate: float, ridge: float) -> dict:
    """For each open leaf the split of most gain, or its value where none gains."""
    bin_of = [F.struct(F.lit(i).alias("f"), reduce(lambda a, b: a + b, ((F.col(name) > e).cast("int") for e in cuts), F.lit(0)).alias("bin")) for i, (name, cuts) in enumerate(edges.items())]
    sums = leaves.select("leaf", "g", "h", F.explode(F.array(*bin_of)).alias("x")).groupBy("leaf", "x.f", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # leaves * features * bins rows
    names, found = list(edges), {}
    for leaf in sorted({r["leaf"] for r in sums}):
        own = [r for r in sums if r["leaf"] == leaf]
        g, h = (sum(r[k] for r in own if r["f"] == 0) / 1e6 for k in ("g", "h"))
        best = (1e-3, rate * g / (h + ridge))
        for f, name in enumerate(names):
            by_bin = {r["bin"]: r for r in own if r["f"] == f}
            left_g = left_h = 0.0
            for at, edge in enumerate(edges[name]):
                if at in by_bin:
                    left_g, left_h = left_g + by_bin[at]["g"] / 1e6, left_h + by_bin[at]["h"] / 1e6
                gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
                if gain > best[0] + 1e-9 and min(left_h, h - left_h) > 0.5:
                    best = (gain, (name, float(edge)))
        found[leaf] = best[1]
    return found


def filter_urls(pages: DataFrame, rules: tuple = RULES, labels: DataFrame | None = None, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, margin) of every page. labels: (url, blocked); by default what the rules decide."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    if labels is None:
        labelled = parsed.filter("hit IS NOT NULL").select("url", "host", "path", (F.col("hit.verdict") == "block").cast("int").alias("blocked"))
    else:
        labelled = labels.filter("url IS NOT NULL AND blocked IS NOT NULL").select("url", host.alias("host"), path.alias("path"), F.col("blocked").cast("int"))
    model = fit(labelled, **options)
    judged = (model.with_features(parsed) if model.trees else parsed).withColumn("margin", model.margin())
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"), "margin")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: by the longest rule, else by trees fitted on the URLs that the rules decide."""
    return filter_urls(table(spark, sf_dir, "pages"))
