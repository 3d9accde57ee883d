"""Exact top-k inner-product search: a ball tree per shard, branch and bound, thresholds shared.

Rows are dealt by locality: each goes to the nearest of a bounded number of pivots, so a cell is a ball with
the pivot as centre and a radius; cells of more than a shard's rows are cut by hash. Each shard's task builds
a ball tree over its vectors and answers blocks of queries. A node's bound is query . centre + |query| *
radius; children are visited with the larger bound first, and a node whose bound is below a query's current
kth score is passed over for that query.

A first round searches each query's own cell, that of the largest query . pivot. The kth score found there
is the query's floor in the second round, which meets only the cells whose bound reaches it: other cells
never see the query. Ties at the kth score are kept and go to the smaller id, so the result is that of a
full scan; how many cells are passed over depends on the vectors, the result does not.

Defined results: components become floor(scale * x); vectors null, empty, or holding null or non-finite
components take no part, neither do null ids. Vectors are compared with those of their own length only.
Integer products must stay below 2**53 to be exact. Fewer than k candidates: all of them. Repeated
vectors tie and go by id; rows with the same id are separate candidates and ask once, with the least of their vectors; a query's
own id is no candidate. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.llm.common import cut, table

NAME = "op7_exact_topk"


class BallTree:
    """Balls around halves of the rows, split at the median along the widest spread."""

    def __init__(self, rows: np.ndarray, leaf: int = 64):
        self.rows = rows
        self.order = np.arange(len(rows))
        self.nodes: list[tuple[int, int, int, int]] = []  # first, last, left child, right child
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._grow(0, len(rows), leaf)
        self.rows = rows[self.order]

    def _grow(self, lo: int, hi: int, leaf: int) -> int:
        own = self.rows[self.order[lo:hi]]
        centre = own.mean(0)
        at = len(self.nodes)
        self.nodes.append((lo, hi, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((own - centre) ** 2).sum(1).max())))
        if hi - lo > leaf and self.radii[at] > 0:
            # two far points as poles; rows go to the half nearer to the one or the other, evenly
            far = own[np.argmax(((own - centre) ** 2).sum(1))]
            other = own[np.argmax(((own - far) ** 2).sum(1))]
            half = (hi - lo) // 2
            split = np.argpartition(own @ (far - other), half)
            self.order[lo:hi] = self.order[lo:hi][split]
            self.nodes[at] = (lo, hi, self._grow(lo, lo + half, leaf), self._grow(lo + half, hi, leaf))
        return at

    def search(self, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best k scores and ids per query (score -inf where there are fewer); floor: kth scores known from elsewhere."""
        ids = ids[self.order]
        best = np.full((len(queries), k), -np.inf)
        names = np.full((len(queries), k), np.iinfo(np.int64).max)
        kth = floor.copy()
        norms = np.sqrt((queries**2).sum(1))
        centres, radii = np.array(self.centres), np.array(self.radii)
        slack = 1e-9 * (1 + norms * (np.sqrt((centres**2).sum(1)).max() + radii.max()))
        bounds = queries @ centres.T + norms[:, None] * radii + slack[:, None]

        def visit(node: int, active: np.ndarray) -> None:
            active = active[bounds[active, node] >= kth[active]]
            if not len(active):
                return
            lo, hi, left, right = self.nodes[node]
            if left < 0:
                scores = np.rint(queries[active] @ self.rows[lo:hi].T)
                scores[query_ids[active][:, None] == ids[lo:hi][None, :]] = -np.inf
                scores = np.concatenate((best[active], scores), axis=1)
                owners = np.concatenate((names[active], np.broadcast_to(ids[lo:hi], (len(active), hi - lo))), axis=1)
                top = np.lexsort((owners, -scores), axis=1)[:, :k]
                best[active], names[active] = np.take_along_axis(scores, top, 1), np.take_along_axis(owners, top, 1)
                kth[active] = np.maximum(kth[active], best[active, -1])
                return
            to_left = bounds[active, left] >= bounds[active, right]
            visit(left, active[to_left])
            visit(right, active)
            visit(left, active[~to_left])

        visit(0, np.arange(len(queries)))
        return best, names


def _usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, vec): integer-valued components of the vectors that take part."""
    column = F.col("vec")
    sound = F.col("id").isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select("id", F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vec"))


RESULT = "query_id long, vec_id long, score double"


def _search(shards: DataFrame, queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Each query's best k in each shard of the cells it is sent to. blocks: (dim, cell, subs, blocks); a shard meets a cell's queries a block at a time."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows, asked = np.stack(left["vec"].to_list()), np.stack(right["vec"].to_list())
        query_ids = right["query_id"].to_numpy()
        scores, names = BallTree(rows).search(asked, query_ids, left["id"].to_numpy(), k, right["floor"].to_numpy())
        i, j = np.nonzero(np.isfinite(scores) & (scores >= right["floor"].to_numpy()[:, None]))
        return pd.DataFrame({"query_id": query_ids[i], "vec_id": names[i, j], "score": scores[i, j]})

    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n))
    plan = F.broadcast(blocks)  # a row per cell
    dealt = shards.join(plan, ["dim", "cell"]).select("dim", "cell", deal("subs", 1).alias("sub"), each("blocks").alias("block"), "id", "vec")
    sent = queries.join(plan, ["dim", "cell"]).select("dim", "cell", each("subs").alias("sub"), deal("blocks", 2).alias("block"), F.col("id").alias("query_id"), "vec", "floor")
    asked = sent.toDF("dim2", "cell2", "sub2", "block2", "query_id", "vec", "floor")
    return dealt.groupBy("dim", "cell", "sub", "block").cogroup(asked.groupBy("dim2", "cell2", "sub2", "block2")).applyInPandas(run, RESULT)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _pivots(usable: DataFrame, sizes: dict[int, int], shard_rows: int, most_pivots: int) -> dict[int, np.ndarray]:
    """For each vector length so many of its vectors as there are shards of it, most_pivots at most; drawn by hash of id."""
    wanted = {d: min(most_pivots, max(1, -(-n // shard_rows))) for d, n in sizes.items()}
    share = F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, (2 * wanted[d] + 20) / n))))[F.size("vec")]
    luck = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    drawn = usable.filter(luck < F.ceil(share * (1 << 30))).select("vec", luck.alias("luck")).distinct().collect()  # some thousand vectors a length
    found: dict[int, list] = {}
    for row in sorted(drawn, key=lambda r: (r["luck"], r["vec"])):
        own = found.setdefault(len(row["vec"]), [])
        if len(own) < wanted[len(row["vec"])] and row["vec"] not in own:
            own.append(row["vec"])
    return {d: np.array(found[d]) if d in found else np.zeros((1, d)) for d in sizes}


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, shard_rows: int = 4096, query_block: int = 2048, most_pivots: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors (id, vec); is_query is a condition on id.

    Each group of vectors and queries that meets is of bounded size: a shard and a block of queries.
    """
    spark = vectors.sparkSession
    usable = cut(_usable(vectors, scale))
    sizes = {r["dim"]: r["n"] for r in usable.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row per vector length
    if not sizes:
        return usable.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    pivots = spark.sparkContext.broadcast(_pivots(usable, sizes, shard_rows, most_pivots))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dim, own in rows.groupby(rows["vec"].map(len)):
                x, p = np.stack(own["vec"].to_list()), pivots.value[dim]
                cell = np.argmax(x @ p.T - (p * p).sum(1) / 2, axis=1)
                yield pd.DataFrame({"dim": dim, "cell": cell, "far": np.sqrt(((x - p[cell]) ** 2).sum(1)), "id": own["id"].to_numpy(), "vec": own["vec"].to_list()})

    assigned = cut(usable.mapInPandas(assign, "dim int, cell int, far double, id long, vec array<double>"))
    cells = assigned.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # most_pivots a vector length at most
    held = {(r["dim"], r["cell"]): (r["n"], r["radius"]) for r in cells}
    radii = {d: np.array([held.get((d, c), (0, -np.inf))[1] for c in range(len(p))]) for d, p in pivots.value.items()}  # an empty cell is never reached
    asked = cut(usable.filter(is_query).groupBy("id").agg(F.min("vec").alias("vec")))  # one question an id

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """To its own cell a query without a floor column, to every other cell in reach one with it."""
        for rows in batches:
            second = "floor" in rows
            for dim, own in rows.groupby(rows["vec"].map(len)):
                x, p, radius = np.stack(own["vec"].to_list()), pivots.value[dim], radii[dim]
                inner = np.where(np.isfinite(radius), x @ p.T, -np.inf)
                home = np.argmax(inner, axis=1)
                if second:
                    floor = own["floor"].to_numpy()
                    norms = np.sqrt((x * x).sum(1))
                    bound = inner + norms[:, None] * np.maximum(radius, 0)
                    bound += 1e-9 * (1 + norms[:, None] * (np.sqrt((p * p).sum(1)) + np.maximum(radius, 0)))
                    open_ = (bound >= floor[:, None]) & np.isfinite(inner)
                    open_[np.arange(len(x)), home] = False
                    i, cell = np.nonzero(open_)
                else:
                    i, cell, floor = np.arange(len(x)), home, np.full(len(x), -np.inf)
                ids, vecs = own["id"].to_numpy(), own["vec"].to_list()
                for lo in range(0, len(i), 10_000):
                    at = i[lo : lo + 10_000]
                    yield pd.DataFrame({"dim": dim, "cell": cell[lo : lo + 10_000], "id": ids[at], "vec": [vecs[a] for a in at], "floor": floor[at]})

    def searched(queries: DataFrame) -> DataFrame:
        sent = cut(queries.mapInPandas(send, "dim int, cell int, id long, vec array<double>, floor double"))
        counts = sent.groupBy("dim", "cell").agg(F.count("*").alias("q")).collect()
        plan = [(r["dim"], r["cell"], -(-held[r["dim"], r["cell"]][0] // shard_rows), -(-r["q"] // query_block)) for r in counts]
        return _search(assigned, sent, spark.createDataFrame(plan, "dim int, cell int, subs long, blocks long"), k)

    first = cut(_best(searched(asked), k))
    floors = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    rest = searched(asked.join(floors, "id", "left").select("id", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))
    return _best(first.select("query_id", "vec_id", "score").unionByName(rest), k).select("query_id", F.col("rank").cast("int"), "vec_id", F.col("score").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest by integer inner product to every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return top_k(vectors, F.col("id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""
