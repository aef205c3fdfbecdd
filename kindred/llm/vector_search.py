"""Exact top-k inner-product search with one KD-tree per shard.

Vectors are dealt to shards by hash. A shard's tree has median splits on the widest
dimension and tight bounding boxes; queries walk it best box first, by the upper bound
of the inner product with a box, and stop at the kth score. Each query first searches its
own shard; that kth score goes with it to the other shards as their starting bound, so
most boxes fall at once. Queries come in blocks, so no task holds more than one shard and
one block.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged


#: A kth score that is not known yet.
NONE = -(2**63)


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    scale: int = 1024
    shard_rows: int = 8192
    block_queries: int = 4096
    leaf: int = 64


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as long; vectors null, empty or with a null or non-finite component go.

    A component that is no long any more raises: cut off it would change the order of results.
    """
    whole = lambda e: F.floor(e.cast("double") * F.lit(float(scale)))
    finite = lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf")))
    far = lambda e: finite(e) & (F.abs(e.cast("double")) * F.lit(float(scale)) >= F.lit(2.0**63))
    x = F.transform("embedding", lambda e: F.when(far(e), F.raise_error(F.concat(F.lit("a component does not fit a long: "), e.cast("string"))).cast("long")).when(finite(e), whole(e).cast("long")))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return vectors.filter(ok & F.forall("embedding", finite)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


class Tree:
    """KD-tree over integer vectors; boxes are tight."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.lo, self.hi, self.kids, self.rows = [], [], [], []
        self._build(np.arange(len(ids)), leaf)

    def _build(self, first: np.ndarray, leaf: int) -> None:
        todo = [(first, -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.lo)
            part = self.x[rows]
            lo, hi = part.min(0), part.max(0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([-1, -1])
            self.rows.append(None)
            if parent >= 0:
                self.kids[parent][side] = node
            dim = int((hi - lo).argmax())
            if len(rows) <= leaf or lo[dim] == hi[dim]:  # equal vectors are not split
                self.rows[node] = np.sort(rows)
                continue
            near = np.argpartition(part[:, dim], len(rows) // 2)
            todo.append((rows[near[: len(rows) // 2]], node, 0))
            todo.append((rows[near[len(rows) // 2 :]], node, 1))

    def arrays(self):
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        return self

    def search(self, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple]:
        """The k best (score, vec_id), ties to the smaller id; only scores >= floor can matter."""
        # upper bounds of all boxes at once; the traversal pops them best first
        bound = np.maximum(q * self.lo, q * self.hi).sum(1)
        best: list[tuple] = []  # heap of (score, -id)
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            kth = max(floor, best[0][0]) if len(best) == k else floor
            if -b < kth:
                break
            rows = self.rows[node]
            if rows is None:
                for c in self.kids[node]:
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            s = self.x[rows] @ q
            ids = self.ids[rows]
            good = np.flatnonzero((s >= kth) & (ids != own))
            if good.size > k:  # ids ascend, so a stable order by score settles ties
                good = good[np.argsort(-s[good], kind="stable")[:k]]
            for i in good:
                item = (s[i], -ids[i])
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(i, -j) for i, j in best]


def _searcher(params: SearchParams):
    def run(key, left, right):
        import pandas as pd

        cols = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})
        dim = int(left["dim"].iloc[0])
        x, q = (np.stack(f["v"].to_numpy()).astype(np.int64) for f in (left, right))
        top = int(max(abs(int(x.min())), abs(int(x.max())))) * int(max(abs(int(q.min())), abs(int(q.max())))) * dim
        kind = np.float64 if top < 2**53 else object if top >= 2**63 else np.int64  # object: whole numbers of any size
        tree = Tree(left["vec_id"].to_numpy(), x.astype(kind), params.leaf).arrays()
        q, out = q.astype(kind), []
        floors = right["floor"].to_numpy()
        for i, own in enumerate(right["vec_id"].to_numpy()):
            floor = int(floors[i]) if floors[i] > NONE else -float("inf")
            for s, v in tree.search(q[i], own, params.k, floor):
                if not -(2**63) <= int(s) < 2**63:
                    raise OverflowError(f"the score of vectors {own} and {int(v)} does not fit a long")
                out.append((own, int(v), int(s)))
        return pd.DataFrame(out, columns=cols) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best other vectors; all, if there are fewer.

    Vectors of another length than the query's do not take part. Rows repeating a vec_id with
    the same vector count once. Empty tables give no rows; other columns take no part. A component or a
    score among the best that does not fit a long raises.
    """
    rows = staged(usable(vectors, params.scale).dropDuplicates(["vec_id", "v"]), "vectors")
    asked = usable(queries, params.scale).dropDuplicates(["vec_id", "v"])
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).withColumn("shards", F.ceil(F.col("n") / params.shard_rows).cast("int"))
    q_sizes = asked.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("nq")).withColumn("blocks", F.ceil(F.col("nq") / params.block_queries).cast("int"))
    both = {r["dim"]: (r["shards"], r["blocks"]) for r in sizes.join(q_sizes, "dim").collect()}  # a row per vector length
    if not both:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pick = lambda i: F.create_map(*[x for d, v in both.items() for x in (F.lit(d), F.lit(v[i]))])
    dim = F.size("v")
    held = lambda df: df.withColumn("dim", dim).filter(F.col("dim").isin(list(both)))
    part = lambda c, n: F.pmod(F.xxhash64("vec_id"), n.cast("long")).cast("int")
    rows = held(rows).withColumn("shard", part("vec_id", pick(0)[F.col("dim")]))
    asked = held(asked).withColumn("home", part("vec_id", pick(0)[F.col("dim")])).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), pick(1)[F.col("dim")].cast("long")).cast("int"))
    schema, keys = "query_id long, vec_id long, score long", ["dim", "shard", "block"]
    blocks = F.explode(F.sequence(F.lit(0), pick(1)[F.col("dim")] - 1))
    dealt = rows.withColumn("block", blocks)
    home = asked.withColumn("shard", F.col("home")).withColumn("floor", F.lit(NONE))
    run = _searcher(params)
    first = staged(dealt.groupBy(*keys).cogroup(home.groupBy(*keys)).applyInPandas(run, schema), "home")
    kth = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= params.k).select(F.col("query_id").alias("vec_id"), F.col("low").alias("floor"))
    away = asked.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE))).withColumn("shard", F.explode(F.sequence(F.lit(0), pick(0)[F.col("dim")] - 1))).filter("shard <> home")
    second = dealt.groupBy(*keys).cogroup(away.groupBy(*keys)).applyInPandas(run, schema)
    return _best(first.unionByName(second), params.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
