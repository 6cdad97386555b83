"""Exact top-k search by integer inner product: a ball tree per shard, branch and bound.

Vectors are quantised to integers and packed into shards of bounded size; each shard holds
a ball tree. A query visits a shard's nodes in the order of their upper bound
``q.centre + |q| * radius`` and stops where the bound falls under its current k-th score.
The k-th score is shared: a first pass over one shard per query block gives every query a
floor, and within a task the floor rises from shard to shard. Query blocks and shards are
both of fixed size, so no task holds more than one block and one shard.

Defined results: vectors that are null, empty, or hold a null or non-finite component take
no part, neither as queries nor as candidates; rows without an id take no part; vectors
of different length are never compared; ties go to the smaller id; of rows that repeat an
id every one is a candidate, the one with the smallest vector is the query, and a query
skips all rows of its own id; with fewer than k candidates all are returned; components and
scores beyond 64 bits count as the least or greatest number of 64 bits; an empty table
gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

SHARD_ROWS = 4096
BLOCK_ROWS = 512
LEAF_ROWS = 64
SCALE = 256
#: Floors a task remembers; a forgotten one starts again at the first pass's.
KEPT_FLOORS = 1024


def quantised(vector: str, scale: int = SCALE) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: str) -> Column:
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def build_tree(x: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Order of the rows, then per node its span, centre and radius; children of node k are 2k+1 and 2k+2."""
    order = np.arange(len(x))
    depth = 0
    while len(x) > leaf << depth:
        depth += 1
    spans: list[tuple[int, int]] = [(0, len(x))]
    for k in range(2**depth - 1):
        lo, hi = spans[k]
        part = x[order[lo:hi]]
        mid = (hi - lo) // 2
        if hi - lo > 1:
            centre = part.mean(axis=0)
            far = part[np.argmax(((part - centre) ** 2).sum(axis=1))]
            other = part[np.argmax(((part - far) ** 2).sum(axis=1))]
            order[lo:hi] = order[lo:hi][np.argsort(part @ (far - other), kind="stable")]
        spans += [(lo, lo + mid), (lo + mid, hi)]
    centres = np.zeros((len(spans), x.shape[1]))
    radius = np.zeros(len(spans))
    for k, (lo, hi) in enumerate(spans):
        if hi > lo:
            part = x[order[lo:hi]]
            centres[k] = part.mean(axis=0)
            radius[k] = np.sqrt(((part - centres[k]) ** 2).sum(axis=1).max())
    return order, spans, centres, radius


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles where they can't round, else through Python integers, up to the ends of 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, LOW, HIGH).astype(np.int64)


class Shard:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order, self.spans, self.centres, self.radius = build_tree(x.astype(np.float64))
        self.ids, self.x = ids[order], x[order]

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's k best here that reach its floor; floor rises in place."""
        qf = q.astype(np.float64)
        norm = np.sqrt((qf**2).sum(axis=1))
        bound = qf @ self.centres.T + norm[:, None] * self.radius
        bound += 1e-9 * np.abs(bound) + 1  # rounding never prunes a hit
        first = len(self.spans) // 2
        leaves = np.arange(first, len(self.spans))
        best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
        alive = np.ones((len(q_ids), len(self.spans)), dtype=bool)
        seen = np.zeros_like(alive)
        for _ in leaves:
            # Prune from the root down with the floors as they are now, then open each query's best leaf.
            alive &= bound >= floor[:, None]
            for node in range(first):
                alive[:, 2 * node + 1] &= alive[:, node]
                alive[:, 2 * node + 2] &= alive[:, node]
            open_ = alive[:, leaves] & ~seen[:, leaves]
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                break
            pick = np.where(open_[rows], bound[rows][:, leaves], -np.inf).argmax(axis=1) + first
            for leaf in np.unique(pick):
                mine = rows[pick == leaf]
                seen[mine, leaf] = True
                lo, hi = self.spans[leaf]
                got, ids = products(q[mine], self.x[lo:hi]), self.ids[lo:hi]
                for r, scores in zip(mine, got, strict=True):
                    ok = np.flatnonzero((scores >= floor[r]) & (ids != q_ids[r]))
                    if len(ok):
                        kept = sorted(best[r] + [(-int(scores[i]), int(ids[i])) for i in ok])[:k]
                        best[r] = kept
                        if len(kept) == k:
                            floor[r] = max(floor[r], -kept[-1][0])
        out = [(r, i, -s) for r, kept in enumerate(best) for s, i in kept]
        a = np.array(out, dtype=np.int64).reshape(len(out), 3)
        return a[:, 0], a[:, 1], a[:, 2]


def pack(pdf: pd.DataFrame) -> tuple[bytes, bytes]:
    pdf = pdf.sort_values("id", kind="stable")
    return pdf["id"].to_numpy(np.int64).tobytes(), np.array(pdf["v"].tolist(), dtype=np.int64).tobytes()


def unpack(ids: bytes, v: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(v, np.int64).reshape(-1, dim)


def packed(rows: DataFrame, group: str) -> DataFrame:
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = pack(pdf)
        return pd.DataFrame({"dim": [key[0]], group: [key[1]], "ids": [ids], "v": [v]})

    return rows.groupBy("dim", group).applyInPandas(run, f"dim int, {group} int, ids binary, v binary")


def search_blocks(pairs: DataFrame, k: int, floors_too: bool) -> DataFrame:
    """pairs: rows (block, floors, shard); gives query_id, vec_id, score, and for the first pass only floors count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard_key, shard, floors = None, None, OrderedDict()
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.dim, r.shard) != shard_key:
                    shard_key, shard = (r.dim, r.shard), Shard(*unpack(r.ids, r.v, r.dim))
                q_ids, q = unpack(r.q_ids, r.q, r.dim)
                # A task goes through its shards one by one; a block's floor rises from shard to shard.
                floor = floors.pop((r.dim, r.block), None)
                if floor is None:
                    floor = np.full(len(q_ids), LOW) if r.floors is None else np.frombuffer(r.floors, np.int64).copy()
                floors[r.dim, r.block] = floor
                if len(floors) > KEPT_FLOORS:
                    floors.popitem(last=False)
                at, ids, scores = shard.search(q_ids, q, floor, k)
                if floors_too:
                    yield pd.DataFrame({"query_id": q_ids[at], "vec_id": ids, "score": scores})
                else:
                    yield pd.DataFrame({"dim": [r.dim], "block": [r.block], "floors": [floor.tobytes()]})

    return pairs.mapInPandas(run, "query_id long, vec_id long, score long" if floors_too else "dim int, block int, floors binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds its k best other rows by integer inner product."""
    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("__v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable("__v"))
    rows = chosen.select("id", F.coalesce("q", F.lit(False)).alias("q"), F.size("__v").alias("dim"), quantised("__v", scale).alias("v"))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("nq"))
    # One row per vector length; the number of shards and blocks follows the counts.
    sizes = counts.select("dim", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("n_shards"), F.ceil(F.col("nq") / BLOCK_ROWS).cast("int").alias("n_blocks"))
    sizes = stage(sizes, "topk-sizes")
    placed = rows.join(sizes, "dim")
    shards = stage(
        packed(placed.select("dim", F.pmod(F.xxhash64("id"), F.col("n_shards")).cast("int").alias("shard"), "id", "v"), "shard"), "topk-shards"
    )
    asked = placed.where("q").groupBy("id").agg(F.min(F.struct("dim", "n_blocks", "v")).alias("m")).select("id", "m.*")
    blocks = packed(asked.select("dim", F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_blocks")).cast("int").alias("block"), "id", "v"), "block")
    blocks = stage(blocks.withColumnsRenamed({"ids": "q_ids", "v": "q"}), "topk-blocks").join(sizes.select("dim", "n_shards"), "dim")
    none = F.lit(None).cast("binary")
    seeds = blocks.withColumn("floors", none).withColumn("shard", F.pmod("block", "n_shards").cast("int"))
    floors = stage(search_blocks(seeds.drop("n_shards").join(shards, ["dim", "shard"]), k, False), "topk-floors")
    lanes = blocks.join(floors, ["dim", "block"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1))).drop("n_shards")
    pairs = lanes.join(shards, ["dim", "shard"]).sortWithinPartitions("dim", "shard", "block")
    found = search_blocks(pairs, k, True)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
