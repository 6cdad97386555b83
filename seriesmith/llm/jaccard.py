"""Exact Jaccard join of word-shingle sets, by signature trees inside exact candidate bundles.

1. Every text becomes its set of word shingles, as 64-bit hashes. Equal sets form a class,
   which takes part once. Shingle frequencies are summed in a sketch of fixed size.
2. Candidates. Sets are cut into R ranges by hash, R growing with the size. Linked sets
   differ in few shingles, so in some range by no more than an R-th of those, and share one
   of that range's first ones in the order (frequency, hash). Rows (shingle, class) of these
   are grouped by shingle. A group is joined by a signature tree over bitmaps of the range,
   so sets that share a passage but are not alike are told apart there; the order by
   frequency keeps common passages out. Pairs that may still be linked join their classes
   into bundles: connected components.
3. In a bundle a signature tree is built: nodes hold the OR of their sets' token bitmaps,
   the AND of them, and the range of set sizes. A dual traversal starts with (root, root)
   and drops node pairs whose largest possible overlap is under what the smallest sizes
   need, and pairs whose sets are all linked with each other already. Pairs of sets that
   remain are compared exactly.

The sketch, and a filter of the shingles that several classes hold, are of fixed size and
only save work; no result depends on what they forget. Their pieces are merged in two steps,
so no task sees those of all tasks. A range of hundreds of hashes that holds under a quarter
of its mean would escape step 2, which is far less likely than a clash of 64-bit hashes.

Large groups are split. A shingle of more than ``HOT_ROWS`` rows, and a bundle of more than
``BUNDLE_ROWS`` classes, is dealt to blocks by hash, with two of its classes in every block.
Blocks are joined by themselves first. Where the classes that are not in the largest
component found so far are left, they are dealt to blocks again, and those meet the other
blocks in pairs; so a large group of copies of one text takes work in proportion to its
rows. Only a group that is large and mostly not alike is quadratic in its blocks. Copies of a
class meet the class's result by broadcast if they are many: there can be no more than
``BROADCAST_ROWS`` classes of over that share of all rows.

Defined results: an empty or null text, or one without words, has an empty set and is linked
with nothing; repeated rows and ids share their class; ties go to the smallest id; a null id
links its text's class but names no component, and a class of null ids alone has a null id;
texts of any length count whole; an empty table gives an empty result; other columns are
carried along whatever their names (``keep_one``) or dropped (``classes``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count
from math import ceil
from typing import Any

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, from_row, in_row, joined, spread_join, stage, utf8
from .hashing import BASE, INVERSE, mix, word_hashes

SKETCH_BITS = 24
SKETCH_PARTS = 64
#: A sketch counter stops here, so the sketch is 16 MB at any size of the data.
MOST = 255
BITMAP_WORDS = 16
#: Bits of the filter of shared shingles (16 MB).
FILTER_BITS = 27
#: Shingles a range holds at least, in the mean, and the 64-bit words of its bitmap.
RANGE = 256
RANGE_WORDS = 8
#: Groups of one shingle up to which all its rows are compared in place; larger ones go through a tree.
GROUP_ROWS = 64
LEAF = 16
FANOUT = 4
#: Rows of one shingle that one task joins.
HOT_ROWS = 1_000
#: Pieces of a sketch or filter are merged within so many groups of tasks, then over these.
MERGES = 256
BUNDLE_ROWS = 1_000
#: Shingles of a bundle that one task may hold.
BUNDLE_SHINGLES = 8_000_000
BLOCK_ROWS = 500


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, min(len(w), k), dtype=np.uint64)
        for i in range(min(k, len(w))):
            h = mix(h * np.uint64(BASE) + w[i : i + n])
    return np.unique(h)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a = int(mix(s).sum(dtype=np.uint64)) ^ len(s)
        b = int(mix(s ^ np.uint64(BASE)).sum(dtype=np.uint64))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    return signed(a), signed(b)


# --- sketch of shingle frequencies ---------------------------------------------------


def pieces(values: np.ndarray) -> list[tuple[int, bytes]]:
    """(part, packed) of an array of bytes."""
    cut = len(values) // SKETCH_PARTS
    return [(p, zlib.compress(values[p * cut : (p + 1) * cut].tobytes(), 1)) for p in range(SKETCH_PARTS)]


def merged(df: DataFrame, width: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """All pieces (part, task, packed) of df as one array of ``width`` bytes."""

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width // SKETCH_PARTS, dtype=np.uint8)
        for x in pdf["packed"]:
            total = add(total, np.frombuffer(zlib.decompress(x), dtype=np.uint8))
        return pd.DataFrame({"part": [key[0]], "packed": [zlib.compress(total.tobytes(), 1)]})

    some = df.groupBy("part", F.pmod("task", F.lit(MERGES)).alias("some")).applyInPandas(run, "part int, packed binary")
    out = np.zeros(width, dtype=np.uint8)
    cut = width // SKETCH_PARTS
    # A fixed number of parts of a fixed size: the array does not grow with the data.
    for r in some.groupBy("part").applyInPandas(run, "part int, packed binary").toLocalIterator():
        out[r["part"] * cut : (r["part"] + 1) * cut] = np.frombuffer(zlib.decompress(r["packed"]), dtype=np.uint8)
    return out


def add_counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x.astype(np.uint16) + y, MOST).astype(np.uint8)


def measure(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """Per row: id, a, b (its set's digest), n (its size); and the sketch, counts by the hash's last bits."""
    width = 1 << SKETCH_BITS

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        names = ["id", "a", "b", "n", "part", "task", "packed"]
        counts = np.zeros(width, dtype=np.uint8)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingles(text, k)
                # A set's shingles are distinct, so an indexed increment counts each; clashes within a set count once.
                at = (s & np.uint64(width - 1)).astype(np.int64)
                counts[at] += counts[at] < MOST
                out.append((doc_id, *set_digest(s), len(s)))
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(out), t) for t in kinds[4:])], names=names)
        if counts.any():
            task = TaskContext.get().partitionId()
            for p, packed in pieces(counts):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds[:4]), *(pa.array([x], t) for x, t in zip((p, task, packed), kinds[4:], strict=True))], names=names)

    both = docs.select(F.col("doc_id").cast("long").alias("id"), utf8().alias("text")).mapInArrow(run, "id long, a long, b long, n long, part int, task int, packed binary")
    both = stage(both, "jaccard-sets")
    rows = both.where("part IS NULL").select("id", "a", "b", "n")
    return rows, merged(both.where("part IS NOT NULL").select("part", "task", "packed"), width, add_counts)


# --- candidate bundles ---------------------------------------------------------------


def levels_of(n: int, t: Fraction) -> list[int]:
    """Logarithms of the numbers of ranges that a set of n shingles is cut into: its own, and that of larger sets it may be linked with."""
    own, up = (max(0, (m // RANGE).bit_length() - 1) for m in (n, int(n / t)))
    return list(range(own, up + 1))


class Prefixes:
    """The rows (token, cls, n, slack, bitmap) of one set."""

    def __init__(self, k: int, t: Fraction, counts: np.ndarray):
        self.k, self.t, self.counts = k, t, counts
        self.mask = np.uint64(len(counts) - 1)
        # Sets of fewer shingles link only with equal ones: no larger set is small enough to hold them, and any other of their size differs too much.
        self.least = next(n for n in range(1, 10**6) if int(n / t) > n)
        self.seen: set[tuple[int, int]] = set()

    def rows(self, text: bytes | None, passes: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, int, int, float, np.ndarray | None]]:
        """(tokens, cls, n, slack, bitmap) for each range; passes: which tokens are wanted, with bitmaps then."""
        s = shingles(text, self.k)
        if len(s) < self.least:
            return
        digest = set_digest(s)
        if digest in self.seen:  # a copy within this task
            return
        if len(self.seen) > 100_000:
            self.seen.clear()
        self.seen.add(digest)
        n, ratio = len(s), (1 - self.t) / (1 + self.t)
        often = self.counts[(s & self.mask).astype(np.int64)]
        s = s[np.lexsort((s, often))]
        spread = mix(s ^ np.uint64(INVERSE))
        for level in levels_of(n, self.t):
            ranges = (spread >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(n, np.int64)
            # A linked set has at most n / t elements, so at most this many of a range's are not in it, in some range.
            most = int(n * (1 - self.t) / self.t / 2**level) + 1
            slack = float(ratio * n / 2**level)
            by = np.argsort(ranges, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(ranges, minlength=2**level))])
            for r in range(2**level):
                mine = by[ends[r] : ends[r + 1]]
                tokens = mix(s[mine[:most]] + np.uint64(level + 1))
                if passes is not None:
                    tokens = tokens[passes(tokens)]
                if len(tokens):
                    bits = None if passes is None else bitmaps([spread[mine]], 64 * RANGE_WORDS)[0]
                    yield tokens.view(np.int64), digest[0], n, slack, bits


def shared_filter(docs: DataFrame, k: int, t: Fraction, sketch: Broadcast, hot_rows: int) -> tuple[np.ndarray, DataFrame]:
    """A bit for each hash of tokens that more than one class holds, in a filter of fixed size; and the hot tokens: token, blocks, and two classes that hold it (lo, hi)."""
    width = 1 << (FILTER_BITS - 3)

    def run(batches):
        import pyarrow as pa

        maker = Prefixes(k, t, sketch.value)
        for batch in batches:
            got = [r for text in batch.column("text").to_pylist() for r in maker.rows(text)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[0] for r in got])), pa.array(np.repeat([r[1] for r in got], [len(r[0]) for r in got]))], names=["token", "cls"])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(width, dtype=np.uint8)
        for b in batches:
            at = b["token"].to_numpy(np.int64).view(np.uint64) & np.uint64(8 * width - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if bits.any():
            task = TaskContext.get().partitionId()
            yield pd.DataFrame(pieces(bits), columns=["part", "packed"]).assign(task=task)[["part", "task", "packed"]]

    tokens = docs.select(utf8().alias("text")).mapInArrow(run, "token long, cls long")
    held = tokens.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    held = stage(held, "jaccard-tokens")
    bits = merged(held.select("token").mapInPandas(fill, "part int, task int, packed binary"), width, np.bitwise_or)
    # No more than BROADCAST_ROWS tokens can hold over that share of all rows.
    least = max(hot_rows, ceil((held.agg(F.sum("n")).first()[0] or 0) / BROADCAST_ROWS))
    hot = stage(held.where(F.col("n") > least).select("token", "lo", "hi", F.ceil(F.col("n") / hot_rows).cast("int").alias("blocks")), "jaccard-hot-tokens")
    return bits, hot


def group_edges(token: np.ndarray, cls: np.ndarray, n: np.ndarray, slack: np.ndarray, words: np.ndarray, t: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes that may be linked, from rows in the order of tokens: enough pairs to join what is connected; known: labels of rows that are connected already."""
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(token)]]))
    found: list[np.ndarray] = []
    small = np.repeat(sizes <= GROUP_ROWS, sizes)
    for lag in range(1, min(GROUP_ROWS, int(sizes.max(initial=1)))):
        i = np.flatnonzero(small[:-lag] & (token[lag:] == token[:-lag]))
        if not len(i):
            break
        j = i + lag
        lost = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
        ok = (lost <= slack[i] + slack[j] + 1e-6) & (np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9) & (cls[i] != cls[j])
        found.append(np.stack([cls[i[ok]], cls[j[ok]]], axis=1))
    for start, size in zip(starts[sizes > GROUP_ROWS], sizes[sizes > GROUP_ROWS], strict=True):
        rows = slice(start, start + size)
        own, first = np.unique(cls[rows], return_index=True)
        at = first + start
        order = np.lexsort((n[at], words[at, 0]))
        tree = SignatureTree(words[at][order], n[at][order], t, slack[at][order])
        union = Union(len(own), None if known is None else known[at])
        traverse(tree, order, union, lambda x, y: True)
        found.append(np.stack([own, own[union.labels()]], axis=1))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


HOT_ROW = ["token", "cls", "n", "slack", "words"]


def edges_of_rows(rows: pd.DataFrame, t: float, known: np.ndarray | None = None) -> pd.DataFrame:
    """rows in the order of token and block."""
    words = np.frombuffer(b"".join(rows["words"]), dtype=np.uint64).reshape(-1, RANGE_WORDS)
    groups = np.cumsum(np.concatenate([[0], (np.diff(rows["token"].to_numpy()) != 0) | (np.diff(rows["block"].to_numpy()) != 0)]))
    a, b = group_edges(groups, *(rows[c].to_numpy() for c in ("cls", "n", "slack")), words, t, known)
    return pd.DataFrame({"a": a, "b": b})


def candidate_labels(docs: DataFrame, k: int, t: Fraction, sketch: Broadcast, hot_rows: int = HOT_ROWS) -> DataFrame:
    """a, root: the classes that may be linked with another, by connected components that hold every link."""
    wanted, hot = shared_filter(docs, k, t, sketch, hot_rows)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    approx = float(t)

    def passes(tokens: np.ndarray) -> np.ndarray:
        bits = shared.value
        at = tokens & np.uint64(8 * len(bits) - 1)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def rich(batches):
        import pyarrow as pa

        maker = Prefixes(k, t, sketch.value)
        for batch in batches:
            got = [r for text in batch.column("text").to_pylist() for r in maker.rows(text, passes)]
            if got:
                times = [len(r[0]) for r in got]
                each = lambda x, kind: pa.array(np.repeat(np.array(x), times), kind)  # noqa: E731, B023
                words = [w for r, m in zip(got, times, strict=True) for w in [r[4].tobytes()] * m]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([r[0] for r in got])), each([r[1] for r in got], pa.int64()), each([r[2] for r in got], pa.int32()), each([r[3] for r in got], pa.float64()), pa.array(words, pa.binary())],
                    names=["token", "cls", "n", "slack", "words"],
                )

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs within each (token, block); rows of hot tokens go on for the pairs between blocks."""
        rest: list[pd.DataFrame] = []

        def told(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            found = edges_of_rows(rows, approx)
            if len(found):
                yield found.assign(**dict.fromkeys(HOT_ROW)).reindex(columns=["a", "b", *HOT_ROW])
            own = rows[rows["own"]]
            if len(own):
                yield own.assign(a=None, b=None).reindex(columns=["a", "b", *HOT_ROW])

        for batch in batches:
            if not len(batch):
                continue
            last = (batch["token"] == batch["token"].iloc[-1]) & (batch["block"] == batch["block"].iloc[-1])
            cut = int(np.argmax(last.to_numpy()))  # the last group may go on
            if cut or (rest and (rest[-1]["token"].iloc[-1], rest[-1]["block"].iloc[-1]) != (batch["token"].iloc[-1], batch["block"].iloc[-1])):
                yield from told(pd.concat([*rest, batch.iloc[:cut]], ignore_index=True))
                rest = []
            rest.append(batch.iloc[cut:])
        if rest:
            yield from told(pd.concat(rest, ignore_index=True))

    rows = docs.select(utf8().alias("text")).mapInArrow(rich, "token long, cls long, n int, slack double, words binary")
    # A hot token's rows are dealt to blocks; two of its classes are in all of them.
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    every = F.when(F.col("cls").isin(F.col("lo"), F.col("hi")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    rows = rows.join(F.broadcast(hot), "token", "left").withColumn("home", F.coalesce(block, F.lit(0)))
    rows = rows.withColumn("block", F.explode(F.coalesce(F.when(F.col("blocks").isNotNull(), every), F.array(F.lit(0)))))
    rows = rows.withColumn("own", F.col("blocks").isNotNull() & (F.col("block") == F.col("home"))).drop("lo", "hi", "blocks", "home")
    out = rows.repartition("token", "block").sortWithinPartitions("token", "block").mapInPandas(edges, "a long, b long, token long, cls long, n int, slack double, words binary")
    out = stage(out, "jaccard-edges")
    first = out.where("a IS NOT NULL").select("a", "b")
    labels = components(first, "jaccard-bundles")
    if not hot.limit(1).count():
        return labels
    # Copies of a class that several tasks saw are one.
    again = out.where("a IS NULL").groupBy("token", "cls").agg(*[F.any_value(c).alias(c) for c in ("n", "slack", "words")]).withColumn("block", F.lit(0))
    return settled(again, labels, "token", "cls", lambda pdf: edges_of_rows(pdf, approx, pdf["root"].to_numpy()), hot_rows, "jaccard-between")


def settled(rows: DataFrame, labels: DataFrame, group: str, node: str, join: Callable[[pd.DataFrame], pd.DataFrame], block_rows: int, name: str) -> DataFrame:
    """labels (a, root) of the components after all pairs of rows of a group are joined, where their labels differ.

    rows: group, node and what join needs; join: rows of a group, with their ``root``, -> a,
    b, enough pairs to join what is linked. A group's largest component so far does not
    meet itself again. Its other rows are dealt to blocks, which meet each other and the
    blocks of the largest in pairs.
    """
    told = rows.join(labels.withColumnRenamed("a", node), node, "left").withColumn("root", F.coalesce("root", node))
    told = stage(told, f"{name}-rows")
    sizes = told.groupBy(group, "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy(group).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("n > most")
    blocks = lambda n: F.ceil(n / block_rows).cast("int")
    sizes = stage(sizes.select(group, "main", blocks(F.col("n") - F.col("most")).alias("rest"), blocks(F.col("most")).alias("mains")), f"{name}-sizes")
    if not sizes.limit(1).count():
        return labels
    placed = told.join(sizes, group).withColumn("in_main", F.col("root") == F.col("main")).withColumn("at", F.pmod(F.xxhash64(node), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rest"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda x, y, kind: F.struct(x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"))
    among = F.transform(upto("rest"), lambda j: pair(F.least("at", j), F.greatest("at", j), "rest"))
    with_main = F.transform(upto("mains"), lambda j: pair(F.col("at"), j, "main"))
    of_main = F.transform(upto("rest"), lambda i: pair(i, F.col("at"), "main"))
    met = placed.withColumn("pair", F.explode(F.when(F.col("in_main"), of_main).otherwise(F.concat(among, with_main))))
    kind = rows.schema[node].dataType.simpleString()
    more = met.drop("main", "rest", "mains", "in_main", "at").groupBy(group, "pair").applyInPandas(lambda pdf: join(pdf.sort_values(node)), f"a {kind}, b {kind}")
    # Links between components join these.
    named = lambda side: labels.toDF(side, f"root_{side}")
    more = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b")
    found = components(more, name).toDF("root", "top")
    known = labels.join(found, "root", "left").select("a", F.coalesce("top", "root").alias("root"))
    fresh = found.select(F.col("root").alias("a"), F.col("top").alias("root")).join(labels, "a", "left_anti")
    return stage(known.unionByName(fresh), f"{name}-labels")


def components(edges: DataFrame, name: str) -> DataFrame:
    """a, root: every node of the edges (a, b) with the smallest node of its component.

    Alternates taking the smallest neighbour's label and jumping to the label's label, until
    nothing changes; each round is written, so lineage stays short. Rounds grow with the
    logarithm of the diameter.
    """
    both = stage(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), f"{name}-edges")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), f"{name}-0")
    for i in count(1):
        near = both.join(labels.toDF("b", "r"), "b").groupBy("a").agg(F.min("r").alias("r"))
        met = labels.join(near, "a").select("a", "root", F.least("root", "r").alias("new"))
        jumped = met.join(labels.toDF("new", "next"), "new").select("a", "root", F.least("new", "next").alias("new"))
        jumped = stage(jumped, f"{name}-{i}")
        if not jumped.where("new <> root").limit(1).count():
            return labels
        labels = jumped.select("a", F.col("new").alias("root"))


# --- the signature tree --------------------------------------------------------------


class Union:
    def __init__(self, n: int, known: np.ndarray | None = None):
        """known: a label for each; those that share one are joined from the start."""
        self.up = np.arange(n)
        if known is not None:
            _, first, same = np.unique(known, return_index=True, return_inverse=True)
            self.up = first[same]

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def labels(self) -> np.ndarray:
        up = self.up
        while True:
            again = up[up]
            if (again == up).all():
                return up.copy()
            up[:] = again


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits), dtype=bool)
    for i, s in enumerate(sets):
        out[i, (s % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


class SignatureTree:
    """Levels of nodes over sets in an order that puts like ones together; level 0 are the sets.

    own: how many elements of a set its bitmap stands for; slack: half of the difference it
    may have with a linked set like itself (None: derived from t and the sizes, which then
    are of the whole sets).
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, t: float, slack: np.ndarray | None = None):
        self.t, self.whole = t, slack is None
        slack = np.zeros(len(sizes)) if slack is None else slack
        self.either, self.all, self.low, self.high, self.slack = [words], [words], [sizes], [sizes], [slack]
        width = LEAF
        while len(self.low[-1]) > 1:
            starts = np.arange(0, len(self.low[-1]), width)
            self.either.append(np.bitwise_or.reduceat(self.either[-1], starts))
            self.all.append(np.bitwise_and.reduceat(self.all[-1], starts))
            self.low.append(np.minimum.reduceat(self.low[-1], starts))
            self.high.append(np.maximum.reduceat(self.high[-1], starts))
            self.slack.append(np.maximum.reduceat(self.slack[-1], starts))
            width = FANOUT

    def fanout(self, level: int) -> int:
        return LEAF if level == 1 else FANOUT

    def children(self, level: int, node: np.ndarray) -> np.ndarray:
        return node[:, None] * self.fanout(level) + np.arange(self.fanout(level))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sets under a node pair can be linked, by sizes and by tokens that one side's sets all have and the other's lack."""
        low, high = self.low[level], self.high[level]
        fits = np.minimum(high[i], high[j]) >= self.t * np.maximum(low[i], low[j]) - 1e-9
        lost_i = np.bitwise_count(self.all[level][i] & ~self.either[level][j]).sum(axis=1, dtype=np.int64)
        lost_j = np.bitwise_count(self.all[level][j] & ~self.either[level][i]).sum(axis=1, dtype=np.int64)
        if not self.whole:
            return fits & (lost_i + lost_j <= self.slack[level][i] + self.slack[level][j] + 1e-6)
        most = np.minimum(high[i] - lost_i, high[j] - lost_j)
        # The overlap is t times the union or more, and the union holds one set and what the other has besides.
        return fits & (most >= np.ceil(self.t * np.maximum(low[i] + lost_j, low[j] + lost_i) - 1e-9))


def linked(x: np.ndarray, y: np.ndarray, t: Fraction) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return t.denominator * both >= t.numerator * (len(x) + len(y) - both)


def order_sets(sets: list[np.ndarray]) -> np.ndarray:
    """By size class, then by the smallest hashes, so that like sets become neighbours."""
    sizes = np.array([len(s) for s in sets])
    first = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64)
    return np.lexsort((sizes, first, (np.log(np.maximum(sizes, 1)) * 4).astype(int)))


def traverse(tree: SignatureTree, order: np.ndarray, union: Union, check: Callable[[int, int], bool]) -> None:
    """Dual traversal: link in union the sets (order[i], order[j]) for which check holds, so far as that joins components."""
    changed = 0
    stack = [(len(tree.low) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]

    def uniform() -> list[np.ndarray]:
        """Per level the label that all sets of a node share, or -1."""
        levels = [union.labels()[order]]
        for k in range(1, len(tree.low)):
            starts = np.arange(0, len(levels[-1]), tree.fanout(k))
            lo, hi = np.minimum.reduceat(levels[-1], starts), np.maximum.reduceat(levels[-1], starts)
            levels.append(np.where(lo == hi, lo, -1))
        return levels

    marks = uniform()
    while stack:
        level, i, j = stack.pop()
        if changed > 256:
            marks, changed = uniform(), 0
        keep = (marks[level][i] != marks[level][j]) | (marks[level][i] < 0)
        i, j = i[keep], j[keep]
        keep = tree.possible(level, i, j)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            for x, y in zip(order[i].tolist(), order[j].tolist(), strict=True):
                if union.find(x) != union.find(y) and check(x, y):
                    union.join(x, y)
                    changed += 1
            continue
        ci, cj = tree.children(level, i), tree.children(level, j)
        x, y = np.repeat(ci, cj.shape[1], axis=1).ravel(), np.tile(cj, (1, ci.shape[1])).ravel()
        ok = (x < len(tree.low[level - 1])) & (y < len(tree.low[level - 1])) & ((x < y) if level == 1 else (x <= y))
        x, y = x[ok], y[ok]
        for start in range(0, len(x), 8192):
            stack.append((level - 1, x[start : start + 8192], y[start : start + 8192]))


def tree_join(sets: list[np.ndarray], t: Fraction, union: Union) -> None:
    """Link in union the sets whose Jaccard similarity is t or more, so far as that joins components."""
    if len(sets) < 2:
        return
    order = order_sets(sets)
    tree = SignatureTree(bitmaps([sets[i] for i in order], 64 * BITMAP_WORDS), np.array([len(sets[i]) for i in order]), float(t))
    for x, y in zip(order, order[1:], strict=False):  # neighbours first: most links of a large group of copies are found here
        if union.find(x) != union.find(y) and linked(sets[x], sets[y], t):
            union.join(x, y)
    traverse(tree, order, union, lambda x, y: linked(sets[x], sets[y], t))


# --- the join ------------------------------------------------------------------------


MEMBER = "a long, b long, cid long, shingles binary"


def unpack(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in pdf["shingles"]]


def bundle_links(members: DataFrame, t: Fraction) -> DataFrame:
    """members (bundle, a, b, cid, shingles) -> a, b, root: the smallest cid linked with the class."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cid", "a", "b"]).drop_duplicates(["a", "b"])
        union = Union(len(pdf))
        tree_join(unpack(pdf), t, union)
        ids = pdf["cid"].to_numpy()
        return pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "root": ids[union.labels()]})

    return members.groupBy("bundle").applyInPandas(run, "a long, b long, root long")


def large_bundle_links(members: DataFrame, t: Fraction, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As bundle_links, for bundles too large for one task, from written members."""
    nodes = members.withColumn("node", F.concat_ws(":", "a", "b"))
    sizes = nodes.groupBy("bundle").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.min("node").alias("lo"), F.max("node").alias("hi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").drop_duplicates("node")
        union = Union(len(pdf), pdf["root"].to_numpy() if "root" in pdf else None)
        tree_join(unpack(pdf), t, union)
        names = pdf["node"].to_numpy()
        roots = names[union.labels()]
        return pd.DataFrame({"a": names[roots != names], "b": roots[roots != names]})

    slim = nodes.select("bundle", "node", "shingles")
    # Two of a bundle's classes are in all of its blocks.
    every = F.when(F.col("node").isin(F.col("lo"), F.col("hi")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    dealt = slim.join(sizes, "bundle").withColumn("block", F.explode(every)).select("bundle", "block", "node", "shingles")
    labels = components(dealt.groupBy("bundle", "block").applyInPandas(run, "a string, b string"), "jaccard-large")
    labels = settled(slim, labels, "bundle", "node", run, block_rows, "jaccard-large-between")
    grouped = nodes.select("node", "a", "b", "cid").join(labels.toDF("node", "group"), "node")
    return grouped.join(grouped.groupBy("group").agg(F.min("cid").alias("root")), "group").select("a", "b", "root")


def join_classes(
    docs: DataFrame, k: int, t: Fraction, bundle_rows: int = BUNDLE_ROWS, bundle_shingles: int = BUNDLE_SHINGLES, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """rows (id, a, b, n) of docs, and links (a, b, root) of the classes linked with one of a smaller id."""
    rows, sketch = measure(docs, k)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    bundles = candidate_labels(docs, k, t, shared, hot_rows)
    # Classes in bundles, each with the row it is read from; halves of digests that clash only share a bundle.
    named = rows.where("n > 0 AND id IS NOT NULL").groupBy("a", "b").agg(F.min("id").alias("cid"), F.max("n").alias("n"))
    held = stage(named.join(bundles.select("a", F.col("root").alias("bundle")), "a"), "jaccard-held")
    sizes = held.groupBy("bundle").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    large = stage(sizes.where((F.col("members") > bundle_rows) | (F.col("n") > bundle_shingles)).select("bundle"), "jaccard-large-bundles")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = [shingles(x, k) for x in batch["text"]]
            mine = np.array([set_digest(x) == (p, q) for x, p, q in zip(s, batch["a"], batch["b"], strict=True)], dtype=bool)
            yield batch[["bundle", "a", "b", "cid"]].assign(shingles=[x.tobytes() for x in s])[mine]

    texts = docs.select(F.col("doc_id").cast("long").alias("cid"), utf8().alias("text"))
    members = joined(texts, held, ["cid"], "inner").select("bundle", "a", "b", "cid", "text").mapInPandas(sets_of, f"bundle long, {MEMBER}")
    if large.limit(1).count():
        members = stage(members, "jaccard-members")
        links = bundle_links(members.join(large, "bundle", "left_anti"), t).unionByName(large_bundle_links(members.join(large, "bundle", "left_semi"), t, block_rows))
    else:
        links = bundle_links(members, t)
    return rows, links


def classes(docs: DataFrame, k: int = 3, percent: int = 90, bundle_rows: int = BUNDLE_ROWS, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    rows, links = join_classes(docs, k, Fraction(percent, 100), bundle_rows, hot_rows=hot_rows, block_rows=block_rows)
    # One row per class with its component, which the copies of the class meet.
    least = rows.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("own"))
    found = stage(least.join(links, ["a", "b"], "left").select("a", "b", F.coalesce("root", "own").alias("component")), "jaccard-components")
    empty = rows.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    full = spread_join(rows.where("n > 0"), found, ["a", "b"], "jaccard-copies").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return full.unionByName(empty)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the ids that are not the smallest of their component; of repeated rows of an id one stays, of null ids all."""
    columns = docs.columns
    whole = F.max(F.col("doc_id") == F.col("component_id"))
    found = classes(docs, k, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(whole.alias("first"), F.count("*").alias("n"))
    found = stage(found.where("NOT first OR n > 1"), "jaccard-found")
    rows = in_row(docs, doc_id=F.col("doc_id"))
    kept = joined(rows, found.where("NOT first").select("doc_id"), ["doc_id"], "left_anti")
    repeated = found.where("first").select("doc_id")
    if repeated.limit(1).count():
        # Of rows that repeat an id the first in the order of their columns stays; partial results go ahead of the shuffle.
        again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("row").alias("row")).select("row", "doc_id")
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(again)
    return kept.select(*from_row(columns))
