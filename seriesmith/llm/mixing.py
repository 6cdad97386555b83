"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's target is its weighted share of all words, at most ``repeats`` times its own
words; the excess is shared anew by weight until no source is above. A source's words lie
in a row, its documents in a permuted order, and that row is repeated: the mix takes
the first ``target`` words of it, so whole passes come first and the rest of the target is
drawn without replacement.

The taken words of all sources are dealt to output shards of equal size by a binary tree
over the shards: at each node the words of each source that go to the left half are drawn
by the multivariate hypergeometric distribution (one exact hypergeometric draw a source,
given those before), so the quotas are exact and distributed as if all words had been
shuffled and cut. A shard's quotas of a source are a stretch of its permuted row, so shards
draw disjoint blocks; a block is a document, which goes whole to the shard in which it
starts. Only a source's last document is cut, at the end of its last word that is taken. A
shard shuffles its documents locally.

Running sums are taken in steps: a source's rows are cut into cells of about ``CELL_ROWS``
rows by hash, cells into chunks, and sums are taken within and over these. A task of the tree
holds the quotas of one node: a number for each source. All draws are seeded by source and
node, so reruns agree, and they are the same distribution at any size.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; rows of size 0 take nothing; repeated rows are told apart by a number given before
planning, and each may be taken; texts of any length are counted whole; an empty table
gives an empty result; other columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from math import ceil, sqrt
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import from_row, in_row, joined, numbered, stage

WEIGHTS = (5, 2, 1)
REPEATS = 3
CELL_ROWS = 2_000
CHUNK_CELLS = 1_000
#: Output shards: at least so many, and more where one would hold more words than this.
LEAST_SHARDS = 256
SHARD_WORDS = 1 << 24
#: Levels of the tree that the first task of it goes through; subtrees below are tasks of their own.
TOP_LEVELS = 5
SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it is."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"([{SPACE}]*[^{SPACE}]+)")), F.lit(1), n.cast("int")), "")


# --- targets -------------------------------------------------------------------------


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size: one row per source) with ``place`` (by code point, null last) and ``target``, by water filling.

    The common level times a source's weight is its target, or its cap if that is less. From
    the level at which no cap counts, the level rises as caps come to count, until no more do.
    """
    ordered = numbered(sizes, [F.col("source").isNull(), F.col("source")], "mix-order")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ready = ordered.withColumn("w", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(repeats))
    ready = stage(ready, "mix-caps")
    level, before = -1.0, -1
    while True:  # each round caps another source or ends
        capped = F.col("cap") < F.lit(level) * F.col("w")
        r = ready.agg(F.sum("source_size").alias("all"), F.count_if(capped).alias("n"), F.sum(F.when(capped, F.col("cap"))).alias("taken"), F.sum(F.when(~capped, F.col("w"))).alias("w")).first()
        if r["n"] == before or not r["w"]:
            break
        level, before = ((r["all"] or 0) - (r["taken"] or 0.0)) / r["w"], r["n"]
    return ready.select("place", "source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


# --- the tree ------------------------------------------------------------------------


def uniform(*parts: object) -> float:
    digest = hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()
    return (int.from_bytes(digest[:7], "little") >> 3) / 2**53


def hypergeometric(u: float, good: int, bad: int, draws: int) -> int:
    """The draw at the quantile u: how many of ``draws`` taken from good + bad are good.

    Weights relative to the mode's come from the exact ratios of neighbours, over all values
    or, where those are many, all within 9 standard deviations, beyond which less is left
    than a double can tell from nothing.
    """
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo >= hi:
        return lo
    n = good + bad
    mode = min(max((draws + 1) * (good + 1) // (n + 2), lo), hi)
    reach = ceil(9 * sqrt(draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1)))) + 12
    lo, hi = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(hi - lo, dtype=np.float64)  # ratio of lo + k + 1 to lo + k
    with np.errstate(divide="ignore"):
        logs = np.log(float(good - lo) - k)
        logs += np.log(float(draws - lo) - k)
        logs -= np.log(k + float(lo + 1))
        logs -= np.log(k + float(bad - draws + lo + 1))
    logs = np.concatenate([[0.0], np.cumsum(logs, out=logs)])
    logs -= logs.max()
    total = np.cumsum(np.exp(logs, out=logs), out=logs)
    return lo + min(int(np.searchsorted(total, u * total[-1], side="right")), hi - lo)


def split(quotas: Sequence[int], part: int, *seed: object) -> list[int]:
    """How many of ``part`` items drawn from all quotas are each source's."""
    out, rest = [], sum(quotas)
    for i, q in enumerate(quotas):
        rest -= q
        x = hypergeometric(uniform(*seed, i), q, rest, part)
        out.append(x)
        part -= x
    return out


def deal(quotas: Sequence[int], lo: int, hi: int, levels: int, seed: int) -> list[tuple[int, int, list[int]]]:
    """Nodes (lo, hi, quotas) of the shards lo to hi after so many levels of the tree, or fewer at single shards."""
    todo, out = [(lo, hi, list(quotas), levels)], []
    while todo:
        a, b, q, left = todo.pop()
        if b - a == 1 or not left:
            out.append((a, b, q))
            continue
        mid = (a + b) // 2
        mine = split(q, sum(q) * (mid - a) // (b - a), seed, a, b)
        todo += [(a, mid, mine, left - 1), (mid, b, [x - y for x, y in zip(q, mine, strict=True)], left - 1)]
    return sorted(out)


def shard_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """sources (place, words) -> place, shard, lo, hi: the stretch of the source's words that a shard takes."""

    def step(levels: int):
        def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("place")
            nodes = deal([int(x) for x in pdf["words"]], int(key[0]), int(key[1]), levels, seed)
            parts = [pd.DataFrame({"a": a, "b": b, "place": pdf["place"].to_numpy(), "words": np.array(q, dtype=np.int64)}) for a, b, q in nodes]
            return pd.concat(parts, ignore_index=True)

        return run

    schema = "a int, b int, place long, words long"
    nodes = sources.select(F.lit(0).alias("a"), F.lit(shards).alias("b"), "place", "words").groupBy("a", "b").applyInPandas(step(TOP_LEVELS), schema)
    if shards > 1 << TOP_LEVELS:
        nodes = nodes.groupBy("a", "b").applyInPandas(step(64), schema)
    before = F.sum("words").over(Window.partitionBy("place").orderBy("a"))
    return nodes.select("place", F.col("a").alias("shard"), (before - F.col("words")).alias("lo"), before.alias("hi")).where("hi > lo")


# --- the plan ------------------------------------------------------------------------


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 0, cell_rows: int = CELL_ROWS, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (n: a number of its own, doc_id, tie, source, size) of a written table -> planned rows, and their copies.

    planned: rows with source_size, target and taken (words, repeats counted); copies: n,
    copy (from 0), words of it, and the shard that gets it.
    """
    counts = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    counts = stage(counts, "mix-sources")
    targets = source_targets(counts.select("source", "source_size"), weights, repeats)
    targets = targets.join(counts.select(F.col("source").alias("s"), F.ceil(F.col("rows") / cell_rows).cast("int").alias("cells")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # A plain key, so that Spark can deal out a large source.
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    targets = stage(targets.withColumn("key", key).withColumn("words", F.round("target").cast("long")), "mix-targets")
    told = joined(rows.withColumn("key", key), targets.drop("source"), ["key"], "inner", targets).drop("key")
    told = told.withColumn("cell", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.col("cells")).cast("int"))
    # One row for every cell_rows rows of a source, and one for every CHUNK_CELLS of those.
    cells = stage(told.groupBy("place", "cell").agg(F.sum("size").alias("own")).withColumn("chunk", F.floor(F.col("cell") / CHUNK_CELLS)), "mix-cells")
    sums = cells.groupBy("place", "chunk").agg(F.sum("own").alias("all"))
    before = sums.select("place", "chunk", (F.sum("all").over(Window.partitionBy("place").orderBy("chunk")) - F.col("all")).alias("before"))
    of_cell = F.sum("own").over(Window.partitionBy("place", "chunk").orderBy("cell")) - F.col("own")
    cells = cells.withColumn("inside", of_cell).join(before, ["place", "chunk"]).select("place", "cell", (F.col("before") + F.col("inside")).alias("start"))
    cells = stage(cells, "mix-starts")
    permuted = Window.partitionBy("place", "cell").orderBy(F.xxhash64("doc_id", "tie", F.lit(seed + 1)), "n")
    inside = F.sum("size").over(permuted) - F.col("size")
    placed = joined(told.withColumn("inside", inside), cells, ["place", "cell"], "inner").withColumn("start", F.col("start") + F.col("inside"))
    # Whole passes, and what the last pass reaches.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - passes * F.col("source_size") - F.col("start")))
    planned = stage(placed.withColumn("taken", passes * F.col("size") + rest).select("n", "doc_id", "source", "size", "source_size", "target", "taken", "place", "start"), "mix-planned")
    if shards is None:
        shards = max(LEAST_SHARDS, ceil((targets.agg(F.sum("words")).first()[0] or 0) / SHARD_WORDS))
    stretches = shard_quotas(targets.select("place", "words"), shards, seed)
    # Stretches meet the rows by buckets of about a stretch's length, so a row meets few of them.
    wide = F.greatest(F.lit(1), F.ceil(F.col("words") / shards)).cast("long")
    width = targets.select("place", wide.alias("width"))
    spread = stretches.join(width, "place")
    spread = spread.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width"))))).drop("width")
    spread = stage(spread, "mix-stretches")
    each = planned.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))))
    each = each.withColumn("at", F.col("copy") * F.col("source_size") + F.col("start"))
    each = joined(each, width, ["place"], "inner", targets).withColumn("bucket", F.floor(F.col("at") / F.col("width")))
    met = joined(each, spread, ["place", "bucket"], "inner").where("lo <= at AND at < hi")
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    return planned, met.select("n", "copy", words.alias("words"), "shard")


def digest(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 0, cell_rows: int = CELL_ROWS, shards: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken, shards (of its copies, comma-joined)."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", F.xxhash64("text").alias("tie"), "source", word_count(text).alias("size"))
    planned, copies = plan(stage(rows, "mix-sizes"), weights, repeats, seed, cell_rows, shards)  # texts are read once
    at = F.array_sort(F.collect_list(F.struct("copy", "shard")))
    of = copies.groupBy("n").agg(F.array_join(F.transform(at, lambda x: x["shard"].cast("string")), ",").alias("shards"))
    return planned.join(of, "n", "left").select("doc_id", "source", "size", "source_size", "target", "taken", F.coalesce("shards", F.lit("")).alias("shards"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 0, cell_rows: int = CELL_ROWS, shards: int | None = None) -> DataFrame:
    """The mixed corpus: docs' columns, a row for each time a document is taken, its text cut where only part is taken.

    Rows are partitioned by shard and lie in their shard's local order, a permutation of its
    documents.
    """
    columns, kinds = docs.columns, docs.schema
    # Numbered once and written, so every row meets its own plan.
    whole = in_row(docs).select(F.monotonically_increasing_id().alias("n"), "row", word_count(F.col("row.text")).alias("size"))
    whole = stage(whole, "mix-rows")
    rows = whole.select("n", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("tie"), F.col("row.source").alias("source"), "size")
    _, copies = plan(rows, weights, repeats, seed, cell_rows, shards)
    each = whole.join(copies, "n").withColumn("order", F.xxhash64("n", "copy", F.lit(seed + 2)))
    each = each.withColumn("cut", F.when(F.col("words") < F.col("size"), first_words(F.col("row.text"), F.col("words"))))
    each = each.repartition("shard").sortWithinPartitions("shard", "order", "n", "copy")
    changed = {"text": F.coalesce("cut", "row.text").cast(kinds["text"].dataType)}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.length("cut")).cast(kinds["n_chars"].dataType)
    return each.select(*[changed[c].alias(c) if c in changed else own for c, own in zip(columns, from_row(columns), strict=True)])
