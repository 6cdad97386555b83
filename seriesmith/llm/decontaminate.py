"""Benchmark decontamination by a broadcast hash set of the items' word windows.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z
lower-cased. An item's windows are its runs of ``width`` consecutive words; an item with
fewer words is one window. The distinct windows are counted, and a benchmark of up to
``MAX_WINDOWS`` of them is one hash set that is broadcast. A larger one is cut into parts by
the windows' hashes; each part is broadcast, scanned for in a pass of its own, written and
destroyed before the next is made, so one part is held at a time, and a document's hits of
all passes are put together. A position is looked at only if its word pair starts some
window, hits of the hash are verified against the words themselves, and hit words are
marked. Hit spans or whole documents can then be removed.

Defined results: a null text has no words; an item that is null or has no words has no
windows; items without an id take no part; repeated items count once; a document hit by a
window that several items hold counts each of them; texts of any length are scanned whole;
empty tables give no hits; other columns are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import from_row, in_row, stage, utf8

WIDTH = 8
#: Windows of a set; they take about 150 MB in each worker.
MAX_WINDOWS = 200_000

# Bytes of words, lower-cased; all others become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SPAN = "array<struct<at:int,n:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Windows:
    """The hash set: windows by the hash of their words, behind a filter on their first two words."""

    def __init__(self, rows: Iterable[tuple[bytes, str]]):
        """rows: a window's words, separated by spaces, and an item that holds it."""
        self.items: dict[tuple[bytes, ...], list[str]] = {}
        words: dict[bytes, bytes] = {}  # one object for each word
        for window, item in rows:
            self.items.setdefault(tuple(words.setdefault(w, w) for w in window.split(b" ")), []).append(item)
        self.vocabulary = set(words)
        self.starts: set[tuple[bytes, bytes] | bytes] = {w[:2] if len(w) > 1 else w[0] for w in self.items}
        self.order = sorted({len(w) for w in self.items})

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Places and lengths of the windows that occur, and their items."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.vocabulary.isdisjoint(words):
            starts, items, order = self.starts, self.items, self.order
            at = [i for i, pair in enumerate(zip(words, words[1:], strict=False)) if pair in starts]
            if 1 in order:
                at = sorted({*at, *(i for i, w in enumerate(words) if w in starts)})
            for i in at:
                for n in order:
                    window = tuple(words[i : i + n])
                    if len(window) < n:
                        break
                    ids = items.get(window)  # the set compares hashes first and then the words
                    if ids:
                        spans.append((i, n))
                        found.update(ids)
        return spans, found


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """window (its words, separated by spaces), id: distinct."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            windows, ids = [], []
            for item, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    windows.append(b" ".join(words[i : i + width]))
                    ids.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(ids, pa.string())], names=["window", "id"])

    items = benchmark.select(F.col("item_id").cast("string").alias("id"), utf8().alias("text")).where("id IS NOT NULL")
    return items.mapInArrow(run, "window binary, id string").distinct()


def hit_words(n: int, spans: Iterable[tuple[int, int]]) -> np.ndarray:
    hit = np.zeros(n, dtype=bool)
    for i, m in spans:
        hit[i : i + m] = True
    return hit


def words_within(text: bytes, keep: np.ndarray) -> str:
    """The text without the words that are not kept, and without what separates two of those."""
    spans, at, end = [], 0, 0
    data = text.translate(WORD_BYTES)
    cut_before = False
    for i, word in enumerate(data.split()):
        start = data.index(word, at)
        at = start + len(word)
        if keep[i]:
            spans.append(text[start if cut_before else end : at])
            cut_before = False
        elif not cut_before:
            spans.append(text[end:start])
            cut_before = True
        end = at
    if not cut_before:
        spans.append(text[end:])
    return b"".join(spans).decode("utf-8", "replace").strip()


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: list[str] | None = None, with_clean: bool = False, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """row (the columns keep, default doc_id), n_words, n_hit, items; with_clean adds ``clean_text``, the text without its hit spans."""
    spark = docs.sparkSession
    windows = stage(windows_of(benchmark, width), "benchmark-windows")
    count = windows.count()
    rows = in_row(docs, ["doc_id"] if keep is None else keep, bytes=utf8())
    added = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType()))]
    schema = StructType([rows.schema["row"], *added, *[StructField("clean_text", StringType())] * with_clean])

    def told(batch, hits):
        """A batch's results from each text's words, spans and items."""
        import pyarrow as pa

        n_words, n_hit, items, clean = [], [], [], []
        for text, (words, spans, found) in zip(batch.column("bytes"), hits, strict=True):
            hit = hit_words(len(words), spans)
            n_words.append(len(words))
            n_hit.append(int(hit.sum()))
            items.append(sorted(set(found)))
            if with_clean:
                clean.append(words_within(text.as_py(), ~hit) if found else None)
        columns = [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(clean, pa.string())] * with_clean], names=["row", "n_words", "n_hit", "items", *["clean_text"] * with_clean])

    def part_of(which: Column | None):
        part = windows if which is None else windows.where(which)
        # At most about max_windows rows.
        return spark.sparkContext.broadcast(Windows((bytes(r["window"]), r["id"]) for r in part.orderBy("window", "id").toLocalIterator()))

    if count <= max_windows:
        shared = part_of(None)

        def run(batches) -> Iterator:
            for b in batches:
                words = [words_of(t) for t in b.column("bytes").to_pylist()]
                yield told(b, [(w, *shared.value.find(w)) for w in words])

        return rows.mapInArrow(run, schema)

    # Parts of half the bound in the mean, so that chance does not take one beyond it.
    parts = ceil(2 * count / max_windows)
    rows = stage(rows.withColumn("n", F.monotonically_increasing_id()), "benchmark-rows")
    passes = None
    for p in range(parts):
        one = part_of(F.pmod(F.xxhash64("window"), F.lit(parts)) == p)
        found = stage(rows.select("n", "bytes").mapInArrow(finder(one), f"n long, spans {SPAN}, items array<string>"), f"benchmark-hits-{p}")
        one.destroy()
        passes = found if passes is None else passes.unionByName(found)
    hits = passes.groupBy("n").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("found"))

    def combine(batches) -> Iterator:
        for b in batches:
            texts, spans, items = (b.column(c).to_pylist() for c in ("bytes", "spans", "found"))
            yield told(b, [(words_of(t), [(x["at"], x["n"]) for x in s or []], i or []) for t, s, i in zip(texts, spans, items, strict=True)])

    return rows.join(hits, "n", "left").select("row", "bytes", "spans", "found").mapInArrow(combine, schema)


def finder(part):
    """A pass over n and bytes: the rows that a part's windows hit."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n, all_spans, items = [], [], []
            for row, text in zip(b.column("n").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                spans, found = part.value.find(words_of(text))
                if found:
                    n.append(row)
                    all_spans.append([{"at": i, "n": m} for i, m in spans])
                    items.append(sorted(found))
            span = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(all_spans, span), pa.array(items, pa.list_(pa.string()))], names=["n", "spans", "items"])

    return run


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_items: int = 2) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs, benchmark, width)
    n_items = F.size("items")
    return found.select(
        "row.doc_id", "n_words", "n_hit", n_items.cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Documents in which a window of some item occurs go; the rest stays as it is."""
    found = scan(docs, benchmark, width, keep=docs.columns)
    return found.where(F.size("items") == 0).select(*from_row(docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every document stays; hit spans leave its text."""
    found = scan(docs, benchmark, width, keep=docs.columns, with_clean=True)
    text = F.coalesce("clean_text", "row.text").alias("text")
    return found.select(*[text if c == "text" else own for c, own in zip(docs.columns, from_row(docs.columns), strict=True)])
