"""Token ids in compressed binary files with one shared zstandard dictionary.

Texts become id arrays (little-endian unsigned 32-bit) with an end id appended. A zstandard
dictionary is trained on the serialized arrays of a bounded sample of documents and written
beside the files; each document is compressed by itself with it, so short documents shrink
well and can still be read alone. A file is a sequence of blocks in ascending id order; a
block keeps the dictionary's SHA-256, the ids, token counts and byte offsets of its
documents, and their frames back to back. Files and dictionary are Parquet containers, so
they go to any store that Spark can write.

Defined results: a null text is encoded as empty (the end id alone); rows are ordered by
id with nulls first, ties by the text; repeated rows stay; an empty table gives no blocks;
the dictionary is left out (empty bytes) where the sample is too small to train one. Texts
of any length are encoded whole: they are cut at spaces and line ends for the tokenizer,
which treats no match across them. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch_path, text_or_empty
from .hashing import span_hashes

DICTIONARY_BYTES = 64 * 1024
SAMPLE_ROWS = 4_000
SAMPLE_IDS = 2_000
BLOCK_BYTES = 4 << 20
LEVEL = 3
MEMO_WORDS = 1_000_000
PART_BYTES = 4 << 20
#: A digit: the pre-tokenizer cuts digits off one by one, so no other text yields its token.
MARK = "7"


#: Lower-case Latin letters: composed, without case or number, so a normaliser of NFC and lower case keeps them.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: A pre-tokenizer of this pattern keeps a run of letters whole and cuts a comma or full stop after it off.
LETTERS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Encoder:
    """Encodes texts word by word with a memo of words, found by hash and then compared; the ids equal those of whole texts.

    Valid for tokenizers whose pre-tokenizer drops white space and matches nothing across
    it, as checked by ``splits_at_space``. For the usual lower-casing normaliser and letter
    pattern, a plain word is known to pass both unchanged and goes to the model directly,
    and a word's capitals and final comma or full stop are taken off before.
    """

    def __init__(self, tokenizer_json: bytes, end_id: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.memo = Memo()
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        config = json.loads(tokenizer_json)
        steps = (config.get("normalizer") or {}).get("normalizers", [])
        cuts = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        letters = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": LETTERS}
        self.plain = None
        if letters and self.mark is not None:
            self.plain = Tokenizer.from_buffer(tokenizer_json)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def splits_at_space(self) -> bool:
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return whole("a b\nc") == whole("a") + whole("b") + whole("c") and whole(" a \n") == whole("a")

    def joined(self, tokenizer, words: list[str]) -> list[np.ndarray]:
        """Words are joined by a mark that always is one token of its own, and cut apart there again."""
        if not words:
            return []
        ids = np.array(tokenizer.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(ids == self.mark).tolist()
        return [ids[a:b] for a, b in zip([0, *(x + 1 for x in at)], [*at, len(ids)], strict=True)]

    def ids_of_words(self, words: list[str]) -> list[np.ndarray]:
        kinds = [0 if self.plain and PLAIN.fullmatch(w) and len(w) < 1000 else 1 if self.mark is not None and MARK not in w and len(w) < 1000 else 2 for w in words]
        found = [iter(self.joined(self.plain, [w for w, k in zip(words, kinds, strict=True) if k == 0])), iter(self.joined(self.tokenizer, [w for w, k in zip(words, kinds, strict=True) if k == 1]))]
        return [self.ids_of(w) if k == 2 else next(found[k]) for w, k in zip(words, kinds, strict=True)]

    def cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words: between spaces and line ends, a final comma or full stop after a letter by itself."""
        space = (data == 32) | (data == 10)
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if self.plain is None:
            return starts, ends
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        stop = ((last == 44) | (last == 46)) & (ends - starts > 1) & (((before >= 97) & (before <= 122)) | ((before >= 65) & (before <= 90)))
        times = 1 + stop
        starts, ends = np.repeat(starts, times), np.repeat(ends, times)
        second = np.cumsum(times)[stop] - 1
        starts[second] = ends[second] - 1
        ends[second - 1] -= 1
        return starts, ends

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        part, size = [], 0
        for t in texts:
            part.append(t.encode("utf-8", "replace"))
            size += len(part[-1])
            if size >= PART_BYTES:
                out += self.encode_part(part)
                part, size = [], 0
        return out + (self.encode_part(part) if part else [])

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_part(self, texts: list[bytes]) -> list[bytes]:
        joined = b"\n".join(texts)
        data = np.frombuffer(joined, dtype=np.uint8)
        starts, ends = self.cut(data)
        if self.plain is not None:
            data = lower_plain(data, starts, ends)
            joined = data.tobytes()
        at = self.numbers(joined, data, starts, ends)
        lengths = self.memo.lengths[at].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.memo.pool[np.repeat(self.memo.starts[at] - total[:-1], lengths) + np.arange(total[-1])]
        # A text's words are those that start in it.
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        cuts = total[np.searchsorted(starts, bounds)].tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] + self.end for a, b in zip(cuts, cuts[1:], strict=False)]


    def numbers(self, joined: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The memo's number of each word, known or learned now."""
        hashes = span_hashes(data, starts, ends)
        spans = lambda rows: [joined[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
        at = self.memo.find(hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if len(self.memo) + len(new) > MEMO_WORDS:
                self.memo = Memo()
                new, first = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            rows = missing[first]
            for i in range(0, len(new), 20_000):
                words = spans(rows[i : i + 20_000])
                self.memo.add(new[i : i + 20_000], words, self.ids_of_words([w.decode("utf-8") for w in words]))
            at = self.memo.find(hashes)
        # A hash finds a word, which must be the same; of words with one hash the others are kept by themselves.
        other = np.flatnonzero(~self.memo.holds(at, data, starts, ends))
        if len(other):
            words = spans(other)
            new = [w for w in dict.fromkeys(words) if w not in self.memo.clashes]
            self.memo.add_clashes(new, self.ids_of_words([w.decode("utf-8") for w in new]))
            at[other] = [self.memo.clashes[w] for w in words]
        return at


def lower_plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes with the words of ASCII alone in lower case.

    A normaliser composes a capital and a mark after it before it lowers them, so words
    with other characters stay as written, and so do words with a "<", for special tokens.
    """
    capitals = np.flatnonzero((data >= 65) & (data <= 90))
    if not len(capitals):
        return data
    kept = np.flatnonzero((data >= 128) | (data == 60))
    word = np.searchsorted(starts, capitals, side="right") - 1
    lowered = data.copy()
    lowered[capitals[np.searchsorted(kept, starts[word]) == np.searchsorted(kept, ends[word])]] += 32
    return lowered


class Memo:
    """64-bit hashes of words -> words and token ids, in arrays with open addressing."""

    def __init__(self):
        self.keys, self.values = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.starts, self.lengths, self.pool = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 16, "<u4")
        self.places, self.sizes, self.letters = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 16, np.uint8)
        self.clashes: dict[bytes, int] = {}
        self.count = self.used = self.written = 0

    def __len__(self) -> int:
        return self.count

    def holds(self, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the words of these numbers are those of data between starts and ends."""
        sizes = ends - starts
        same = self.sizes[at] == sizes
        rows = np.flatnonzero(same & (sizes > 0))
        if len(rows):
            sizes = sizes[rows]
            before = np.cumsum(sizes) - sizes
            step = np.arange(int(sizes.sum()))
            equal = self.letters[np.repeat(self.places[at[rows]] - before, sizes) + step] == data[np.repeat(starts[rows] - before, sizes) + step]
            same[rows] = np.logical_and.reduceat(equal, before)
        return same

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (hashes & mask).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.values[slot], -1)
        open_ = np.flatnonzero((key != hashes) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            key = self.keys[slot[open_]]
            hit = key == hashes[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def add(self, hashes: np.ndarray, words: list[bytes], ids: list[np.ndarray]) -> None:
        """hashes: distinct and not yet known."""
        n = len(hashes)
        if 2 * (self.count + n) > len(self.keys):
            known = self.keys != 0
            keys, values = self.keys[known], self.values[known]
            size = 1 << int(4 * (self.count + n)).bit_length()
            self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self.put(keys, values)
        self.put(hashes, np.arange(self.count, self.count + n, dtype=np.int32))
        self.keep(words, ids)

    def add_clashes(self, words: list[bytes], ids: list[np.ndarray]) -> None:
        """Words whose hash is another word's."""
        self.clashes.update(zip(words, range(self.count, self.count + len(words)), strict=True))
        self.keep(words, ids)

    def keep(self, words: list[bytes], ids: list[np.ndarray]) -> None:
        n, sizes = len(words), np.array([len(x) for x in ids], dtype=np.int64)
        letters = np.array([len(x) for x in words], dtype=np.int64)
        end, last = self.used + int(sizes.sum()), self.written + int(letters.sum())
        self.starts, self.lengths, self.pool = grown(self.starts, self.count + n), grown(self.lengths, self.count + n), grown(self.pool, end)
        self.places, self.sizes, self.letters = grown(self.places, self.count + n), grown(self.sizes, self.count + n), grown(self.letters, last)
        mine = slice(self.count, self.count + n)
        self.starts[mine], self.lengths[mine] = self.used + np.cumsum(sizes) - sizes, sizes
        self.places[mine], self.sizes[mine] = self.written + np.cumsum(letters) - letters, letters
        if n:
            self.pool[self.used : end] = np.concatenate(ids)
            self.letters[self.written : last] = np.frombuffer(b"".join(words), np.uint8)
        self.count, self.used, self.written = self.count + n, end, last

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            self.keys[slot[mine]], self.values[slot[mine]] = keys[mine], values[mine]
            rest = np.ones(len(keys), dtype=bool)
            rest[mine] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & mask


def grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def encoder_source(spark: SparkSession, path: str, end_id: int):
    """The tokenizer's file as a broadcast (a vocabulary, so of bounded size) and the getter for executors."""
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    return lambda: encoder_of(shared.value, end_id)


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def encoder_of(tokenizer_json: bytes, end_id: int) -> Encoder:
    """The worker's own encoder, whose memo outlives a task. Closures find it through the module, not a copy of its globals."""
    key = (hash(tokenizer_json), end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokenizer_json, end_id)
    return _ENCODERS[key]


def train_dictionary(docs: DataFrame, get, rows: int = SAMPLE_ROWS) -> bytes:
    """Trained on the first ids of a bounded sample of documents, which is all a dictionary can hold."""
    import zstandard

    share = min(1_000_000, int(1_000_000 * rows / max(1, docs.count())) + 1)
    sample = docs.select(F.col("doc_id"), text_or_empty().alias("text")).where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = get()
        for b in batches:
            yield pd.DataFrame({"id": b["doc_id"], "ids": [x[: 4 * SAMPLE_IDS] for x in encoder.encode_many(b["text"].tolist())]})

    got = sample.mapInPandas(run, "id long, ids binary").orderBy("id").limit(2 * rows).collect()
    samples = sorted(bytes(r["ids"]) for r in got)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


BLOCK_SCHEMA = "file int, block int, dictionary_sha256 string, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, sample_rows: int = SAMPLE_ROWS) -> str:
    """Encode docs (doc_id, text) into ``path``/blocks and ``path``/dictionary; returns path."""
    import zstandard

    spark = docs.sparkSession
    get = encoder_source(spark, tokenizer_path, end_id)
    if not get().splits_at_space():
        raise ValueError("this tokenizer joins text across white space")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, get, sample_rows)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dictionary_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = get()
        given = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=given) if given else zstandard.ZstdCompressor(level=LEVEL)
        block, size, ids, counts, frames, file = 0, 0, [], [], [], 0

        def told() -> pd.DataFrame:
            ends = np.cumsum([0, *map(len, frames)])
            return pd.DataFrame({"file": [file], "block": [block], "dictionary_sha256": [digest], "doc_ids": [ids], "n_tokens": [counts], "offsets": [ends.tolist()], "payload": [b"".join(frames)]})

        for b in batches:
            for file, doc_id, raw in zip(b["file"], b["doc_id"], encoder.encode_many(b["text"].tolist()), strict=True):  # noqa: B020
                ids.append(None if doc_id is None or doc_id != doc_id else int(doc_id))
                counts.append(len(raw) // 4)
                frames.append(press.compress(raw))
                size += len(frames[-1])
                if size >= BLOCK_BYTES:
                    yield told()
                    block, size, ids, counts, frames = block + 1, 0, [], [], []
        if ids:
            yield told()

    # The range's tie key splits an id that holds many rows; texts are dealt before they are encoded, so each is encoded once.
    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("string").alias("__s"), "doc_id", text_or_empty().alias("text")).withColumn("__t", tie)
    ordered = ordered.repartitionByRange("doc_id", "__t").sortWithinPartitions("doc_id", "__t", "text")
    # Ids go through Python as strings, since pandas would turn longs with nulls into doubles.
    ordered.select(F.spark_partition_id().alias("file"), F.col("__s").alias("doc_id"), "text").mapInPandas(run, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    return path


def block_starts(blocks: DataFrame) -> DataFrame:
    """file, block, start: ids before a block. Sums go from blocks to files, so no task sees all blocks."""
    of_block = blocks.select("file", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    of_file = of_block.groupBy("file").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_file = of_file.select("file", before.alias("file_start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return of_block.withColumn("inside", inside).join(of_file, "file").select("file", "block", (F.col("file_start") + F.col("inside")).alias("start"))


def load_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    r = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(r["dictionary"])).hexdigest() != r["dictionary_sha256"]:
        raise ValueError("the dictionary does not match its hash")
    return r["dictionary_sha256"], bytes(r["dictionary"])


def decoder(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def read_documents(blocks: DataFrame, doc_ids: list[int], path: str) -> DataFrame:
    """doc_id and ids of single documents: only their frames are decompressed."""
    digest, dictionary = load_dictionary(blocks.sparkSession, path)
    wanted = set(doc_ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = decoder(dictionary)
        for b in batches:
            for r in b.itertuples(index=False):
                if r.dictionary_sha256 != digest:
                    raise ValueError("the block was written with another dictionary")
                for i, doc_id in enumerate(r.doc_ids):
                    if doc_id in wanted:
                        raw = d.decompress(r.payload[r.offsets[i] : r.offsets[i + 1]])
                        yield pd.DataFrame({"doc_id": [doc_id], "ids": [np.frombuffer(raw, "<u4").astype(np.int64)]})

    held = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(i)).cast("long") for i in doc_ids])))
    return held.select("dictionary_sha256", "doc_ids", "offsets", "payload").mapInPandas(run, "doc_id long, ids array<long>")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    digest, dictionary = load_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches):
        import pyarrow as pa

        d = decoder(dictionary)
        for b in batches:
            for r in b.to_pylist():
                if r["dictionary_sha256"] != digest:
                    raise ValueError("the block was written with another dictionary")
                out, before, payload = [], 0, memoryview(r["payload"])
                for i, doc_id in enumerate(r["doc_ids"]):
                    raw = d.decompress(payload[r["offsets"][i] : r["offsets"][i + 1]])
                    if len(raw) != 4 * r["n_tokens"][i]:
                        raise ValueError("a frame does not hold the ids its index promises")
                    out.append((r["file"], r["block"], doc_id, before, len(raw) // 4, zlib.crc32(raw)))
                    before += len(raw) // 4
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    found = blocks.mapInArrow(run, "file int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    placed = found.join(block_starts(blocks), ["file", "block"])
    return placed.select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-store")
    return read_store(docs.sparkSession, write_store(docs, path, tokenizer_path, end_id))


__all__ = ["Encoder", "encode_and_read", "read_documents", "read_store", "train_dictionary", "write_store"]
