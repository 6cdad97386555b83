"""Token counts by a finite-state tokenizer.

A byte-pair-encoding model (SentencePiece file, byte fallback, identity normaliser) is
compiled into a deterministic transducer over characters. An encoding is the right one
exactly if each adjacent pair of its tokens is (merging the pair's text alone gives the
pair back), so the last token of a prefix follows from the last tokens of the few shorter
prefixes from which a token is still open. A state holds those, with token counts relative
to its own; a transition carries the change of the count. States and transitions are made
when first reached and kept, up to a bound.

White space resets the transducer: no piece holds it after another character. A chunk of
text therefore has a short state map: what it adds before its first white space depends on
the state it starts in (``head``), the rest does not (``count``), and the state it ends in is
that of its last open unit (``tail``). Where head or tail is long, its own map is a trial run
from the start state (``Run``): a run from any other state adds what the trial adds from the
place on where both are in the same state, which is looked for in the first ``PROBE``
characters. Maps compose associatively, so long texts are cut into chunks that are mapped in
parallel tasks and composed level by level, ``FOLD`` neighbours a task, with or without white
space. A text in which some run never falls in with its trial (such as one letter repeated)
is counted in one piece. Within a task, units between white space are maps too and are
remembered.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows stay; an
empty table gives an empty result; texts of any length are counted whole; other columns are
dropped.
"""

from __future__ import annotations

import heapq
import pickle
import struct
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty

SPACE = "▁"
LIMIT = 4096
LONG_CHARS = 1 << 20
CHUNK_CHARS = 1 << 18
#: Chunk maps that a task of one level of the scan composes.
FOLD = 64
#: Characters of a run in which another may fall in with it, and from how many on a stretch is kept as a run.
PROBE = 256
LONG_RUN = 1024
MEMO_UNITS = 500_000
MAX_STATES = 200_000


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[i : i + size]
            i += size


def read_model(data: bytes) -> dict[str, float]:
    """Score of each normal piece. Raises for models the transducer does not express."""
    scores: dict[str, float] = {}
    trainer: dict[int, int | bytes] = {}
    normalizer: dict[int, int | bytes] = {}
    for number, value in proto_fields(data):
        if number == 1:
            piece = dict(proto_fields(value))
            kind = piece.get(3, 1)
            if kind == 1:
                scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0]
            elif kind not in (2, 3, 6):
                raise ValueError("user-defined and unused pieces are not supported")
        elif number == 2:
            trainer = dict(proto_fields(value))
        elif number == 3:
            normalizer = dict(proto_fields(value))
    if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
        raise ValueError("only byte-pair encoding with byte fallback and white space in front is supported")
    if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("only the identity normaliser with a dummy prefix and kept white space is supported")
    if any(SPACE in p.lstrip(SPACE) for p in scores):
        raise ValueError("a piece holds white space after another character")
    return scores


def merge(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """Byte-pair merging by the definition: the best-scored adjacent pair first, the leftmost of equals."""
    parts: list[str | None] = list(symbols)
    after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b >= 0 and (piece := parts[a] + parts[b]) in scores:
            heapq.heappush(heap, (-scores[piece], a, b, piece))

    for a in range(len(parts) - 1):
        offer(a)
    while heap:
        _, a, b, piece = heapq.heappop(heap)
        if parts[a] is None or parts[b] is None or parts[a] + parts[b] != piece or after[a] != b:
            continue
        parts[a], parts[b] = piece, None
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    return [p for p in parts if p is not None]


class State(dict):
    """char -> (next state, change of the token count)."""

    __slots__ = ("open",)

    def __init__(self, entries: tuple[tuple[str, str | None, int], ...]):
        super().__init__()
        self.open = entries


class Run(NamedTuple):
    """The state map of a stretch without white space: its first characters, the trial's states and counts after each, its count and last state."""

    text: str
    states: list[tuple]
    counts: list[int]
    total: int
    end: tuple


class Unresolved(Exception):
    """A run did not fall in with its trial."""


#: A text with long stretches without white space as runs; a unit of one.
Pieces = list[str | Run]
Unit = str | tuple[str | Run, ...]


class Transducer:
    """The compiled tokenizer; grows as texts need it."""

    def __init__(self, model: bytes):
        scores = read_model(model)
        self.runs = {p: s for p, s in scores.items() if not p.strip(SPACE) and len(p) > 1}
        self.scores = {p: s for p, s in scores.items() if p not in self.runs}
        worst = min(self.scores.values(), default=0)
        if any(s > worst for s in self.runs.values()):
            raise ValueError("a piece of white space alone must rank after all others")
        self.prefixes = {p[:n] for p in self.scores for n in range(1, len(p))}
        self.stable: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.run_counts: dict[int, int] = {0: 0}
        self.states: dict[tuple, State] = {}
        self.units: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.states.clear()
        self.pairs.clear()
        self.start = self.state((("", None, 0),))

    def state(self, entries: tuple) -> State:
        got = self.states.get(entries)
        if got is None:
            got = self.states[entries] = State(entries)
        return got

    def is_stable(self, piece: str) -> bool:
        if piece not in self.stable:
            self.stable[piece] = len(merge(list(piece), self.scores)) == 1
        return self.stable[piece]

    def fits(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.pairs:
            self.pairs[key] = merge(list(a + b), self.scores) == [a, b]
        return self.pairs[key]

    def step(self, state: State, char: str) -> tuple[State, int]:
        """Make the transition and keep it."""
        if char not in self.scores:  # written as bytes; nothing merges across it
            got = self.start, len(char.encode("utf-8", "surrogatepass"))
            state[char] = got
            return got
        for text, last, count in state.open:
            piece = text + char
            if piece in self.scores and self.is_stable(piece) and (last is None or self.fits(last, piece)):
                break
        else:
            raise AssertionError(f"no token ends at {char!r}")
        delta = count + 1
        entries = tuple((t + char, last_, c - delta) for t, last_, c in state.open if t + char in self.prefixes)
        got = self.state((*entries, ("", piece, 0))), delta
        state[char] = got
        return got

    def run(self, text: str, state: State | None = None) -> tuple[State, int]:
        """The state after text and the tokens it adds."""
        state, total = self.start if state is None else state, 0  # a state without transitions yet is an empty dict
        for char in text:
            got = state.get(char) or self.step(state, char)
            state, total = got[0], total + got[1]
        return state, total

    def run_count(self, n: int) -> int:
        """Tokens of n white-space symbols that no word takes."""
        if n not in self.run_counts:
            self.run_counts[n] = len(merge([SPACE] * n, self.runs))
        return self.run_counts[n]

    def learn(self, units: list[str]) -> None:
        """Remember the count of units: a white-space symbol and what follows up to the next."""
        if len(self.units) + len(units) > MEMO_UNITS:
            self.units.clear()
        if len(self.states) > MAX_STATES:
            self.clear()
        for unit in units:
            self.units[unit] = self.run(SPACE + unit)[1] if unit else 0

    def trial(self, text: str) -> Run:
        state, total, states, counts = self.start, 0, [], []
        for char in text[:PROBE]:
            state, more = self.run(char, state)
            total += more
            states.append(state.open)
            counts.append(total)
        state, more = self.run(text[PROBE:], state)
        return Run(text[:PROBE], states, counts, total + more, state.open)

    def follow(self, run: Run, state: State) -> tuple[State, int]:
        """The state after the run's stretch and the tokens it adds, from any state before it."""
        total = 0
        for char, known, before in zip(run.text, run.states, run.counts, strict=True):
            state, more = self.run(char, state)
            total += more
            if state.open == known:
                return self.state(run.end), total + run.total - before
        raise Unresolved

    def count_pieces(self, unit: tuple[str | Run, ...]) -> int:
        state, total = self.run(SPACE)
        for piece in unit:
            state, more = self.run(piece, state) if isinstance(piece, str) else self.follow(piece, state)
            total += more
        return total

    def count_units(self, parts: list[Unit]) -> int:
        """Tokens of parts that each follow one white-space symbol; the last part is closed."""
        long = sum(self.count_pieces(p) for p in parts if not isinstance(p, str))
        plain = [p for p in parts if isinstance(p, str)]
        new = list(set(plain).difference(self.units))
        if len(new) > MEMO_UNITS // 4:  # more than should be remembered at once
            return long + sum(self.run(SPACE + p)[1] for p in plain if p) + self.white_space(parts)
        if new:
            self.learn(new)
            if len(self.units) < len(new) + 1 or not self.units.keys() >= set(plain):
                self.learn(list(set(plain).difference(self.units)))
        return long + sum(map(self.units.__getitem__, plain)) + (self.white_space(parts) if "" in plain else 0)

    def leaves_bare(self, part: Unit) -> bool:
        """Whether a white-space symbol in front stays by itself."""
        first = part if isinstance(part, str) else part[0] if isinstance(part[0], str) else part[0].text
        if first[0] not in self.scores:
            return True
        if not isinstance(part, str):
            raise Unresolved  # takes the whole stretch
        return merge(list(SPACE + part), self.scores)[0] == SPACE

    def white_space(self, parts: list[Unit]) -> int:
        """What runs of white-space symbols add. They merge among themselves last: a word takes its symbol first, if it does."""
        total = empty = 0
        for part in parts:
            if not part:
                empty += 1
            elif empty:
                total += self.run_count(empty + 1) - 1 if self.leaves_bare(part) else self.run_count(empty)
                empty = 0
        return total + self.run_count(empty)

    def squeezed(self, text: str) -> Pieces:
        """The text with its long stretches as runs."""
        out: Pieces = [""]
        for i, unit in enumerate(text.split(" ")):
            if i:
                out.append(" ")
            out.append(unit if len(unit) < LONG_RUN else self.trial(unit))
        return self.joined(out)

    def joined(self, pieces: Pieces) -> Pieces:
        """Neighbouring texts as one, and neighbouring runs as one."""
        out: Pieces = []
        for p in pieces:
            if not out or isinstance(out[-1], str) != isinstance(p, str):
                out.append(p)
            elif isinstance(p, str):
                out[-1] += p
            else:
                a = out[-1]
                state, more = self.follow(p, self.state(a.end))
                out[-1] = a._replace(total=a.total + more, end=state.open)
        return [p for p in out if p != ""]

    def units_of(self, pieces: Pieces) -> list[Unit]:
        """The units between white space."""
        units: list[Pieces] = [[]]
        for p in pieces:
            if isinstance(p, str):
                first, *rest = p.split(" ")
                units[-1].append(first)
                units += [[x] for x in rest]
            else:
                units[-1].append(p)
        return ["".join(u) if all(isinstance(x, str) for x in u) else tuple(x for x in u if x != "") for u in units]

    def chunk_map(self, chunk: str, squeeze: bool = False) -> ChunkMap:
        """squeeze: long heads and tails as runs, for maps that leave the task."""
        keep = self.squeezed if squeeze else lambda x: [x]
        parts = chunk.replace(SPACE, " ").split(" ")
        first = next((i for i in range(1, len(parts) - 1) if parts[i]), None)
        if first is None:
            return ChunkMap(keep(" ".join(parts)), None, 0)
        last = next(i for i in range(len(parts) - 2, 0, -1) if parts[i])
        return ChunkMap(keep(" ".join(parts[: first + 1])), keep(" ".join(parts[last + 1 :])), self.count_units(parts[first + 1 : last + 1]) if last > first else 0)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None:
            return ChunkMap(self.joined([*a.head, *b.head]), b.tail, b.count)
        if b.tail is None:
            return ChunkMap(a.head, self.joined([*a.tail, *b.head]), a.count)
        return ChunkMap(a.head, b.tail, a.count + self.count_units(self.units_of([*a.tail, *b.head])) + b.count)

    def total(self, m: ChunkMap) -> int:
        """Tokens of a whole text from the map of white space (the dummy prefix) and the text."""
        rest = 0 if m.tail is None else m.count + self.count_units(self.units_of(m.tail))
        return self.count_units(self.units_of(m.head)[1:]) + rest

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        maps = [self.chunk_map((" " if i == 0 else "") + text[i : i + chunk]) for i in range(0, len(text), chunk)]
        return self.total(self.scan(maps))

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """Balanced composition, level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]


class ChunkMap(NamedTuple):
    """How a chunk of text acts on the transducer.

    head: its text up to the first unit that ends in it, which depends on the state at the
    start; count: tokens of the units after that; tail: the text after the last unit that
    ends, without the white-space symbol in front (None: no unit ends, head is everything).
    """

    head: Pieces
    tail: Pieces | None
    count: int


_COMPILED: dict[int, Transducer] = {}


def transducer_of(model: bytes) -> Transducer:
    """The worker's own transducer, which outlives a task. Closures find it through the module, not a copy of its globals."""
    key = hash(model)
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, long_chars: int = LONG_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of docs (doc_id, text)."""
    with open(model_path, "rb") as f:  # a vocabulary file, so of bounded size
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def get() -> Transducer:
        return transducer_of(shared.value)

    def whole(batches):
        """Counts texts that are not long; long ones go on with their text."""
        import pyarrow as pa

        t = get()
        for b in batches:
            texts = b.column("text").to_pylist()
            long = [len(x) > long_chars for x in texts]
            n = pa.array([None if y else t.count(x, chunk_chars) for x, y in zip(texts, long, strict=True)], pa.int64())
            rest = pa.array([x if y else None for x, y in zip(texts, long, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("n_bytes"), n, rest], names=["row", "doc_id", "n_bytes", "n_tokens", "text"])

    def frame_of(b: pd.DataFrame, maps: list[ChunkMap | None]) -> pd.DataFrame:
        return pd.DataFrame({"row": b["row"], "chunk": b["chunk"], "map": [None if m is None else pickle.dumps(m) for m in maps]})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = get()
        for b in batches:
            yield frame_of(b, [t.chunk_map((" " if i == 0 else "") + x, True) for i, x in zip(b["chunk"], b["text"], strict=True)])

    def fold(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        """Maps of neighbouring chunks as one, or none where a run is unresolved."""
        t, pdf = get(), pdf.sort_values("chunk")
        m = None
        if pdf["map"].notna().all():
            try:
                m = t.scan([pickle.loads(x) for x in pdf["map"]])  # written by this function's own job
            except Unresolved:
                m = None
        return frame_of(pd.DataFrame({"row": [key[0]], "chunk": [key[1]]}), [m])

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = get()
        for b in batches:
            out = []
            for x in b["map"]:
                try:
                    out.append(None if x is None else t.total(pickle.loads(x)))
                except Unresolved:
                    out.append(None)
            yield pd.DataFrame({"row": b["row"], "total": pd.array(out, "Int64")})

    def at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = get()
        for b in batches:
            yield pd.DataFrame({"row": b["row"], "total": [t.count(x, chunk_chars) for x in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    # Read once; the rows' numbers are written, so a repeated task can't change them.
    told = stage(rows.mapInArrow(whole, f"row long, doc_id {kind}, n_bytes long, n_tokens long, text string"), "token-counts")
    done = told.drop("text")
    long = told.where("text IS NOT NULL").withColumn("chunks", F.ceil(F.length("text") / chunk_chars).cast("int"))
    most = long.agg(F.max("chunks")).first()[0]
    if most:
        cut = long.select("row", "text", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        cut = cut.select("row", F.col("chunk").cast("long").alias("chunk"), F.expr(f"substring(text, chunk * {chunk_chars} + 1, {chunk_chars})").alias("text"))
        maps = cut.repartition("row", "chunk").mapInPandas(chunks, MAP)
        while most > 1:  # level by level, each in tasks for a few chunks
            maps = maps.groupBy("row", F.floor(F.col("chunk") / FOLD).alias("chunk")).applyInPandas(fold, MAP)
            most = -(-most // FOLD)
        found = stage(maps.mapInPandas(totals, "row long, total long"), "token-counts-long")
        rest = long.join(found.where("total IS NULL"), "row", "left_semi").select("row", "text").mapInPandas(at_once, "row long, total long")
        done = done.join(found.where("total IS NOT NULL").unionByName(rest), "row", "left").withColumn("n_tokens", F.coalesce("n_tokens", "total"))
    return done.select("doc_id", "n_bytes", "n_tokens").withColumn("over_limit", F.col("n_tokens") > limit)


MAP = "row long, chunk long, map binary"
