"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The model is fitted on a bounded sample of labelled rows (``max_rows``, spread by the id's
hash) with cross-fitting, alike at every size: the rows lie in ``FOLDS`` folds; a row's
features use word statistics of the other folds, and the calibration sees each row's score
by trees grown on the other folds. So neither lexicon nor calibration is learned from the
rows that it is applied to, and all rows serve the final lexicon and trees. Features are
densities and counts only: no label, language, source or id is an input. Scoring reads every
whole text, of any length, in Arrow batches.

Defined results: null and empty texts have all-zero features and get the score of such a
text; repeated rows get equal scores; labels that are null, or of ids without a document,
are ignored, and repeated labels count once, as toxic if any is; where no usable label is
toxic, or none is clean, there is nothing to learn and the score is by the fixed lexicon
alone; a null id is not held out; an empty table gives an empty result; other columns are
carried along whatever their names, but ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import from_row, in_row, others, stage, text_or_empty

MAX_ROWS = 20_000
THRESHOLD = 0.7
FOLDS = 5

# Insults, and second-person words of the corpus's languages.
INSULTS = frozenset("idiot moron stupid dumb loser pathetic scum trash clown worthless disgusting garbage fool imbecile vermin filth".split())
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())

WORD = re.compile(r"[^\W\d_]+")
INSIDE = re.compile(r"(?<=[^\W\d_])[@$*#!|_.\-0-9]+(?=[^\W\d_])")
SPACED = re.compile(r"(?:(?<!\S)[^\W\d_][ .\-*]){4,}")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
JUNK = re.compile(r"([^\w\s])\1+")
LEET = str.maketrans("013457@$!", "oieastasi")
PREFIXES = (4, 5, 6)
FEATURES = (
    "insult_density", "insults", "word_odds", "word_hits", "prefix_odds", "prefix_hits", "top_odds", "near_second_person", "second_person",
    "capitals", "shouted_words", "punctuation", "exclaims", "inside_rate", "spaced_rate", "repeated_rate", "junk_rate", "hidden_insults", "digits", "length",
)


def keys_of(word: str) -> list[str]:
    """A word and its prefixes as lexicon keys; a prefix is marked by a trailing dash."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


@dataclass
class Lexicon:
    """Log odds of words and prefixes, learned from labelled texts."""

    odds: dict[str, float] = field(default_factory=dict)
    memo: dict[str, tuple[float, float]] = field(default_factory=dict, repr=False)

    def of(self, word: str) -> tuple[float, float]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.odds.get(word, 0.0), max((self.odds.get(k, 0.0) for k in keys_of(word)[1:]), default=0.0)
            self.memo[word] = got
        return got


def hidden_insults(low: str) -> tuple[int, int]:
    """Marks inside words, and how many of them are in a word that is an insult without them or with letters in their place."""
    flat, inside, hidden, end, insult = None, 0, 0, 0, False
    if INSIDE.search(low):
        flat = " ".join(low.split())  # words end at any white space
        for m in INSIDE.finditer(flat):
            inside += 1
            if m.start() >= end:  # the first mark of a word
                end = flat.find(" ", m.end())
                end = len(flat) if end < 0 else end
                word = flat[flat.rfind(" ", 0, m.start()) + 1 : end]
                insult = bool(INSULTS & {re.sub(r"[\W\d_]", "", word), re.sub(r"[^a-z]", "", word.translate(LEET))})
            hidden += insult
    return inside, hidden


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = WORD.findall(low)
    n, chars = max(1, len(words)), len(text)
    insults = word_odds = word_hits = prefix_odds = prefix_hits = second = 0.0
    top, hits = 0.0, set()
    for w, c in Counter(words).items():
        a, b = lexicon.of(w)
        if w in INSULTS:
            insults += c
            hits.add(w)
        if a > 0:
            word_odds += a * c
            word_hits += c
            hits.add(w)
        if b > 0:
            prefix_odds += b * c
            prefix_hits += c
            hits.add(w)
        if w in SECOND_PERSON:
            second += c
        top = max(top, a, b)
    near = 0
    if hits and second:
        near = sum(w in hits and not SECOND_PERSON.isdisjoint(words[max(0, i - 3) : i + 4]) for i, w in enumerate(words))
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    lower = np.frombuffer(low.encode("utf-32-le", "replace"), dtype=np.uint32)
    capitals = int((code != lower).sum()) if len(code) == len(lower) else 0
    ascii_marks = int(((code > 32) & (code < 48) | (code > 57) & (code < 65) | (code > 90) & (code < 97) | (code > 122) & (code < 127)).sum())
    digits = int(((code >= 48) & (code <= 57)).sum())
    inside, hidden = hidden_insults(low)
    spaced = len(SPACED.findall(low))
    shouted = sum(map(str.isupper, text.split())) if capitals > 0.2 * chars else 0
    return [
        insults / n, insults, word_odds / n, word_hits / n, prefix_odds / n, prefix_hits / n, top, near / n, second / n,
        capitals / chars, shouted / n, ascii_marks / chars, text.count("!") / chars, inside / n, spaced / n, len(REPEATED.findall(low)) / n,
        len(JUNK.findall(low)) / n, hidden / n, digits / chars, float(np.log1p(n)),
    ]


def least_texts(toxic: int) -> int:
    """Toxic texts that must hold a key for its odds to count; so a lexicon has at most a hundred times the keys of a text."""
    return max(3, toxic // 100)


def learn_odds(stats: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """stats: key, toxic and clean texts that hold it. The odds are their lower bound at 95 percent, so keys of few texts count little."""
    odds, least = {}, least_texts(toxic)
    for key, t, c in stats:
        value = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)) - 1.64 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= least and value >= 2:
            odds[key] = float(value)
    return odds


@dataclass
class Trees:
    """Boosted trees of fixed depth in arrays: node k has children 2k+1 and 2k+2."""

    base: float
    rate: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += self.rate * leaf[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, smooth: float = 1.0) -> Trees:
    """Logistic-loss boosting with histogram splits and Newton leaves; deterministic."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    if not len(y):
        return Trees(base, rate, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, [0.0]])) for c in cuts]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width, inner = max(len(c) for c in cuts) + 1, 2**depth - 1
    score = np.full(len(y), base)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf)
            if len(mine) >= 2:
                g_all, h_all = grad[mine].sum(), hess[mine].sum()
                for j, c in enumerate(cuts):
                    g = np.bincount(binned[mine, j], grad[mine], width).cumsum()[: len(c)]
                    h = np.bincount(binned[mine, j], hess[mine], width).cumsum()[: len(c)]
                    gain = g**2 / (h + smooth) + (g_all - g) ** 2 / (h_all - h + smooth) - g_all**2 / (h_all + smooth)
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (float(gain[b]), j, float(c[b]))
            feature[t, k], cut[t, k] = best[1:]
            node[mine] = 2 * k + 1 + (x[mine, best[1]] > best[2])
        node -= inner
        g, h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
        leaf[t] = np.clip(g / (h + smooth), -4, 4)
        score += rate * leaf[t][node]
    return Trees(base, rate, feature, cut, leaf)


@dataclass
class Isotonic:
    """Pool-adjacent-violators fit; linear between the middles of its steps."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # weight, sum of y, sum of raw
        for r, v in zip(raw[order], y[order], strict=True):
            blocks.append([1.0, float(v), float(r)])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                w, s, q = blocks.pop()
                blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + q]
        at = np.array([q / w for w, _, q in blocks])
        value = np.array([(s + 0.02) / (w + 0.04) for w, s, _ in blocks])
        return cls(at, np.maximum.accumulate(value))

    def of(self, raw: np.ndarray) -> np.ndarray:
        # A thousandth follows the raw score, so texts of one step keep their order.
        return np.clip(0.999 * np.interp(raw, self.at, self.value) + 0.001 / (1 + np.exp(-raw)), 0, 1)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    isotonic: Isotonic | None

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
        if self.trees is None:
            return np.where((x[:, 1] > 0) | (x[:, 17] > 0), 0.9, 0.05)
        raw = self.trees.raw(x)
        return self.isotonic.of(raw) if self.isotonic else 1 / (1 + np.exp(-raw))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, y, fold of at most about max_rows labelled rows."""
    usable = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("y").cast("int").alias("y"))
    )
    total = usable.count()
    share = min(1.0, max_rows / max(1, total))
    spread = F.shiftrightunsigned(F.xxhash64("id", F.lit(7)), 2)  # 62 bits
    chosen = usable.where(spread < int(share * 2**62)).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(FOLDS)).cast("int"))
    texts = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text"))
    # The sample is bounded by max_rows, so its ids can be broadcast.
    return texts.join(F.broadcast(chosen), "id").select("text", "y", "fold")


def count_keys(batches) -> Iterator:
    """Arrow batches of key, fold, toxic and clean: texts of each kind that hold the key."""
    import pyarrow as pa

    counts: Counter = Counter()

    def told():
        keys = list(counts)
        for i in range(0, len(keys), 100_000):
            part = keys[i : i + 100_000]
            n = [counts[k] for k in part]
            y = [k[2] for k in part]
            columns = [pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.int32()), pa.array([a * b for a, b in zip(n, y, strict=True)], pa.int64()), pa.array([a * (1 - b) for a, b in zip(n, y, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "fold", "toxic", "clean"])

    for batch in batches:
        for text, y, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "fold")), strict=True):
            counts.update((k, fold, int(y > 0)) for k in {k for w in set(WORD.findall(text.lower())) for k in keys_of(w)})
        if len(counts) > 400_000:
            yield from told()
            counts.clear()
    yield from told()


def learn_lexicons(rows: DataFrame, sizes: dict[tuple[int, int], int]) -> list[Lexicon]:
    """One lexicon for each fold, learned from the others, and last that of all rows."""
    sums = [F.sum(F.when(F.col("fold") == f, F.col(k))) for f in range(FOLDS) for k in ("toxic", "clean")]
    names = [f"{k}{f}" for f in range(FOLDS) for k in ("toxic", "clean")]
    stats = rows.mapInArrow(count_keys, "key string, fold int, toxic long, clean long").groupBy("key").agg(*[F.coalesce(x, F.lit(0)).alias(n) for x, n in zip(sums, names, strict=True)])
    sides = [[f for f in range(FOLDS) if f != out] for out in range(FOLDS + 1)]
    totals = [tuple(sum(sizes[f, y] for f in side) for y in (1, 0)) for side in sides]
    wanted = F.lit(False)
    for side, (toxic, clean) in zip(sides, totals, strict=True):
        t, c = (sum((F.col(f"{k}{f}") for f in side), F.lit(0)) for k in ("toxic", "clean"))
        wanted = wanted | ((t >= least_texts(toxic)) & ((t + 0.5) * (clean + 1) >= 7 * (c + 0.5) * (toxic + 1)))  # e to the 2 is over 7
    got = stats.where(wanted).collect()
    lexicons = []
    for side, (toxic, clean) in zip(sides, totals, strict=True):
        lexicons.append(Lexicon(learn_odds([(r["key"], sum(r[f"toxic{f}"] for f in side), sum(r[f"clean{f}"] for f in side)) for r in got], toxic, clean)))
    return lexicons


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Only rows whose crc32(doc_id) mod 3 is not 1 are learned from."""
    rows = stage(training_rows(docs, labels, max_rows), "toxicity-sample")
    sizes: Counter = Counter()
    for r in rows.groupBy("fold", (F.col("y") > 0).cast("int").alias("y")).count().collect():
        sizes[r["fold"], r["y"]] = r["count"]
    if not all(sum(sizes[f, y] for f in range(FOLDS)) for y in (0, 1)):
        return Model(Lexicon(), None, None)
    lexicons = learn_lexicons(rows, sizes)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [features(t, lexicons[f]) for t, f in zip(b["text"], b["fold"], strict=True)], "y": b["y"], "fold": b["fold"]})

    got = rows.mapInPandas(measure, "x array<double>, y int, fold int").collect()  # the sample, bounded by max_rows
    got.sort(key=lambda r: (r["fold"], r["y"], r["x"]))
    x, fold = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["fold"] for r in got])
    y = np.array([float(r["y"] > 0) for r in got])
    raw = np.zeros(len(got))
    for f in np.unique(fold):
        raw[fold == f] = boost(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(lexicons[-1], boost(x, y), Isotonic.fit(raw, y))


def scored_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """row (the columns keep, default doc_id), score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample's
    rows = in_row(docs, ["doc_id"] if keep is None else keep, text=F.col("text"))
    schema = StructType([rows.schema["row"], StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            s = m.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["row", "score", "predicted"])

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default doc_id) with ``score`` and ``predicted``."""
    kept = others(["doc_id"] if keep is None else keep, ["score", "predicted"])
    return scored_rows(docs, model, threshold, kept).select(*from_row(kept), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that score under the threshold, with all their columns."""
    found = scored_rows(docs, fit(docs, labels), threshold, docs.columns)
    return found.where("predicted = 0").select(*from_row(docs.columns))
