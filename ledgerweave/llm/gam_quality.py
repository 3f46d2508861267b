"""Quality classifier: a generalised additive model with pairwise interactions (operator 5).

Every text is described by counts over the whole text (shares of character classes, words, lines, repetition).
Each feature is cut into quantile bins; cyclic boosting visits the features in turn and adds one shallow tree over
the bins to that feature's lookup table, then does the same over two-dimensional tables of the strongest pairs. A
score is the logistic of an intercept plus one table entry for each feature and pair.

Training reads labels only where ``crc32(doc_id as text) % 3 <> 1`` and at most ``sample_rows`` of them, those with
the smallest seeded hashes; that bounded sample of features (not texts) is what the driver fits on. Scoring has no
shuffle.

Defined results: a null or empty text scores as the model scores zero counts; labels without a document, with a null
quality or with a null doc_id are not used; repeated rows score alike and come back once each; with labels of one
class or none the score is their smoothed share (0.5 without labels); a null doc_id is not held out; extra columns
are not read; of several texts under one labelled id the one with the smallest hash is learned from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frequent function words of the four languages of the corpus.
FUNCTION_WORDS = (
    "the of and to a in is that it for was on with be by as this are at from "
    "der die und in den von zu das mit sich auf des für ist nicht dem im ein als eine "
    "de la le et les des en un du une que pour est qui par dans sur au pas avec "
    "de la que el en y los se del las por un no con su una es para al lo"
)
_FUNCTION = sorted({w.encode() for w in FUNCTION_WORDS.split()})


def _classes() -> np.ndarray:
    """Byte -> class: 0 lower, 1 upper, 2 digit, 3 blank, 4 sentence marks, 5 other marks, 6 above ASCII, 7 control."""
    out = np.full(256, 7)
    for b in range(32, 127):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c in ".,;:?!'\"()-" else 5
    out[128:] = 6
    out[[9, 10, 11, 12, 13]] = 3
    return out


CLASS = _classes()
FEATURES = (
    "log_bytes", "lower", "upper", "digit", "blank", "sentence_marks", "other_marks", "above_ascii", "control", "word_bytes", "words_a_line",
    "distinct_words", "top_word", "function_words", "repeated_lines", "stops_a_word", "bangs_a_word", "bars_a_word", "capital_words", "log_words",
)


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = np.bincount(CLASS, weights=hist, minlength=8) / n
    words = raw.split()
    counted = Counter(raw.lower().split())
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    capital = sum(map(bytes.isupper, words))
    return [
        np.log1p(len(raw)), *share[[0, 1, 2, 3, 4, 5, 6, 7]], (n - hist[32] - hist[10]) / w, len(words) / max(1, len(lines)),
        len(counted) / w, max(counted.values(), default=0) / w, sum(counted[x] for x in _FUNCTION) / w, 1 - len(set(lines)) / max(1, len(lines)),
        hist[46] / w, hist[33] / w, hist[124] / w, capital / w, np.log1p(len(words)),
    ]


@dataclass
class Additive:
    """Lookup tables of a fitted model."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.intercept)
        if self.tables:
            bins = _bin(x, self.edges)
            for f, table in enumerate(self.tables):
                margin += table[bins[:, f]]
            for a, b, table in self.pairs:
                margin += table[bins[:, a], bins[:, b]]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _bin(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Best gain and place of a cut along the last axis; place 0 means no cut."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
    gain = np.where((hl >= least) & (ht - hl >= least), gain, 0.0)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1 if gain[k] > 0 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> tuple[np.ndarray, float]:
    """A shallow tree over one feature's bins, as its value in every bin, and its gain."""
    gain, k = _cut(g, h, ridge, least) if depth else (0.0, 0)
    if not k:
        return np.full(len(g), g.sum() / (h.sum() + ridge)), 0.0
    left, gl = _tree(g[:k], h[:k], depth - 1, ridge, least)
    right, gr = _tree(g[k:], h[k:], depth - 1, ridge, least)
    return np.concatenate([left, right]), gain + gl + gr


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, float]:
    """One cut along the first feature, then one along the second in each part."""
    _, k = _cut(g.sum(axis=1), h.sum(axis=1), ridge, least)
    k = k or g.shape[0] // 2
    out, total = np.zeros(g.shape), 0.0
    for part in (slice(0, k), slice(k, None)):
        value, gain = _tree(g[part].sum(axis=0), h[part].sum(axis=0), 1, ridge, least)
        out[part] = value
        total += gain
    return out, total


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 80, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0) -> Additive:
    """Cyclic boosting of lookup tables on a bounded sample."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(intercept=float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    b = _bin(x, model.edges)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    gains = np.zeros(len(sizes))
    for _ in range(rounds):
        for f, s in enumerate(sizes):
            g, h = slopes()
            tree, gain = _tree(np.bincount(b[:, f], g, s), np.bincount(b[:, f], h, s), 2, ridge, least)
            gains[f] += gain
            model.tables[f] += rate * tree
            margin += rate * tree[b[:, f]]
    g, h = slopes()
    strong = np.argsort(-gains)[:10]

    def grid(a: int, c: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(b[:, a] * sizes[c] + b[:, c], v, sizes[a] * sizes[c]).reshape(sizes[a], sizes[c])

    options = [(-_pair_tree(grid(a, c, g), grid(a, c, h), ridge, least)[1], a, c) for i, a in enumerate(strong) for c in strong[i + 1 :]]
    chosen = [(int(a), int(c)) for _, a, c in sorted(options)[:pairs]]
    model.pairs = [(a, c, np.zeros((sizes[a], sizes[c]))) for a, c in chosen]
    for _ in range(pair_rounds):
        for a, c, table in model.pairs:
            g, h = slopes()
            tree, _ = _pair_tree(grid(a, c, g), grid(a, c, h), ridge, least)
            table += rate * tree
            margin += rate * tree[b[:, a], b[:, c]]
    return model


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def text_features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([features(t) for t in batch])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, seed: int = 17) -> Additive:
    usable = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    picked = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows ids: a proven bound for the broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", text_features("text").alias("x"), F.xxhash64("text").alias("h"))
    # of several texts under one id the one with the smallest hash counts, so reruns fit the same model
    rows = found.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("x", "h").alias("x")).orderBy("doc_id").collect()
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([float(r.quality) for r in rows]))


def scorer(model: Additive):
    """Column function: score of a text."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(np.array([features(t) for t in batch], dtype=float).reshape(len(batch), len(FEATURES))))

    return score


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    score = scorer(train(docs, labels, sample_rows))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_gam_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below 0.5 go; the columns stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(scorer(train(docs, labels))("text") >= 0.5)
