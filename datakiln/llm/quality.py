"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles over the features, each on the residual of all
others, and add up to one look-up table for each feature; then tables for the feature
pairs that explain most of what is left.  A document's score is the logistic of the sum of
its bins' entries, looked up for whole Arrow batches at once.

The model is fitted on at most `MOST_TRAINING` labelled rows (a parameter); all documents
are scored on their whole text, however long, each row for itself: repeated rows get one
score.  Null and empty texts have the features of an empty text.  Equal gains cut at the
lowest bin, and pairs that explain alike are taken in the order of the features; a score of
exactly 0.5 predicts 1.  Columns held_out, score and predicted of the documents are
replaced, others may have any names.  Without labels of both kinds the score is the
smoothed share of label 1 for every text.  An empty table gives an empty result.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.llm.labelled import held_out, training_sample

MOST_TRAINING = 20_000
MODULUS, FOLD = 3, 1
BINS, PAIR_BINS, PAIRS = 32, 8, 6
CYCLES, PAIR_CYCLES, RATE, PENALTY = 150, 60, 0.1, 1.0

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "punctuation", "symbols", "exclamation", "white_space",
    "beyond_ascii", "distinct_words", "repeated_next", "top_word", "distinct_lines", "log_line", "log_longest_word",
)
CLASSES = (bytes(range(65, 91)), b"0123456789", b".,;:'\"?()-", b"#$%&*@^~|<>{}[]\\/_=+`", b"!", b" \t\n\r\x0b\x0c", bytes(range(128, 192)), bytes(range(97, 123)), bytes(range(192, 256)))
COUNTED = np.array([[float(b in kind) for kind in CLASSES] for b in range(256)])


def features(text: bytes | None) -> list[float]:
    """The numbers of `FEATURES` for one whole text."""
    text = text or b""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ COUNTED
    upper, digits, punctuation, symbols, exclamation, space, continued, lower, beyond = counts.tolist()
    words, lines = text.split(), text.split(b"\n")
    seen = Counter(words)
    chars, m = max(n - continued, 1.0), max(len(words), 1)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), (n - space) / m, upper / max(upper + lower + beyond, 1.0), digits / chars, punctuation / chars,
        symbols / chars, exclamation / chars, space / chars, beyond / chars, len(seen) / m, sum(map(eq, words, words[1:])) / m,
        max(seen.values(), default=0) / m, len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), float(np.log1p(max(map(len, seen), default=0))),
    ]


@dataclass(frozen=True)
class Additive:
    """Bin edges and look-up tables; `score` gives logits of a feature matrix."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j])]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.pair_edges[i], x[:, i]), np.searchsorted(self.pair_edges[j], x[:, j])]
        return total


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Distinct inner quantiles of a feature."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow regression tree over ordered bins, as one value for each bin."""
    step = np.full(len(g), g.sum() / (h.sum() + PENALTY))
    if depth == 0 or len(g) < 2:
        return step
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = gain(left_g, left_h) + gain(g.sum() - left_g, h.sum() - left_h)
    if gains.max() <= gain(g.sum(), h.sum()) + 1e-9:
        return step
    at = int(gains.argmax()) + 1
    return np.concatenate([tree(g[:at], h[:at], depth - 1), tree(g[at:], h[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree that cuts the first feature once and each side by the second; the better of both orders."""

    def best(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        top, value = float(gain(g.sum(), h.sum())), np.full(g.shape, g.sum() / (h.sum() + PENALTY))
        for at in range(1, len(g)):
            sides = [tree(g[s].sum(axis=0), h[s].sum(axis=0), 1) for s in (slice(None, at), slice(at, None))]
            made = np.concatenate([np.tile(sides[0], (at, 1)), np.tile(sides[1], (len(g) - at, 1))])
            won = float((2 * g * made - (h + 0.0) * made * made).sum())
            if won > top:
                top, value = won, made
        return top, value

    one, other = best(g, h), best(g.T, h.T)
    return one[1] if one[0] >= other[0] else other[1].T


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of the single tables, then of the tables of the best pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [cut_points(x[:, j], BINS) if len(x) else np.empty(0) for j in range(len(FEATURES))]
    pair_edges = [cut_points(x[:, j], PAIR_BINS) if len(x) else np.empty(0) for j in range(len(FEATURES))]
    tables, base = [np.zeros(len(e) + 1) for e in edges], float(np.log(share / (1 - share)))
    pairs: dict[tuple[int, int], np.ndarray] = {}
    if not 0 < y.sum() < len(y):
        return Additive(base, edges, tables, pair_edges, pairs)
    bins = [np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j]) for j, e in enumerate(pair_edges)]
    logit = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for j, b in enumerate(bins):
            g, h = slopes()
            n = len(tables[j])
            step = RATE * tree(np.bincount(b, g, n), np.bincount(b, h, n))
            tables[j] += step
            logit += step[b]
    g, h = slopes()
    cells, sizes = {}, [len(e) + 1 for e in pair_edges]
    for i, j in combinations(range(len(FEATURES)), 2):
        cell = coarse[i] * sizes[j] + coarse[j]
        cells[i, j] = cell, gain(np.bincount(cell, g, sizes[i] * sizes[j]), np.bincount(cell, h, sizes[i] * sizes[j])).sum()
    chosen = sorted(cells, key=lambda p: -cells[p][1])[:PAIRS]
    pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for i, j in chosen}
    for _ in range(PAIR_CYCLES):
        for (i, j), table in pairs.items():
            g, h = slopes()
            cell = cells[i, j][0]
            step = RATE * pair_tree(*(np.bincount(cell, w, table.size).reshape(table.shape) for w in (g, h)))
            table += step
            logit += step.ravel()[cell]
    return Additive(base, edges, tables, pair_edges, pairs)


def features_column(text: Column) -> Column:
    """The features of a text column as ``array<double>``."""

    @F.arrow_udf("array<double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([features(t.as_py()) for t in batch], pa.list_(pa.float64()))

    return measured(text.cast("binary"))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Additive:
    """The model of ``labels.quality`` from at most ``most`` labelled documents outside the fold."""
    sample = training_sample(docs, labels, "quality", MODULUS, FOLD, most)
    rows = sample.select("doc_id", "label", features_column(F.col("text")).alias("x")).toArrow().sort_by("doc_id")
    flat = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return fit(flat.reshape(-1, len(FEATURES)), rows.column("label").to_numpy().astype(float))


def score_column(spark: SparkSession, model: Additive, text: Column) -> Column:
    """The score (0 to 1, higher: better) of a text column; broadcast is the model, bounded by its bins."""
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch]).reshape(-1, len(FEATURES))
            yield pa.array(1 / (1 + np.exp(-shipped.value.score(x))), pa.float64())

    return scored(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if score >= 0.5); one row for each row."""
    model = learn(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, most)
    scored = docs.withColumns({"held_out": held_out(F.col(doc_id), MODULUS, FOLD), "score": score_column(docs.sparkSession, model, F.col(text))})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
