"""Toxicity: a counterfactual-regularised classifier.

Words are chosen by how many different contexts (the word before) they have in toxic and
in other documents, so that copies of one text count once.  A logistic model over the
presence of these words is fitted with a penalty on score changes: in every labelled
sentence that names a group, the group's term is swapped for each other term of its kind,
both sentences are read by the model, and the squared difference of their logits is added
to the loss.  Naming a group then says nothing by itself, whatever the labels of the texts
that happen to name it.

The model is fitted on at most `MOST_TRAINING` labelled rows (a parameter); its vocabulary
holds the groups' terms and the `MOST_WORDS` words that tell most, of those with at least
`LEAST_CONTEXTS` toxic contexts, which bounds what the fit holds and what is broadcast.
All documents are scored on their whole text, however long, each row for itself: repeated
rows get one score.  Null and empty texts have no words and get the score of the
intercept.  Words that tell alike are taken in code point order; a score of exactly 0.5
predicts 1.  Columns held_out, score and predicted of the documents are replaced, others
may have any names.  Without labels of both kinds the score is the smoothed share of label
1.  An empty table gives an empty result.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.jobs import scratch
from datakiln.llm.labelled import held_out, training_sample

MOST_TRAINING = 20_000
MODULUS, FOLD = 5, 0
MOST_WORDS, LEAST_CONTEXTS, LEAST_RATIO = 512, 5, 4.0
PENALTY, SWAP_PENALTY, ROUNDS = 1.0, 50.0, 40

#: Terms that name a group, by kind; a term is swapped within its kind.
IDENTITY = (
    ("women", "men", "woman", "man", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "mexican", "chinese", "indian"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
)
NAMES = tuple(term for kind in IDENTITY for term in kind)
WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[.!?\n]+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


@dataclass(frozen=True)
class Model:
    """Intercept and the weight of each word's presence."""

    base: float
    weights: dict[str, float]

    def logit(self, text: str) -> float:
        return self.base + sum(self.weights[w] for w in self.weights.keys() & set(words_of(text)))


def contexts(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many contexts, the words before, it occurs in documents of either label."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    spelt = sample.select("label", words.alias("words"))
    before = F.concat(F.array(F.lit("")), F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))))
    pair = spelt.select("label", F.explode(F.arrays_zip(F.col("words").alias("word"), before.alias("before"))).alias("p"))
    met = pair.groupBy("p.word", "p.before").agg(F.max("label").alias("toxic"), F.max(1 - F.col("label")).alias("clean"))
    return met.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_words(sample: DataFrame) -> list[str]:
    """At most `MOST_WORDS` words that stand out in toxic documents, most telling first."""
    counted = scratch.save(contexts(sample), "contexts")
    whole = counted.agg(F.sum("toxic"), F.sum("clean")).first()
    if not whole[0] or not whole[1]:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * F.lit((whole[1] + 1) / (whole[0] + 1)))
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    telling = counted.filter((F.col("toxic") >= LEAST_CONTEXTS) & (odds >= float(np.log(LEAST_RATIO))))
    return [row.word for row in telling.orderBy(z.desc(), "word").limit(MOST_WORDS).select("word").collect()]


def swapped_sentences(text: str) -> Iterator[tuple[list[str], list[str], float]]:
    """(words, words with a group's term swapped, weight) for each sentence, term and other term of its kind.

    The swaps of a term share a weight of one.
    """
    for sentence in SENTENCES.split(text):
        words = words_of(sentence)
        for kind in IDENTITY:
            for term in set(words) & set(kind):
                for other in kind:
                    if other != term:
                        yield words, [other if w == term else w for w in words], 1 / (len(kind) - 1)


def changes_of(text: str, place: dict[str, int]) -> dict[tuple[int, int], float]:
    """(place lost or -1, place gained or -1) to weight: how swaps change what the model reads of a document's sentences."""
    found: dict[tuple[int, int], float] = {}
    for before, after, weight in swapped_sentences(text):
        a, b = ({place[w] for w in words if w in place} for words in (before, after))
        change = (next(iter(a - b), -1), next(iter(b - a), -1))  # a swap takes one word out and puts at most one in
        found[change] = found.get(change, 0.0) + weight
    return found


def fit(present: list[list[int]], y: np.ndarray, changes: dict[tuple[int, int], float], vocabulary: list[str], swap_penalty: float = SWAP_PENALTY) -> Model:
    """Newton steps on the logistic loss, a ridge on the words, and the squared logit change of each swapped sentence."""
    n, m = len(y), len(vocabulary)
    share = (y.sum() + 1) / (n + 2)
    beta = np.zeros(m + 1)
    beta[0] = np.log(share / (1 - share))
    if not 0 < y.sum() < n:
        return Model(float(beta[0]), {})
    x = np.zeros((n, m + 1))
    x[:, 0] = 1
    for i, places in enumerate(present):
        x[i, np.asarray(places, int) + 1] = 1
    ridge = PENALTY * np.eye(m + 1)
    ridge[0, 0] = 1e-6
    for (lost, gained), weight in changes.items():
        d = np.zeros(m + 1)
        for place, sign in ((lost, -1), (gained, 1)):
            if place >= 0:
                d[place + 1] = sign
        ridge += swap_penalty * weight * np.outer(d, d)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(x @ beta)))
        slope = x.T @ (y - p) - ridge @ beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Model(float(beta[0]), {w: float(beta[i + 1]) for i, w in enumerate(vocabulary)})


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, swap_penalty: float = SWAP_PENALTY) -> Model:
    """The model of ``labels.toxic`` from at most ``most`` labelled documents outside the fold."""
    sample = scratch.save(training_sample(docs, labels, "toxic", MODULUS, FOLD, most), "sample")
    chosen = choose_words(sample)
    vocabulary = [*NAMES, *(w for w in chosen if w not in NAMES)]
    place = {w: i for i, w in enumerate(vocabulary)}
    change = pa.list_(pa.struct([("lost", pa.int32()), ("gained", pa.int32()), ("weight", pa.float64())]))

    @F.arrow_udf("struct<present:array<int>,changes:array<struct<lost:int,gained:int,weight:double>>>")
    def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [text.as_py() or "" for text in batch]
            present = [sorted(place[w] for w in place.keys() & set(words_of(t))) for t in texts]
            changes = [[{"lost": a, "gained": b, "weight": n} for (a, b), n in sorted(changes_of(t, place).items())] for t in texts]
            yield pa.StructArray.from_arrays([pa.array(present, pa.list_(pa.int32())), pa.array(changes, change)], ["present", "changes"])

    read = scratch.save(sample.select("doc_id", "label", placed(F.col("text")).alias("p")), "read")
    swaps = read.select(F.explode("p.changes").alias("c")).groupBy("c.lost", "c.gained").agg(F.sum("c.weight").alias("weight"))
    changes = {(r.lost, r.gained): r.weight for r in swaps.orderBy("lost", "gained").collect()}  # at most the pairs of terms
    rows = read.select("doc_id", "label", "p.present").toArrow().sort_by("doc_id").to_pydict()
    return fit(rows["present"], np.array(rows["label"], float), changes, vocabulary, swap_penalty)


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score (0 to 1, higher: label 1 likelier); broadcast is the model, bounded by `MOST_WORDS`."""
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            logits = np.array([shipped.value.logit(text.as_py() or "") for text in batch], float)
            yield pa.array(1 / (1 + np.exp(-logits)), pa.float64())

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, text: str = "text", doc_id: str = "doc_id", swap_penalty: float = SWAP_PENALTY) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if score >= 0.5); one row for each row."""
    model = learn(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, most, swap_penalty)
    scored = docs.withColumns({"held_out": held_out(F.col(doc_id), MODULUS, FOLD), "score": score_column(docs.sparkSession, model, F.col(text))})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
