"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, A-Z as a-z. A document has the features of its words, of
pairs of neighbours and of pairs with one word between, each hashed to one of ``FEATURES`` places
and counted once however often it occurs. FTRL-proximal keeps a learning rate for each place and an
L1 penalty that leaves most weights at exactly zero; the others are all that is broadcast.

The model learns from at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of
their id; this bound on fitting is the only sample. They are found with a filter of bounded size,
so texts that are not trained on are never shuffled. Scoring covers whole texts of all documents.

Labels are learned only from rows outside of the held-out fold, crc32(id as text) mod 5 = 0. NULL
and empty texts have no features and get the score of the intercept. Rows without an id are not
held out and not learned from. NULL labels are not learned from; of repeated labels of one id each
counts. Without a label of each kind to learn from, the score is the share of toxic labels, or 0.
Repeated rows get the same score; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.support import bit_words, small_batches, table, with_bit, written
from emberlog.llm.words import Words, mix, word_hashes

FEATURES = 1 << 20
TRAIN_ROWS = 20_000
FILTER_BITS = 1 << 22
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every feature of a slice, repeats included."""
    h = words.hashes
    row = np.repeat(np.arange(words.rows), np.diff(words.bounds))
    rows, places = [row], [h]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            pair = mix(h[:-gap] * np.uint64(3) + h[gap:] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
            rows.append(row[gap:][same])
            places.append(pair[same])
    return np.concatenate(rows), (np.concatenate(places) % np.uint64(FEATURES)).astype(np.int64)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(draw, toxic, text) to (draw, toxic, places), each place of a document once."""
    for batch in batches:
        draw, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for words in word_hashes(batch.column(2), letters_only=True):
            row, place = features(words)
            both = np.unique(row * FEATURES + place)
            cuts = np.searchsorted(both // FEATURES, np.arange(words.rows + 1))
            place = (both % FEATURES).astype(np.int32)
            span = slice(words.first, words.first + words.rows)
            yield pa.RecordBatch.from_pydict({
                "draw": pa.array(draw[span], pa.int64()), "toxic": pa.array(toxic[span], pa.int32()),
                "places": [place[a:b].tobytes() for a, b in zip(cuts, cuts[1:])],
            })


class Ftrl:
    """FTRL-proximal for logistic loss; place ``FEATURES`` is the intercept, without penalty."""

    def __init__(self):
        self.z = np.zeros(FEATURES + 1)
        self.n = np.zeros(FEATURES + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def intercept(self) -> float:
        return float(-self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA))

    def learn(self, places: np.ndarray, label: int) -> None:
        w, b = self.weights(places), self.intercept()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - label
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[places] = n + g * g
        n = self.n[-1]
        self.z[-1] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * b
        self.n[-1] = n + g * g


def fit(places: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not zero, the intercept at place ``FEATURES``."""
    share = sum(labels) / max(1, len(labels))
    if share in (0, 1):
        logit = 35.0 if share else -35.0
        return np.array([FEATURES]), np.array([logit])
    model = Ftrl()
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(labels)):
            model.learn(places[i], labels[i])
    w = model.weights(np.arange(FEATURES))
    kept = np.flatnonzero(w)
    return np.append(kept, FEATURES), np.append(w[kept], model.intercept())


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, labels = [], []
    for batch in batches:
        labels += batch.column("toxic").to_pylist()
        places += [np.frombuffer(x, np.int32).copy() for x in batch.column("places").to_pylist()]
    at, w = fit(places, labels)
    yield pa.RecordBatch.from_pydict({"place": pa.array(at, pa.int32()), "weight": pa.array(w, pa.float64())})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The weights learned from labelled documents outside of the held-out fold."""
    small_batches(docs.sparkSession)
    known = F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))
    sample = written(
        labels.filter(known)
        .select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"),
                F.xxhash64(F.col("doc_id").cast("long")).alias("draw"))
        .orderBy("draw", "toxic").limit(rows),
        "labels",
    )
    cell = F.pmod("draw", F.lit(FILTER_BITS))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words = bit_words(sample.select(cell.alias("cell")))
    near = with_bit(texts, F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)), words, "near").filter("near")
    return _collected(
        near.join(sample, near["id"] == sample["label_id"]).select("draw", "toxic", "text")
        .mapInArrow(_extract, "draw long, toxic int, places binary")
        .repartition(1).sortWithinPartitions("draw", "toxic", "places")
        .mapInArrow(_train, "place int, weight double")
    )


def _collected(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = weights.toArrow()
    return rows.column("place").to_numpy(), rows.column("weight").to_numpy()


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from its text alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values = shared.value
        dense = np.zeros(FEATURES + 1)
        dense[places] = values
        for batch in batches:
            out = []
            for words in word_hashes(batch.column(1), letters_only=True):
                row, place = features(words)
                weighs = dense[place] != 0
                both = np.unique(row[weighs] * FEATURES + place[weighs])
                sums = np.bincount(both // FEATURES, weights=dense[both % FEATURES], minlength=words.rows)
                out.append(1 / (1 + np.exp(-np.clip(sums + dense[FEATURES], -35, 35))))
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    return (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
    )


@query("op5_toxicity")
def _op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
