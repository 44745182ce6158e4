"""Hard negatives for anchors and their positives, found by angular triangle filtering.

Vectors are whole numbers, scores whole inner products. An anchor's positives are the rows of its
label with the highest scores; the hard negatives of a pair are the rows of other labels with the
highest scores within a window given by the positive's score. Higher scores come first, of equal
ones the smaller id.

Every row keeps its norm and its angles to ``REFERENCES`` reference directions. Angles on a sphere
obey the triangle inequality: the angle of two rows lies between the largest difference of their
angles to a reference and the smallest sum, a sum beyond a half turn counting backwards. Cosines of
both ends, times the norms, bound the score; both ends are widened by more than any rounding. Rows
are laid out by their nearest reference and the angle to it. Runs of ``RUN`` rows are bounded as
one first, then row by row; only where the bounds overlap an anchor's window, or reach beyond what
the task has found already, the whole-number score is computed.

Anchors are taken in blocks of about ``ANCHORS``, each against all rows in one narrow pass, so a
block is the largest thing that is sent to tasks. A task returns the best rows of each window that
it has seen, a few per window, and these are ranked. Neither an anchor's candidates nor a label are
ever gathered, so a label with a third of all rows is no special case.

Rows without an id or label, with a NULL vector or a NULL or non-finite component take no part.
Repeated rows count each, but a row is no positive of an anchor with the same id. Where vectors
differ in length, missing components are 0. An empty table, or one without anchors, gives an empty
table. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.support import fresh, table, written
from emberlog.llm.vectors import complete, matrix, products, scaled
from emberlog.session import shared_dir

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = (30, 100), (90, 100)  # window of a negative's score, as parts of the positive's
REFERENCES = 8
ANCHORS = 2048
RUN = 256
_WAITING = 20_000  # candidates that wait to be ranked
_ANGLE = 4e-6  # radians by which bounds are widened: angles are stored as 32-bit floats
_FOUND = "anchor int, slot int, id long, score long"


def _angles(v: np.ndarray, norm: np.ndarray, references: np.ndarray) -> np.ndarray:
    length = np.sqrt((references.astype(np.float64) ** 2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = v.astype(np.float64) @ references.T.astype(np.float64) / (norm[:, None] * length)
    # A vector of zeros has any angle; its norm makes all bounds 0.
    return np.arccos(np.clip(np.nan_to_num(cosine, nan=0.0, posinf=0.0, neginf=0.0), -1, 1))


def _placing(references: np.ndarray):
    """(id, label, v) to rows with norm, angles and the place that orders them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"), references.shape[1])
            norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
            angles = _angles(v, norm, references)
            near = angles.argmin(axis=1)
            place = near * 4.0 + angles[np.arange(len(v)), near]
            flat = pa.array(angles.astype(np.float32).ravel())
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * angles.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("v"), pa.array(norm),
                 pa.ListArray.from_arrays(offsets, flat), pa.array(place)],
                ["id", "label", "v", "norm", "angles", "place"],
            )

    return run


def score_bounds(low: np.ndarray, high: np.ndarray, short: np.ndarray, long: np.ndarray,
                 angles: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of rows, or runs of rows, with anchors.

    ``low``, ``high``: least and largest angles of a row or run to each reference; ``short``,
    ``long``: least and largest norm; ``angles``, ``norm``: the anchors'.
    """
    shape = len(low), len(angles)
    least, most = np.zeros(shape, np.float32), np.full(shape, np.pi, np.float32)
    for r in range(low.shape[1]):
        a, x, y = angles[None, :, r], low[:, r, None], high[:, r, None]
        np.maximum(least, a - y, out=least)
        np.maximum(least, x - a, out=least)
        np.minimum(most, a + y, out=most)
        np.minimum(most, np.float32(2 * np.pi) - a - x, out=most)
    top = np.cos(np.maximum(least - _ANGLE, 0, dtype=np.float64))
    end = np.cos(np.minimum(most + _ANGLE, np.pi, dtype=np.float64))
    upper = top * np.where(top > 0, long[:, None], short[:, None]) * norm
    lower = end * np.where(end > 0, short[:, None], long[:, None]) * norm
    slack = 1e-9 * long[:, None] * norm + 1e-3
    return lower - slack, upper + slack


class _Best:
    """The first ``most`` of what is seen for each (anchor, slot), and the score that a newcomer
    must reach. What comes is ranked when much has come."""

    def __init__(self, least: np.ndarray, most: int):
        self.least, self.most = least.copy(), most
        self.rows = [np.empty(0, np.int64)] * 4
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, anchor: np.ndarray, slot: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        self.waiting.append((anchor, slot, id_, score))
        self.n += len(anchor)
        if self.n > max(_WAITING, len(self.rows[0])):
            self.rank()

    def rank(self) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, *self.waiting)]
        self.waiting, self.n = [], 0
        if not len(rows[0]):
            return
        order = np.lexsort((rows[2], -rows[3], rows[1], rows[0]))
        rows = [x[order] for x in rows]
        new = np.concatenate(([True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)))
        rank = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        self.rows = [x[rank < self.most] for x in rows]
        full = rank == self.most - 1
        self.least[rows[0][full], rows[1][full]] = rows[3][full]


def _search(block: dict, same: bool, most: int):
    """Per anchor of the block and window, the first rows of a task's that lie in the window.

    ``block``: ids, labels, v, norm and angles of anchors; least and largest scores of their
    windows (anchors x slots); windows whose least exceeds the largest are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(block["least"], most)
        ids, labels, largest = block["ids"], block["labels"], block["largest"]
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                rows = batch.slice(at, RUN)
                angles = np.stack(rows.column("angles").to_numpy(zero_copy_only=False))
                norm = rows.column("norm").to_numpy()
                # The least and the largest score that is still of use for an anchor.
                wanted = best.least <= largest
                least = np.where(wanted, best.least, np.iinfo(np.int64).max).min(axis=1)
                top = np.where(wanted, largest, np.iinfo(np.int64).min).max(axis=1)
                lower, upper = score_bounds(
                    angles.min(axis=0)[None], angles.max(axis=0)[None], norm.min()[None], norm.max()[None],
                    block["angles"], block["norm"],
                )
                near = np.flatnonzero((upper[0] >= least) & (lower[0] <= top))
                if not len(near):
                    continue
                label = rows.column("label").to_numpy()
                lower, upper = score_bounds(angles, angles, norm, norm, block["angles"][near], block["norm"][near])
                maybe = (upper >= least[near]) & (lower <= top[near])
                maybe &= (label[:, None] == labels[near]) == same
                i, j = np.nonzero(maybe)
                if not len(i):
                    continue
                v = matrix(rows.column("v"), block["v"].shape[1])
                if len(i) * 8 > maybe.size:
                    score = products(v, block["v"][near])[i, j]
                else:
                    score = np.einsum("ij,ij->i", v[i], block["v"][near[j]])
                id_, anchor = rows.column("id").to_numpy()[i], near[j]
                if same:
                    other = id_ != ids[anchor]
                    id_, anchor, score = id_[other], anchor[other], score[other]
                for slot in range(largest.shape[1]):
                    fits = (score >= best.least[anchor, slot]) & (score <= largest[anchor, slot])
                    n = np.count_nonzero(fits)
                    best.add(anchor[fits], np.full(n, slot), id_[fits], score[fits])
        best.rank()
        anchor, slot, id_, score = best.rows
        if len(anchor):
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(id_), pa.array(score)],
                ["anchor", "slot", "id", "score"],
            )

    return run


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _window(score: int) -> tuple[int, int]:
    """Least and largest score of a negative for a positive's score."""
    return -(-LOW[0] * score // LOW[1]), HIGH[0] * score // HIGH[1]


def hard_negatives(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   scale: int = SCALE, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col)
    usable = complete(vector) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    kept = written(
        rows.filter(usable).select(
            F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
            scaled(vector, scale).alias("v"),
        ),
        "vectors",
    )
    width = kept.agg(F.max(F.size("v"))).first()[0]
    path = shared_dir(spark, "hard-negatives")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not width:
        return spark.createDataFrame([], out)
    # Directions of rows; any choice is right, and rows spread over the data.
    chosen = kept.filter(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id", "v").limit(REFERENCES).select("v")
    references = np.zeros((REFERENCES, width), np.int64)
    references[:, 0] = 1
    for i, r in enumerate(chosen.collect()):
        references[i] = [*r["v"], *[0] * (width - len(r["v"]))]
    placed = "id long, label long, v array<int>, norm double, angles array<float>, place double"
    laid_out = written(
        kept.mapInArrow(_placing(references), placed).repartitionByRange("place", "id").sortWithinPartitions("place"),
        "placed",
    )
    anchors = laid_out.filter(is_anchor)
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], out)
    blocks = -(-n // ANCHORS)
    # Dealt in turn, so that no block is much larger than the others, whatever ids repeat.
    anchors = written(anchors.repartition(blocks).withColumn("block", F.spark_partition_id()), "anchors")
    for k in range(blocks):
        own = anchors.filter(F.col("block") == k).collect()
        if not own:
            continue
        block = {
            "ids": np.array([r["id"] for r in own], np.int64), "labels": np.array([r["label"] for r in own], np.int64),
            "v": np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in own], np.int64),
            "norm": np.array([r["norm"] for r in own]), "angles": np.array([r["angles"] for r in own], np.float32),
        }
        anything = np.iinfo(np.int64)
        every = {"least": np.full((len(own), 1), anything.min), "largest": np.full((len(own), 1), anything.max)}
        best = _ranked(laid_out.mapInArrow(_search(block | every, True, positives), _FOUND), positives).collect()
        # Windows without a positive are empty.
        least, largest = np.full((len(own), positives), 1), np.full((len(own), positives), 0)
        pairs = []
        for r in best:
            a, slot = r["anchor"], r["rank"] - 1
            least[a, slot], largest[a, slot] = _window(r["score"])
            pairs.append((a, slot, int(block["ids"][a]), r["id"], r["score"]))
        windows = {"least": least.astype(np.int64), "largest": largest.astype(np.int64)}
        found = _ranked(laid_out.mapInArrow(_search(block | windows, False, negatives), _FOUND), negatives)
        # As many rows as the block has pairs.
        named = spark.createDataFrame(pairs, "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
        found.join(F.broadcast(named), ["anchor", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(path)
    return spark.read.schema(out).parquet(path)


OP13_SQL = f"""
with e as (
  select row_number() over () as r, vec_id,
    case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (
  select a.r, a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
    cast(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) as bigint) as score
  from e a, e b where a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
positives as (
  select r, anchor_id, id as positive_id, score as positive_score, row_number() over (partition by r order by score desc, id) as slot
  from scored where same qualify slot <= {POSITIVES}),
negatives as (
  select p.anchor_id, p.positive_id, p.positive_score, n.id as negative_id, n.score as negative_score,
    cast(row_number() over (partition by p.r, p.slot order by n.score desc, n.id) as integer) as rank
  from positives p join scored n on n.r = p.r and not n.same
    and {LOW[0]} * positive_score <= {LOW[1]} * n.score and {HIGH[1]} * n.score <= {HIGH[0]} * positive_score
  qualify rank <= {NEGATIVES})
select * from negatives
"""


@query("op13_hard_negatives", OP13_SQL)
def _op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    (name,) = fresh(rows, "mined_label")
    return hard_negatives(rows.withColumn(name, label), F.col("id") % 100 == 0, label_col=name)
