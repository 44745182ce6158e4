"""Sharding by proportional stratified interleaving.

Rows are put into a seeded random order within each source. Row r of a source with n rows has the
fractional rank (r + 1/2) / n; sorting all rows by it spreads every source evenly over the whole
order, and cutting the order into equal runs gives every shard the mixture of the whole. The law
is "rows": shard sizes differ by one row at most.

No global sort is needed. Ranks are counts of earlier buckets plus a rank within a bucket, once
over buckets of the random order within a source, once over buckets of the fractional rank; both
kinds of bucket hold about ``BUCKET_ROWS`` rows, whichever source is large, and more only beyond
``MAX_CELLS`` buckets.

A NULL source is a source of its own. Rows that agree in everything are interchangeable. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.support import beside, fresh, table, written

SEED = 17
BUCKET_ROWS = 1024
# Buckets that one window over counts may see; with more rows, buckets grow instead.
MAX_CELLS = 1 << 20


def _ranks(df: DataFrame, by: Sequence[str], bucket: str, order: Sequence[str], rank: str) -> DataFrame:
    """Rank from 0 of each row among those that agree in ``by``, in the order of buckets, then of
    ``order``. Only counts of buckets are ranked in one window per value of ``by``."""
    n, before = f"{rank}_n", f"{rank}_before"
    counts = df.groupBy(*by, bucket).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    within = Window.partitionBy(*by, bucket).orderBy(*order)
    # The first row of a bucket gets the count of the earlier buckets; the sum carries it on.
    placed = df.withColumn(rank, F.row_number().over(within) - 1)
    same = [placed[c].eqNullSafe(starts[c]) for c in (*by, bucket)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return placed.join(starts, cond).select(
        *(placed[c] for c in df.columns), (placed[rank] + starts[before]).alias(rank)
    )


def interleave(rows: DataFrame, shards: int, key: Sequence[str], source: str = "source",
               seed: int = SEED) -> DataFrame:
    """Every row with ``shard`` (0 to ``shards`` - 1) and ``slot``, its place in the shard.

    ``key`` are columns that tell rows apart and seed the order; all columns of ``rows`` travel
    through the shuffles, so pass narrow rows. A column of ``rows`` named ``shard`` or ``slot`` has
    an underscore put in front.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    names = beside(rows.columns, ["shard", "slot"])
    rows = rows.select(*(F.col(c).alias(n) for c, n in names.items()))
    key, source = [names.get(k, k) for k in key], names.get(source, source)
    draw, bucket, rank, total, share, cell, place = fresh(
        rows, "draw", "bucket", "rank", "total", "share", "cell", "place"
    )
    src = F.col(source)
    drawn = written(
        rows.withColumn(draw, F.md5(F.concat_ws(":", F.lit(str(seed)), *(
            F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key
        )))),
        "shard-rows",
    )
    n = drawn.count()
    if n == 0:
        return drawn.select(*rows.columns, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # Hex digits of the draw that make buckets of about BUCKET_ROWS rows within the largest source.
    digits = min(5, (max(1, n // BUCKET_ROWS) - 1).bit_length() // 4 + 1)
    sourced = _ranks(
        drawn.withColumn(bucket, F.substring(draw, 1, digits)), [source], bucket, [draw, *key], rank
    )
    sizes = drawn.groupBy(src.alias(f"{source}_")).agg(F.count("*").alias(total))
    shared = sourced.join(sizes, src.eqNullSafe(F.col(f"{source}_"))).withColumn(
        share, (F.col(rank) + F.lit(0.5)) / F.col(total)
    )
    cells = min(max(1, n // BUCKET_ROWS), MAX_CELLS)
    one = shared.withColumn(cell, F.floor(F.col(share) * F.lit(cells))).withColumn(f"{cell}_all", F.lit(0))
    placed = _ranks(one, [f"{cell}_all"], cell, [share, source, draw, *key], place)
    shard = F.expr(f"{place} * {shards}L div {n}L")
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return (
        placed.select(*rows.columns, F.col(place), shard.cast("int").alias("shard"))
        .select(*rows.columns, "shard", (F.col(place) - first).alias("slot"))
    )


# All columns but text_crc32, which DuckDB cannot compute; the tests compare it.
LAYOUT_SQL = f"""
    with t as (
      select doc_id, source, strlen(coalesce(text, '')) + 1 as size,
             md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as draw from documents),
    r as (
      select *, row_number() over (partition by source order by draw, doc_id) - 1 as r,
             count(*) over (partition by source) as n from t),
    p as (
      select *, row_number() over (order by (r + 0.5::double) / n, source, draw, doc_id) - 1 as p,
             count(*) over () as total from r)
    select doc_id, size, 'rows' as law, cast(p * 8 // total as integer) as shard,
           cast(p - (p * 8 // total * total + 7) // 8 as bigint) as slot,
           cast(null as integer) as grown_shard
    from p
"""


@query("op10_sharding")
def _op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    out = interleave(docs, 8, ["doc_id"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
