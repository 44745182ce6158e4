"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Words are runs of digits, letters and all that is not ASCII; A-Z count as a-z. A window is
``window`` consecutive words of a benchmark item; an item with fewer words, but not without any, is
one window. A document contains a window where the same words follow each other.

1. Windows are sets of shingles of ``SHINGLE`` words (of fewer, if the window is shorter). A first
   pass over the documents counts these shingles in the corpus; the order is from rare to frequent.
2. A document that contains a window has all of its shingles, so a prefix of one shingle, the
   rarest, must be met. Windows whose rarest shingle occurs nowhere are left out.
3. A second pass joins all shingles of the documents with these prefixes. The place of the shingle
   tells where the window would begin: it must not begin before the document (position) nor end
   after it (length). What passes is compared word by word with the item-sized window there.
4. Windows found are merged to spans of words, and their items are listed, per document.

The prefixes are broadcast if they are within ``MOST_PREFIXES`` and ``MOST_BYTES``. Beyond that
shingles of documents pass a bit array of bounded size, and the rest are shuffled with the words
around them, never with whole texts; hot shingles are split by adaptive execution. Only matches,
and one short row per document, are gathered by document.

NULL texts have no words. Rows of either table may repeat; each row of the documents has a row in
the result. Items without an id count for spans but are not listed. Empty tables of documents give
an empty result, empty benchmarks documents without spans. Other columns, whatever their names,
take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.support import bit_words, lower_ascii, table, with_bit, written

WINDOW = 10
SHINGLE = 3
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
MOST_PREFIXES = 200_000  # rows that are broadcast at most
MOST_BYTES = 16 << 20  # and bytes of their words
FILTER_BITS = 1 << 27


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def _shingles(words: str, k: int) -> Column:
    """All runs of k words, as structs of words, in order."""
    runs = F.greatest(F.size(words) - (k - 1), F.lit(0))
    return F.arrays_zip(*(F.slice(words, i + 1, runs) for i in range(k)))


def _hash(run: str, k: int) -> Column:
    # The fields of a zip are named by their position.
    return F.xxhash64(*(F.col(run)[str(i)] for i in range(k)))


def _cell(hash_: str) -> Column:
    return F.col(hash_).bitwiseAND(F.lit(FILTER_BITS - 1))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(window, win, k) of all different windows, and (window, item) of the items they are in."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1)))
    each = written(
        words.filter(n > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("win")),
        "item-windows",
    )
    windows = written(
        each.select("win").distinct().select(
            F.monotonically_increasing_id().alias("window"), "win", F.least(F.size("win"), F.lit(SHINGLE)).alias("k")
        ),
        "windows",
    )
    listed = each.filter("item is not null").join(windows, "win").select("window", "item").distinct()
    return windows, written(listed, "window-items")


def _window_shingles(windows: DataFrame, k: int) -> DataFrame:
    """(window, offset, h) of the shingles of k words."""
    at = windows.filter(F.col("k") == k).select("window", F.posexplode(_shingles("win", k)).alias("offset", "run"))
    return at.select("window", "offset", _hash("run", k).alias("h"))


def corpus_counts(texts: DataFrame, shingles: DataFrame, k: int) -> DataFrame:
    """(h, count) of the given shingles in all documents."""
    bits = bit_words(shingles.select(_cell("h").alias("cell")).distinct())
    runs = texts.select(words_of(F.col("text")).alias("words")).select(F.explode(_shingles("words", k)).alias("run"))
    met = with_bit(runs.select(_hash("run", k).alias("h")), _cell("h"), bits, "met").filter("met")
    return met.groupBy("h").agg(F.count("*").alias("count"))


def prefixes(texts: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """(window, h, offset, win): the rarest shingle of each window, where it occurs at all."""
    shingles = written(_window_shingles(windows, k), "window-shingles")
    counts = written(corpus_counts(texts, shingles, k), "counts")
    best = shingles.join(counts, "h").groupBy("window").agg(F.min(F.struct("count", "h", "offset")).alias("best"))
    every = shingles.groupBy("window").agg(F.count("*").alias("all"))
    # A window with a shingle that occurs nowhere cannot occur.
    met = shingles.join(counts, "h", "left_semi").groupBy("window").agg(F.count("*").alias("all"))
    possible = best.join(every.join(met, ["window", "all"], "left_semi"), "window")
    return written(
        windows.join(possible, "window").select("window", "best.h", "best.offset", "win"), "prefixes"
    )


def _matches(texts: DataFrame, prefix: DataFrame, window: int, k: int) -> DataFrame:
    """(row, id, n_words, window, start, end) of verified windows, and for each document also a row
    whose window is NULL."""
    size = prefix.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.concat_ws(" ", "win"))).alias("bytes")).first()
    runs = texts.select("row", "id", words_of(F.col("text")).alias("words")).select(
        "row", "id", "words", F.size("words").alias("n_words"), F.posexplode_outer(_shingles("words", k)).alias("pos", "run")
    )
    # Of each document, the row of its first shingle, or of none, stands for the document.
    leads = F.coalesce("pos", F.lit(0)) == 0
    runs = runs.select("row", "id", "words", "n_words", "pos", _hash("run", k).alias("h"))
    if size["n"] <= MOST_PREFIXES and (size["bytes"] or 0) <= MOST_BYTES:
        near = runs.select("*", F.lit(0).alias("from"))
        prefix = F.broadcast(prefix)
    else:
        bits = bit_words(prefix.select(_cell("h").alias("cell")).distinct())
        start = F.greatest(F.col("pos") - (window - 1), F.lit(0))
        near = with_bit(runs, _cell("h"), bits, "near").filter(F.col("near") | leads).select(
            "row", "id", F.slice("words", F.coalesce(start, F.lit(0)) + 1, 2 * window).alias("words"), "n_words", "pos",
            # Documents without a shingle would all meet in one partition.
            F.when(F.col("pos").isNull(), F.xxhash64("row")).otherwise(F.col("h")).alias("h"), start.alias("from"),
        )
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.size("win") <= F.col("n_words"))
    # The slice is asked for only where the bounds hold.
    same = F.when(inside, F.slice("words", start - F.col("from") + 1, F.size("win")) == F.col("win"))
    found = near.join(prefix, "h", "left").select("*", F.coalesce(same, F.lit(False)).alias("same"))
    return found.filter(F.col("same") | leads).select(
        "row", "id", F.col("n_words").cast("long").alias("n_words"), F.when(F.col("same"), F.col("window")).alias("window"),
        F.when(F.col("same"), start).alias("start"), F.when(F.col("same"), start + F.size("win")).alias("end"),
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_words, ``spans`` (start, end) of words that occur in items, in
    order and apart from each other, and ``items``, the sorted ids of these."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    windows, listed = item_windows(items, window, item_col, item_text_col)
    kinds = sorted(r["k"] for r in windows.select("k").distinct().collect()) or [SHINGLE]
    if len(kinds) > 1:
        texts = written(texts, "texts")  # the numbers of rows must be the same for each kind
    parts = [
        written(_matches(texts, prefixes(texts.select("text"), windows, k), window, k), "matches") for k in kinds
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)

    by_start = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_first(), "end")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = opened.withColumn("span", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("row", "span").agg(
        F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    span = F.when(F.col("start").isNotNull(), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    per_doc = spans.groupBy("row").agg(
        F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(span)).alias("spans")
    )
    named = (
        found.filter("window is not null").select("row", "window").distinct().join(listed, "window")
        .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return per_doc.join(named, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


OP11_SQL = """
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
starts as (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0),
wins as (select distinct cast(item_id as varchar) as item, list_slice(w, i, i + 9) as win from starts),
sizes as (select distinct len(win) as size from wins),
runs as (
  select r, p, list_slice(w, p, p + size - 1) as win, size
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as p from docs, sizes where len(w) >= size)),
met as (select runs.r, runs.p, runs.size, wins.item from runs join wins on runs.win = wins.win),
hits as (select r, count(distinct word) as n_hit
         from (select r, unnest(range(p, p + size)) as word from (select distinct r, p, size from met)) group by r),
named as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids
          from met group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hits using (r) left join named using (r)
"""


@query("op11_decontamination", OP11_SQL)
def _op11(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
