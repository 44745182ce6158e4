import collections

from emberlog.llm.exact_dedup import exact_dedup, exact_groups, text_hash
from plain_text import sha


def expected(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[sha(r["text"])].append(r["doc_id"])
    return groups


def test_awkward_rows(awkward):
    groups = expected(awkward.select("doc_id", "text").collect())
    got = exact_groups(awkward).collect()
    assert len(got) == awkward.count()
    kept = collections.Counter()
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_rows_that_stay_keep_their_columns(awkward, no_docs):
    out = exact_dedup(awkward)
    assert out.columns == awkward.columns
    groups = expected(awkward.select("doc_id", "text").collect())
    want = sorted(str(max((i for i in g if i is not None), default=None)) for g in groups.values())
    assert sorted(str(r["doc_id"]) for r in out.select("doc_id").collect()) == want
    assert exact_dedup(no_docs).count() == 0 and exact_groups(no_docs).count() == 0


def test_a_full_filter_changes_nothing(docs_of, monkeypatch):
    import emberlog.llm.repeat_filter as e

    rows = [(i, f"Text {i % 700}", "en", "a") for i in range(1000)]
    want = sorted(map(tuple, exact_groups(docs_of(rows)).collect()))
    monkeypatch.setattr(e, "_hash", lambda sha: e.F.pmod(e.F.xxhash64(sha), e.F.lit(3)))
    assert sorted(map(tuple, exact_groups(docs_of(rows)).collect())) == want
    assert sum(r[3] for r in want) == 700


def test_parts_looked_up_one_after_another(docs_of, awkward, monkeypatch):
    import emberlog.llm.repeat_filter as e

    rows = [(i, f"Text {i % 900}", "en", "a") for i in range(1200)]
    want = sorted(map(tuple, exact_groups(docs_of(rows)).collect()))
    odd = sorted(map(str, exact_groups(awkward).collect()))
    monkeypatch.setattr(e, "PART_BITS", 1 << 18)
    assert e.RepeatFilter(docs_of(rows).withColumn("sha", text_hash(e.F.col("text"))), "sha", len(rows)).parts == 4
    assert sorted(map(tuple, exact_groups(docs_of(rows)).collect())) == want
    assert sorted(map(str, exact_groups(awkward).collect())) == odd


def test_few_unique_rows_are_marked(spark):
    """Every repeated row is marked, and of the others, with 16 bits for each, about one in a hundred."""
    from pyspark.sql import functions as F

    import emberlog.llm.repeat_filter as e

    df = spark.range(130_000).select("id", text_hash(F.when(F.col("id") < 500, F.col("id") % 50).otherwise(F.col("id")).cast("string")).alias("sha"))
    marked = e.RepeatFilter(df, "sha", 130_000).marked(df, "sha", "again")
    r = marked.agg(F.sum(F.when(F.col("id") < 500, F.col("again").cast("int"))).alias("repeated"),
                   F.sum(F.when(F.col("id") >= 500, F.col("again").cast("int"))).alias("others")).first()
    assert r["repeated"] == 500 and 0 < r["others"] < 2600
    assert marked.count() == 130_000
