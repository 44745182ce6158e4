import random

from emberlog.llm.language_id import address_language, identify, keep_identified

WORDS = {
    "en": "the and of to which through right house weather thing would night".split(),
    "de": "der und die nicht schön über straße werden zwischen mögen haus zeit".split(),
    "fr": "le les et où être français château très beaucoup maison élève ça".split(),
}


def sample(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_text_overrules_a_wrong_declaration(docs_of):
    rng = random.Random(2)
    rows = [(i, sample(rng, lang), lang, f"www.{lang}.example.org") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000, sample(rng, "de"), "en", "x.org"), (1001, sample(rng, "fr"), None, None), (1002, "1234 5678", "en", "x.org")]
    got = {r["doc_id"]: r for r in identify(docs_of(rows, extra=True), "lang", "source").collect()}
    assert all(got[i]["language"] == lang and got[i]["kept"] for i, _, lang, _ in rows[:180])
    assert got[1000]["language"] == "de" and got[1001]["language"] == "fr"
    assert not got[1002]["kept"]


def test_host_and_declaration_decide_short_texts(docs_of):
    rng = random.Random(3)
    rows = [(i, sample(rng, lang), lang, f"{lang}.example.org") for i, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += [(500, "haus", "fr", "de.example.org"), (501, "maison", None, "fr.example.org")]
    got = {r["doc_id"]: r["language"] for r in identify(docs_of(rows), "lang", "source").collect()}
    assert got[501] == "fr" and got[500] == "de"


def test_addresses(spark):
    cases = {"https://a.example.org/fr/1": "fr", "http://b.de": "de", "http://b.de/es/": "es", "http://b.com/x": None,
             "no address": None, "https://x.co.uk:80/en.html": "en"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r[0]: r[1] for r in df.select("u", address_language(df["u"])).collect()}
    assert got == cases
    rng = random.Random(4)
    rows = [(i, sample(rng, k), k, f"http://h{i % 4}.example.org/{k}/") for i, k in enumerate(["en", "de", "fr"] * 30)]
    df = spark.createDataFrame(rows, "id long, text string, markup string, url string").withColumn("host", spark.range(1).select("id").columns and __import__("pyspark.sql.functions", fromlist=["x"]).expr("split(url, '/')[2]"))
    out = identify(df, "markup", "host", address="url")
    assert all(r["language"] == r["markup"] for r in out.collect())


def test_awkward_rows(awkward, no_docs):
    out = identify(awkward, "lang", "source")
    assert sorted(out.columns) == sorted({*awkward.columns, "language", "posterior", "kept"})
    rows = out.select("doc_id", "posterior", "kept").collect()
    assert len(rows) == awkward.count()
    assert not any(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert keep_identified(awkward).columns == awkward.columns
    empty = identify(no_docs, "lang", "source")
    assert empty.count() == 0 and keep_identified(no_docs).columns == no_docs.columns
