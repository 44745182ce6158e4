import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from emberlog.llm.mixing import SEED, Plan, budgets, mix
from plain_text import WORD

EVEN = Plan("'d'", "1", "1", "1", 500, 2)


def plain_division(budget, children):
    """children {name: (weight, capacity)}; serve the most constrained first."""
    out, left = {}, budget
    rest = sum(w for w, c in children.values() if w and c)
    level = None
    for name, (w, c) in sorted(children.items(), key=lambda x: (x[1][1] / x[1][0] if x[1][0] else 0, x[0])):
        if not w or not c:
            continue
        if level is None and c * rest <= left * w:
            out[name], left, rest = c, left - c, rest - w
        else:
            level = level or (left, rest)
            out[name] = level[0] * w // level[1]
    return out


def test_shortages_stay_among_siblings(spark):
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 10_000), ("a", "fr", "s1", 50), ("b", "en", "s3", 20_000)]
    plan = Plan("x", "case domain when 'a' then 3 else 1 end", "1", "1", 300, 1)
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in budgets(df, plan).collect()}
    total = sum(x[3] for x in leaves) * 300 // 1000
    by_domain = plain_division(total, {"a": (3, 10_150), "b": (1, 20_000)})
    by_lang = plain_division(by_domain["a"], {"en": (1, 10_100), "fr": (1, 50)})
    by_source = plain_division(by_lang["en"], {"s1": (1, 100), "s2": (1, 10_000)})
    assert got == {("a", "en", "s1"): by_source["s1"], ("a", "en", "s2"): by_source["s2"],
                   ("a", "fr", "s1"): by_lang["fr"], ("b", "en", "s3"): by_domain["b"]}
    assert got["a", "fr", "s1"] == 50 and got["a", "en", "s1"] == 100


def test_prefixes_against_sorting(docs_of):
    rows = [(i, "w " * (i % 17), "en" if i % 5 else None, f"s{i % 3}" if i % 4 else "big") for i in range(800)]
    docs = docs_of(rows, extra=True)
    out = mix(docs, EVEN)
    assert sorted(out.columns) == sorted(docs.columns)  # epoch stands in for a column of that name
    got = defaultdict(int)
    for r in out.select("doc_id").collect():
        got[r["doc_id"]] += 1
    tokens = {i: max(1, len(WORD.findall(t))) for i, t, _, _ in rows}
    leaves = defaultdict(list)
    for i, _, lang, source in rows:
        leaves[lang, source].append(i)
    total = sum(tokens.values()) * 500 // 1000
    size = {k: sum(tokens[i] for i in v) for k, v in leaves.items()}
    langs = plain_division(total, {lang or "": (1, 2 * sum(n for (k, _), n in size.items() if k == lang)) for lang in ("en", None)})
    want = {}
    for lang in ("en", None):
        parts = plain_division(langs[lang or ""], {s: (1, 2 * n) for (k, s), n in size.items() if k == lang})
        for source, budget in parts.items():
            whole, rest = divmod(budget, size[lang, source])
            order = sorted(leaves[lang, source], key=lambda i: hashlib.md5(f"{SEED}:{whole}:{i}".encode()).hexdigest())
            used, fits = 0, True
            for i in order:
                used += tokens[i]
                fits = fits and used <= rest
                if whole + fits:
                    want[i] = whole + fits
    assert got == want


def test_awkward_rows(awkward, no_docs):
    out = mix(awkward, Plan("source", "1", "1", "1", 1000, 1))
    assert sorted(out.columns) == sorted(awkward.columns)
    assert out.count() == awkward.count()  # the whole budget, once each
    assert mix(no_docs).count() == 0
    assert mix(awkward, EVEN._replace(share=0)).count() == 0
    assert mix(awkward, EVEN._replace(source_weight="case when source = 'a' then 1 else 0 end")).select(
        F.count_if(F.col("source").isNull() | (F.col("source") != "a"))).first()[0] == 0
