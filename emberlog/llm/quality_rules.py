"""Quality rules: a table of thresholds compiled into one projection of Spark columns.

``measures`` turns a text into counts, ``RATIOS`` names what the rules compare, ``RULES`` is the
table of bounds, and ``compile_rules`` makes one Column of them. There is no user function.

A NULL text has no words. Words are runs of characters other than space, tab, line feed, vertical
tab, form feed and carriage return. Ratios of a text without words are NULL and pass no rule that
has a lower bound; such a text fails the base rules anyway. Every row gives one row, equal rows too; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.support import SPACES, SPACE_CLASS, beside, fresh, table

SYMBOLS = "#*$%&|<>"

# Common words of the languages the rules know, in plain lower case.
STOP_WORDS = (
    "the of and to in is that it for was on are as with by at be this from or a",
    "de la le et les des en un une du que est pour qui dans par sur pas au avec",
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als",
    "que el los se del las por con una su para es al lo como más o pero sus no",
)


class Rule(NamedTuple):
    """A ratio must lie within its bounds; None leaves a side open."""

    ratio: str
    least: float | None = None
    most: float | None = None


#: The threshold table in use. Bounds are wide: they are there for junk, not for taste.
RULES = (
    Rule("mean_word_length", 2.0, 16.0),
    Rule("symbol_word_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.3),
)


def bound_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that lie in some run of three words that the text has twice or more.

    Runs are hashed. Only a text in which a hash occurs again sorts its runs, by hash and place,
    so that equal ones are neighbours; nothing is looked up run by run in a list.
    """

    def places(windows: Column) -> Column:
        """Where the runs that occur twice or more begin, in order."""
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            def same(k: Column, e: Column) -> Column:
                return F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))

            kept = F.filter(s, lambda e, k: same(k - 1, e) | same(k + 1, e))
            return F.sort_array(F.transform(kept, lambda e: e["i"]))

        return bound_once(ordered, repeated)

    def covered(at: Column) -> Column:
        """Words under runs of three that begin at ``at``."""
        return F.aggregate(
            F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))),
            F.lit(0), lambda total, n: total + n,
        )

    def counted(w: Column) -> Column:
        again = F.size(F.array_distinct(w)) < F.size(w)
        return F.when(again, bound_once(places(w), covered)).otherwise(F.lit(0))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bound_once(windows, counted)).cast("long")


def is_stop_word(word: Column) -> Column:
    """Whether the word, without what follows its last letter, is a stop word in any case."""
    stop = sorted({w for row in STOP_WORDS for w in row.split()})
    longest = max(map(len, stop))
    # Stop words are letters only, so what may follow one has no letter.
    tailed = word.rlike(rf"^\p{{L}}{{1,{longest}}}+[^\p{{L}}]++$")
    bare = F.lower(F.regexp_extract(word, r"^\p{L}+", 0))
    return F.lower(word).isin(stop) | (tailed & bare.isin(stop))


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Counts of a text; ``words`` is its array of words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": bound_once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
        "n_stop_words": F.size(F.filter(words, is_stop_word)).cast("long"),
    }


#: What rules can bound, as a numerator and a denominator among the measures.
RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_word_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
}


def compile_rules(rules: Sequence[Rule]) -> Column:
    """One boolean Column over the measures: whether every rule holds."""
    holds = F.lit(True)
    for rule in rules:
        top, base = RATIOS[rule.ratio]
        if rule.least is not None:
            holds = holds & (F.col(top) >= F.lit(rule.least) * F.col(base)) & (F.col(base) > 0)
        if rule.most is not None:
            holds = holds & (F.col(top) <= F.lit(rule.most) * F.col(base))
    return holds


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text",
            keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the measures, ``base_failed`` and ``kept`` of every row.

    A column of ``keep`` that is named like one of the others has an underscore put in front.
    """
    names = beside(keep, [*measures(F.lit(""), F.array(F.lit(""))), "base_failed", "kept"])
    moved = [F.col(c).alias(n) for c, n in names.items()]
    words, text = fresh(docs.select(*moved), "words", "words_text")
    split = docs.select(*moved, F.col(text_col).alias(text), words_of(F.col(text_col)).alias(words))
    measured = split.select(
        *names.values(), *(c.alias(n) for n, c in measures(F.col(text), F.col(words)).items())
    )
    judged = measured.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for row in STOP_WORDS for w in row.split()}))
_BOUNDS = " and ".join(
    [f"{RATIOS[r.ratio][0]} >= {r.least!r}::double * {RATIOS[r.ratio][1]} and {RATIOS[r.ratio][1]} > 0"
     for r in RULES if r.least is not None]
    + [f"{RATIOS[r.ratio][0]} <= {r.most!r}::double * {RATIOS[r.ratio][1]}"
       for r in RULES if r.most is not None]
)


@query(
    "op9_quality_rules",
    f"""
    with t as (
      select doc_id, coalesce(text, '') as t, list_filter(
               string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
      from documents),
    pos as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t),
    runs as (
      select doc_id, i, count(*) over (
        partition by doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as c from pos),
    hit as (select doc_id, unnest([i, i + 1, i + 2]) as j from runs where c > 1),
    rep as (select doc_id, count(distinct j) as n from hit group by doc_id),
    m as (
      select doc_id, cast(len(w) as bigint) as n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
             length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
             coalesce(rep.n, 0) as n_repeat_words,
             cast(len(list_filter(w, lambda x: lower(regexp_replace(x, '[^\\pL]+$', '')) in ({_STOPS})))
                  as bigint) as n_stop_words
      from t left join rep using (doc_id)),
    b as (
      select * exclude (lines), cast(len(lines) as bigint) as n_lines,
             cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
             n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
      from m)
    select *, not base_failed and {_BOUNDS} as kept from b
    """,
)
def _op9(spark, sf_dir):
    out = quality(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_stop_words",
    )
