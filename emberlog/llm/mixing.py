"""Mixing sources to target weights by hierarchical budgeting.

Weights are whole numbers at three levels: domain, language within a domain, source within both. A
budget of tokens is divided from the top: each node gives its children shares by weight, none more
than it holds in ``max_epochs`` passes over its rows. What one child cannot take goes to its
siblings by their weights; only what all of them together cannot take comes back to the level
above, as a node never gets more than its children hold. Division is exact, in whole numbers.

A leaf takes all its rows once for each whole epoch its budget covers, and then the longest prefix
of one more epoch that fits, in an order of rows drawn from the seed, the epoch and the row's id.
That prefix is a threshold on the draws: it is found in a few rounds of counting by ever longer
beginnings of the draw, so no leaf is ever sorted or gathered, and then every row decides for
itself. Only narrow rows are shuffled, after partial sums.

Tokens are words between white space; rows without words count one token. NULL texts are empty. NULL
domains, languages and sources are values of their own. Rows without an id draw as if the id were
empty. Rows of a leaf with the same draw, such as repeated rows, are taken or left together. Leaves
of weight 0 get nothing. An empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.support import SPACE_CLASS, fresh, table, written

SEED = 29
_EXACT = "decimal(38,0)"
_DIGITS = (3, 6)


class Plan(NamedTuple):
    """The budget as per mille of all tokens, the most epochs, and weights as SQL over the columns
    ``domain``, ``lang`` and ``source``; ``domain`` is SQL over the columns of the documents."""

    domain: str
    domain_weight: str
    language_weight: str
    source_weight: str
    share: int = 700
    max_epochs: int = 2


#: The mixture of the registered query and of the pipeline.
PLAN = Plan(
    domain="case when source in ('src0', 'src1', 'src2') then 'web' "
           "when source in ('src3', 'src4', 'src5', 'src6') then 'reference' else 'community' end",
    domain_weight="case domain when 'web' then 50 when 'reference' then 20 else 30 end",
    language_weight="case lang when 'en' then 60 when 'fr' then 15 when 'de' then 15 else 10 end",
    source_weight="case when source = 'src0' then 2 else 1 end",
)


def token_count(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")
    return F.greatest(F.size(words), F.lit(1)).cast("long")


def draw(id_: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))))


def _divide(children: DataFrame, parents: DataFrame, by: list[str], name: str) -> DataFrame:
    """Children (``by``, ``name``, weight, capacity) with ``budget``, shared out of the budget of
    their parent. Children are taken in the order of capacity per weight; each takes its capacity
    if its share of what is left, by weight among those not yet served, is as large."""
    match = [children[c].eqNullSafe(parents[c]) for c in by]
    cond = F.lit(True)
    for m in match:
        cond = cond & m
    rows = children.join(parents.select(*by, F.col("budget").alias("whole")), cond).select(
        *(children[c] for c in children.columns), "whole"
    ).filter("weight > 0 and capacity > 0")
    order = Window.partitionBy(*by).orderBy(F.col("capacity").cast("double") / F.col("weight"), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({
        "used": F.coalesce(F.sum(F.col("capacity")).over(before), F.lit(0)).cast(_EXACT),
        "behind": F.coalesce(F.sum(F.col("weight")).over(before), F.lit(0)).cast(_EXACT),
        "weights": F.sum("weight").over(Window.partitionBy(*by)).cast(_EXACT),
    })
    left, rest = F.col("whole").cast(_EXACT) - F.col("used"), F.col("weights") - F.col("behind")
    served = F.col("capacity").cast(_EXACT) * rest <= left * F.col("weight").cast(_EXACT)
    # The first child that is not served in full, and all after it, share what is left by weight.
    marked = summed.withColumn("open", F.when(~served, F.struct(
        left.alias("left"), rest.alias("rest"))))
    first = F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("level", first).select(
        *children.columns,
        F.when(F.col("level").isNull(), F.col("capacity"))
        .otherwise(F.floor(F.expr("level.left * weight / level.rest"))).cast("long").alias("budget"),
    )


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with the tokens each is to give."""
    base = leaves.withColumn("capacity", F.col("tokens") * plan.max_epochs)
    sources = base.withColumn("weight", F.expr(plan.source_weight).cast("long"))
    usable = sources.filter("weight > 0")
    langs = usable.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn(
        "weight", F.expr(plan.language_weight).cast("long"))
    domains = langs.filter("weight > 0").groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn(
        "weight", F.expr(plan.domain_weight).cast("long")).withColumn("root", F.lit(0))
    total = leaves.agg(F.expr(f"sum(tokens) * {plan.share} div 1000").alias("budget")).withColumn("root", F.lit(0))
    root = total.select("root", "budget")
    domain_budgets = written(_divide(domains, root, ["root"], "domain"), "budgets")
    lang_budgets = written(_divide(langs, domain_budgets, ["domain"], "lang"), "budgets")
    return _divide(sources, lang_budgets, ["domain", "lang"], "source")


def mix(docs: DataFrame, plan: Plan = PLAN, seed: int = SEED, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The chosen rows, with the columns of ``docs`` and ``epoch`` (from 0; in place of a column
    so named). A row chosen in several epochs comes once for each."""
    keys = written(
        docs.withColumn("domain", F.expr(plan.domain)).select(
            F.col(id_col).cast("string").alias("id"), "domain", F.col(lang_col).alias("lang"),
            F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("tokens"),
        ),
        "mix-keys",
    )
    leaf = ["domain", "lang", "source"]
    leaves = written(keys.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), "leaves")
    shares = written(
        budgets(leaves, plan).select(
            *leaf, F.expr("budget div tokens").cast("int").alias("whole"),
            F.expr("budget % tokens").alias("rest"), F.lit("").alias("head"),
        ),
        "shares",
    )

    # In each round, the beginning of the draw within which the prefix ends gets longer.
    def same(a: DataFrame, b: DataFrame):
        cond = F.lit(True)
        for c in leaf:
            cond = cond & a[c].eqNullSafe(b[c])
        return cond

    def drawn(levels: DataFrame) -> DataFrame:
        rows = keys.join(levels, same(keys, levels)).select(
            *(keys[c] for c in leaf), "tokens", draw(F.col("id"), F.col("whole"), seed).alias("draw"),
            "whole", "rest", "head",
        )
        return rows.filter(F.col("draw").startswith(F.col("head")))

    for digits in (*_DIGITS, 32):
        by = drawn(shares).groupBy(*leaf, "whole", "rest", F.substring("draw", 1, digits).alias("head")).agg(
            F.sum("tokens").alias("tokens"))
        upto = Window.partitionBy(*leaf).orderBy("head").rowsBetween(Window.unboundedPreceding, 0)
        summed = by.withColumn("sum", F.sum("tokens").over(upto))
        # The first beginning that does not fit; what lies before it is taken.
        over = summed.filter("sum > rest").groupBy(*leaf).agg(F.min(F.struct("head", "sum", "tokens", "whole", "rest")).alias("x"))
        shares_next = over.select(
            *leaf, "x.whole", (F.col("x.rest") - F.col("x.sum") + F.col("x.tokens")).alias("rest"), F.col("x.head").alias("head"),
        )
        shares = written(shares_next, "shares")

    # ``head`` is now the first whole draw left out; rows before it have one epoch more.
    (n,) = fresh(docs, "whole_epochs")
    names = dict(zip(("domain", *leaf[1:], "head"), fresh(docs, "leaf_domain", "leaf_lang", "leaf_source", "leaf_head")))
    cut = shares.select(*(F.col(c).alias(names[c]) for c in (*leaf, "head")), F.col("whole").alias(n))
    own = {"domain": F.expr(plan.domain), "lang": F.col(lang_col), "source": F.col(source_col)}
    (dom,) = fresh(docs, "domain_key")
    seen = docs.withColumn(dom, own["domain"])
    cond = F.col(dom).eqNullSafe(F.col(names["domain"]))
    cond = cond & F.col(lang_col).eqNullSafe(F.col(names["lang"])) & F.col(source_col).eqNullSafe(F.col(names["source"]))
    joined = seen.join(cut, cond)
    times = F.col(n) + (draw(F.col(id_col), F.col(n), seed) < F.col(names["head"])).cast("int")
    keep = [c for c in docs.columns if c.lower() != "epoch"]
    return joined.filter(times > 0).select(
        *keep, F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch")
    )


_DOMAIN, _DW, _LW, _SW = PLAN[:4]


def _share_sql(name: str, rows: str, parents: str, link: str, by: str, key: str) -> str:
    return f"""
    {name}_a as (
      select c.*, p.budget as whole, sum(c.weight) over (partition by {by}) as weights,
             coalesce(sum(c.capacity) over w, 0) as used, coalesce(sum(c.weight) over w, 0) as behind
      from {rows} c join {parents} p on {link} where c.weight > 0 and c.capacity > 0
      window w as (partition by {by} order by c.capacity::double / c.weight, c.{key} nulls first
                   rows between unbounded preceding and 1 preceding)),
    {name}_b as (
      select *, first_value(case when capacity::hugeint * (weights - behind) > (whole - used)::hugeint * weight
                                 then [(whole - used)::hugeint, (weights - behind)::hugeint] end ignore nulls) over (
               partition by {by.replace('c.', '')} order by capacity::double / weight, {key} nulls first
               rows between unbounded preceding and current row) as lv
      from {name}_a),
    {name}_s as (
      select * exclude (lv), cast(case when lv is null then capacity else lv[1] * weight // lv[2] end as bigint) as budget
      from {name}_b)"""


MIX_SQL = f"""
    k as (
      select *, {_DOMAIN} as domain, cast(greatest(len(list_filter(string_split_regex(
               coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 1) as bigint) as tokens from docs),
    leaves as (select domain, lang, source, sum(tokens)::bigint as tokens from k group by all),
    sources as (
      select *, tokens * {PLAN.max_epochs} as capacity, {_SW} as weight from leaves),
    langs as (select domain, lang, sum(capacity) as capacity, {_LW} as weight from sources where weight > 0 group by domain, lang),
    domains as (select domain, sum(capacity) as capacity, {_DW} as weight, 0 as root from langs where weight > 0 group by domain),
    root as (select sum(tokens) * {PLAN.share} // 1000 as budget, 0 as root from leaves),
    {_share_sql("d", "domains", "root", "c.root = p.root", "c.root", "domain")},
    {_share_sql("l", "langs", "d_s", "c.domain is not distinct from p.domain", "c.domain", "lang")},
    {_share_sql("s", "sources", "l_s", "c.domain is not distinct from p.domain and c.lang is not distinct from p.lang",
                "c.domain, c.lang", "source")},
    e as (
      select k.*, budget // s.tokens as whole, budget % s.tokens as rest,
             md5('{SEED}:' || (budget // s.tokens) || ':' || coalesce(cast(doc_id as varchar), '')) as draw
      from k join s_s s on k.domain is not distinct from s.domain and k.lang is not distinct from s.lang
        and k.source is not distinct from s.source),
    t as (
      select *, whole + case when sum(tokens) over (
               partition by domain, lang, source order by draw) <= rest then 1 else 0 end as times from e),
    mixed as (select *, unnest(range(cast(times as bigint))) as epoch from t)"""


@query(
    "op3_source_mixing",
    f"""with docs as (select * from documents), {MIX_SQL}
    select doc_id, lang, source, cast(epoch as integer) as epoch from mixed""",
)
def _op3(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "epoch")
