"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: a naive Bayes model of hashed byte trigrams of the lower-cased words. Its log-likelihood
  counts like that of ``TEXT_WEIGHT`` trigrams at most, as neighbouring trigrams are not independent.
* Declared language (an attribute of the markup or a column): right with ``DECLARED_RIGHT``.
* Address suffix, such as ``.fr`` or a path that begins with ``/fr/``: right with ``SUFFIX_RIGHT``.
* Host: how often each language is the likeliest by text among all rows of the host, smoothed with
  the same of its domain, which is smoothed with that of all rows, ``SMOOTHING`` rows' worth each.

The languages are the ``MAX_LANGUAGES`` most often declared ones with ``MIN_DECLARED`` rows or more.
The text model is fitted on a sample, about ``FIT_ROWS`` rows of each language (a bound on fitting
only); the host counts cover all rows and are partial sums before they are shuffled. Rows are
shuffled only if the table of hosts is too large to broadcast.

``kept`` is true if the row's best language reaches ``MIN_POSTERIOR`` and the text has any word with
letters. NULL and empty texts have no text evidence and are not kept. NULL or unknown declared
languages, addresses and hosts are neutral; a NULL host is a host of its own. Without any language
to choose from, ``language`` is NULL and nothing is kept. Repeated rows agree; an empty table gives
an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.support import fresh, small_batches, table, written
from emberlog.llm.words import slices, utf8

CELLS = 1 << 16
FIT_ROWS = 1000
MIN_DECLARED = 5
MAX_LANGUAGES = 64
TEXT_WEIGHT = 60.0
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.8
SMOOTHING = 10.0
MIN_POSTERIOR = 0.6

# Languages that a suffix of a host or the first part of a path speaks for.
SUFFIX_LANGUAGES = {
    "at": "de", "ch": "de", "de": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "uk": "en",
    "us": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "se": "sv",
}


def trigram_cells(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By slices: first row, number of rows, and (row, cell) of the trigrams of words. A trigram
    is three bytes with at most a blank on one side; bytes other than letters are blanks."""
    data, bounds = utf8(column)
    codes = np.arange(256, dtype=np.uint32)
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    letter = ((lower >= 97) & (lower <= 122)) | (codes >= 128)
    fold = np.where(letter, lower, 0).astype(np.uint32)
    for a, b in slices(bounds):
        text = fold[data[bounds[a] : bounds[b]]]
        if len(text) < 3:
            yield a, b - a, np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        code = (text[:-2] << 16) | (text[1:-1] << 8) | text[2:]
        row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        good = (text[1:-1] != 0) & ((text[:-2] != 0) | (text[2:] != 0)) & (row[:-2] == row[2:])
        cell = (code[good] * np.uint32(0x9E3779B1)) >> np.uint32(16)
        yield a, b - a, row[:-2][good], cell.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, text) to the counts of cells of each language in this task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        for first, rows, row, cell in trigram_cells(batch.column(1)):
            own = names[first : first + rows]
            for name in set(own):
                total = totals.setdefault(name, np.zeros(CELLS, np.int64))
                total += np.bincount(cell[(own == name)[row]], minlength=CELLS)
    for name, total in totals.items():
        yield pa.RecordBatch.from_pydict({"language": [name], "counts": [zlib.compress(total.tobytes(), 1)]})


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, counts in zip(*(c.to_pylist() for c in batch.columns)):
            totals.setdefault(name, np.zeros(CELLS, np.int64))
            totals[name] += np.frombuffer(zlib.decompress(counts), np.int64)
    for name, total in totals.items():
        yield pa.RecordBatch.from_pydict({"language": [name], "counts": [zlib.compress(total.tobytes(), 1)]})


def known_languages(docs: DataFrame, declared: str) -> dict[str, int]:
    """Declared languages with their rows, at most ``MAX_LANGUAGES``."""
    rows = (
        docs.filter(F.col(declared).isNotNull()).groupBy(F.col(declared).alias("language"))
        .agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DECLARED)
        .orderBy(F.desc("n"), "language").limit(MAX_LANGUAGES).collect()
    )
    return dict(sorted((r["language"], r["n"]) for r in rows))


def fit(docs: DataFrame, declared: str, text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages, and the log-probability of each cell in each of them."""
    sizes = known_languages(docs, declared)
    if not sizes:
        return [], np.zeros((CELLS, 0), np.float32)
    draw = F.pmod(F.xxhash64(text_col), F.lit(1_000_000))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1e6, 1e6 * FIT_ROWS / n))))
    schema = "language string, counts binary"
    rows = (
        docs.filter(F.col(declared).isin(list(sizes)) & (draw < share[F.col(declared)]))
        .select(F.col(declared).alias("language"), F.col(text_col).alias("text"))
        .mapInArrow(_count, schema).repartition("language").mapInArrow(_sum, schema).collect()
    )
    found = {r["language"]: np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in rows}
    counts = np.stack([found.get(k, np.zeros(CELLS, np.int64)) for k in sizes], axis=1) + 0.5
    return list(sizes), np.log(counts / counts.sum(axis=0)).astype(np.float32)


def text_evidence(docs: DataFrame, model: np.ndarray):
    """A column function: log-likelihood of a text in each language; NULL without a trigram."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def evidence(text: pa.Array) -> pa.Array:
        table_ = shared.value
        out = []
        for _, rows, row, cell in trigram_cells(text):
            n = np.bincount(row, minlength=rows)
            total = np.stack(
                [np.bincount(row, weights=table_[cell, k], minlength=rows) for k in range(table_.shape[1])],
                axis=1,
            ) if table_.shape[1] else np.zeros((rows, 0))
            scaled = total * (np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1))[:, None]
            out += [x if k else None for x, k in zip(scaled, n)]
        return pa.array(out, pa.list_(pa.float64()))

    return evidence


def _best(evidence: Column) -> Column:
    """The place of the largest entry, 0-based; NULL for NULL."""
    return F.array_position(evidence, F.array_max(evidence)).cast("int") - 1


def host_priors(rows: DataFrame, count: int, smoothing: float = SMOOTHING) -> DataFrame:
    """(host, domain, prior): the log-prior of each of ``count`` languages for every host of rows
    (host, domain, best)."""
    def counted(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(*(F.sum(F.when(F.col("best") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(count)))

    def again(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(count)))

    hosts = written(counted(rows, "host", "domain"), "hosts")
    domains = again(hosts, "domain")
    top = again(domains).first()
    total = sum((top[f"n{i}"] or 0) for i in range(count)) + count
    everywhere = [((top[f"n{i}"] or 0) + 1) / total for i in range(count)]

    def smooth(prior: Sequence[Column]) -> list[Column]:
        n = sum((F.col(f"n{i}") for i in range(count)), F.lit(0))
        return [(F.col(f"n{i}") + F.lit(smoothing) * prior[i]) / (n + F.lit(smoothing)) for i in range(count)]

    d = domains.select(
        F.col("domain").alias("d"), *(p.alias(f"p{i}") for i, p in enumerate(smooth([F.lit(x) for x in everywhere])))
    )
    joined = hosts.join(d, F.col("domain").eqNullSafe(F.col("d")))
    prior = smooth([F.col(f"p{i}") for i in range(count)])
    return joined.select("host", "domain", F.array(*(F.log(p) for p in prior)).alias("prior"))


def address_language(address: Column) -> Column:
    """The language that an address speaks for: by the first part of its path, else by the last
    label of its host; NULL if by neither."""
    known = F.create_map(*(F.lit(x) for pair in SUFFIX_LANGUAGES.items() for x in pair))
    codes = F.create_map(*(F.lit(x) for k in sorted(set(SUFFIX_LANGUAGES.values())) for x in (k, k)))
    path = F.lower(F.regexp_extract(address, r"(?s)^.*?://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.lower(F.regexp_extract(address, r"(?s)^.*?://[^/?#]*\.([A-Za-z]+)(?::\d+)?(?:[/?#]|$)", 1))
    return F.coalesce(codes[path], known[suffix])


def identify(docs: DataFrame, declared: str, host: str, text_col: str = "text",
             address: str | None = None) -> DataFrame:
    """``docs`` with ``language``, ``posterior`` and ``kept``, in place of columns so named."""
    small_batches(docs.sparkSession)
    languages, model = fit(docs, declared, text_col)
    keep = [c for c in docs.columns if c.lower() not in ("language", "posterior", "kept")]
    if not languages:
        return docs.select(*keep, F.lit(None).cast("string").alias("language"),
                           F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("kept"))
    evidence = text_evidence(docs, model)
    text, h, dom, prior_h, prior_d = fresh(docs, "evidence", "host_key", "domain_key", "prior_host", "prior_domain")
    host_domain = F.substring_index(F.col(host).cast("string"), ".", -2)
    # Written, so that its size is known when the join with the documents is planned.
    priors = written(host_priors(
        docs.select(F.col(host).cast("string").alias("host"), host_domain.alias("domain"),
                    evidence(F.col(text_col)).alias("e")).select("host", "domain", _best(F.col("e")).alias("best")),
        len(languages),
    ), "priors").select(F.col("host").alias(prior_h), F.col("domain").alias(prior_d), "prior")
    (prior,) = fresh(docs, "log_prior")
    priors = priors.withColumnRenamed("prior", prior)
    seen = docs.withColumns({h: F.col(host).cast("string"), dom: host_domain})
    joined = seen.join(priors, F.col(h).eqNullSafe(F.col(prior_h)) & F.col(dom).eqNullSafe(F.col(prior_d)), "left")
    known = joined.withColumn(text, evidence(F.col(text_col)))

    def speaks(value: Column, right: float) -> Column:
        """Log-evidence of a named language: NULL or an unknown one says nothing."""
        wrong = (1 - right) / max(1, len(languages) - 1)
        return F.when(
            F.coalesce(value.isin(languages), F.lit(False)),
            F.array(*(F.when(value == k, float(np.log(right))).otherwise(float(np.log(wrong))) for k in languages)),
        ).otherwise(F.array(*(F.lit(0.0) for _ in languages)))

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    flat = F.array(*(F.lit(0.0) for _ in languages))
    total = plus(F.coalesce(F.col(text), flat), F.coalesce(F.col(prior), flat))
    total = plus(total, speaks(F.col(declared), DECLARED_RIGHT))
    if address is not None:
        total = plus(total, speaks(address_language(F.col(address)), SUFFIX_RIGHT))
    (sums,) = fresh(known, "sums")
    fused = known.withColumn(sums, total)
    most = F.array_max(sums)
    share = F.lit(1.0) / F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + F.exp(x - most))
    names = F.array(*(F.lit(k) for k in languages))
    return fused.select(
        *keep, names[_best(F.col(sums))].alias("language"), share.alias("posterior"),
        (F.col(text).isNotNull() & (share >= MIN_POSTERIOR)).alias("kept"),
    )


def keep_identified(docs: DataFrame, declared: str = "lang", host: str = "source", text_col: str = "text") -> DataFrame:
    """The rows whose language is identified, with the columns of ``docs``."""
    flagged = identify(docs.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(docs.columns))), *(
        f"c_{docs.columns.index(c)}" for c in (declared, host, text_col)
    ))
    return flagged.filter("kept").select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)))


@query("op7_language_id")
def _op7(spark, sf_dir):
    out = identify(table(spark, sf_dir, "documents"), declared="lang", host="source")
    return out.select("doc_id", "lang", "language", "posterior", "kept")
