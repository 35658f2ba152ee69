"""Quality rules judged with their hosts, in DataFrame and SQL functions only (operator 9).

A document fails the base rules if it has fewer than ``MIN_WORDS`` words, or if over
``MOST_REPEATED`` percent of its words lie in 8-word windows found twice or more in it.
Failures are counted by host (``source``). A small host's rate says little, so rates are
shrunk towards all hosts' by a beta prior, fitted to the hosts' rates by moments: a host with
``f`` failures in ``n`` documents gets ``(f + a) / (n + a + b)``. A document is kept if it
passes itself and its host's shrunk rate is at most ``WORST_HOST``.

Null and empty texts have no words and fail. A null source is a host of its own; ids are not
looked at, so null and repeated ids and repeated rows count as documents of their own. An
empty table gives no rows. Equal windows are found by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import stored

MIN_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30
WORST_HOST = 0.5

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
_SPACES = r"' \t\n\u000B\u000C\r'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated(words: str) -> str:
    """Words in windows that the text has twice or more, the first included."""
    # Windows are hashed from the words' hashes: slices of the words would be copied.
    window = ", ".join(f"g[i + {k}]" for k in range(WINDOW))
    hashes = f"transform(sequence(0, size(g) - {WINDOW}), i -> xxhash64({window}))"
    same = "(k > 0 and s[k - 1].v = x.v) or (k < size(s) - 1 and s[k + 1].v = x.v)"
    starts = "sort_array(transform(filter(s, (x, k) -> " + same + "), x -> x.i))"
    covered = (
        "aggregate(" + starts + ", named_struct('n', 0L, 'at', -1000),"
        f" (a, x) -> named_struct('n', a.n + least({WINDOW}, x - a.at), 'at', x), a -> a.n)"
    )
    pairs = "sort_array(transform(h, (v, i) -> named_struct('v', v, 'i', i)))"
    some = f"if(size(array_distinct(h)) = size(h), 0L, {_let(pairs, 's', covered)})"
    found = _let(f"transform({words}, x -> xxhash64(x))", "g", _let(hashes, "h", some))
    return f"if(size({words}) <= {WINDOW}, 0L, {found})"


def measures(docs: DataFrame) -> DataFrame:
    """The counts of the base rules, and whether a document fails them.

    They replace columns of the same names.
    """
    docs = docs.drop(*COLUMNS[1:], "_body", "_words", "_host", "_rate")
    trimmed = docs.selectExpr("*", f"trim(both {_SPACES} from coalesce(text, '')) _body")
    split = trimmed.selectExpr("*", r"if(_body = '', cast(array() as array<string>), split(_body, '[ \\t-\\r]+')) _words")
    counted = split.selectExpr(
        "*",
        "cast(size(_words) as long) n_words",
        f"cast(length(translate(_body, {_SPACES}, '')) as long) word_chars",
        "cast(length(_body) - length(translate(_body, '#*$%&|<>', '')) as long) n_symbols",
        _let(_lines(), "l", "cast(size(l) - size(array_distinct(l)) as long)") + " n_dup_lines",
        f"{_let('_words', 'w', _repeated('w'))} n_repeat_words",
    )
    return counted.drop("_body", "_words").withColumn(
        "base_failed",
        F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"),
    )


def _lines() -> str:
    return rf"filter(split(coalesce(text, ''), '\\n'), x -> trim(both {_SPACES} from x) <> '')"


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """Failures, documents and shrunk failure rate of each host."""
    counts = judged.groupBy(F.col(host).alias("_host")).agg(
        F.count_if("base_failed").alias("_failed"), F.count(F.lit(1)).alias("_docs")
    )
    hosts = stored(counts, "hosts")  # read twice, for the prior and for the rates
    # Moments of the rates; k = a + b, the documents that the prior is worth.
    moments = hosts.agg(
        (F.sum("_failed") / F.sum("_docs")).alias("_mean"),
        F.var_samp(F.col("_failed") / F.col("_docs")).alias("_var"),
        F.avg(1 / F.col("_docs")).alias("_inverse"),
    )
    spread = F.expr("coalesce(_var - _mean * (1 - _mean) * _inverse, 0)")
    prior = moments.select(
        "_mean",
        F.when(spread <= 0, F.lit(1e6)).otherwise(F.greatest(F.expr("_mean * (1 - _mean)") / spread - 1, F.lit(1.0))).alias("_worth"),
    )
    one = prior.select(F.struct("_mean", "_worth").alias("p")).scalar()
    return hosts.select(
        "_host",
        ((F.col("_failed") + one["_mean"] * one["_worth"]) / (F.col("_docs") + one["_worth"])).alias("_rate"),
    )


def judge(measured: DataFrame, rates: DataFrame, host: str = "source", worst: float = WORST_HOST) -> DataFrame:
    """Rows of ``measures`` with the verdict that also looks at their host."""
    rejected = rates.filter(F.col("_rate") > worst)
    return (
        measured.join(rejected, measured[host].eqNullSafe(rejected["_host"]), "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("_rate").isNull())
        .drop("_host", "_rate")
    )


def host_rules(docs: DataFrame, host: str = "source", worst: float = WORST_HOST) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``.

    The texts are measured for the hosts' rates and again for the result: storing them between
    would copy the corpus.
    """
    return judge(measures(docs), host_rates(measures(docs), host), host, worst)


def query(spark, sf_dir):
    from strata.llm.common import read

    measured = measures(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    measured = stored(measured, "quality")
    return judge(measured, host_rates(measured)).select(*COLUMNS)


ORACLE = r"""
WITH base AS (
    SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), parts AS (
    SELECT *, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS words,
        regexp_extract_all(text, '[^\n]*[^ \t\n\x0b\f\r][^\n]*') AS lines
    FROM base
), windows AS (
    SELECT rid, unnest(range(1, len(words) - 6)) AS pos, words FROM parts WHERE len(words) > 8
), keyed AS (
    SELECT rid, pos, array_to_string(list_slice(words, pos, pos + 7), ' ') AS key FROM windows
), twice AS (
    SELECT rid, pos FROM keyed QUALIFY count(*) OVER (PARTITION BY rid, key) > 1
), covered AS (
    SELECT rid, sum(least(8, pos - before)) AS n FROM (
        SELECT rid, pos, coalesce(lag(pos) OVER (PARTITION BY rid ORDER BY pos), -1000) AS before FROM twice
    ) GROUP BY rid
), measured AS (
    SELECT p.doc_id, p.source, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM parts p LEFT JOIN covered c USING (rid)
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
), hosts AS (
    SELECT source, count(*) FILTER (WHERE base_failed) AS failed, count(*) AS docs FROM judged GROUP BY source
), moments AS (
    SELECT sum(failed) / sum(docs) AS mean, coalesce(var_samp(failed / docs) - mean * (1 - mean) * avg(1 / docs), 0) AS spread
    FROM hosts
), prior AS (
    SELECT mean, CASE WHEN spread <= 0 THEN 1e6 ELSE greatest(mean * (1 - mean) / spread - 1, 1.0) END AS worth FROM moments
), rejected AS (
    SELECT source FROM hosts, prior WHERE (failed + mean * worth) / (docs + worth) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT EXISTS (SELECT 1 FROM rejected r WHERE r.source IS NOT DISTINCT FROM j.source) AS kept
FROM judged j
"""
