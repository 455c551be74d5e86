"""Host-level quality rules, in DataFrame operations only.

Each document gets counts and rule failures. Failures are summed by host (``source``); a beta prior is fitted to the
hosts' rates by moments (empirical Bayes) and shrinks each host's rate towards the mean of all hosts, so that hosts with
few documents are not judged on noise. Hosts whose shrunk rate of any rule exceeds ``max_rate`` are rejected, and
the verdict is joined back to the documents.

Null text has no words (and so fails); a null source is a host of its own; repeated rows count once each and are all
returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]"
SYMBOLS = "#*$%&|<>"
RULES = ("short", "repetitive", "symbols", "lines")
#: A fitted prior weighs at least and at most as much as so many documents.
STRENGTH = (2.0, 1000.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: str) -> Column:
    """Words covered by 5-word windows that occur at least twice in the array column ``w``, the first place included.

    Windows are compared by 64-bit hash. Only texts with a repeat sort their windows: n log n, whatever repeats.
    """
    n = F.size(w)
    seq = F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0)))
    key = lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(5)])

    def covered(windows: Column) -> Column:
        sorted_ = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, j: F.coalesce(x.h == F.get(s, j - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(s, j + 1).h, F.lit(False)))
        starts = let(sorted_, lambda s: F.sort_array(F.transform(twice(s), lambda x: x.i)))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, j: F.when(j == 0, 5).otherwise(F.least(F.lit(5), x - F.get(p, j - 1)))), F.lit(0), lambda a, x: a + x))

    some = let(F.transform(seq, key), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 6, F.lit(0)).otherwise(some).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, source, counts, rule failures) of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"), F.array_remove(F.split(text, SPACE + "+"), "").alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    counted = split.select(
        "doc_id", "source", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
        repeat_words("w").alias("n_repeat_words"),
    ).select("doc_id", "source", "n_words", "word_chars", "n_symbols", "lines.n_lines", "lines.n_dup_lines", "n_repeat_words")
    failures = {
        "short": F.col("n_words") < 10,
        "repetitive": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }
    return counted.withColumns({f"fails_{k}": v for k, v in failures.items()})


def host_rates(measured: DataFrame) -> DataFrame:
    """(source, n_docs, rate_<rule>): failure rates by host, shrunk by the beta prior fitted over all hosts."""
    hosts = measured.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES])
    moments = hosts.agg(*[x for r in RULES for x in ((F.sum(r) / F.sum("n_docs")).alias(f"m_{r}"), F.coalesce(F.var_samp(F.col(r) / F.col("n_docs")), F.lit(0.0)).alias(f"v_{r}"))])

    def prior(r: str) -> Column:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(STRENGTH[1])
        return F.struct(m.alias("mean"), strength.alias("strength")).alias(r)

    priors = moments.select(F.struct(*[prior(r) for r in RULES]).alias("p"))
    shrunk = hosts.withColumn("p", priors.scalar())
    return shrunk.select("source", "n_docs", *[((F.col(r) + F.col(f"p.{r}.mean") * F.col(f"p.{r}.strength")) / (F.col("n_docs") + F.col(f"p.{r}.strength"))).alias(f"rate_{r}") for r in RULES])


def judge(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``host_failed`` and ``kept``.

    Counts are taken once and written to the shared checkpoint folder; the host verdicts join back to that table.
    The join carries no hint: a small host table is broadcast by its measured size, a large one is shuffled.
    """
    from .store import stored

    measured = stored(measure(docs))
    verdicts = host_rates(measured).select(F.col("source").alias("host"), F.greatest(*[F.col(f"rate_{r}") for r in RULES]).alias("host_rate"))
    joined = measured.join(verdicts, measured.source.eqNullSafe(verdicts.host), "left")
    base = F.col("fails_short") | F.col("fails_repetitive")
    host = F.coalesce(F.col("host_rate") > max_rate, F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~host).alias("kept"), host.alias("host_failed"))


#: The same verdicts in SQL, over the view ``documents``.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, ws[i:i + 4] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(5, coalesce(i - p, 5))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS l FROM d),
m AS (SELECT d.doc_id, d.source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) JOIN ln USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repetitive, 10 * n_symbols > word_chars AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines FROM m),
h AS (SELECT source, count(*) AS n, sum(short::INT) AS f1, sum(repetitive::INT) AS f2, sum(symbols::INT) AS f3, sum(lines::INT) AS f4 FROM f GROUP BY source),
long AS (SELECT source, n, unnest([f1, f2, f3, f4]) AS x, unnest([1, 2, 3, 4]) AS rule FROM h),
p AS (SELECT rule, sum(x) / sum(n) AS mean, coalesce(var_samp(x / n), 0) AS v FROM long GROUP BY rule),
s AS (SELECT rule, mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, 2.0), 1000.0) ELSE 1000.0 END AS strength FROM p),
verdict AS (SELECT source, max((x + mean * strength) / (n + strength)) > 0.5 AS host_failed FROM long JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (short OR repetitive) AS base_failed, (NOT short AND NOT repetitive AND NOT host_failed) AS kept, host_failed
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""
