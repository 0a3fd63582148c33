"""Host-level quality rules in DataFrame functions only.

`text_counts` derives per-document counts from the whole text; `host_verdicts` adds each rule's failures up by host
(partial sums before the shuffle, so a host with a third of all rows is one row per task), shrinks the hosts' failure
rates towards an empirical beta prior, and `apply_verdicts` joins the verdicts back.

A document is kept unless it fails a rule itself or its host's shrunk failure rate of some rule is above that rule's
limit. The join back is Spark's choice at run time: hosts are broadcast only if their measured size is below
spark.sql.autoBroadcastJoinThreshold, else shuffled with skewed hosts split.

Defined results: a null text has no words and fails; a null source is a host of its own; repeated rows count and
return as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, staged, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Limits of the shrunk failure rate of a host.
HOST_LIMIT = 0.5
#: Documents that the prior weighs at most.
PRIOR_LIMIT = 1000.0



def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts over the whole text.

    Windows that occur twice are found from the number of distinct window hashes first; only texts where those clash
    compare the windows themselves, sorted, in linear space.
    """
    d = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", WORD_GAP), lambda x: x != ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0))
    d = d.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    n = WINDOW - 1
    window_hash = ", ".join(f"hashes[i + {k}]" for k in range(WINDOW))
    d = d.withColumn("marks", F.expr(f"if(size(hashes) > {n}, transform(slice(hashes, 1, size(hashes) - {n}), (h, i) -> xxhash64({window_hash})), array())"))
    d = d.withColumn("suspect", F.size("marks") > F.size(F.array_distinct("marks")))
    d = d.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("suspect"), F.col("words")).alias("words"),
    )
    d = d.withColumn("windows", F.expr(f"if(words is null, null, sort_array(transform(slice(words, 1, size(words) - {n}), (x, i) -> struct(concat_ws(' ', slice(words, i + 1, {WINDOW})) as w, i as i))))"))
    d = d.withColumn("at", F.expr("if(windows is null, null, sort_array(transform(filter(windows, (x, i) -> (i > 0 and x.w = windows[i - 1].w) or (i < size(windows) - 1 and x.w = get(windows, i + 1).w)), x -> x.i)))"))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("words", "windows", "at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def rules() -> dict[str, Column]:
    """What a document can fail: the base rules, symbols on many words, mostly repeated lines."""
    return {
        "few_words": F.col("n_words") < 10,
        "repeats": F.col("n_repeat_words") * 100 > F.col("n_words") * 20,
        "symbols": F.col("n_symbols") * 100 > F.col("n_words") * 40,
        "dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * 70,
    }


def host_verdicts(counts: DataFrame, checks: dict[str, Column], limit: float = HOST_LIMIT) -> DataFrame:
    """source, host_docs, host_rejected: rejected if the shrunk rate of any rule is above the limit.

    The prior of a rule is the beta distribution with the mean and the between-host variance of the hosts' rates; where
    sampling alone explains the variance, it weighs PRIOR_LIMIT documents. Its few numbers are one row on the driver.
    """
    hosts = counts.groupBy("source").agg(F.count("*").alias("host_docs"), *[F.sum(c.cast("long")).alias(f"fails_{k}") for k, c in checks.items()])
    moments = []
    for k in checks:
        rate = F.col(f"fails_{k}") / F.col("host_docs")
        moments += [F.avg(rate).alias(f"m_{k}"), (F.avg(rate * rate) - F.avg(rate) * F.avg(rate)).alias(f"v_{k}")]
    found = hosts.agg(*moments, F.avg(1 / F.col("host_docs")).alias("inv")).first()
    rejected = F.lit(False)
    for k in checks:
        m, v, inv = (x or 0.0 for x in (found[f"m_{k}"], found[f"v_{k}"], found["inv"]))
        spread = m * (1 - m)
        between = v - spread * inv
        weight = min(PRIOR_LIMIT, max(1.0, spread / between - 1)) if between > 0 else PRIOR_LIMIT
        rejected = rejected | ((F.col(f"fails_{k}") + m * weight) / (F.col("host_docs") + weight) > limit)
    return hosts.select("source", "host_docs", rejected.alias("host_rejected"))


def apply_verdicts(counts: DataFrame, verdicts: DataFrame, checks: dict[str, Column]) -> DataFrame:
    failed = F.lit(False)
    for c in checks.values():
        failed = failed | c
    v = verdicts.withColumnRenamed("source", "host")
    return counts.join(v, counts["source"].eqNullSafe(v["host"]), "left").drop("host").withColumn("kept", ~failed & ~F.col("host_rejected"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = staged(text_counts(table(spark, sf_dir, "documents")))
    checks = rules()
    out = apply_verdicts(counts, host_verdicts(counts, checks), checks)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept", "n_lines", "host_docs", "host_rejected")


ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
win as (select rid, i, list_slice(words, i, i + 4) as w from (select rid, words, unnest(range(1, len(words) - 3)) as i from d where len(words) >= 5)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, w) as c from win) where c > 1),
cov as (select rid, sum(least(5, coalesce(nxt - i, 5))) as n from (select rid, i, lead(i) over (partition by rid order by i) as nxt from rep) group by rid),
c as (select d.doc_id, d.source, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words from d left join cov using (rid)),
f as (select *, n_words < 10 as r1, n_repeat_words * 100 > n_words * 20 as r2, n_symbols * 100 > n_words * 40 as r3, n_dup_lines * 100 > n_lines * 70 as r4 from c),
h as (select source, count(*) as n, unnest([sum(r1::int), sum(r2::int), sum(r3::int), sum(r4::int)]) as fails, unnest([1, 2, 3, 4]) as rule from f group by source),
p as (select rule, avg(fails / n) as m, avg((fails / n) * (fails / n)) - avg(fails / n) * avg(fails / n) as v, avg(1 / n) as inv from h group by rule),
q as (select rule, m, case when v - m * (1 - m) * inv > 0 then least(1000.0, greatest(1.0, m * (1 - m) / (v - m * (1 - m) * inv) - 1)) else 1000.0 end as weight from p),
g as (select source, max(n)::bigint as host_docs, bool_or((fails + m * weight) / (n + weight) > 0.5) as host_rejected from h join q using (rule) group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r1 or r2) as base_failed,
  not (r1 or r2 or r3 or r4) and not host_rejected as kept, n_lines, host_docs, host_rejected
from f join g on f.source is not distinct from g.source
"""
