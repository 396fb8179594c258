"""Quality rules with host verdicts, in DataFrame functions only.

A document fails the base rules with fewer than 20 words, or with over 30 % of its words in
8-word windows that occur twice or more in it. The failure rates of hosts are shrunk by a
beta prior fitted to all hosts (method of moments), so a host of a few documents is judged
mostly by what is usual; a host whose shrunk rate is above ``HOST_LIMIT`` loses all documents.

Nulls and ties: a null text has no words and fails. Documents without a host are judged by
the base rules alone and belong to no host. Repeated rows count as often as they occur. An
empty table gives no rows. Columns named like the measures are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.functions.binding import let
from mailrank.llm.common import carrying, table, words, written

MIN_WORDS = 20
REPEATED_PERCENT = 30
WINDOW = 8
HOST_LIMIT = 0.5


def repeated_words(w: Column) -> Column:
    """Words in windows of ``WINDOW`` words that the array holds twice or more.

    Equal windows have equal hashes, so a text whose window hashes are all different has none;
    the others are compared by their words.
    """
    none = F.lit(0).cast("bigint")
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, none, lambda total, x: total + x)

    def exact(_: Column) -> Column:
        texts = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("s"), i.alias("i")))

        def again(s: Column) -> Column:
            near = F.transform(
                s,
                lambda x, k: F.struct(
                    x["i"].alias("i"),
                    ((x["s"] == F.get(s, k - 1)["s"]) | (x["s"] == F.get(s, k + 1)["s"])).alias("twice"),
                ),
            )
            return F.sort_array(F.transform(F.filter(near, lambda x: x["twice"]), lambda x: x["i"]))

        return let(let(F.sort_array(texts), again), covered)

    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(exact(h)))
    return F.when(F.size(w) < WINDOW, none).otherwise(found)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures and ``base_failed``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measures(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    out = docs.withColumn("_m", let(words(F.col(text)), measures))
    out = out.withColumns(
        {
            "n_words": F.col("_m.n_words"),
            "word_chars": F.col("_m.word_chars"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
            "n_repeat_words": F.col("_m.n_repeat_words"),
        }
    ).drop("_m")
    repeated = F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeated)


def host_verdicts(rows: DataFrame, host: str = "source") -> DataFrame:
    """``host, host_rate, host_rejected`` from rows with ``base_failed``; one row for each host."""
    failed = F.sum(F.col("base_failed").cast("bigint"))
    hosts = rows.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n"), failed.alias("f"))
    prior = hosts.select((F.col("f") / F.col("n")).alias("r")).agg(F.avg("r").alias("mean"), F.var_pop("r").alias("spread"))
    free = F.col("mean") * (1 - F.col("mean"))
    # How many documents the prior weighs; null where all hosts have one rate.
    prior = prior.select("mean", F.when(F.col("spread") > 0, F.greatest(free / F.col("spread") - 1, F.lit(0.0))).alias("strength"))
    mean, strength = prior.select("mean").scalar(), prior.select("strength").scalar()
    shrunk = hosts.withColumns({"mean": mean, "strength": strength})
    rate = (F.col("f") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    shrunk = shrunk.select(host, F.coalesce(rate, F.col("mean")).alias("host_rate"))
    return shrunk.withColumn("host_rejected", F.col("host_rate") > HOST_LIMIT)


def judged(rows: DataFrame, host: str = "source") -> DataFrame:
    """Measured rows with ``kept``. ``rows`` is read twice, so it should be a written table."""
    verdicts = written(host_verdicts(rows, host).select(host, "host_rejected"), "host-verdicts")
    out = rows.drop("host_rejected").join(verdicts, host, "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))).drop("host_rejected")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = written(measured(docs).select("doc_id", "source", *MEASURES, "base_failed"), "measured")
    return judged(rows).select("doc_id", *MEASURES, "base_failed", "kept")


@carrying
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are kept, with the columns they came with, of any name."""
    names = docs.columns
    flagged = measured(docs).select(*names, "base_failed")
    # Texts of failed rows are not needed again, the rows count for their hosts.
    rows = written(flagged.withColumn("text", F.when(~F.col("base_failed"), F.col("text"))), "flagged")
    return judged(rows).where("kept").select(*names)


MEASURED_SQL = r"""
  base_words AS (
    SELECT row_number() OVER () AS rid, *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM {documents}
  ),
  spots AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM base_words),
  windows AS (
    SELECT rid, pos, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o,
                      lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o] AS s
    FROM spots WINDOW o AS (PARTITION BY rid ORDER BY pos)
  ),
  twice AS (SELECT rid, pos FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS c FROM windows WHERE s[8] IS NOT NULL) WHERE c > 1),
  covered AS (
    SELECT rid, sum(least(8, coalesce(after - pos, 8)))::BIGINT AS n
    FROM (SELECT rid, pos, lead(pos) OVER (PARTITION BY rid ORDER BY pos) AS after FROM twice) GROUP BY rid
  ),
  measured AS (
    SELECT b.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
           (len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
            - len(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)),
                                            lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
           coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM base_words b LEFT JOIN covered c USING (rid)
  ),
  flagged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
  hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM flagged WHERE source IS NOT NULL GROUP BY source),
  prior AS (
    SELECT mean, CASE WHEN spread > 0 THEN greatest(mean * (1 - mean) / spread - 1, 0.0) END AS strength
    FROM (SELECT avg(f / n) AS mean, var_pop(f / n) AS spread FROM hosts)
  ),
  verdicts AS (
    SELECT source, coalesce((f + mean * strength) / (n + strength), mean) > 0.5 AS rejected FROM hosts, prior
  ),
  judged AS (
    SELECT f.*, NOT base_failed AND NOT coalesce(rejected, false) AS kept FROM flagged f LEFT JOIN verdicts v USING (source)
  )"""

SQL = f"""
WITH {MEASURED_SQL.format(documents="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""
