"""Mixing sources to target weights, in DataFrame functions only.

A token budget runs down a tree of domain, language and source. The children of a node share
its budget by weight; none gets more than its tokens times the allowed epochs, and what a
child cannot use goes to its siblings by their weights. As a node never gets more than its
children hold together, a shortage leaves a node only when all below it are used up, and then
goes to that node's own siblings. Shares are whole tokens (largest remainders first).

A leaf with budget ``b`` and ``a`` tokens is read ``b div a`` times; the rest is a prefix of
one more epoch, in the order of a hash of seed, epoch, document and size, and the last
document of the prefix gives only the tokens that are left. The place of the cut is found
through sums over hash buckets, two levels of 256, so no task sorts a leaf.

Nulls and ties: null keys and null texts are taken as empty. Repeated rows (one id, one size)
share a place in the order, and equal parts of what is left there. Texts without tokens are
taken with every whole epoch and never in the prefix past its end. An empty table gives no
rows. Columns named like the new ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailrank.llm.common import carrying, WORD, table, written

LEVELS = ["domain", "lang", "source"]
SEED = 20
EPOCHS = 3
# Weights of the production mix; values not listed weigh 1.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 3}, "source": {}}
BUDGET_PARTS = (3, 5)  # three fifths of the corpus' tokens


def weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    return reduce(lambda c, kv: F.when(F.col(level) == kv[0], kv[1]).otherwise(c), weights.get(level, {}).items(), F.lit(1)).cast("bigint")


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``budget`` of nodes with ``w``, ``cap`` and their parent's budget ``b``; parents' caps cover ``b``.

    Sorted by how soon they are full, nodes are full up to the first whose share of what is
    left fits; the others share that by weight.
    """
    family = Window.partitionBy(*parents)
    order = family.orderBy((F.col("cap") / F.col("w")).asc(), F.col(name).asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")

    def wide(c: str) -> Column:
        return F.col(c).cast("decimal(19,0)")

    nodes = nodes.withColumns(
        {
            "_b": F.col("b") - F.coalesce(F.sum("cap").over(before), none),
            "_w": F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), none),
        }
    )
    full = (wide("cap") * wide("_w") <= wide("w") * wide("_b")).cast("int")
    nodes = nodes.withColumn("_full", full)
    nodes = nodes.withColumn("_full", F.min("_full").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    nodes = nodes.withColumns(
        {
            "_b": F.col("b") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(family), none),
            "_w": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("w"))).over(family), none),
        }
    )
    nodes = nodes.withColumns(
        {
            "_share": F.when(~F.col("_full"), F.expr("(cast(w as decimal(19,0)) * cast(_b as decimal(19,0))) div cast(_w as decimal(19,0))")),
            "_left": F.when(~F.col("_full"), F.expr("(cast(w as decimal(19,0)) * cast(_b as decimal(19,0))) % cast(_w as decimal(19,0))")),
        }
    )
    spare = F.col("_b") - F.sum("_share").over(family)
    place = F.row_number().over(family.orderBy(F.col("_left").desc_nulls_last(), F.col(name).asc()))
    nodes = nodes.withColumns({"_spare": spare, "_place": place})
    share = F.col("_share") + F.when(F.col("_place") <= F.col("_spare"), 1).otherwise(0)
    return nodes.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(share).cast("bigint"))


def leaf_budgets(sizes: DataFrame, budget: int, weights: dict, epochs: int, levels: list[str]) -> DataFrame:
    """``levels, held, budget`` for each leaf, from rows with ``levels`` and ``tokens``."""
    leaves = written(sizes.groupBy(*levels).agg(F.sum("tokens").alias("held")), "leaves")
    known = leaves.agg((F.sum("held") * epochs).alias("cap")).select(F.least(F.col("cap"), F.lit(budget).cast("bigint")).alias("b"))
    above = None
    for k, name in enumerate(levels):
        path = levels[: k + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("held") * epochs).alias("cap")).withColumn("w", weight(name, weights))
        nodes = nodes.withColumn("b", known.scalar()) if above is None else nodes.join(above, levels[:k])
        filled = fill(nodes.where("w > 0"), levels[:k], name)
        above = filled.select(*path, F.col("budget").alias("b"))
    return leaves.join(above.withColumnRenamed("b", "budget"), levels)


def _place(seed: int, epoch: Column) -> Column:
    parts = [F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tokens").cast("string")]
    return F.md5(F.concat_ws("|", *parts))


def cuts(sizes: DataFrame, budgets: DataFrame, seed: int, levels: list[str]) -> DataFrame:
    """For each leaf ``whole`` (epochs read whole), ``cut`` (the hash where the prefix ends) and the
    ``room`` left for the rows at it, which are ``rows_at_cut``; no ``cut`` where nothing is left over."""
    leaves = written(
        budgets.where("held > 0").select(
            *levels, F.expr("budget div held").alias("whole"), (F.col("budget") % F.col("held")).alias("room")
        ),
        "leaf-shares",
    )
    rows = sizes.where("tokens > 0").join(leaves.where("room > 0"), levels).withColumn("h", _place(seed, F.col("whole")))
    prefix = Window.partitionBy(*levels).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)

    def first_over(held: DataFrame) -> DataFrame:
        """The bucket in which the room runs out, with the room left at its start."""
        held = held.withColumn("room", F.col("room") - F.coalesce(F.sum("held").over(prefix), F.lit(0).cast("bigint")))
        return held.where((F.col("room") > 0) & (F.col("room") <= F.col("held")))

    for k in (0, 1):
        at = F.substring("h", 2 * k + 1, 2)
        sums = rows.withColumn("at", at).groupBy(*levels, "room", "at").agg(F.sum("tokens").alias("held"))
        bucket = written(first_over(sums).select(*levels, F.col("room").alias("_room"), "at"), "cut-buckets")
        rows = rows.withColumn("at", at).join(bucket, [*levels, "at"]).drop("at", "room").withColumnRenamed("_room", "room")
    last = rows.groupBy(*levels, "room", F.col("h").alias("at")).agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("n"))
    found = first_over(last).select(*levels, F.col("at").alias("cut"), "room", F.col("n").alias("rows_at_cut"))
    return written(leaves.select(*levels, "whole").join(found, levels, "left"), "cuts")


def select(docs: DataFrame, cut: DataFrame, seed: int, levels: list[str]) -> DataFrame:
    """Rows of ``docs`` (with ``levels`` and ``tokens``) for every epoch they are in, with ``epoch`` and ``take_tokens``."""
    rows = docs.join(cut, levels).withColumn("_h", _place(seed, F.col("whole")))
    share = F.least(F.col("tokens"), F.expr("room div rows_at_cut"))
    part = F.when((F.col("_h") < F.col("cut")) & (F.col("tokens") > 0), F.col("tokens")).when(F.col("_h") == F.col("cut"), share)
    every = F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).otherwise(F.array().cast("array<bigint>"))
    taken = F.transform(every, lambda e: F.struct(e.alias("epoch"), F.col("tokens").alias("take")))
    taken = F.when(part > 0, F.array_append(taken, F.struct(F.col("whole").alias("epoch"), part.alias("take")))).otherwise(taken)
    rows = rows.withColumn("_taken", F.explode(taken))
    rows = rows.withColumns({"epoch": F.col("_taken.epoch"), "take_tokens": F.col("_taken.take")})
    return rows.drop("_taken", "_h", "whole", "cut", "room", "rows_at_cut")


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with the production tree's keys and their words as ``tokens``."""
    number = F.coalesce(F.regexp_extract(F.col("source"), "([0-9]{1,6})$", 1).try_cast("int"), F.lit(0))
    return docs.withColumns(
        {
            "domain": F.concat(F.lit("d"), (number % 3).cast("string")),
            "lang": F.coalesce("lang", F.lit("")),
            "source": F.coalesce("source", F.lit("")),
            "tokens": F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint"),
        }
    )


def mixed(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``docs`` mixed by the production weights and budget; ``sizes`` are its keys, ids and tokens, written."""
    parts, whole = BUDGET_PARTS
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budgets = leaf_budgets(sizes, total * parts // whole, WEIGHTS, EPOCHS, LEVELS)
    return select(docs, cuts(sizes, budgets, SEED, LEVELS), SEED, LEVELS)


SIZES = [*LEVELS, "doc_id", "tokens"]


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    sizes = written(keyed(docs).select(*SIZES), "sizes")
    return mixed(sizes, sizes).select(*SIZES, "epoch", "take_tokens")


@carrying
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each epoch that takes tokens of them; a text is never cut, so the last
    document of a leaf's prefix stays whole. Columns of any other name come along unchanged."""
    names = docs.columns
    rows = keyed(docs.withColumns({"_lang": F.col("lang"), "_source": F.col("source")}))
    out = mixed(rows, written(rows.select(*SIZES), "sizes"))
    return out.withColumns({"lang": F.col("_lang"), "source": F.col("_source")}).select(*names)


def _weights_sql(level: str) -> str:
    cases = "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    return f"CASE {level}{cases} ELSE 1 END" if cases else "1"


def _level_sql(k: int) -> str:
    """Water filling of one level, as in :func:`fill`."""
    path, parents = ", ".join(LEVELS[: k + 1]), ", ".join(LEVELS[:k])
    family = f"PARTITION BY {parents}" if parents else ""
    source = (
        f"(SELECT g.*, u.b FROM g{k} g JOIN level{k - 1} u USING ({parents}))"
        if k
        else f"(SELECT g.*, (SELECT least(sum(held) * {EPOCHS}, sum(held) * {BUDGET_PARTS[0]} // {BUDGET_PARTS[1]}) FROM leaves) AS b FROM g0 g)"
    )
    order = f"{family} ORDER BY cap / w, {LEVELS[k]}"
    return f"""
  g{k} AS (SELECT {path}, sum(held)::HUGEINT * {EPOCHS} AS cap, ({_weights_sql(LEVELS[k])})::HUGEINT AS w FROM leaves GROUP BY {path}),
  a{k} AS (SELECT *, b - coalesce(sum(cap) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb,
                  sum(w) OVER ({family}) - coalesce(sum(w) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rw
           FROM {source} WINDOW x AS ({order})),
  f{k} AS (SELECT *, min((cap * rw <= w * rb)::INT) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS is_full FROM a{k}),
  s{k} AS (SELECT *, b - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({family}), 0) AS lb,
                  sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({family}) AS lw FROM f{k}),
  p{k} AS (SELECT *, CASE WHEN NOT is_full THEN ((w * lb)::HUGEINT // lw::HUGEINT) END AS share,
                  CASE WHEN NOT is_full THEN ((w * lb)::HUGEINT % lw::HUGEINT) END AS rest FROM s{k}),
  q{k} AS (SELECT *, lb - sum(share) OVER ({family}) AS spare,
                  row_number() OVER ({family} ORDER BY rest DESC NULLS LAST, {LEVELS[k]}) AS place FROM p{k}),
  level{k} AS (SELECT {path}, (CASE WHEN is_full THEN cap ELSE share + (place <= spare)::INT END)::BIGINT AS b FROM q{k})"""


MIX_SQL = (
    r"""
  keyed AS (
    SELECT *, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{1,6})$', 1) AS INT), 0) % 3) AS domain,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
    FROM (SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)
  ),
  leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS held FROM keyed GROUP BY ALL),"""
    + ",".join(_level_sql(k) for k in range(3))
    + f""",
  shares AS (SELECT k.*, b // held AS whole, b % held AS room FROM keyed k JOIN leaves USING (domain, lang, source)
             JOIN level2 USING (domain, lang, source) WHERE held > 0),
  placed AS (SELECT *, md5('{SEED}|' || whole || '|' || coalesce(doc_id::VARCHAR, '') || '|' || tokens) AS h FROM shares),
  summed AS (SELECT *, count(*) OVER (PARTITION BY domain, lang, source, h) AS m,
                    sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
             FROM placed),
  parts AS (SELECT *, CASE WHEN upto <= room THEN tokens ELSE least(tokens, greatest(room - (upto - m * tokens), 0) // m) END AS part FROM summed)"""
)

SQL = f"""
WITH {MIX_SQL}
SELECT domain, lang, source, doc_id, tokens, epoch::BIGINT AS epoch, tokens AS take_tokens
FROM (SELECT *, unnest(range(whole)) AS epoch FROM parts)
UNION ALL
SELECT domain, lang, source, doc_id, tokens, whole::BIGINT, part::BIGINT FROM parts WHERE part > 0
"""
