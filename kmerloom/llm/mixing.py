"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A document's expected copies are in proportion to its weight within its source, so that the
expected words meet the target and no document exceeds the most copies: the whole part is certain, and the fraction is an
inclusion probability p. Documents are ranked by the odds of a random number over the odds of p, and those ranked first are taken
until the target's remainder is filled. What is left of the remainder is then closed with the one document whose size fits
it best. The cut is found from sums by source and bucket, so that no task sorts a whole source. DataFrame functions only.

Defined cases: a null source is a source, the last; a null or empty text has size 0 and takes 0; weights are rounded to whole
numbers from 0 to 64, null is 0, and a source without positive weights takes nothing; rows that repeat an id are drawn
alike; an empty table gives an empty table; other columns are carried along, whatever their names, and input columns named like an
output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Document weights are whole numbers up to this, so that a source has a bounded number of different expected copies.
MOST_WEIGHT = 64
#: Buckets per source: sorted together is about this many rows of a source that is the whole table.
ROWS_PER_BUCKET = 4096
OUT = ["size", "source_size", "target", "copies", "taken"]


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per source (_skey, source_size, target) from (_skey, source_size); filled like water up to each cap."""
    place = F.row_number().over(Window.orderBy("_skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    cap = F.col("source_size") * F.lit(float(most))
    t = sizes.withColumn("_w", weight).withColumn("_cap", cap).withColumn("_level", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy()
    up = Window.orderBy("_level", "_skey")
    t = t.withColumn("_left", F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("_water", F.col("_left") / F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    # Where a source can't hold its share, neither can those of a lower level; the first that can sets the level.
    t = t.withColumn("_water", F.min(F.when(F.col("_level") > F.col("_water"), F.struct("_level", "_skey", "_water"))).over(everything)["_water"])
    target = F.when(F.col("_water").isNull() | (F.col("_level") <= F.col("_water")), F.col("_cap")).otherwise(F.col("_water") * F.col("_w"))
    return t.select("_skey", "source_size", target.alias("target"))


def _skey(source: Column) -> Column:
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def expected_copies(masses: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(_skey, _w, source_size, target, _lambda) from (_skey, _w, _mass), the words of each weight: least(most, level * _w), summing to the target."""
    t = masses.join(F.broadcast(targets), "_skey")  # at most MOST_WEIGHT + 1 rows a source
    down = Window.partitionBy("_skey").orderBy(F.desc("_w"))
    before = F.coalesce(F.sum("_mass").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("_level", F.try_divide(F.col("target") - F.lit(float(most)) * before, F.sum(F.col("_w") * F.col("_mass")).over(down.rowsBetween(0, Window.unboundedFollowing))))
    # Heavier weights reach the most copies first; the first that doesn't sets the level.
    cut = F.max(F.when(F.col("_level") * F.col("_w") <= most, F.struct("_w", "_level"))).over(Window.partitionBy("_skey"))
    t = t.withColumn("_cut", cut)
    copies = F.when(F.col("_w") == 0, F.lit(0.0)).when(F.col("_cut").isNull() | (F.col("_w") > F.col("_cut._w")), F.lit(float(most))).otherwise(F.col("_cut._level") * F.col("_w"))
    return t.select("_skey", "_w", "source_size", "target", copies.alias("_lambda"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, weight_col: str | None = None, size_weight: Callable[[Column], Column] | None = None, seed: str = "mix", carry: bool = True) -> DataFrame:
    """Rows of docs with size, source_size, target, copies (0 to most) and taken; with carry false, just the id and these.

    Within a source, expected copies are in proportion to weight_col or to size_weight of the size, or alike.
    """
    scratch = common.Scratch(docs.sparkSession)
    # the input's columns travel in one struct, so none of them can clash with a column of ours
    own = [c for c in (docs.columns if carry else [id_col]) if c.lower() not in OUT]
    size = F.regexp_count(common.text_or_empty(text_col), F.lit(common.WORD)).cast("bigint")
    given = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    whole = F.greatest(F.lit(0), F.least(F.lit(MOST_WEIGHT), F.coalesce(F.round(given), F.lit(0)))).cast("int")
    facts = docs.select(F.struct(*own).alias("row"), F.col(id_col).alias("_id"), size.alias("size"), _skey(F.col(source_col)).alias("_skey"), common.unit_hash(F.col(id_col), seed=seed).alias("_u"), whole.alias("_w"))

    def weighed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_w", size_weight(F.col("size")).cast("int")) if size_weight else rows

    base = scratch.save(weighed(facts.select("_id", "size", "_skey", "_u", "_w")))
    masses = scratch.save(base.groupBy("_skey", "_w").agg(F.sum("size").alias("_mass"), F.count(F.lit(1)).alias("_rows")))
    sums = masses.groupBy("_skey").agg(F.sum("_mass").alias("source_size"), F.sum("_rows").alias("_rows"))
    rates = scratch.save(expected_copies(masses.drop("_rows"), source_targets(sums.select("_skey", "source_size"), weights, share, most), most))
    sources, total = rates.count(), masses.agg(F.sum("_rows")).first()[0] or 0
    q = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))

    def drawn(rows: DataFrame) -> DataFrame:
        rows = rows.join(common.counted_broadcast(rates, sources), ["_skey", "_w"])
        rows = rows.withColumn("_whole", F.floor("_lambda")).withColumn("_p", F.col("_lambda") - F.col("_whole"))
        return rows.withColumn("_v", F.when(F.col("_p") > 0, q / (1 + q)))

    ranked = drawn(base)
    buckets = max(1, total // ROWS_PER_BUCKET)
    ranked = ranked.withColumn("_bucket", F.when(F.col("_v").isNotNull(), F.least(F.floor(F.col("_v") * buckets), F.lit(buckets - 1))))
    levels = ranked.groupBy("_skey", "_bucket").agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("size"))).alias("_words"), F.sum(F.col("_whole") * F.col("size")).alias("_sure"), F.first("target").alias("_target"))
    levels = levels.withColumn("_quota", F.col("_target") - F.sum("_sure").over(Window.partitionBy("_skey"))).filter("_bucket is not null")
    upto = Window.partitionBy("_skey").orderBy("_bucket")
    levels = levels.withColumn("_upto", F.sum("_words").over(upto))
    crossing = levels.filter("_upto > _quota").groupBy("_skey").agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_words")).alias("_before"), "_quota")).alias("c")).select("_skey", "c.*")
    crossing = scratch.save(crossing)
    near = ranked.join(common.counted_broadcast(crossing, sources), ["_skey", "_bucket"])
    running = F.sum("size").over(Window.partitionBy("_skey").orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    near = near.withColumn("_running", running).groupBy("_skey").agg(
        F.max(F.when(F.col("_running") <= F.col("_quota"), F.struct("_v", "_running"))).alias("last"))
    cuts = crossing.join(near, "_skey", "left").select(
        "_skey", F.coalesce("last._v", F.col("_bucket") / F.lit(float(buckets))).alias("_cut"), (F.col("_quota") - F.coalesce("last._running", F.col("_before"))).alias("_gap"))
    cuts = scratch.save(cuts)
    # Of the documents beyond the cut, the one that comes nearest to what is missing, if it comes nearer than nothing.
    beyond = ranked.join(common.counted_broadcast(cuts, sources), "_skey").filter("_v > _cut and abs(size - _gap) < _gap")
    fills = beyond.groupBy("_skey").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_gap")).alias("miss"), F.col("_v").alias("_fill"), F.col("_id").alias("_fill_id"))).alias("f")).select("_skey", "f._fill", "f._fill_id")
    cuts = scratch.save(cuts.join(fills, "_skey", "left"))

    rows = drawn(weighed(facts) if carry else base.withColumn("row", F.struct(F.col("_id").alias(id_col)))).join(common.counted_broadcast(cuts, sources), "_skey", "left")
    chosen = F.when(F.col("_v").isNull(), F.lit(False)).otherwise(F.col("_cut").isNull() | (F.col("_v") <= F.col("_cut")) | F.coalesce((F.col("_v") == F.col("_fill")) & F.col("_id").eqNullSafe(F.col("_fill_id")), F.lit(False)))
    rows = rows.withColumn("copies", (F.col("_whole") + chosen.cast("int")).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in own], *OUT)


def digits(size: Column) -> Column:
    """The number of digits of a size: longer documents are likelier, by little."""
    return F.length(size.cast("string"))


def op3_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    """Mixes documents with weights of their number of words' digits."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix(docs, size_weight=digits, carry=False).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY skey),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / w AS lev FROM w),
x AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY lev, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY lev, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wat FROM l),
y AS (SELECT *, first_value(CASE WHEN lev > wat THEN wat END IGNORE NULLS) OVER (ORDER BY lev, skey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water FROM x),
t AS (SELECT skey, source_size, CASE WHEN water IS NULL OR lev <= water THEN cap ELSE water * w END AS target FROM y),
m AS (SELECT skey, len(CAST(size AS VARCHAR)) AS dw, CAST(sum(size) AS BIGINT) AS mass FROM base GROUP BY ALL),
n AS (SELECT *, (target - CAST(2 AS DOUBLE) * coalesce(sum(mass) OVER (PARTITION BY skey ORDER BY dw DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / nullif(sum(dw * mass) OVER (PARTITION BY skey ORDER BY dw DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM m JOIN t USING (skey)),
k AS (SELECT skey, max(dw) AS cw, arg_max(level, dw) AS cl FROM n WHERE level * dw <= 2 GROUP BY skey),
o AS (SELECT skey, dw, source_size, target, CASE WHEN cl IS NULL OR dw > cw THEN CAST(2 AS DOUBLE) ELSE cl * dw END AS lam FROM n LEFT JOIN k USING (skey)),
d AS (SELECT base.*, source_size, target, lam FROM base JOIN o ON base.skey = o.skey AND len(CAST(size AS VARCHAR)) = dw),
e AS (SELECT *, floor(lam) AS whole, lam - floor(lam) AS p FROM d),
g AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM e),
h AS (SELECT *, q / (1 + q) AS v, target - sum(whole * size) OVER (PARTITION BY skey) AS quota FROM g),
r AS (SELECT *, CASE WHEN v IS NOT NULL THEN sum(CASE WHEN v IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY skey ORDER BY v NULLS LAST) END AS running FROM h),
c AS (SELECT *, quota - max(CASE WHEN running <= quota THEN running ELSE 0 END) OVER (PARTITION BY skey) AS gap, running <= quota AS inside FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY skey, v IS NOT NULL AND NOT inside AND abs(size - gap) < gap ORDER BY abs(size - gap), v, doc_id) = 1
         AND v IS NOT NULL AND NOT inside AND abs(size - gap) < gap AS fill FROM c)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN v IS NOT NULL AND (inside OR fill) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM f
"""
