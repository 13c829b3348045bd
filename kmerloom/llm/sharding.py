"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked; a row's fractional rank is its place in its source
over the source's size. Sorted by that, every stretch of the whole holds the sources in proportion, so equal
stretches make shards that match the mixture. Both ranks come from counts by bucket, so no task sorts a source or the
table. DataFrame functions only.

Defined cases: a null source is a source, the last; a null text has no bytes; rows that repeat an id get
slots of their own; fewer rows than shards leave shards empty; an empty table gives an empty table; other columns are
carried along, whatever their names, and input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .mixing import _skey

SHARDS = 40
ROWS_PER_BUCKET = 4096
OUT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "shard", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all, if None) with size, text_crc32, law, shard, slot and grown_shard (null)."""
    # the input's columns travel in one struct, so none of them can clash with a column of ours
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUT]
    text = common.text_or_empty(text_col)
    rows = docs.select(
        F.struct(*keep).alias("row"), F.col(id_col).alias("_id"), (F.octet_length(text).cast("bigint") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        _skey(F.col(source_col)).alias("_skey"), common.unit_hash(F.col(id_col), seed=seed).alias("_u"))
    rows = common.saved(rows)
    sizes = common.saved(rows.groupBy("_skey").agg(F.count(F.lit(1)).alias("_of")))
    total = sizes.agg(F.sum("_of")).first()[0] or 0
    buckets = max(1, total // ROWS_PER_BUCKET)
    tie = [F.col("_id"), F.col("text_crc32"), F.col("size")]
    place = lambda c: F.least(F.floor(F.col(c) * buckets), F.lit(buckets - 1))
    rows = common.exact_rank(rows.withColumn("_b", place("_u")), ["_skey"], [F.col("_u"), *tie], "_b", "_rank").drop("_b")
    rows = rows.join(common.counted_broadcast(sizes, sizes.count()), "_skey")
    rows = rows.withColumn("_frac", (F.col("_rank") - F.lit(0.5)) / F.col("_of")).withColumn("_b", place("_frac"))
    rows = common.exact_rank(common.saved(rows), [], [F.col("_frac"), F.col("_skey"), F.col("_rank")], "_b", "_place")
    at = F.col("_place").cast("bigint") - 1
    rows = rows.withColumn("shard", F.expr(f"cast((cast(_place as bigint) - 1) * {shards} div {max(total, 1)} as int)"))
    start = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    rows = rows.withColumns({"law": F.lit("rows"), "slot": at - start, "grown_shard": F.lit(None).cast("int")})
    return rows.select(*[F.col("row").getField(c).alias(c) for c in keep], *OUT)


def op5_stratified_shards(spark, sf_dir: str) -> DataFrame:
    return shard(common.documents(spark, sf_dir).select("doc_id", "text", "source"), keep=["doc_id"])


def _crc_table() -> list[int]:
    """What crc32 makes of each byte."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table.append(c)
    return table


#: DuckDB has no crc32: it is folded over the bytes by a table.
ORACLE = r"""
WITH raw AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, hex(encode(coalesce(text, ''))) AS h,
  (CAST('0x' || substr(md5('shard|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
base AS (SELECT doc_id, skey, u, CAST(length(h) // 2 + 16 AS BIGINT) AS size,
  xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST('0x' || substr(h, i, 2) AS BIGINT) FOR i IN range(1, length(h), 2)]), lambda a, x: xor(a >> 8, TABLE[xor(a, x) % 256 + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM raw),
a AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY u, doc_id, text_crc32, size) AS rank, count(*) OVER (PARTITION BY skey) AS n FROM base),
b AS (SELECT *, row_number() OVER (ORDER BY (rank - CAST(0.5 AS DOUBLE)) / n, skey, rank) - 1 AS place, count(*) OVER () AS total FROM a),
c AS (SELECT *, CAST(place * 40 // total AS INT) AS shard FROM b)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(place - (CAST(shard AS BIGINT) * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM c
""".replace("TABLE", f"CAST({_crc_table()} AS BIGINT[])")
