"""Exact dedup by two passes over a Bloom filter.

Pass 1 hashes every text to a cell in each of two bit arrays and keeps the cells that were hit twice. Pass 2 tests each row:
one with a cell hit once is surely unique and passes straight through; the others are shuffled by their SHA-256 and
settled exactly. The filter has a bounded number of cells and so is always broadcast: rows beyond MOST_CELLS / CELLS_PER_ROW
only make more of the unique rows possible repeats, which are shuffled in vain. DataFrame functions only.

Defined cases: a null text equals the empty text; rows with equal text and equal id are ties, of which one stays; null
ids come after all others; an empty table gives an empty table; other columns are carried along, whatever their names, and input
columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Cells per row in each of the two arrays. At 16, about 1 unique row in 250 is shuffled in vain.
CELLS_PER_ROW = 16
#: Cells of both arrays at most: 32 MB. They are stored in blocks of BLOCK words of 64 cells.
MOST_CELLS, BLOCK = 1 << 28, 64
OUT = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: str = "text"):
    return F.regexp_replace(common.text_or_empty(text), common.SPACE, " ")


def filter_width(rows: int, most: int = MOST_CELLS) -> int:
    """Cells of each array."""
    cells = 64 * BLOCK
    return cells * max(1, min(CELLS_PER_ROW * rows, most // 2) // cells)


def _cell(k: int, width: int):
    return F.pmod(F.xxhash64("text_sha256", F.lit(k)), F.lit(width)) + F.lit(k * width)


def repeated_cells(signatures: DataFrame, width: int) -> DataFrame:
    """The Bloom filter: blocks of words, whose bits are the cells that two or more rows fell into."""
    both = signatures.select(F.explode(F.array(_cell(0, width), _cell(1, width))).alias("cell"))
    often = both.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    words = often.groupBy(F.expr(f"cell div {64 * BLOCK}").alias("block"), F.expr(f"cast(pmod(cell div 64, {BLOCK}) as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(cell, 64) as int))")).alias("bits"))
    blocks = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))  # at most BLOCK words
    return blocks.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.coalesce(F.col("words")[i], F.lit(0).cast("bigint"))).alias("bits"))


def possibly_repeated(rows: DataFrame, bloom: DataFrame, width: int) -> DataFrame:
    """rows with a boolean maybe; false means that no other row has the text."""
    hit = []
    for k in (0, 1):
        block, cell = F.expr(f"({k * width} + pmod(xxhash64(text_sha256, {k}), {width})) div {64 * BLOCK}"), _cell(k, width)
        rows = rows.withColumn(f"block{k}", block).join(F.broadcast(bloom.select(F.col("block").alias(f"block{k}"), F.col("bits").alias(f"bits{k}"))), f"block{k}", "left")
        word = F.element_at(f"bits{k}", (F.pmod(F.shiftright(cell, 6), F.lit(BLOCK)) + 1).cast("int"))
        hit.append(F.coalesce(F.getbit(word, F.pmod(cell, F.lit(64)).cast("int")), F.lit(0)) == 1)
    return rows.withColumn("maybe", hit[0] & hit[1]).drop("block0", "block1", "bits0", "bits1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = True, most_cells: int = MOST_CELLS) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256; with carry false, just the id and these."""
    scratch = common.Scratch(docs.sparkSession)
    # the input's columns travel in one struct, so none of them can clash with a column of ours
    own = [c for c in (docs.columns if carry else [id_col]) if c.lower() not in OUT]
    signed = docs.select(F.struct(*own).alias("row"), F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("text_sha256"))
    signatures = scratch.save(signed.select("id", "text_sha256"))
    total = signatures.count()
    width = filter_width(total, most_cells)
    bloom = scratch.save(repeated_cells(signatures, width))
    maybe = possibly_repeated(signatures, bloom, width).filter("maybe")
    by_row = maybe.groupBy("text_sha256", "id").agg(F.count(F.lit(1)).alias("n"))
    groups = scratch.save(by_row.groupBy("text_sha256").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(F.min_by("n", "id"), F.sum("n")).alias("first")))

    rows = signed if carry else signatures.withColumn("row", F.struct(F.col("id").alias(id_col)))
    tested = possibly_repeated(rows, bloom, width)
    alone = tested.filter("not maybe").drop("maybe").withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)})
    settled = common.join_groups(tested.filter("maybe").drop("maybe"), groups, "text_sha256", "group_size", total)
    first = F.col("id").eqNullSafe(F.col("keep_id"))
    clear = settled.filter(~first | (F.col("first") == 1)).withColumn("kept", first)
    ties = settled.filter(first & (F.col("first") > 1)).withColumn("kept", F.row_number().over(Window.partitionBy("text_sha256").orderBy("id")) == 1)
    columns = ["row", *OUT]
    out = alone.select(columns).unionByName(clear.select(columns)).unionByName(ties.select(columns))
    return out.select(*[F.col("row").getField(c).alias(c) for c in own], *OUT)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir).select("doc_id", "text"), carry=False)


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t
"""
