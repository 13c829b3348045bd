"""FASTA and FASTQ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(read_index, label, seq); label is the whole header line, a sequence may have several lines; gzip is read as well.

    A record begins with a > at the beginning of a line; line ends of both kinds are taken off.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select("value", F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("_file"))
    # a file's first record still has its >
    firsts = records.groupBy("_file").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("_first"))
    records = records.drop("_file").join(firsts, "_at", "left").withColumn("value", F.when(F.col("_first"), F.regexp_replace("value", r"^\s*>?", "")).otherwise(F.col("value")))
    records = records.filter(F.length(F.trim("value")) > 0)
    first = F.instr("value", "\n")
    label = F.when(first == 0, F.col("value")).otherwise(F.expr("substring(value, 1, instr(value, '\n') - 1)"))
    seq = F.when(first == 0, F.lit("")).otherwise(F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s+", ""))
    return _numbered(records.select(F.regexp_replace(label, r"\s+$", "").alias("label"), seq.alias("seq"), "_at"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_index, label, seq) of records of four lines; a file that ends within a record, or whose header or third
    line is wrong, fails when it is read. Lines are numbered from counts per split, so a file may be read by many tasks."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("_file")).withColumn("_part", F.shiftright("_at", 33))
    # of each file's part of a split: where it begins, and how many lines it has
    counts = lines.groupBy("_file", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(counts.select("_file", "_part", "_from", before.alias("_before")), ["_file", "_part"]).withColumn("_line", F.col("_before") + F.col("_at") - F.col("_from"))
    records = lines.groupBy("_file", F.expr("_line div 4").alias("_record")).agg(F.min("_at").alias("_at"), *[F.max(F.when(F.col("_line") % 4 == i, F.col("value"))).alias(c) for i, c in enumerate(("_head", "seq", "_plus", "_quality"))])
    wrong = F.col("_quality").isNull() | ~F.col("_head").startswith("@") | ~F.col("_plus").startswith("+")
    label = F.when(wrong, F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("_head", F.lit(""))))).otherwise(F.expr("substring(_head, 2)"))
    return _numbered(records.select(label.alias("label"), "seq", "_at"))


def read_fastx(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ, by the first character."""
    first = spark.read.text(path).filter(F.length("value") > 0).first()
    return read_fastq(spark, path) if first and first[0].startswith("@") else read_fasta(spark, path)


def _numbered(records: DataFrame) -> DataFrame:
    """Numbers from 0 in the order of `_at`: counts per partition are summed up, so no task holds all rows."""
    parts = records.withColumn("_part", F.shiftright("_at", 33))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    return parts.withColumn("_in", inside).join(offsets, "_part").select((F.col("_before") + F.col("_in")).alias("read_index"), "label", "seq")


def select_range(reads: DataFrame, begin: int = 0, end: int | None = None) -> DataFrame:
    """Reads of index begin to end (excluded), numbered anew from 0."""
    if end is not None and begin > end:
        raise ValueError("begin must not be above end")
    kept = reads.filter(F.col("read_index") >= begin)
    return (kept if end is None else kept.filter(F.col("read_index") < end)).withColumn("read_index", F.col("read_index") - begin)


def fasta_lines(reads: DataFrame, seq_col: str = "seq", index_col: str = "read_index") -> DataFrame:
    """(index, record): the text of each record, in order; an index that occurs twice is an error."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(index_col)) > 1
    record = F.concat(F.lit(">"), F.col("label"), F.lit("\n"), F.col(seq_col))
    checked = F.when(twice, F.raise_error(F.concat(F.lit("an index occurs twice: "), F.col(index_col).cast("string")))).otherwise(record)
    return reads.select(index_col, checked.alias("record")).orderBy(index_col)


def write_fasta(reads: DataFrame, path: str, seq_col: str = "seq", index_col: str = "read_index", single: bool = False) -> None:
    """Records in index order. Part files hold consecutive ranges; with single there is one of them."""
    lines = fasta_lines(reads, seq_col, index_col)
    lines = lines.coalesce(1).sortWithinPartitions(index_col) if single else lines
    lines.select("record").write.mode("overwrite").text(path)
