"""What the text operators share: words, shared-folder checkpoints, exact ranks and joins that stand skew."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space in every contract of this package: a blank and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(sc) -> None:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset on a local master, as in tests."""
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="kmerloom-checkpoint-"))


def saved(df: DataFrame) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir and read it from there: short lineage that outlives executors."""
    ensure_checkpoint_dir(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables of one operator, as Parquet in the folder in spark.checkpoint.dir.

    Like a checkpoint a table outlives executors, but it is read by column and can be deleted as soon as its successor is
    written. What is not dropped goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark.sparkContext)
        self.spark, self.paths, self.made = spark, {}, 0
        self.folder = self._path(f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}")
        self.files = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.deleteOnExit(self.folder)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder.toString()}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, and let Spark delete the shuffle files of plans that are gone."""
        for t in tables:
            self.files.delete(self._path(self.paths.pop(id(t))[0]), True)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def unused(taken: list[str], *wanted: str) -> list[str]:
    """Names for internal columns that clash with none of `taken`, whatever its case."""
    low = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out


def aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """docs with columns that are called like one of `names` renamed, and the columns that give docs back."""
    clash = [c for c in docs.columns if c.lower() in names]
    new = dict(zip(clash, unused([*docs.columns, *names], *[f"_{c}" for c in clash])))
    return docs.withColumnsRenamed(new), [F.col(new.get(c, c)).alias(c) for c in docs.columns]


def counted_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the counted rows are within the bound; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unit_hash(*cols: Column, seed: str) -> Column:
    """A double inside (0, 1) that depends on the columns and the seed alone; md5, so that other engines agree."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def exact_rank(df: DataFrame, part: list[str], order: list[Column], bucket: str, out: str) -> DataFrame:
    """The 1-based rank of each row within `part`, without one task ever seeing a whole part.

    `bucket` names a column that rises with `order`. Rows are counted by part and bucket, the counts are summed
    up over the buckets, and only rows of one bucket are sorted together.
    """
    counts = df.groupBy(*part, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*part, bucket).orderBy(*order)
    ranked = df.withColumn("_inside", F.row_number().over(inside)).join(offsets, [*part, bucket])
    return ranked.withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Give each row the columns of its group.

    Groups of over a thousandth of all rows number under 1,000, so they are broadcast and their rows stay where
    they are; the rows of the others are joined by shuffle, with no key holding more than that thousandth.
    """
    limit = max(total // 1000, 1000)
    extra = [c for c in groups.columns if c != key]
    hot = rows.join(F.broadcast(groups.filter(F.col(size) > limit)), key, "left")
    done = hot.filter(F.col(size).isNotNull())
    rest = hot.filter(F.col(size).isNull()).drop(*extra)
    return done.unionByName(rest.join(groups.filter(F.col(size) <= limit), key))


#: Groups of more rows than HOT (estimated from one row in SAMPLED) are aggregated before they are shuffled.
HOT, SAMPLED = 50_000, 64


def hot_keys(scratch: "Scratch", sample: DataFrame, keys: list[str], total: int, most: int = HOT) -> DataFrame | None:
    """The keys of groups of over `most` rows, judged by a sample of one in SAMPLED; at most about 100,000 keys, or None."""
    limit = max(most, total // 100_000) // SAMPLED
    if total <= most:
        return None
    found = scratch.save(sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys))
    return found if found.limit(1).count() else None


def with_groups(rows: DataFrame, keys: list[str], facts: dict[str, Column], hot: DataFrame | None) -> DataFrame:
    """rows with the aggregates `facts` of their group.

    The rows of groups in `hot` stay where they are: their aggregates are made before the shuffle and broadcast, one for each hot
    key. All others take one shuffle, in which no group is large.
    """
    group = Window.partitionBy(*keys)
    cold = rows if hot is None else rows.join(F.broadcast(hot), keys, "left_anti")
    cold = cold.withColumns({n: a.over(group) for n, a in facts.items()})
    if hot is None:
        return cold
    warm = rows.join(F.broadcast(hot), keys, "left_semi")
    sums = warm.groupBy(*keys).agg(*[a.alias(n) for n, a in facts.items()])
    return cold.unionByName(warm.join(F.broadcast(sums), keys).select(cold.columns))


#: Text bytes that a Python worker turns into objects at once; bytes of a batch that Spark hands to a Python worker.
SLICE_BYTES, BATCH_BYTES = 2_000_000, 4_000_000
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound a session's Arrow batches by bytes: 10,000 long rows would be held whole by the executor and its worker, several times.

    Only where rows are cut into batches depends on it. A smaller limit that was set stays.
    """
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def give_back() -> None:
    """Return what this worker has freed to the system: workers idle on between stages with all that they ever held."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another libc
        pass


def sliced(batches, text: str = "text", most: int = SLICE_BYTES):
    """Record batches cut into runs of rows with about `most` bytes of text (a longer text is alone)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def map_texts(df: DataFrame, per_slice, schema: str) -> DataFrame:
    """mapInArrow over slices: per_slice(record batch) gives a dict of columns, in the order of schema.

    per_slice may be a class: then it is called once per task, and what it gives once per slice.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = to_arrow_schema(_parse_datatype_string(schema))
    bound_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        give_back()
        f = per_slice() if isinstance(per_slice, type) else per_slice
        for part in sliced(batches):
            yield pa.RecordBatch.from_pydict(f(part), schema=columns)
        del f
        give_back()

    return df.mapInArrow(run, schema)


def is_held_out(fold: int, rest: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves `rest` modulo `fold`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(fold)) == rest
