"""The index's own views, as windows and joins: the Burrows-Wheeler text, its runs, totals, ranks and backward search.

Correction needs none of them; they serve interchange and queries of suffix ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import ALPHABET
from ..session import saved

#: Rows that are summed up together by a window.
BLOCK = 1 << 16


def symbol_code(c) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in ALPHABET]), c).cast("int") - 1


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """rows with their places from 0 in the order: sorted by ranges, and counted up over the partitions."""
    rows = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = rows.withColumn("_part", F.shiftright("_at", 33))
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return part.withColumn(out, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("_part", "_at", "_before")


def running(rows: DataFrame, order: str, value: Column, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with the sum of value up to and with each row, along the whole numbers `order`, within the keys.

    Blocks of BLOCK numbers are summed up first, so a window sorts one block, or one row per block.
    """
    rows = saved(rows.withColumn("_v", value).withColumn("_block", F.expr(f"{order} div {BLOCK}")))
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "_block", before.alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy(*keys, "_block").orderBy(order))
    return rows.join(sums, [*keys, "_block"]).withColumn(out, (F.col("_before") + inside).cast("bigint")).drop("_v", "_block", "_before")


def _run_numbers(rows: DataFrame, what: str) -> DataFrame:
    """rows (pos, what) with run: the number of the run of equal values that they are in."""
    rows = saved(rows)
    before = rows.select((F.col("pos") + 1).alias("pos"), F.col(what).alias("_prior"))
    fresh = rows.join(before, "pos", "left").withColumn("_new", (~F.col(what).eqNullSafe(F.col("_prior"))).cast("int")).drop("_prior")
    return running(fresh, "pos", F.col("_new"), "run").withColumn("run", F.col("run") - 1).drop("_new")


def bwt(reads: DataFrame, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """(pos, symbol) of the text of all reads, each ended by $; ends are in the order of the sorted reads.

    Sorts every suffix (by ranges, over all tasks) and writes it out, so it is meant for collections of short reads.
    """
    ranked = numbered(reads.select(F.col(seq_col).alias("s"), F.col(id_col).alias("id")), ["s", "id"], "r")
    suffixes = ranked.select("s", "r", F.explode(F.sequence(F.lit(1), F.length("s") + 1)).alias("i"))
    suffixes = suffixes.select(F.concat(F.expr("substring(s, i)"), F.lit("$")).alias("suffix"), "r", F.when(F.col("i") == 1, "$").otherwise(F.expr("substring(s, i - 1, 1)")).alias("symbol"))
    return numbered(suffixes, ["suffix", "r"], "pos").select("pos", "symbol")


def runs(text: DataFrame) -> DataFrame:
    """(run, symbol, length) of (pos, symbol), in order."""
    return _run_numbers(text, "symbol").groupBy("run").agg(F.first("symbol").alias("symbol"), F.count(F.lit(1)).alias("length"))


def run_bytes(found: DataFrame) -> DataFrame:
    """(pos, byte): the low three bits are the symbol, the others a digit of the length in base 32, lowest first."""
    digits = F.transform(F.sequence(F.lit(0), F.floor(F.log(F.col("length") + 0.5) / F.log(F.lit(32.0))).cast("int")), lambda i: F.pmod(F.floor(F.col("length") / F.pow(F.lit(32.0), i)), F.lit(32)))
    placed = running(found.withColumn("digits", digits), "run", F.size("digits"), "end")
    bytes_ = placed.select((F.col("end") - F.size("digits")).alias("start"), symbol_code(F.col("symbol")).alias("code"), F.posexplode("digits").alias("i", "digit"))
    return bytes_.select((F.col("start") + F.col("i")).cast("bigint").alias("pos"), (F.col("code") + 8 * F.col("digit")).cast("int").alias("byte"))


def runs_of_bytes(found: DataFrame) -> DataFrame:
    """(run, symbol, length) of (pos, byte): the reverse of run_bytes."""
    marked = _run_numbers(found.select("pos", F.col("byte").bitwiseAND(7).alias("code"), F.shiftright("byte", 3).alias("digit")), "code")
    first = F.min("pos").over(Window.partitionBy("run"))  # a run has a byte for each digit of its length
    length = F.sum(F.col("digit") * F.pow(F.lit(32.0), F.col("pos") - F.col("_first"))).cast("bigint")
    return marked.withColumn("_first", first).groupBy("run").agg(F.first(F.element_at(F.array(*[F.lit(x) for x in ALPHABET]), F.col("code").cast("int") + 1)).alias("symbol"), length.alias("length"))


def totals(found: DataFrame) -> DataFrame:
    """(symbol, n, start, end) of runs (symbol, length), for all six symbols in their order; end is excluded."""
    spark = found.sparkSession
    all_ = spark.createDataFrame([(c, i) for i, c in enumerate(ALPHABET)], "symbol string, code int")
    sums = all_.join(found.groupBy("symbol").agg(F.sum("length").alias("_n")), "symbol", "left").select("symbol", "code", F.coalesce("_n", F.lit(0)).alias("n"))
    end = F.sum("n").over(Window.orderBy("code"))
    return sums.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).select("symbol", "code", "n", "start", "end")


def ranks(text: DataFrame) -> DataFrame:
    """(pos, symbol, rank): rank counts the symbol strictly before pos."""
    return running(text, "pos", F.lit(1), "rank", ("symbol",)).select("pos", "symbol", (F.col("rank") - 1).alias("rank"))


def bit_blocks(set_bits: DataFrame, size: int, base: int = 0) -> DataFrame:
    """(block, bits, before) of (pos): words of 64 bits and the set bits before each, plus base."""
    spark = set_bits.sparkSession
    words = set_bits.groupBy(F.floor(F.col("pos") / 64).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(pos, 64) as int))")).alias("_bits"))
    blocks = spark.range(size // 64 + (size % 64 > 0) + 1).withColumnRenamed("id", "block").join(words, "block", "left").select("block", F.coalesce("_bits", F.lit(0).cast("bigint")).alias("bits"))
    return running(blocks, "block", F.bit_count("bits"), "before").withColumn("before", F.col("before") - F.bit_count("bits") + base)


def bit_ranks(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (pos) with bit and rank: the set bits strictly before pos, plus the base of the blocks."""
    q = queries.withColumn("block", F.floor(F.col("pos") / 64)).join(blocks, "block")
    below = F.expr("bits & ~shiftleft(-1L, cast(pmod(pos, 64) as int))")
    return q.select("pos", F.expr("cast(getbit(bits, cast(pmod(pos, 64) as int)) as int)").alias("bit"), (F.col("before") + F.bit_count(below)).alias("rank"))


def rank_blocks(text: DataFrame, size: int) -> DataFrame:
    """(symbol, block, bits, before) for all symbols and blocks of 64 places: where the symbol stands, and how often before."""
    grid = text.sparkSession.range(size // 64 + 1).select(F.explode(F.array(*[F.lit(c) for c in ALPHABET])).alias("symbol"), F.col("id").alias("block"))
    words = text.groupBy("symbol", F.expr("pos div 64").alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(pos, 64) as int))")).alias("bits"))
    blocks = grid.join(words, ["symbol", "block"], "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("bigint")))
    return running(blocks, "block", F.bit_count("bits"), "before", ("symbol",)).withColumn("before", F.col("before") - F.bit_count("bits"))


def constrain(state: DataFrame, blocks: DataFrame, starts: dict[str, int]) -> DataFrame:
    """state (low, high, symbol and more) with the range of suffixes that begin with the symbol and go on as the range does."""
    base = F.element_at(F.create_map(*[x for c in ALPHABET for x in (F.lit(c), F.lit(starts[c]).cast("bigint"))]), F.col("symbol"))
    for end in ("low", "high"):
        at = blocks.select("symbol", F.col("block").alias("_block"), "bits", "before")
        state = state.withColumn("_block", F.expr(f"{end} div 64")).join(at, ["symbol", "_block"])
        below = F.expr(f"bits & ~shiftleft(-1L, cast(pmod({end}, 64) as int))")
        state = state.withColumn(end, base + F.col("before") + F.bit_count(below)).drop("_block", "bits", "before")
    return state


def ranges(text: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (kmer) with low and high: the half-open range of suffixes that begin with it, by backward search.

    A step joins the blocks that hold both ends; k-mers of any lengths go together. An empty k-mer has the whole text, and a k-mer
    that never occurs a range of nothing.
    """
    text = saved(text)
    size = text.count()
    blocks = saved(rank_blocks(text, size))
    starts, total = {}, 0
    sums = {r["symbol"]: r["n"] for r in text.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).collect()}  # six at most
    for c in ALPHABET:
        starts[c], total = total, total + sums.get(c, 0)
    state = saved(queries.select("kmer").distinct().withColumns({"low": F.lit(0).cast("bigint"), "high": F.lit(size).cast("bigint"), "at": F.length("kmer")}))
    while not (open_ := state.filter("at > 0 and low < high")).isEmpty():
        moved = constrain(open_.withColumn("symbol", F.expr("substring(kmer, at, 1)")), blocks, starts).select("kmer", "low", "high", (F.col("at") - 1).alias("at"))
        state = saved(state.filter("not (at > 0 and low < high)").unionByName(moved))
    return state.select("kmer", "low", F.greatest("low", "high").alias("high"))


def text_of_runs(found: DataFrame) -> DataFrame:
    """(pos, symbol) of runs."""
    placed = running(found, "run", F.col("length"), "end")
    return placed.select(F.expr("explode(sequence(end - length, end - 1))").alias("pos"), "symbol")


def reads_of_bwt(text: DataFrame) -> DataFrame:
    """(read, seq): the reads that a text was made of. Every place doubles its walk back each round, until all meet a $."""
    text = saved(ranks(text))
    starts = {r["symbol"]: r["start"] for r in totals(runs(text)).collect()}
    first = F.create_map(*[x for c in ALPHABET for x in (F.lit(c), F.lit(starts[c]).cast("bigint"))])
    end = F.col("symbol") == "$"
    walk = saved(text.select("pos", F.when(~end, F.element_at(first, F.col("symbol")) + F.col("rank")).alias("to"), F.when(end, "").otherwise(F.col("symbol")).alias("seq")))
    while not walk.filter("to is not null").isEmpty():
        on = walk.select(F.col("pos").alias("to"), F.col("to").alias("_to"), F.col("seq").alias("_seq"))
        walk = saved(walk.join(on, "to", "left").select("pos", F.col("_to").alias("to"), F.concat(F.coalesce("_seq", F.lit("")), "seq").alias("seq")))
    return walk.filter(F.col("pos") < text.filter("symbol = '$'").count()).select(F.col("pos").alias("read"), "seq")
