"""The run-length file: an array header of 96 bytes, then one byte per digit of each run."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import ALPHABET

HEADER = 96


RUN = re.compile(r"(.)\1*")


def _digits(symbol: str, length: int) -> bytes:
    out = bytearray()
    while length:
        out.append(ALPHABET.index(symbol) | (length & 31) << 3)
        length >>= 5
    return bytes(out)


def encode_parts(parts: Iterable[str]) -> Iterator[bytes]:
    """Runs of a text over the alphabet, given part by part; line ends are passed over, even within a run."""
    symbol, length = "", 0
    for part in parts:
        plain = part.replace("\n", "")
        if odd := set(plain) - set(ALPHABET):
            raise ValueError(f"unexpected symbols: {sorted(odd)}")
        for run in RUN.finditer(plain):
            if run[1] != symbol:
                yield _digits(symbol, length)
                symbol, length = run[1], 0
            length += run.end() - run.start()
    yield _digits(symbol, length)


def encode_text(text: str) -> bytes:
    return b"".join(encode_parts([text]))


def pack(data: bytes) -> bytes:
    """Fixed format: magic, version 1.0, the header's length, a dictionary padded by blanks, a line end."""
    return header(len(data)) + data


def header(size: int) -> bytes:
    said = f"{{'descr': '|u1', 'fortran_order': False, 'shape': ({size}, ), }}".encode()
    return (b"\x93NUMPY\x01\x00" + (HEADER - 10).to_bytes(2, "little") + said).ljust(HEADER - 1) + b"\n"


def unpack(file: bytes) -> bytes:
    if file[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    end = -(-(10 + int.from_bytes(file[8:10], "little")) // 16) * 16
    shape = re.search(rb"'shape'\s*:\s*\(\s*(\d+)", file[10:end])
    if not shape or int(shape[1]) != len(file) - end:
        raise EOFError("the file is shorter or longer than its header says")
    return file[end:]


def write(parts: Iterable[bytes], path: str) -> None:
    """The file of bytes that come part by part; the header is filled in last."""
    with open(path, "wb") as f:
        f.write(header(0))
        size = sum(map(f.write, parts))
        f.seek(0)
        f.write(header(size))


def save(text: str, path: str) -> None:
    write(encode_parts([text]), path)


def save_bytes(found: DataFrame, path: str) -> None:
    """The file of (pos, byte), on the driver's disk; rows pass through the driver partition by partition."""
    write((bytes([r["byte"]]) for r in found.orderBy("pos").select("byte").toLocalIterator()), path)


def index_of_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(pos, byte) of the Burrows-Wheeler text of all reads of FASTA or FASTQ files (gzip too); their repeats count."""
    from ..operators import index
    from . import fastx

    reads = None
    for i, path in enumerate(paths):
        mine = fastx.read_fastx(spark, path).select(F.concat(F.lit(f"{i:09d}-"), F.lpad(F.col("read_index").cast("string"), 18, "0")).alias("read_id"), "seq")
        reads = mine if reads is None else reads.unionByName(mine)
    return index.run_bytes(index.runs(index.bwt(reads)))


def reads_of_file(spark: SparkSession, path: str) -> DataFrame:
    """(read_index, label, seq) of the reads that a run-length file was made of."""
    from ..operators import index

    text = index.text_of_runs(index.runs_of_bytes(load(spark, path)))
    return index.reads_of_bwt(text).select(F.col("read").alias("read_index"), F.lit("").alias("label"), "seq")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(pos, byte) of a file in any store that Spark reads."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                data = np.frombuffer(unpack(content), np.uint8)
                for k in range(0, len(data), 1 << 20):
                    part = data[k : k + (1 << 20)]
                    yield pa.RecordBatch.from_pydict({"pos": np.arange(k, k + len(part)), "byte": part.astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "pos bigint, byte int")


def vector(spark: SparkSession, data: bytes) -> DataFrame:
    """(pos, byte) of bytes at hand."""
    return spark.createDataFrame(list(enumerate(data)), "pos bigint, byte int")


def bwt_of_strings(reads: DataFrame) -> DataFrame:
    from ..operators.index import bwt

    return bwt(reads)


def text(symbols: DataFrame) -> str:
    """The text of (pos, symbol) as one string; for small collections."""
    return "".join(r["symbol"] for r in symbols.orderBy(F.col("pos")).toLocalIterator())
