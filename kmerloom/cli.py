"""Command line: `convert` (text to run-length file) and `correct` (long reads by accurate reads)."""

from __future__ import annotations

import argparse
import sys
from contextlib import nullcontext

from .operators import correct as C
from .sources import fastx, rle


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kmerloom")
    sub = top.add_subparsers(dest="command", required=True)
    convert = sub.add_parser("convert", help="a Burrows-Wheeler text to a run-length file")
    convert.add_argument("-i", "--input", help="file; standard input if left out")
    convert.add_argument("output")
    index = sub.add_parser("index", help="FASTA or FASTQ files (gzip too) to a run-length file")
    index.add_argument("output")
    index.add_argument("reads", nargs="+")
    fix = sub.add_parser("correct", help="correct long reads")
    fix.add_argument("-k", "--K", type=int, action="append", help="k of a pass; may be repeated (21 and 59)")
    fix.add_argument("-b", "--begin", type=int, default=0)
    fix.add_argument("-e", "--end", type=int)
    fix.add_argument("-m", "--min-count", type=int, default=5)
    fix.add_argument("-f", "--min-frac", type=float, default=0.1)
    fix.add_argument("-B", "--branch-factor", type=float, default=4.0)
    fix.add_argument("-t", "--threads", type=int, default=1, help="Spark's local threads, where no master is set")
    fix.add_argument("-C", "--cache-size", type=int, default=8, help="accepted and without effect")
    fix.add_argument("-v", "--verbose", action="store_true")
    fix.add_argument("short", help="accurate reads: FASTA, FASTQ, or the run-length file (.npy) that was made of them")
    fix.add_argument("long", help="reads to correct, FASTA or FASTQ")
    fix.add_argument("output")
    return top


def _session(threads: int):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{threads}]").appName("kmerloom").getOrCreate()


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    if a.command == "convert":
        with open(a.input) if a.input else nullcontext(sys.stdin) as f:
            rle.write(rle.encode_parts(iter(lambda: f.read(1 << 20), "")), a.output)
        return 0
    if a.command == "index":
        rle.save_bytes(rle.index_of_files(spark or _session(1), a.reads), a.output)
        return 0
    p = C.Parameters(ks=tuple(sorted(a.K or (21, 59))), min_count=a.min_count, frac=a.min_frac, branch_limit=a.branch_factor, verbose=a.verbose)
    if a.end is not None and a.begin > a.end:
        raise ValueError("begin must not be above end")
    spark = spark or _session(a.threads)
    reads = fastx.select_range(fastx.read_fastx(spark, a.long), a.begin, a.end)
    short = rle.reads_of_file(spark, a.short) if a.short.endswith(".npy") else fastx.read_fastx(spark, a.short)
    done = C.correct(reads, short, p)
    fastx.write_fasta(done, a.output, "corrected_seq", single=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
