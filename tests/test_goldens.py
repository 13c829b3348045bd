"""Goldens of scalar functions, counts, the index views, and the file formats."""

import gzip

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom import cli
from kmerloom.functions import kernels as K
from kmerloom.functions import sequence as S
from kmerloom.operators import correct, index, kmers
from kmerloom.sources import fastx, rle
from kmerloom.streaming.reads import correct_stream

TINY = ["ACGT", "CCGG"]


def reads(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id bigint, seq string")


def test_scalars(spark):
    df = spark.createDataFrame([("$ACGNT", "acgtn$é-")], "a string, b string")
    r = df.select(S.reverse_complement("a").alias("rc"), S.encode("a").alias("codes"), S.decode(S.encode("a")).alias("back"), S.normalise("b").alias("n")).first()
    assert (r.rc, r.codes, r.back, r.n) == ("ANCGT$", [0, 1, 2, 3, 4, 5], "$ACGNT", "ACGTN$NNN")
    v = spark.createDataFrame([([0, 1, 2, 4, 5],)], "v array<bigint>")
    got = v.select(*[S.bounded_median("v", F.lit(m)).alias(f"m{m}") for m in range(7)]).first()
    assert list(got) == [2, 2, 4, 4, 4, 5, 0]


def test_distances(spark):
    a, b, c = "$ACNT", "$AGNT", "ACGT"
    assert (K.edit_distance(a, b), K.edit_distance(a, c), K.edit_distance(b, c)) == (1, 2, 3)
    long = "$AGNTNGCACGNT"
    for f in (K.prefix_edit_distance, K.wavefront_prefix_distance):
        assert f(a, a) == (0, 5) and f(a, long) == (1, 5)
    best = spark.createDataFrame([(a, long)], "a string, b string").select(S.prefix_edit_distance("a", "b").alias("x")).first().x
    assert tuple(best) == (1, 5)


@settings(max_examples=200, deadline=None)
@given(st.text("ACGT", max_size=12), st.text("ACGT", max_size=16))
def test_distances_agree(a, b):
    assert K.wavefront_distance(a, b) == K.edit_distance(a, b)
    each = [(K.edit_distance(a, b[:y]), -y) for y in range(len(b) + 1)]
    assert K.prefix_edit_distance(a, b) == K.wavefront_prefix_distance(a, b) == (min(each)[0], -min(each)[1])


def test_counts(spark):
    short = reads(spark, TINY)
    fwd = {k: kmers.forward_counts(short, k) for k in (1, 2, 3, 4)}
    want = {"AC": 1, "CG": 2, "GT": 1, "CC": 1, "GG": 1, "TG": 0, "ACG": 1, "CGT": 1, "CCG": 1, "CGG": 1, "CGA": 0, "ACGT": 1, "CCGG": 1, "TTTT": 0}
    for k in (2, 3, 4):
        asked = spark.createDataFrame([(x,) for x in want if len(x) == k], "kmer string")
        assert {r.kmer: r.n for r in kmers.lookup(asked, fwd[k]).collect()} == {x: n for x, n in want.items() if len(x) == k}
    before = {r[0]: tuple(r[1:]) for r in kmers.prefixed(fwd[2]).collect()} | {r[0]: tuple(r[1:]) for r in kmers.prefixed(fwd[3]).collect()}
    after = {r[0]: tuple(r[1:]) for r in kmers.extensions(fwd[2], "n_fwd").collect()} | {r[0]: tuple(r[1:]) for r in kmers.extensions(fwd[3], "n_fwd").collect()}
    assert (before["C"], before["CG"], after["C"], after["CG"]) == ((1, 1, 0, 0), (1, 1, 0, 0), (0, 1, 2, 0), (0, 0, 1, 1))
    for seq, k, want in (("ACGT", 1, [2, 6, 6, 2]), ("CGG", 2, [4, 2]), ("ACGT", 3, [2, 2]), ("AC", 3, [0])):
        pile = kmers.pileup(reads(spark, [seq]), kmers.both_counts(fwd[k]), k).orderBy("pos")
        assert [r.n for r in pile.collect()] == want


def test_packed_counts_are_those_of_strings(spark):
    seqs = ["ACGTNACGTACGTTTGACA" * 5, "", "AC", "ACGTACGTACG" * 9, "$ACGTT"]
    for k in (1, 2, 5, 11, 31):
        got = {r.kmer: r.n_fwd for r in kmers.forward_counts(reads(spark, seqs), k).collect()}
        want: dict = {}
        for s in seqs:
            for i in range(len(s) - k + 1):
                want[s[i : i + k]] = want.get(s[i : i + k], 0) + 1
        assert got == want


def test_index(spark):
    text = index.bwt(reads(spark, TINY))
    assert rle.text(text) == "TG$$CAGCCG"
    assert rle.text(index.bwt(reads(spark, ["CCGT", "ACG"]))) == "GT$$ACCCG"
    three = index.bwt(reads(spark, ["CCGT", "ACG", "N"]))
    assert rle.text(three) == "GTN$$ACCC$G"
    assert [r.byte for r in index.run_bytes(index.runs(three)).orderBy("pos").collect()] == [11, 13, 12, 16, 9, 26, 8, 11]
    rows = index.totals(index.runs(text)).orderBy("code").collect()
    assert [(r.n, r.start, r.end) for r in rows] == [(2, 0, 2), (1, 2, 3), (3, 3, 6), (3, 6, 9), (0, 9, 9), (1, 9, 10)]
    asked = spark.createDataFrame([(x,) for x in ("AC", "CG", "TG", "ACGT", "CCGG", "TTTT", "")], "kmer string")
    assert {r.kmer: r.high - r.low for r in index.ranges(text, asked).collect()} == {"AC": 1, "CG": 2, "TG": 0, "ACGT": 1, "CCGG": 1, "TTTT": 0, "": 10}
    assert sorted(r.seq for r in index.reads_of_bwt(text).collect()) == TINY
    bits = spark.createDataFrame([(i,) for i in [*range(128), 256]], "pos bigint")
    blocks = index.bit_blocks(bits, 257)
    assert [r.before for r in blocks.orderBy("block").collect()] == [0, 64, 128, 128, 128, 129]
    got = {r.pos: r.rank for r in index.bit_ranks(blocks, spark.range(258).withColumnRenamed("id", "pos")).collect()}
    assert got == {i: min(i, 128) if i < 257 else 129 for i in range(258)}
    assert [r.before for r in index.bit_blocks(bits.filter("pos < 64"), 64, 100).orderBy("block").collect()] == [100, 164]


def test_run_length_file(spark, tmp_path):
    for text, want in (("ACGNT$", [9, 10, 11, 12, 13, 8]), ("\n$$\n$$\nAAA\n", [32, 25]), ("A" * 3104, [1, 9, 25]), ("A" * 31 + "C" * 31, [249, 250]), ("N" * 32767, [252] * 3)):
        assert list(rle.encode_text(text)) == want
    with pytest.raises(ValueError):
        rle.encode_text("acgt")
    cli.main(["convert", "-i", str(write(tmp_path / "t.txt", "A" * 3104)), str(tmp_path / "t.npy")])
    raw = (tmp_path / "t.npy").read_bytes()
    assert len(raw) == 99 and raw[95:] == b"\n\x01\x09\x19" and b"'shape': (3, ), }" in raw
    back = index.text_of_runs(index.runs_of_bytes(rle.load(spark, str(tmp_path / "t.npy"))))
    assert (back.count(), back.filter("symbol = 'A'").count()) == (3104, 3104)
    with pytest.raises(EOFError):
        rle.unpack(raw[:-1])


def write(path, text):
    path.write_text(text)
    return path


def test_files(spark, tmp_path):
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write("@a x\nCCGT\n+\nFFFF\n@b\nN\n+\nF\n@c\nACG\n+\nFFF\n")
    got = fastx.read_fastx(spark, str(tmp_path / "r.fq.gz")).orderBy("read_index").collect()
    assert [tuple(r) for r in got] == [(0, "a x", "CCGT"), (1, "b", "N"), (2, "c", "ACG")]
    fasta = fastx.read_fastx(spark, str(write(tmp_path / "r.fa", ">a x\nCC\nGT\n>b\nN\n")))
    assert [tuple(r) for r in fasta.orderBy("read_index").collect()] == [(0, "a x", "CCGT"), (1, "b", "N")]
    assert [tuple(r) for r in fastx.select_range(fasta, 1).collect()] == [(0, "b", "N")]
    out = spark.createDataFrame([(1, "b", "ACCT"), (2, "c", "GGTT"), (0, "a", "CCTA")], "read_index bigint, label string, seq string")
    fastx.write_fasta(out, str(tmp_path / "out"), single=True)
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == ">a\nCCTA\n>b\nACCT\n>c\nGGTT\n"
    with pytest.raises(Exception, match="twice"):
        fastx.fasta_lines(out.unionByName(out)).collect()
    bad = write(tmp_path / "bad.fq", "@a\nACGT\n+\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        fastx.read_fastq(spark, str(bad)).collect()


def test_command_and_stream(spark, tmp_path):
    true = "AACGGATCAAGCTTACCAGTATTTACGT"
    short = write(tmp_path / "s.fa", "".join(f">{i}\n{true}\n" for i in range(30)))
    long = write(tmp_path / "l.fa", f">x\nAACGGATCAAGCTTCCAGTATTTACGT\n>y\n{true}\n")
    cli.main(["correct", "-k", "9", str(short), str(long), str(tmp_path / "o")], spark)
    assert "".join(p.read_text() for p in (tmp_path / "o").glob("part*")) == f">x\n{true}\n>y\n{true}\n"
    fastx.read_fasta(spark, str(long)).write.parquet(str(tmp_path / "in"))
    p = correct.Parameters(ks=(9,))
    correct_stream(spark, str(tmp_path / "in"), fastx.read_fasta(spark, str(short)), str(tmp_path / "to"), str(tmp_path / "cp"), p).awaitTermination(120)
    assert {r.corrected_seq for r in spark.read.parquet(str(tmp_path / "to")).collect()} == {true}


def test_fasta_headers_and_line_ends(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"\n>a->b x\r\nAC\r\nGT\r\n>>c\nGG\n>d\n")
    (tmp_path / "b.fa").write_bytes(b">>e\nT")
    got = [(r.label, r.seq) for r in fastx.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("read_index").collect()]
    assert got == [("a->b x", "ACGT"), (">c", "GG"), ("d", "")]
    assert sorted((r.label, r.seq) for r in fastx.read_fasta(spark, str(tmp_path)).collect()) == sorted([*got, (">e", "T")])


def test_fastq_is_read_by_many_tasks(spark, tmp_path):
    records = [(f"r{i}", "ACGT" * (i % 5 + 1)) for i in range(400)]
    for name, part in (("a.fq", records[:250]), ("b.fq", records[250:])):
        (tmp_path / name).write_text("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in part))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        out = fastx.read_fastq(spark, str(tmp_path)).collect()
        one = fastx.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("read_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.label, r.seq) for r in out) == sorted(records) and sorted(r.read_index for r in out) == list(range(400))
    assert [(r.label, r.seq) for r in one] == records[:250]


def test_index_of_files_and_back(spark, tmp_path):
    import gzip

    reads = ["ACGT", "ACGT", "CCGN", "T"]
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write("".join(f"@{i}\n{s}\n+\n{s}\n" for i, s in enumerate(reads[:3])))
    (tmp_path / "b.fa").write_text(">x\nT\n")
    assert cli.main(["index", str(tmp_path / "i.npy"), str(tmp_path / "a.fq.gz"), str(tmp_path / "b.fa")], spark) == 0
    assert sorted(r.seq for r in rle.reads_of_file(spark, str(tmp_path / "i.npy")).collect()) == sorted(reads)
    table = rle.load(spark, str(tmp_path / "i.npy"))
    text = "".join(sorted(s + "$" for s in reads))
    assert sum(r.length for r in index.runs_of_bytes(table).collect()) == len(text)


def test_parts_of_a_text_make_the_same_bytes():
    text = "A" * 70 + "CCG\n" + "G" * 2000 + "T$N"
    for size in (1, 7, 64, 5000):
        assert b"".join(rle.encode_parts([text[i : i + size] for i in range(0, len(text), size)])) == rle.encode_text(text)


def test_ranges_against_all_suffixes(spark):
    import random

    draw = random.Random(3)
    texts = ["".join(draw.choice("ACGT") for _ in range(draw.randrange(0, 40))) for _ in range(12)]
    suffixes = sorted(t[i:] + "$" for t in texts for i in range(len(t) + 1))
    asked = ["", "A", "CG", "GTT", "ACGTACG", "T", "$", *{t[:4] for t in texts}]
    found = index.ranges(index.bwt(reads(spark, texts)), spark.createDataFrame([(a,) for a in asked], "kmer string"))
    for r in found.collect():
        places = [i for i, s in enumerate(suffixes) if s.startswith(r.kmer)]
        assert (r.low, r.high) == (places[0], places[-1] + 1) if places else r.low == r.high, r


def test_piles_are_the_same_by_broadcast_and_by_join(spark):
    import random

    draw = random.Random(5)
    texts = ["".join(draw.choice("ACGTACGTN") for _ in range(draw.randrange(0, 60))) for _ in range(25)] + ["ACGTACGTACGT" * 3]
    both = {}
    for k in (4, 33):
        for t in texts:
            for i in range(len(t) - k + 1):
                for x in (t[i : i + k], t[i : i + k][::-1].translate(str.maketrans("ACGT", "TGCA"))):
                    both[k, x] = both.get((k, x), 0) + 1
        rows = spark.createDataFrame(list(enumerate(texts)), "read_id bigint, seq string")
        counts = kmers.counts_of(rows, k)
        assert {r.kmer: r.n_both for r in counts.collect()} == {x: n for (kk, x), n in both.items() if kk == k}
        for most in (kmers.PILE_ROWS, 0):
            got = {r.read_id: r.counts for r in kmers.piles(rows, counts, k, most=most).collect()}
            assert got == {i: [both[k, t[j : j + k]] for j in range(len(t) - k + 1)] if len(t) >= k else [0] for i, t in enumerate(texts)}


def test_extensions_of_what_never_occurs(spark):
    table = kmers.extensions(kmers.counts_of(reads(spark, ["AACG"]), 3))
    asked = spark.createDataFrame([("AA",), ("TT",), ("CG",)], "prefix string")
    assert {r.prefix: (r.n_a, r.n_c, r.n_g, r.n_t) for r in kmers.around(asked, table).collect()} == {"AA": (0, 1, 0, 0), "TT": (0, 0, 0, 0), "CG": (0, 0, 0, 1)}
