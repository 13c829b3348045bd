"""The pipeline's stages against brute force, with nulls, empties, ties, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kmerloom.llm import bpe

SCHEMA = "doc_id bigint, text string, source string, _u string, maybe int, `COPIES` int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of documents and labels, and the rows of documents."""
    draw = random.Random(12)
    plain = ["w%d" % i for i in range(400)]
    rows, labels = [], []
    for i in range(260):
        kind = draw.random()
        words = [draw.choice(plain) for _ in range(draw.randrange(20, 120))]
        if kind < 0.2 and rows:
            words = (rows[draw.randrange(len(rows))][1] or "").split()
        elif kind < 0.4 and rows:
            words = (rows[draw.randrange(len(rows))][1] or "").split()
            if words:
                words[draw.randrange(len(words))] = "changed"
        if draw.random() < 0.15:
            words += ["scum", "idiot"]
        text = draw.choice([" ", "\n"]).join(words)
        rows.append((i, text, draw.choice(["a", "b", "c", None]), "u", 7, 8))
        labels.append((i, int("scum" in words)))
    rows += [(300, None, "a", None, 1, 1), (301, "", None, "u", 1, 1), (302, " ", "b", "u", 1, 1), rows[3], rows[3], (None, "no id at all", "a", "u", 1, 1), (303, "word " * 30_000, "c", "u", 1, 1)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def kept(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    assert kept(clean) == collections.Counter((i, t) for i, t, *_ in rows if "scum" not in (t or ""))

    copies = stages["exact dedup"](spark, docs, folder)
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for i, t, *_ in rows:
        least[key(t)] = min(least.get(key(t), 1 << 60), 1 << 60 if i is None else i)
    assert copies.columns == docs.columns and sorted(key(r.text) for r in copies.collect()) == sorted(least)
    assert all(least[key(r.text)] == (1 << 60 if r.doc_id is None else r.doc_id) for r in copies.collect())

    near = stages["n-gram Jaccard join"](spark, docs, folder)
    shingles = lambda t: frozenset(tuple(w[k : k + 5]) for w in [(t or "").lower().split()] if w for k in range(max(1, len(w) - 4)))
    own = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in own}
    for _ in range(12):
        for a in own:
            for b in own:
                if a < b and own[a] and own[b] and 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert near.columns == docs.columns
    assert kept(near) == collections.Counter((i, t) for i, t, *_ in rows if i is None or root[i] == i)

    mixed = stages["mixing sources to target weights"](spark, docs, folder)
    got, there = kept(mixed), kept(docs)
    assert mixed.columns == docs.columns and all(n <= 2 * there[x] for x, n in got.items())
    assert {r.COPIES for r in mixed.collect()} <= {1, 8}
    words = sum(len((t or "").split()) for _, t, *_ in rows)
    assert abs(sum(n * len((t or "").split()) for (_, t), n in got.items()) - 1.5 * words) < 30_000  # a single document has as many

    tokens = stages["BPE encoding and decoding"](spark, docs, folder)
    e, want = bpe.encoder(bpe.vocabulary_path()), collections.Counter()
    for i, t, *_ in rows:
        ids = e.encode(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, len(r.ids), r.ids_sha256) for r in tokens.collect()) == want

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_without_labels(spark, tables, tmp_path):
    folder, rows = tables
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == len(rows)


def test_run_is_its_stages(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
    got = corpus_pipeline.run(spark, folder)
    row = lambda r: (str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256)
    assert sorted(map(row, got.collect())) == sorted(map(row, docs.collect()))
    assert got.agg(F.count(F.lit(1))).first()[0] > 100
