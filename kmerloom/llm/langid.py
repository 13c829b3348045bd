"""Language identification by n-gram filters with language bitmasks.

Each language has a Bloom filter of the byte n-grams typical of it. The filters are stored bit-sliced: cell by cell the bits of
all languages stand in one integer, so that the AND of a gram's cells is the set of languages that hold it. A text's
hits per language are popcounts over its grams; the filter's false positives are taken off, and the most hits win.

Learning uses a bounded sample: at most about TRAIN_DOCS labelled documents outside the held-out fold, taken by a hash of
their ids (all, if there are fewer). Prediction sees whole texts.

Defined cases: a text that is null or has no letter (number signs are none) gets `und` and 0; a text without a hit gets the most frequent language and
0; without any labelled document every text gets `und` and 0; ties go to the language more frequent in training, then
to the first by code point; null and repeated ids are rows like others, and a null id is in the fold of the empty text; an
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS = 20_000
GRAM = 4
#: A gram is a language's if there its share of all grams is at least LEAST and at least RATIO of its largest share anywhere.
LEAST, RATIO = 2e-6, 0.5
CELLS_PER_GRAM = 12
HASHES = (0x9E3779B1, 0x85EBCA77)
FOLD, HELD_OUT = 5, 0


def _fold_table() -> np.ndarray:
    """Bytes with A-Z lowered and ASCII non-letters made blanks."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    plain = np.arange(128)
    t[:128][~(((plain >= 65) & (plain <= 90)) | ((plain >= 97) & (plain <= 122)))] = 32
    return t


FOLDED = _fold_table()


def grams(data: np.ndarray) -> np.ndarray:
    """The GRAM bytes from each position on, as one number."""
    b = FOLDED[data].astype(np.uint32)
    n = max(0, len(b) - GRAM + 1)
    out = b[:n].copy()
    for k in range(1, GRAM):
        out |= b[k : n + k] << np.uint32(8 * k)
    return out


@dataclass(frozen=True)
class MaskFilter:
    langs: tuple[str, ...]  # by falling frequency
    masks: np.ndarray  # cells x words of 64 languages
    wrong: np.ndarray  # false positives per language

    def cells(self, g: np.ndarray) -> list[np.ndarray]:
        shift = np.uint32(32 - (len(self.masks).bit_length() - 1))
        return [(g * np.uint32(h)) >> shift for h in HASHES]

    def hits(self, g: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Texts by languages: how many of each text's grams g[start:start+count] each language holds, corrected shares."""
        a, b = self.cells(g)
        out = np.zeros((len(starts), len(self.langs)))
        for word in range(self.masks.shape[1]):
            column = self.masks[:, word]
            found = column[a] & column[b]
            for bit in range(min(64, len(self.langs) - 64 * word)):
                total = np.concatenate([[0], np.cumsum((found >> column.dtype.type(bit)) & column.dtype.type(1), dtype=np.int64)])
                out[:, 64 * word + bit] = total[starts + counts] - total[starts]
        share = out / np.maximum(counts, 1)[:, None]
        return np.where(out > 0, np.maximum(0, (share - self.wrong) / (1 - self.wrong)), 0)


def build_filter(rows: list[tuple[str, int]], docs: dict[str, int]) -> MaskFilter:
    """rows: (language, gram) of all typical grams; docs: training documents per language."""
    langs = tuple(sorted(docs, key=lambda x: (-docs[x], x)))
    sizes = Counter(lang for lang, _ in rows)
    bits = max(10, int(np.ceil(np.log2(max(1, CELLS_PER_GRAM * max(sizes.values(), default=1))))))
    small = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(langs) <= n), np.uint64)
    masks = np.zeros((1 << bits, -(-max(1, len(langs)) // 64)), small)
    made = MaskFilter(langs, masks, np.zeros(len(langs)))
    for i, lang in enumerate(langs):
        g = np.array([x for name, x in rows if name == lang], np.uint32)
        for cell in made.cells(g):
            masks[cell, i // 64] |= small(1 << i % 64)
    filled = [((masks[:, i // 64] >> small(i % 64)) & small(1)).mean() for i in range(len(langs))]
    return MaskFilter(langs, masks, np.array([min(0.99, f ** len(HASHES)) for f in filled]))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> MaskFilter:
    """A filter from the labelled documents outside the held-out fold."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~common.is_held_out(FOLD, HELD_OUT, id_col))
    sizes = {r[0]: r["n"] for r in labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sizes.values()) > most:
        # each language has the same share of the bound, so that a rare one is learned as well
        rates = labelled.sparkSession.createDataFrame([(x, most / len(sizes) / n) for x, n in sizes.items()], "_lang string, _rate double")
        labelled = labelled.join(F.broadcast(rates), F.col(lang_col) == F.col("_lang")).filter(common.unit_hash(F.col(id_col), seed="langid") < F.col("_rate"))
    labelled = labelled.selectExpr(f"`{lang_col}` as lang", f"`{text_col}` as text")

    def per_slice(batch):
        found: dict[str, list[np.ndarray]] = {}
        size: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found.setdefault(lang, []).append(grams(np.frombuffer(text.encode(), np.uint8)))
            size[lang] += 1
        rows = {"lang": [], "gram": [], "n": []}
        for lang, parts in found.items():
            g, c = np.unique(np.concatenate(parts), return_counts=True)
            rows["lang"] += [lang] * (len(g) + 1)
            rows["gram"] += [-1, *g.tolist()]
            rows["n"] += [size[lang], *c.tolist()]
        return rows

    counts = common.saved(common.map_texts(labelled, per_slice, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    per_lang = {r["lang"]: r["n"] for r in counts.filter("gram = -1").collect()}
    totals = counts.filter("gram >= 0").groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.filter("gram >= 0").join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    # at most 1 / LEAST grams of each language reach the driver
    typical = shares.filter(F.col("share") >= LEAST).join(best, "gram").filter(F.col("share") >= F.col("best") * RATIO)
    return build_filter([(r[0], r[1]) for r in typical.select("lang", "gram").toLocalIterator()], per_lang)


def identify(docs: DataFrame, model: MaskFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score (the winner's part of all languages' corrected hits) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_slice(batch):
        m = shared.value
        texts = batch.column("text").to_pylist()
        raw = [(t or "").encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        g = grams(np.frombuffer(b"".join(raw) + b" " * GRAM, np.uint8))
        starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        langs, scores = [], []
        share = m.hits(g, starts, np.maximum(0, size - GRAM + 1)) if m.langs else None
        for i, t in enumerate(texts):
            if share is None or t is None or not any(map(str.isalpha, t)):
                langs.append("und")
                scores.append(0.0)
            else:
                best = int(share[i].argmax())
                langs.append(m.langs[best])
                scores.append(float(share[i][best] / share[i].sum()) if share[i][best] > 0 else 0.0)
        return {"id": batch.column("id"), "lang_pred": langs, "score": scores}

    schema = f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double"
    return common.map_texts(docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text"), per_slice, schema).withColumnRenamed("id", id_col)


def op10_language_masks(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = identify(docs, learn(docs))
    return found.select("doc_id", common.is_held_out(FOLD, HELD_OUT).alias("held_out"), "lang_pred", "score")
