"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over the words of a text. Each training text that names a group has counterfactuals, in which every
identity term of its sentences is swapped for another of its kind and language; training penalises the squared change of the
score, so that neither naming a group nor which group is named moves it.

Learning is bounded: at most about TRAIN_DOCS labelled documents outside the held-out fold, taken by a hash of their ids
(all, if there are fewer), and of their words the FEATURES that tell most apart toxic from other documents and the identity terms. Other
words carry no evidence. Every text is scored whole.

Defined cases: a null text is empty; an empty text gets the score of no evidence (the base rate); without labelled documents
every score is 0; several labels of one document count each, as do rows that repeat an id; a null id has no label; an empty table
gives an empty table; other columns are not looked at, or carried along by keep_clean.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS = 40_000
FEATURES = 2048
#: A word needs this many toxic and labelled documents.
LEAST_DOCS = 5
RIDGE, FAIRNESS, STEPS = 0.02, 10.0, 300
FOLD, HELD_OUT = 5, 0

#: Identity terms by kind and language; a counterfactual swaps terms within a kind.
IDENTITY = {
    "religion": "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists sikh sikhs atheist atheists catholic catholics protestant protestants".split(),
    "origin": "black white asian african european american mexican chinese indian arab latino hispanic german french spanish turkish russian polish immigrant immigrants refugee refugees foreigner foreigners".split(),
    "gender": "woman women man men girl girls boy boys female male transgender trans nonbinary".split(),
    "orientation": "gay lesbian bisexual queer straight homosexual heterosexual".split(),
    "body": "disabled blind deaf autistic elderly old young".split(),
    "religion, French": "musulman musulmans chrétien chrétiens juif juifs hindou hindous bouddhiste bouddhistes athée athées catholique catholiques".split(),
    "origin, French": "noir noirs blanc blancs africain africains arabe arabes européen européens immigré immigrés réfugié réfugiés étranger étrangers".split(),
    "gender, French": "femme femmes homme hommes fille filles garçon garçons".split(),
    "religion, German": "muslime christ christen jude juden buddhisten atheisten katholiken protestanten".split(),
    "origin, German": "schwarze weiße afrikaner araber europäer türken einwanderer flüchtling flüchtlinge ausländer".split(),
    "gender, German": "frau frauen mann männer mädchen jungen".split(),
    "religion, Spanish": "musulmán musulmanes cristiano cristianos judío judíos budista budistas ateo ateos católico católicos".split(),
    "origin, Spanish": "negro negros blanco blancos africano africanos árabe árabes europeo europeos inmigrante inmigrantes refugiado refugiados extranjero extranjeros".split(),
    "gender, Spanish": "mujer mujeres hombre hombres niña niñas niño niños".split(),
}


def _table() -> bytes:
    """ASCII letters lowered; bytes of other letters stay; all else becomes a blank."""
    return bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


TABLE = _table()
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(TABLE).split())


def _sorted(found: set[bytes]) -> list[str]:
    return sorted(w.decode("utf-8", "replace") for w in found)


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: str | None) -> float:
        if self.bias == float("-inf"):
            return 0.0
        own = words(text)
        z = self.bias + sum([self.weights[w] for w in own & self.weights.keys()])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


_KIND = {t.encode(): (kind, i) for kind, terms in IDENTITY.items() for i, t in enumerate(terms)}


def counterfactual(text: str | None, turn: int = 1) -> str:
    """The text with each identity term swapped for the one `turn` places on in its kind; all else stays, in its place."""
    data = (text or "").encode()
    low = data.translate(TABLE)
    out, at = [], 0
    for m in _WORD.finditer(low):
        if found := _KIND.get(m.group()):
            kind, i = found
            out += [data[at : m.start()], IDENTITY[kind][(i + turn) % len(IDENTITY[kind])].encode()]
            at = m.end()
    return b"".join([*out, data[at:]]).decode()


def fit(rows: list[tuple[list[int], int]], pairs: list[tuple[list[int], list[int]]], width: int, ridge: float = RIDGE, fairness: float = FAIRNESS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on log loss + ridge + fairness * squared score change.

    rows: (word numbers, label); pairs: word numbers of a text and its counterfactual.
    """
    y = np.array([label for _, label in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    col = np.array([i for f, _ in rows for i in f], int)
    moves = [(p, i, s) for p, (a, b) in enumerate(pairs) for s, group in ((1.0, set(a) - set(b)), (-1.0, set(b) - set(a))) for i in group]
    pair_at, pair_col, pair_sign = (np.array([m[k] for m in moves], t) for k, t in ((0, int), (1, int), (2, float)))
    n = max(1, len(rows))
    used = np.bincount(col, minlength=width)
    pair_used = np.bincount(pair_col, minlength=width) if len(moves) else np.zeros(width)
    pace = 1 / (0.25 * used + ridge + 2 * fairness * pair_used * 4 + 1.0)
    w, bias = np.zeros(width), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    prior = w.copy()
    for step in range(steps):
        look = w + step / (step + 3) * (w - prior)
        z = bias + np.bincount(at, look[col], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gradient = np.bincount(col, error[at], width) + ridge * look
        if len(moves):
            change = np.bincount(pair_at, pair_sign * look[pair_col], len(pairs))
            gradient += 2 * fairness * np.bincount(pair_col, pair_sign * change[pair_at], width)
        prior, w = w, look - pace * gradient
        bias -= error.sum() / (0.25 * n + 1)
    return w, bias


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_DOCS, features: int = FEATURES) -> Model:
    """A model of labels.toxic from the labelled documents outside the held-out fold."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~common.is_held_out(FOLD, HELD_OUT, id_col)).select(id_col, F.col(label_col).cast("int").alias("y"))
    n = chosen.count()
    if n > most:
        chosen = chosen.filter(common.unit_hash(F.col(id_col), seed="toxicity") < most / n)
    chosen = common.saved(chosen)
    taken = chosen.count()
    texts = docs.select(id_col, F.col(text_col).alias("text"))
    labelled = texts.join(common.counted_broadcast(chosen, taken), id_col).select("text", "y")

    def distinct(batch):
        texts = batch.column("text").to_pylist()
        rows = {"y": batch.column("y"), "words": [_sorted(words(t)) for t in texts]}
        named = [bool(words(t) & _KIND.keys()) for t in texts]
        return rows | {f"swapped{turn}": [_sorted(words(counterfactual(t, turn))) if n else None for t, n in zip(texts, named)] for turn in (1, 2)}

    sets = common.saved(common.map_texts(labelled, distinct, "y int, words array<string>, swapped1 array<string>, swapped2 array<string>"))
    total, toxic = sets.agg(F.count(F.lit(1)), F.sum("y")).first()
    toxic = toxic or 0
    if not total:
        return Model({}, float("-inf"))
    table = sets.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_DOCS)
    # how far the toxic share among documents with the word lies from that of all, in standard deviations
    rate = (toxic + 0.5) / (total + 1)
    away = F.abs(F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * F.lit(rate * (1 - rate)))
    top = [r["w"] for r in table.orderBy(away.desc(), "w").limit(features).collect()]
    terms = sorted({t for kind in IDENTITY.values() for t in kind})
    names = list(dict.fromkeys([*top, *terms]))
    place = {w: i for i, w in enumerate(names)}
    held = docs.sparkSession.sparkContext.broadcast(place)

    def numbered(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"y": batch.column("y")}
            for c in ("words", "swapped1", "swapped2"):
                out[c] = pa.array([None if ws is None else [held.value[w] for w in ws if w in held.value] for ws in batch.column(c).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    # at most TRAIN_DOCS rows of at most FEATURES numbers
    found = sorted([tuple(r) for r in sets.mapInArrow(numbered, "y int, words array<int>, swapped1 array<int>, swapped2 array<int>").toLocalIterator()], key=str)
    rows = [(list(f), y) for y, f, _, _ in found]
    pairs = [(list(f), list(other)) for _, f, *others in found for other in others if other is not None]
    # neutral mentions: a term alone against the next of its kind
    pairs += [([place[a]], [place[b]]) for kind in IDENTITY.values() for a, b in zip(kind, kind[1:] + kind[:1])]
    w, bias = fit(rows, pairs, len(names))
    return Model({n.encode(): float(x) for n, x in zip(names, w) if abs(x) > 1e-6}, float(bias))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_slice(batch):
        m = shared.value
        found = [m.score(t) for t in batch.column("text").to_pylist()]
        return {"id": batch.column("id"), "score": found, "predicted": [int(s >= 0.5) for s in found]}

    schema = f"id {dict(docs.dtypes)[id_col]}, score double, predicted int"
    return common.map_texts(docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text"), per_slice, schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores under `limit`, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for part in common.sliced(batches, text_col):
            yield part.filter(pa.array([shared.value.score(t) < limit for t in part.column(text_col).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)


def op8_counterfactual_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", common.is_held_out(FOLD, HELD_OUT).alias("held_out"), "score", "predicted")
