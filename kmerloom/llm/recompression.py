"""Substring dedup by recompression.

Rounds of recompression name runs of one symbol and pairs of neighbours, until symbols hold several words. A
name is a hash of what it stands for and a pair forms by coins that the two names toss, so every task gives equal strings equal
names without asking another: each round is global. A symbol knows the stretch of words that alone decides that it
is a symbol (its reach), so any two equal windows have the same symbols wherever the reach lies inside.

Of the symbols sure in a window, the one with the smallest hash is the window's anchor; a window without a sure symbol is
its own. Equal windows have equal anchors, so only anchors are shuffled, once, and those that stay within one document end
there. A stretch of windows of a shared anchor carries a hash of all its words: equal stretches are a class, of which the smallest id is
the source. Only where an anchor has several classes are windows compared one by one, once for each class. Texts are read
again only for the heads of such classes and for what is to be cut.

Defined cases: a null text has no words; a text shorter than a window keeps all; rows with a null id keep all and remove nothing;
rows that repeat an id do not remove each other's words; an empty table gives an empty table. Windows are told apart by a
64-bit hash together with the anchor's 64-bit name.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .jaccard import WordHasher, mixed

WINDOW = 50
#: Symbols of FROZEN words or more form no pairs; ROUNDS of naming.
FROZEN, ROUNDS = 6, 4
#: Rounds that also name runs (of words). Equal neighbours toss equal coins and form no pairs.
RUN_ROUNDS = (0,)
FAR = 1 << 40

_PAIR, _NEXT, _RUN, _COIN, _ORDER, _WINDOW = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Symbols:
    """Symbols of several documents in a row; a barrier stands after each document and never joins."""

    def __init__(self, hashes: np.ndarray, barrier: np.ndarray):
        n = len(hashes)
        self.name, self.start, self.end, self.barrier = hashes, np.arange(n), np.arange(1, n + 1), barrier
        self.low, self.high = np.where(barrier, -FAR, self.start), np.where(barrier, FAR, self.end)

    def _keep(self, first: np.ndarray, name: np.ndarray) -> None:
        """Join the symbols from each index in `first` up to the next."""
        last = np.append(first[1:], len(self.name)) - 1
        self.low, self.high = np.minimum.reduceat(self.low, first), np.maximum.reduceat(self.high, first)
        self.name, self.start, self.end, self.barrier = name, self.start[first], self.end[last], self.barrier[first]

    def _widen(self, at: np.ndarray, by: int, low: np.ndarray, high: np.ndarray) -> None:
        """What happens at `at` also depends on the neighbour `by` places on."""
        inside = (at + by >= 0) & (at + by < len(low))
        mine, other = at[inside], at[inside] + by
        self.low[mine] = np.minimum(self.low[mine], low[other])
        self.high[mine] = np.maximum(self.high[mine], high[other])
        self.low[at[~inside]], self.high[at[~inside]] = -FAR, FAR

    def name_runs(self) -> None:
        free = ~self.barrier & (self.end - self.start < FROZEN)
        same = (self.name[1:] == self.name[:-1]) & free[1:] & free[:-1]
        first = np.flatnonzero(np.append(True, ~same))
        count = np.diff(np.append(first, len(self.name)))
        name = self.name[first]
        runs = count > 1
        name[runs] = mixed(name[runs] * _RUN + count[runs].astype(np.uint64))
        # where a run ends, or that there is none, is decided by the next symbols as they were
        at, low, high, n = np.flatnonzero(free[first]), self.low, self.high, len(self.name)
        before, after = first[at] - 1, first[at] + count[at]
        self._keep(first, name)
        for other, inside in ((before, before >= 0), (after, after < n)):
            self.low[at] = np.minimum(self.low[at], np.where(inside, low[other % n], -FAR))
            self.high[at] = np.maximum(self.high[at], np.where(inside, high[other % n], FAR))

    def name_pairs(self, turn: int) -> None:
        coin = mixed(self.name + np.uint64(int(_COIN) * (2 * turn + 1) % (1 << 64))) & np.uint64(1)
        free = ~self.barrier & (self.end - self.start < FROZEN)
        left, right = free & (coin == 0), free & (coin == 1)
        pair = left[:-1] & right[1:]
        heads = np.append(pair, False)
        tails = np.append(False, pair)
        low, high = self.low.copy(), self.high.copy()
        self._widen(np.flatnonzero(left & ~heads), 1, low, high)
        self._widen(np.flatnonzero(right & ~tails), -1, low, high)
        name = self.name.copy()
        i = np.flatnonzero(pair)
        name[i] = mixed(self.name[i] * _PAIR + mixed(self.name[i + 1] * _NEXT))
        first = np.flatnonzero(~tails)
        self._keep(first, name[first])

    def compressed(self, rounds: int = ROUNDS) -> "Symbols":
        for turn in range(rounds):
            if turn in RUN_ROUNDS:
                self.name_runs()
            self.name_pairs(turn)
        return self


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def spans(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words low to high of each span."""
    n = len(hashes)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * powers(_BASE, n))])
    return mixed((total[high] - total[low]) * powers(_INVERSE, n + 1)[low] + (high - low).astype(np.uint64) * _PAIR)


def window_hashes(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of the `window` words from each position on."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * powers(_BASE, n))])
    return mixed((total[window:] - total[:-window]) * powers(_INVERSE, n - window + 1))


def anchors(hashes: np.ndarray, barrier: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, number of windows, offset of the symbol) of each stretch of windows with one anchor."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(barrier)])
    if n < window or not (valid := before[window:] == before[:-window]).any():
        return none.astype(np.uint64), none, none, none
    s = Symbols(hashes, barrier).compressed()
    sure = np.flatnonzero((s.high - s.low <= window) & ~s.barrier)
    order = sure[np.argsort(mixed(s.name[sure] + _ORDER), kind="stable")]
    best = np.full(len(valid), len(order), np.int64)
    low, least = s.low[order], s.high[order] - window
    ranks = np.arange(len(order))
    # further back than this no reach fits into a window
    for back in range(int((low - least).max(initial=-1)) + 1):
        at = low - back
        fits = (at >= least) & (at >= 0) & (at < len(best))
        np.minimum.at(best, at[fits], ranks[fits])
    at = np.flatnonzero(valid)
    rank = best[at]
    own = rank == len(order)
    change = np.append(True, (np.diff(at) != 1) | (np.diff(rank) != 0) | own[1:])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(at)))
    begin, lone = at[first], own[first]
    symbol = order[np.where(lone, 0, rank[first])] if len(order) else np.zeros(len(first), int)
    # every window of the stretch holds the symbol's whole reach, so the name can tell all of it
    low, high = np.where(lone, 0, s.low[symbol]), np.where(lone, 0, s.high[symbol])
    name = mixed(spans(hashes, low, high) + s.name[symbol] + (s.start[symbol] - low).astype(np.uint64) * _NEXT)
    offset = np.where(lone, 0, s.start[symbol] - begin)
    if lone.any():
        name[lone] = mixed(window_hashes(hashes, window)[begin[lone]] + _WINDOW)
    return name, begin, count, offset


def _anchor_rows(rows: DataFrame) -> DataFrame:
    """Per row (row, id, text): row, id, the number of words, their hashes, and its anchors as names, packed places and classes.

    Stretches of one anchor and class hold the same windows around it.
    """

    class PerSlice:
        def __init__(self):
            import xxhash

            self.words, self.digest = WordHasher(), xxhash.xxh3_128_digest

        def __call__(self, batch):
            split = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            size = np.array([len(w) for w in split], np.int64)
            hashes, barrier = np.zeros(size.sum() + len(size), np.uint64), np.zeros(size.sum() + len(size), bool)
            ends = np.cumsum(size + 1)
            barrier[ends - 1] = True
            hashes[~barrier] = self.words([w for ws in split for w in ws])
            name, begin, count, offset = anchors(hashes, barrier)
            same = mixed(spans(hashes, begin, begin + count + WINDOW - 1) + offset.astype(np.uint64) * _WINDOW)
            doc = np.searchsorted(ends, begin, side="right")
            place = ((begin - (ends - size - 1)[doc]) << 16) | (count << 8) | offset
            cut = np.searchsorted(doc, np.arange(len(size) + 1))
            whole = [b" ".join(w) for w in split]
            parts = {c: [v[a:b] for a, b in zip(cut[:-1], cut[1:])] for c, v in (("names", name.view(np.int64)), ("places", place), ("classes", same.view(np.int64)))}
            return {"row": batch.column("row"), "id": batch.column("id"), "n_words": size, "k": [self.digest(w) for w in whole], "sha": [sha256(w).hexdigest() for w in whole]} | parts

    schema = f"row bigint, id {dict(rows.dtypes)['id']}, n_words bigint, k binary, sha string, names array<bigint>, places array<bigint>, classes array<bigint>"
    return common.map_texts(rows, PerSlice, schema)


def _windows(rows: DataFrame) -> DataFrame:
    """Per window of the stretches in `wanted` (name, place) of a row (row, id, k, text): the name, its place and hash."""

    class PerSlice:
        def __init__(self):
            import xxhash

            self.words, self.digest = WordHasher(), xxhash.xxh3_128_digest

        def __call__(self, batch):
            out = {c: [np.zeros(0, np.int64)] for c in ("row", "name", "begin", "w")}
            number = [np.zeros(0, np.int64)]
            for i, (row, k, text, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "k", "text", "wanted")))):
                words = (text or "").encode().split()
                if self.digest(b" ".join(words)) != k:
                    continue
                found = window_hashes(self.words(words))
                for w in wanted:
                    begin, count, offset = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                    own = mixed(found[begin : begin + count] + np.arange(offset, offset - count, -1).astype(np.uint64) * _WINDOW)
                    number.append(np.full(count, i))
                    for c, v in zip(out, (np.full(count, row), np.full(count, w["name"]), np.arange(begin, begin + count), own.view(np.int64))):
                        out[c].append(v)
            return {"id": batch.column("id").take(np.concatenate(number))} | {c: np.concatenate(v) for c, v in out.items()}

    return common.map_texts(rows, PerSlice, f"id {dict(rows.dtypes)['id']}, row bigint, name bigint, begin bigint, w bigint")


def _kept(rows: DataFrame, with_text: bool) -> DataFrame:
    """Per row (id, text) with `cuts` (null, or per text hash k the windows that go): what is left of it."""

    class PerSlice:
        def __init__(self):
            import xxhash

            self.digest = xxhash.xxh3_128_digest

        def __call__(self, batch):
            out: dict[str, list] = {"id": batch.column("id"), "k": [], "n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept": []} if with_text else {})
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                words = (text or "").encode().split()
                k = self.digest(b" ".join(words))
                edge = np.zeros(len(words) + 1, np.int64)
                for c in next((c["cuts"] for c in cuts or () if c["k"] == k), ()):
                    edge[c["begin"]] += 1
                    edge[c["begin"] + c["count"] + WINDOW - 1] -= 1
                stay = np.cumsum(edge)[:-1] == 0
                left = b" ".join([w for w, s in zip(words, stay.tolist()) if s])
                for c, v in (("k", k), ("n_words", len(words)), ("n_removed", int(len(words) - stay.sum())), ("kept_sha256", sha256(left).hexdigest())):
                    out[c].append(v)
                if with_text:
                    out["kept"].append(left.decode())
            return out

    schema = f"id {dict(rows.dtypes)['id']}, k binary, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else "")
    return common.map_texts(rows.select("id", "text", "cuts"), PerSlice, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, hot_at: int = common.HOT) -> DataFrame:
    """Per row: the id, n_words, n_removed, kept_sha256 and, with with_text, the kept words."""
    scratch = common.Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = scratch.save(_anchor_rows(rows.withColumn("row", F.monotonically_increasing_id())))
    total = base.agg(F.sum(F.size("names"))).first()[0] or 0

    def grouped(table: DataFrame, keys: list[str], by: str, facts: dict) -> DataFrame:
        sample = table.filter(F.pmod(F.xxhash64(by), F.lit(common.SAMPLED)) == 0).select(*keys)
        return common.with_groups(table, keys, facts, common.hot_keys(scratch, sample, keys, total, hot_at))

    def with_rows(facts: DataFrame) -> DataFrame:
        """Rows of the facts' ids. The ids are broadcast where they were counted to be within the bound; then only texts that have facts are shuffled."""
        return rows.join(common.counted_broadcast(facts.select("id").distinct(), facts.count()), "id", "left_semi").join(facts, "id")

    zipped = F.explode(F.arrays_zip(F.col("names").alias("name"), F.col("places").alias("place"), F.col("classes").alias("c")))
    found = base.filter("id is not null").select("row", "id", zipped.alias("a")).select("row", "id", "a.*")
    shared = scratch.save(grouped(found, ["name"], "row", {"lo": F.min("id"), "hi": F.max("id")}).filter("lo < hi").select("row", "id", "name", "place", "c"))
    stretches = scratch.save(grouped(shared, ["name", "c"], "row", {"least": F.min("id")}))
    scratch.drop(shared)

    # anchors with several classes: their windows are compared one by one, where a class is first
    firsts = grouped(stretches.filter("id = least").select("row", "id", "name", "c", "place"), ["name"], "c", {"lo": F.min("c"), "hi": F.max("c")}).filter("lo <> hi")
    wanted = firsts.groupBy("row", "id").agg(F.collect_list(F.struct("name", "place")).alias("wanted"))
    wanted = scratch.save(wanted.join(base.select("row", "k"), "row"))
    each = _windows(with_rows(wanted))
    late = scratch.save(grouped(scratch.save(each), ["name", "w"], "row", {"source": F.min("id")}).filter("source < id").select("row", "begin"))
    whole = stretches.filter("id > least").select("row", F.shiftright("place", 16).alias("begin"), F.shiftright("place", 8).bitwiseAND(255).alias("count"))
    cuts = whole.unionByName(late.withColumn("count", F.lit(1).cast("bigint"))).groupBy("row").agg(F.collect_list(F.struct("begin", "count")).alias("cuts"))
    cuts = cuts.join(base.select("row", "id", "k"), "row").groupBy("id").agg(F.collect_list(F.struct("k", "cuts")).alias("cuts"))
    cuts = scratch.save(cuts)
    scratch.drop(stretches, late, wanted)
    kept = _kept(rows.join(cuts, "id", "left") if with_text else with_rows(cuts), with_text)
    if with_text:
        return kept.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")
    out = base.select("id", "k", "n_words", "sha").join(kept.drop("n_words").dropDuplicates(["id", "k"]), ["id", "k"], "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir), with_text=False)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n, ws FROM w),
v AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + 50], ' ')) AS h FROM p WHERE pos + 50 <= n),
f AS (SELECT h, min(doc_id) AS source FROM v GROUP BY h),
g AS (SELECT doc_id, pos FROM v JOIN f USING (h) WHERE source < doc_id),
c AS (SELECT p.doc_id, p.pos, word, max(g.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
