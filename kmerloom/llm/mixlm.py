"""Language-model scoring by logistic context mixing.

A text is a row of tokens (its words with A-Z lowered, then an end), and every decision is a bit. Two kinds of context predict it:

Words. A token is the bits of its bytes and a closing blank, which no word holds. Several predictors give the next bit's
probability: exact counts of the token's whole beginning over all training tokens, and over those of texts with the same cue; and
tables, indexed by hashes, of the last one, three (with the cue) and five bytes, counted over distinct training pairs of cue and token. The cue, a
hash of the text's most frequent short word, is told first, and its cost counts. The logits are mixed with weights gated by
how often the beginning was seen. The weights are learned online, from all training tokens: each task takes its tokens in turn,
judges each without itself and takes a step; the tasks' weights are then averaged, each gate's by its tokens. A last table,
filled as the tokens pass, refines the mixed probability by gate and level. Every bit is normalised, so the probabilities of
all tokens under a cue sum to 1. Tokens with the same cue and beginning share its decisions, which are worked out once.

Phrases. A text is cut where a hash of two tokens says so. Before a phrase, one bit says whether it is one that followed the
same phrase in another training document. Its probability is that of such contexts seen as often (gated, and learned from
all training phrases, each without itself). If it is, the phrase has the part that it has of the context's
successors; if not, its words follow. So copied text costs little, as it does for any model with a long context.

All training documents are counted and every document is scored whole. What is counted grows with the input and
stays in tables: pairs of cue and word are dealt out by their first bytes, by more of them where many words share these, and sorted by
Spark. Sent to all tasks are only tables of bounded size: short contexts, weights, counts by first bytes, and the HEAD most
frequent pairs with their scores. The other tokens of a document meet their scores in a join by hash (64 bits), in which no
pair is frequent.

Defined cases: a null text is empty; an empty text is just an end; without training documents nothing is known and every bit has
probability 1/2; a null id counts as the empty text for the fold; rows that repeat an id are documents of their own; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .jaccard import _and_end, mixed
from .recompression import spans

FOLD, HELD_OUT = 7, 2
#: The most frequent pairs, whose scores go to every task.
HEAD = 200_000
#: Slots of the tables for contexts of one, three (with the cue) and five bytes; the last grows with the training words up to MOST_SLOTS.
SLOTS, MOST_SLOTS = (1 << 16, 1 << 18, 1 << 18), 1 << 21
GATES, LEVELS = 20, 33
INPUTS = len(SLOTS) + 3
#: Words of up to SHORT bytes are cues; their hashes fall into CUES - 1 classes, and 0 is a text without one.
SHORT, CUES = 3, 24
#: The longest words that are hashed together.
LONG = 64
#: One place in PHRASE ends a phrase.
PHRASE = 24
#: Distinct pairs of slices that a task holds before it adds them up and passes them on; pairs in a unit, which is a beginning shared by all its words.
FLUSH, UNIT = 1_500_000, 200_000
#: Pairs that are worked on at once, unless a unit has more.
CHUNK = 50_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mixed(np.arange(1, 257).astype(np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C17)


def word_hashes(data: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of `size` bytes from each place in `low` on: byte by byte over all words; words of more than LONG bytes one by one."""
    out = np.zeros(len(low), np.uint64)
    live = np.flatnonzero(size <= LONG)
    for k in range(LONG):
        live = live[size[live] > k]
        if not len(live):
            break
        out[live] = out[live] * _STEP + _BYTE[data[low[live] + k]]
    out = mixed(out + size.astype(np.uint64))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[low[i] : low[i] + size[i]])
    return out


def hashes_of(words: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, words), np.int64, len(words))
    return word_hashes(np.frombuffer(b"".join(words) + b" ", np.uint8), np.cumsum(size) - size, size)


class Slice:
    """The tokens of texts as arrays: the texts' numbers of tokens (`size`), and of each token its text, place in `data`, length and hash."""

    def __init__(self, texts: list):
        raw = [(t or "").encode() for t in texts]
        self.data = _LOWERED[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
        starts = np.cumsum([0, *[len(r) + 1 for r in raw]])[:-1].astype(np.int64)
        word = ~_SPACE[self.data]
        edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
        low, high = edge[::2], edge[1::2]
        doc = np.searchsorted(starts, low, side="right") - 1
        self.size = np.bincount(doc, minlength=len(raw)) + 1
        ends = np.cumsum(self.size) - 1
        at = np.arange(len(low)) + doc
        total = len(low) + len(raw)
        self.doc = np.repeat(np.arange(len(raw)), self.size)
        self.low, self.length = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.low[at], self.length[at] = low, high - low
        self.h = np.empty(total, np.uint64)
        self.h[at], self.h[ends] = word_hashes(self.data, low, high - low), hashes_of([b""])[0]

    def word(self, i: int) -> bytes:
        return self.data[self.low[i] : self.low[i] + self.length[i]].tobytes()

    def cues(self) -> np.ndarray:
        """Per text the class of its most frequent short word (of several, the first by its bytes); 0 without one."""
        held = np.flatnonzero((self.length > 0) & (self.length <= SHORT))
        low, length = self.low[held], self.length[held]
        value = np.zeros(len(held), np.int64)
        for k in range(SHORT):
            value = value << 8 | np.where(length > k, self.data[np.minimum(low + k, len(self.data) - 1)], 0)
        key, count = np.unique(self.doc[held] << 32 | value << 2 | length, return_counts=True)
        doc, value = key >> 32, key & 0xFFFFFFFF
        order = np.lexsort((value, -count, doc))
        first = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
        out = np.zeros(len(self.size), np.int64)
        total = sum((value[first] >> (2 + 8 * k)) & 255 for k in range(SHORT))
        out[doc[first]] = 7 * total % (CUES - 1) + 1
        return out


def pair_keys(hashes: np.ndarray, cue) -> np.ndarray:
    return mixed(hashes + np.asarray(cue).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def phrases(hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, context, hash) of each phrase of texts of these sizes; the context of a text's first is 0."""
    ends = np.zeros(len(hashes), bool)
    ends[:-1] = mixed(hashes[:-1] + hashes[1:] * np.uint64(3)) % np.uint64(PHRASE) == 0
    ends[np.cumsum(size) - 1] = True
    high = np.flatnonzero(ends) + 1
    low = np.append(0, high)[:-1]
    name = spans(hashes, low, high).view(np.int64)
    context = np.append(0, name)[:-1]
    context[np.searchsorted(low, np.cumsum(size) - size)] = 0
    return low, context, name


def _pair_counts(docs: DataFrame) -> DataFrame:
    """Per word (the empty word is the end) and cue: c in training documents and n in all; and per cue, as a null word, the documents."""

    def run(batches):
        import pyarrow as pa

        parts, cued = [], np.zeros((2, CUES), np.int64)

        def rows():
            h, cue, count, train, low, length = (np.concatenate([p[k] for p in parts]) for k in range(6))
            texts = [p[6] for p in parts]
            at = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            key = pair_keys(h, cue)
            order = np.argsort(key)
            first = np.flatnonzero(np.diff(key[order], prepend=~key[order][:1]) != 0)
            one = order[first]
            words = [texts[i][a : a + n] for i, a, n in zip(at[one].tolist(), low[one].tolist(), length[one].tolist())]
            parts.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "cue": cue[one], "c": np.add.reduceat(train[order], first), "n": np.add.reduceat(count[order], first)})

        for part in common.sliced(batches):
            s = Slice(part.column("text").to_pylist())
            held = np.array(part.column("held_out").to_pylist(), bool)
            cue = s.cues()
            cued += np.stack([np.bincount(cue[keep], minlength=CUES) for keep in (~held, held | True)])
            key = pair_keys(s.h, cue[s.doc])
            order = np.argsort(key)
            first = np.flatnonzero(np.diff(key[order], prepend=~key[order][:1]) != 0)
            one, ones = order[first], np.ones(len(key), np.int64)
            parts.append((s.h[one], cue[s.doc[one]], np.add.reduceat(ones, first), np.add.reduceat((~held[s.doc[order]]).astype(np.int64), first), s.low[one], s.length[one], s.data.tobytes()))
            if sum(len(p[0]) for p in parts) > FLUSH:
                yield rows()
        if parts:
            yield rows()
        yield pa.RecordBatch.from_pydict({"word": pa.nulls(CUES, pa.binary()), "cue": np.arange(CUES), "c": cued[0], "n": cued[1]})

    return docs.mapInArrow(run, "word binary, cue bigint, c bigint, n bigint").groupBy("word", "cue").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Leading zero bits of a byte.
_LEADING = np.array([8 - int(x).bit_length() for x in range(256)])


class Bits:
    """The bit decisions of tokens sorted as closed within their cues, depth by depth.

    Tokens are distinct. Those with the same cue and beginning share its decisions, and stand together; complete ones drop out."""

    def __init__(self, words: list[bytes], cue: np.ndarray):
        closed = [w + b" " for w in words]
        self.size = np.array([len(w) for w in closed], np.int64)
        self.data = np.frombuffer(b"".join(closed), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.cue = cue
        # how many bits a token shares with the one above it; -1 under another cue
        self.shared = np.full(len(closed), -1)
        same = np.flatnonzero(cue[1:] == cue[:-1]) + 1
        depth = 0
        while len(same):
            self.shared[same] = depth * 8
            same = same[np.minimum(self.size[same], self.size[same - 1]) > depth]
            differ = self.data[self.at[same] + depth] ^ self.data[self.at[same - 1] + depth]
            self.shared[same] += _LEADING[differ]
            same = same[differ == 0]
            depth += 1

    def depths(self, slots: tuple[int, ...] = ()):
        """Per depth and decision: the first token that takes it and the one after the last, their bit, whether it is the
        second at its beginning, which follows the first, and, if wanted, the slots of its short contexts."""
        low = np.flatnonzero(self.shared < 0)
        high = np.append(low[1:], len(self.size))
        past = np.zeros(len(low), np.uint64)
        parting = np.argsort(self.shared, kind="stable")
        parts_at = self.shared[parting]
        depth, done = 0, len(low)
        while len(low):
            if slots:
                three, five = (past & np.uint64((1 << 8 * k) - 1) for k in (3, 5))
                three = mixed(three | (self.cue[low].astype(np.uint64) + np.uint64(1)) << np.uint64(32))
                five, one = mixed(five + np.uint64(1 << 56)), (past & np.uint64(255)) << np.uint64(8)
            byte = self.data[self.at[low] + depth].astype(np.uint64)
            for t in range(7, -1, -1):
                second = np.zeros(len(low), bool)
                end = done + int(np.searchsorted(parts_at[done:], depth * 8 + 7 - t, side="right"))
                if end > done:  # in the order of tokens, as the sort is stable
                    new, done = parting[done:end], end
                    place = np.searchsorted(low, new)
                    whence = np.insert(np.arange(len(low)), place, place - 1)
                    second, low = np.insert(second, place, True), np.insert(low, place, new)
                    high = np.minimum(high[whence], np.append(low[1:], len(self.size)))
                    past, byte = past[whence], byte[whence]
                    byte[second] = self.data[self.at[new] + depth]
                    if slots:
                        three, five, one = three[whence], five[whence], one[whence]
                bit = ((byte >> np.uint64(t)) & np.uint64(1)).astype(np.int64)
                node = (byte | np.uint64(256)) >> np.uint64(t + 1)
                places = [(one | node).astype(np.int64), *[(mixed(x + node) & np.uint64(s - 1)).astype(np.int64) for x, s in zip((three, five), slots[1:])]] if slots else []
                yield depth * 8 + 7 - t, low, high, bit, second, places
            stay = self.size[low] > depth + 1
            low, high, past = low[stay], high[stay], (past << np.uint64(8) | byte)[stay]
            depth += 1


def _closed() -> Column:
    return F.concat("word", F.lit(b" "))


def _begin(n: int) -> Column:
    """The first n bytes of the closed word; the end, which has one, gets a 0."""
    return F.substring(F.concat(_closed(), F.lit(b"\0")), 1, n) if n == 2 else F.substring(_closed(), 1, n)


class Beginnings:
    """Training tokens by their first bytes: of all by the first two, and by one more where a beginning has over `most` pairs."""

    def __init__(self, pairs: DataFrame, most: int):
        self.first = np.zeros((CUES + 1, 1 << 16))
        size: dict[bytes, int] = {}
        # at most 65,536 beginnings of two bytes, and CUES times as many sums
        for r in pairs.groupBy("cue", _begin(2).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("pairs")).toLocalIterator():
            begin = bytes(r["b"])
            self.first[r["cue"], int.from_bytes(begin, "big")] += r["c"]
            size[begin] = size.get(begin, 0) + r["pairs"]
        large = [b for b, n in size.items() if n > most]
        self.first[-1] = self.first[:-1].sum(axis=0)
        self.longer: dict[bytes, np.ndarray] = {}
        length = 2
        while large:  # beginnings with more than `most` pairs number under pairs / most at each length
            length += 1
            mine = pairs.filter(_begin(length - 1).isin(large)).filter(F.octet_length(_closed()) >= length)
            self.longer |= {b: np.zeros((CUES + 1, 256)) for b in large}
            large = []
            for r in mine.groupBy(_begin(length).alias("b"), "cue").agg(F.sum("c").alias("c")).toLocalIterator():
                self.longer[bytes(r["b"][:-1])][r["cue"], r["b"][-1]] += r["c"]
            for r in mine.groupBy(_begin(length).alias("b")).agg(F.count(F.lit(1)).alias("pairs")).filter(F.col("pairs") > most).toLocalIterator():
                if r["b"][-1] != 0x20:  # one word with all its cues
                    large.append(bytes(r["b"]))
        for t in self.longer.values():
            t[-1] = t[:-1].sum(axis=0)
        self.sums = np.concatenate([[0.0], np.cumsum(self.first.ravel())])

    def unit(self) -> Column:
        """The shortest beginning of a word that few enough pairs share."""
        out, sizes = _begin(2), sorted({len(b) for b in self.longer})
        for n in sizes:
            out = F.when(_begin(n).isin([b for b in self.longer if len(b) == n]), _begin(n + 1)).otherwise(out)
        return out

    def counts(self, depth: int, unit: bytes, row: np.ndarray, heads: np.ndarray, low, high, bit, second, sums) -> tuple[np.ndarray, np.ndarray]:
        """Per decision (see Bits.depths), of the training tokens of the row (a cue, or all) with the bits so far: those whose next bit is 1, and all.

        sums: of the tokens' counts, of those before each place."""
        if depth < 16:
            shift = 16 - depth
            start = (heads[low] + (row[low] << 16)) >> shift << shift
            middle, end = start + (1 << (shift - 1)), start + (1 << shift)
            return self.sums[end] - self.sums[middle], self.sums[end] - self.sums[start]
        if depth < 8 * len(unit):
            at, shift = depth // 8, 8 - depth % 8
            start = unit[at] >> shift << shift
            both = self.longer[unit[:at]][:, start : start + (1 << shift)]
            return both[:, 1 << (shift - 1) :].sum(axis=1)[row[low]], both.sum(axis=1)[row[low]]
        total = (sums[high] - sums[low]).astype(float)
        ones = total * bit
        later = np.flatnonzero(second)
        if len(later):
            both, one = total[later] + total[later - 1], ones[later] + ones[later - 1]
            total[later], total[later - 1], ones[later], ones[later - 1] = both, both, one, one
        return ones, total


def _chunks(batches, most: int = CHUNK):
    """Whole units of a task, sorted by unit, cue and closed word: the unit if it is a long one, words, cues, c and n."""
    import pyarrow as pa

    held: list = []
    for batch in _and_end(batches):
        if batch is not None:
            held.append(batch)
            if sum(b.num_rows for b in held) <= most:
                continue
        if not held:
            return
        table = pa.Table.from_batches(held)
        units, words = (table.column(c).to_pylist() for c in ("unit", "word"))
        cue, c, n = (table.column(k).to_numpy() for k in ("cue", "c", "n"))
        ends = [i for i in range(1, len(units)) if units[i] != units[i - 1]]
        start, last = 0, 0
        for end in [*ends, len(units)] if batch is None else ends:
            unit = units[end - 1]
            # a long unit is a chunk of its own; short ones fill a chunk together
            if len(unit) > 2 and start < last:
                yield b"", words[start:last], cue[start:last], c[start:last], n[start:last]
                start = last
            if len(unit) > 2 or end - start >= most or batch is None and end == len(units):
                yield unit if len(unit) > 2 else b"", words[start:end], cue[start:end], c[start:end], n[start:end]
                start = end
            last = end
        if batch is None:
            return
        held = table.slice(start).combine_chunks().to_batches()


def _words_of(words: list[bytes], counts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a chunk, sorted as closed; the place of each pair's word; the words' counts."""
    distinct = sorted(set(words), key=lambda w: w + b" ")
    place = {w: i for i, w in enumerate(distinct)}
    at = np.fromiter((place[w] for w in words), np.int64, len(words))
    return distinct, at, np.bincount(at, counts, len(distinct)).astype(np.int64)


def short_contexts(pairs: DataFrame, slots: tuple[int, ...]) -> list[np.ndarray]:
    """Per table: how many distinct training pairs of cue and word had a 0 and a 1 in each slot."""
    piece = 1 << 14

    def run(batches):
        import pyarrow as pa

        tables = [np.zeros((s, 2), np.float32) for s in slots]
        for _, words, cue, counts, _ in _chunks(batches):
            words, cue = [w for w, c in zip(words, counts) if c > 0], cue[counts > 0]
            for _, low, high, bit, _, places in Bits(words, cue).depths(slots):
                sizes = (high - low).astype(np.float32)
                for table, place in zip(tables, places):
                    np.add.at(table.reshape(-1), place * 2 + bit, sizes)
        flat = np.concatenate([t.ravel() for t in tables])
        parts = [(i // piece, flat[i : i + piece]) for i in range(0, len(flat), piece)]
        parts = [(i, x.tobytes()) for i, x in parts if x.any()]
        yield pa.RecordBatch.from_pydict({"i": pa.array([i for i, _ in parts], pa.int64()), "part": pa.array([x for _, x in parts], pa.binary())})

    def added(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("i").to_pylist(), batch.column("part").to_pylist()):
                x = np.frombuffer(part, np.float32)
                sums[i] = sums[i] + x if i in sums else x
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(sums), pa.int64()), "part": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    parts = pairs.mapInArrow(run, "i bigint, part binary").repartition("i").mapInArrow(added, "i bigint, part binary")
    flat = np.zeros(2 * sum(slots), np.float32)
    for r in parts.toLocalIterator():
        x = np.frombuffer(r["part"], np.float32)
        flat[r["i"] * piece : r["i"] * piece + len(x)] = x
    cuts = np.cumsum([2 * s for s in slots])[:-1]
    return [t.reshape(-1, 2) for t in np.split(flat, cuts)]


def decisions(unit: bytes, words: list[bytes], cue: np.ndarray, counts: np.ndarray, tables: list[np.ndarray], top: Beginnings):
    """Per depth: the open pairs of a chunk, their bit, gate and inputs."""
    for low, high, bit, gate, inputs in shared_decisions(unit, words, cue, counts, tables, top):
        sizes = high - low
        live = np.repeat(high - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        yield live, *(np.repeat(x, sizes, axis=0) for x in (bit, gate, inputs))


def shared_decisions(unit: bytes, words: list[bytes], cue: np.ndarray, counts: np.ndarray, tables: list[np.ndarray], top: Beginnings, alone: bool = False):
    """Per depth and decision of a chunk: the first pair that takes it and the one after the last, their bit, gate and inputs.

    alone: each training token judged without itself; instead of pairs come None and how many tokens take the decision so."""
    slots = tuple(len(t) for t in tables)
    distinct, place, word_counts = _words_of(words, counts)
    word_heads = np.array([int.from_bytes((w + b" \0")[:2], "big") for w in distinct], np.int64)
    heads, all_rows = word_heads[place], np.full(len(distinct), CUES)
    # a lone pair is gone from the tables without its token
    sums, lone, word_sums = (np.append(0, np.cumsum(x)) for x in (counts, counts == 1, word_counts))
    whole = Bits(distinct, np.zeros(len(distinct), np.int64)).depths()
    logits = [] if alone else [np.log((t[:, 1] + np.float32(0.1)) / (t[:, 0] + np.float32(0.1))) for t in tables]
    for depth, low, high, bit, second, places in Bits(words, cue).depths(slots):
        _, w_low, *word_bits, _ = next(whole)
        ones, total = top.counts(depth, unit, all_rows, word_heads, w_low, *word_bits, word_sums)
        mine = np.searchsorted(w_low, place[low], side="right") - 1
        ones, total = ones[mine], total[mine]
        own, own_total = top.counts(depth, unit, cue, heads, low, high, bit, second, sums)
        if alone:
            # the tokens of lone pairs and those of others leave different tables behind
            single = (lone[high] - lone[low]).astype(float)
            others = sums[high] - sums[low] - single
            some, more = np.flatnonzero(single), np.flatnonzero(others)
            pick, weight = np.append(some, more), np.append(single[some], others[more])
            if len(pick) == 0:
                continue
            gone = np.repeat(np.float32([1, 0]), [len(some), len(more)])
            bit, places = bit[pick], [p[pick] for p in places]
            ones, total, own, own_total = ones[pick] - bit, total[pick] - 1, own[pick] - bit, own_total[pick] - 1
        inputs = np.empty((len(bit), INPUTS), np.float32)
        # what stands under the cue is drawn towards what stands anywhere
        anywhere = 2 * (ones + 0.05) / (total + 0.1)
        inputs[:, 0] = np.log(((ones + 0.05) / (total - ones + 0.05)).astype(np.float32))
        inputs[:, 1] = np.log(((own + anywhere) / (own_total - own + (2 - anywhere))).astype(np.float32))
        for k, (table, slot) in enumerate(zip(tables, places)):
            if not alone:
                inputs[:, k + 2] = logits[k][slot]
                continue
            flat, own_one = table.reshape(-1), gone * bit.astype(np.float32)
            inputs[:, k + 2] = np.log((flat[2 * slot + 1] - own_one + np.float32(0.1)) / (flat[2 * slot] - (gone - own_one) + np.float32(0.1)))
        inputs[:, -1] = 0.3
        gate = np.minimum(np.log2(total + 1).astype(int), GATES - 1)
        yield (None, weight, bit, gate, inputs) if alone else (low, high, bit, gate, inputs)


class Mixer:
    """Gated weights and the table that refines their result."""

    def __init__(self):
        self.weights = np.zeros((GATES, INPUTS))
        self.weights[:, 1], self.weights[:3, 2:-1] = 0.9, 0.3
        self.refined = np.tile(squash((np.arange(LEVELS) - LEVELS // 2) / 2.0), (GATES, 1))
        #: Per gate the mass learned from and the inputs' curvature; per gate and level the mass seen, and that of ones.
        self.mass, self.bend = np.zeros(GATES), np.full((GATES, INPUTS), 50.0)
        self.seen, self.ones = np.zeros((GATES, LEVELS)), np.zeros((GATES, LEVELS))

    def mixed(self, gate, inputs):
        return np.einsum("ij,ij->i", self.weights.astype(np.float32)[gate], inputs)

    def probability(self, gate, inputs):
        """Of a 1: the mean of the mixed probability and its refinement."""
        x = np.clip(self.mixed(gate, inputs), -12, 12)
        place = np.clip(x * 2, -(LEVELS // 2), LEVELS // 2 - 1e-3) + LEVELS // 2
        low = place.astype(int)
        part = place - low
        fine = self.refined[gate, low] * (1 - part) + self.refined[gate, low + 1] * part
        return np.clip((squash(x) + fine) / 2, 1e-7, 1 - 1e-7)

    def learn(self, bit, gate, inputs, weight):
        """One online step with these decisions, each judged before the step: weights downhill, and the refinement's counts."""
        x = self.mixed(gate, inputs)
        p = squash(x)
        error, curve = (bit - p) * weight, p * (1 - p) * weight
        level = np.clip(np.rint(x * 2), -(LEVELS // 2), LEVELS // 2).astype(int) + LEVELS // 2
        at = gate * LEVELS + level
        self.seen += np.bincount(at, weight, GATES * LEVELS).reshape(GATES, LEVELS)
        self.ones += np.bincount(at, weight * bit, GATES * LEVELS).reshape(GATES, LEVELS)
        self.mass += np.bincount(gate, weight, GATES)
        columns = inputs.T.astype(float)
        step = np.stack([np.bincount(gate, error * c, GATES) for c in columns], axis=1)
        bend = np.stack([np.bincount(gate, curve * c * c, GATES) for c in columns], axis=1)
        self.bend += bend
        self.weights += np.clip(step / (2 * self.bend), -0.1, 0.1)

    def merged(self, mass, moved, seen, ones) -> "Mixer":
        """After all tasks, by their sums: each gate's weights averaged by mass, refinement by the counts."""
        out = Mixer()
        out.seen, out.ones = seen, ones
        out.weights = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-9)[:, None], self.weights)
        prior = np.tile(squash((np.arange(LEVELS) - LEVELS // 2) / 2.0), (GATES, 1))
        out.refined = (out.ones + 20 * prior) / (out.seen + 20)
        return out


def learn_mixer(pairs: DataFrame, tables, top: Beginnings) -> Mixer:
    """Weights and refinement from all training tokens, each taken once."""
    shared = pairs.sparkSession.sparkContext.broadcast((tables, top))

    def run(batches):
        import pyarrow as pa

        tables, top = shared.value
        mine = Mixer()
        for unit, words, cue, counts, _ in _chunks(batches):
            for _, weight, bit, gate, inputs in shared_decisions(unit, words, cue, counts, tables, top, True):
                mine.learn(bit, gate, inputs, weight)
        rows = np.concatenate([mine.mass, (mine.weights * mine.mass[:, None]).ravel(), mine.seen.ravel(), mine.ones.ravel()])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(rows)), "v": rows})

    sums = pairs.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(GATES * (1 + INPUTS + 2 * LEVELS))
    for r in sums.toLocalIterator():
        flat[r["i"]] = r["v"]
    shared.unpersist()
    mass, moved, seen, ones = np.split(flat, np.cumsum([GATES, GATES * INPUTS, GATES * LEVELS]))
    return Mixer().merged(mass, moved.reshape(GATES, INPUTS), seen.reshape(GATES, LEVELS), ones.reshape(GATES, LEVELS))


def _scored_pairs(pairs: DataFrame, tables, top: Beginnings, mixer: Mixer) -> DataFrame:
    """Per pair: its key, n, the word's c, whether the pair is its word's first, and log10 probability."""
    shared = pairs.sparkSession.sparkContext.broadcast((tables, top, mixer))

    def run(batches):
        import pyarrow as pa

        tables, top, mixer = shared.value
        for unit, words, cue, counts, seen in _chunks(batches):
            steps = np.zeros(len(words) + 1)  # from each pair's score to the next one's
            for low, high, bit, gate, inputs in shared_decisions(unit, words, cue, counts, tables, top):
                p = mixer.probability(gate, inputs)
                log_p = np.log10(np.where(bit == 1, p, 1 - p))
                steps[low] += log_p
                steps[high] -= log_p
            total = np.cumsum(steps)[:-1]
            _, place, word_counts = _words_of(words, counts)
            first = np.zeros(len(words), bool)
            first[np.unique(place, return_index=True)[1]] = True
            yield pa.RecordBatch.from_pydict({"h": pair_keys(hashes_of(words), cue), "c": word_counts[place], "n": seen, "first": first, "log_p": total})

    return pairs.mapInArrow(run, "h bigint, c bigint, n bigint, first boolean, log_p double")


def _head(scored: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key (rising), c and score of the HEAD most frequent pairs; packed by one executor task, so that the driver gets three arrays."""

    def packed(batches):
        import pyarrow as pa

        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is not None:
            table = table.sort_by("h")
            yield pa.RecordBatch.from_pydict({c: pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ("h", "c", "p")})

    top = scored.orderBy(F.desc("n"), "h").limit(HEAD).select("h", "c", F.col("log_p").alias("p")).coalesce(1)
    found = top.mapInArrow(packed, "h binary, c binary, p binary").collect()
    parts = [bytes(v) for v in found[0]] if found else [b""] * 3
    return tuple(np.frombuffer(v, kind) for v, kind in zip(parts, (np.int64, np.int64, np.float64)))


def _text_rows(docs: DataFrame, head, cue_cost: list[float]) -> DataFrame:
    """Per row: counts, the phrases, each phrase's score by the words of the head, and the other words with the numbers of their phrases."""
    shared = docs.sparkSession.sparkContext.broadcast(head)
    kind = dict(docs.dtypes)["id"]

    class PerSlice:
        def __init__(self):
            self.h, c, self.p = shared.value
            self.known, self.c = (c > 0).astype(float), np.log10(c + 1.0)

        def __call__(self, batch):
            import pyarrow as pa

            s = Slice(batch.column("text").to_pylist())
            size, doc, h, cue = s.size, s.doc, s.h, s.cues()
            low, context, name = phrases(h, size)
            first = np.searchsorted(low, np.append(np.cumsum(size) - size, len(h)))  # each text's first phrase
            number = np.searchsorted(low, np.arange(len(h)), side="right") - 1
            h = pair_keys(h, cue[doc])
            at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
            hit = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
            per = lambda where, v, n: np.bincount(where[hit], v[at[hit]], n)
            tails = np.append(0, np.cumsum(np.bincount(doc[~hit], minlength=len(size))))
            listed = lambda cuts, v: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v))
            out: dict = {c: batch.column(c) for c in ("row", "id", "held_out")}
            return out | {
                "n_tokens": size, "n_bytes": np.bincount(doc, s.length + 1, len(size)).astype(np.int64),
                "known": per(doc, self.known, len(size)).astype(np.int64), "seen": per(doc, self.c, len(size)), "cue_p": np.array(cue_cost)[cue],
                "contexts": listed(first, context), "phrases": listed(first, name), "log_p": listed(first, per(number, self.p, len(low)).astype(np.float32)),
                "tail": listed(tails, h[~hit]), "of": listed(tails, (number - first[doc])[~hit].astype(np.int32)),
            }

    return common.map_texts(docs, PerSlice, f"row bigint, id {kind}, held_out boolean, n_tokens bigint, n_bytes bigint, known bigint, seen double, cue_p double, contexts array<bigint>, phrases array<bigint>, log_p array<float>, tail array<bigint>, of array<int>")


def _phrase_bits(scratch: common.Scratch, rows: DataFrame, hot_at: int) -> DataFrame:
    """Per row: the numbers of its phrases that followed their context elsewhere, and log10 probability of all its phrase bits."""
    zipped = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("phrases") - 1).alias("j"), F.col("contexts").alias("context"), F.col("phrases").alias("phrase"))).alias("p")
    each = rows.select("row", (~F.col("held_out")).cast("int").alias("own"), zipped).select("row", "own", "p.*").filter("context <> 0")
    total = rows.agg(F.sum(F.size("phrases"))).first()[0] or 0

    def grouped(table: DataFrame, keys: list[str], facts: dict) -> DataFrame:
        sample = table.filter(F.pmod(F.xxhash64("row"), F.lit(common.SAMPLED)) == 0).select(*keys)
        return common.with_groups(table, keys, facts, common.hot_keys(scratch, sample, keys, total, hot_at))

    known = grouped(each, ["context"], {"n": F.sum("own"), "_rows": F.count(F.lit(1))}).filter("_rows > 1 and n > 0").drop("_rows")
    known = grouped(scratch.save(known), ["context", "phrase"], {"m": F.sum("own")})
    known = known.withColumns({"n": F.col("n") - F.col("own"), "m": F.col("m") - F.col("own")}).filter("n > 0")
    known = scratch.save(known.select("row", "j", "own", "m", "n", F.least(F.floor(F.log2("n")), F.lit(GATES - 1)).alias("gate")))
    # at most GATES rows
    learned = {r["gate"]: (r["hits"] + 0.5) / (r["all"] + 1) for r in known.filter("own = 1").groupBy("gate").agg(F.count(F.when(F.col("m") > 0, 1)).alias("hits"), F.count(F.lit(1)).alias("all")).collect()}
    share = F.element_at(F.array(*[F.lit(float(learned.get(g, 0.5))) for g in range(GATES)]), F.col("gate").cast("int") + 1)
    cost = F.when(F.col("m") > 0, F.log10(share * F.col("m") / F.col("n"))).otherwise(F.log10(1 - share))
    return known.groupBy("row").agg(F.collect_list(F.when(F.col("m") > 0, F.col("j"))).alias("copied"), F.sum(cost).alias("phrase_p"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, hot_at: int = common.HOT) -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    scratch = common.Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), common.is_held_out(FOLD, HELD_OUT, id_col).alias("held_out"))
    counted = scratch.save(_pair_counts(docs.select("text", "held_out")))
    cues = {r["cue"]: r["c"] for r in counted.filter("word is null").collect()}  # at most CUES rows
    cue_cost = [float(np.log10((cues.get(q, 0) + 1) / (sum(cues.values()) + CUES))) for q in range(CUES)]
    counted = counted.filter("word is not null")
    top = Beginnings(counted, unit)
    train, known = int(top.first[-1].sum()), counted.count()
    # one checkpoint keeps each task's units together and sorted
    pairs = common.saved(counted.withColumn("unit", top.unit()).repartition("unit").sortWithinPartitions("unit", "cue", _closed()))
    slots = (*SLOTS[:-1], max(SLOTS[-1], min(MOST_SLOTS, 1 << known.bit_length())))
    tables = short_contexts(pairs, slots)
    scored = scratch.save(_scored_pairs(pairs, tables, top, learn_mixer(pairs, tables, top)))
    distinct = scored.filter("first and c > 0").count()
    rows = _text_rows(docs.withColumn("row", F.monotonically_increasing_id()), _head(scored), cue_cost)
    rows = scratch.save(rows)

    bits = scratch.save(_phrase_bits(scratch, rows, hot_at))
    rows = rows.drop("contexts", "phrases").join(bits, "row", "left").withColumn("copied", F.coalesce("copied", F.array().cast("array<int>")))
    written = F.aggregate(F.filter("log_p", lambda x, j: ~F.array_contains("copied", j)), F.lit(0.0), lambda a, x: a + x)
    rows = scratch.save(rows.withColumn("log_p", written))
    rest = rows.select("row", "copied", F.explode(F.arrays_zip(F.col("tail").alias("h"), F.col("of").alias("j"))).alias("t")).select("row", "t.h", F.array_contains("copied", F.col("t.j")).alias("_copied"))
    rest = rest.join(scored.select("h", F.col("c").alias("_c"), F.col("log_p").alias("_p")), "h")
    rest = rest.groupBy("row").agg(F.count(F.when(F.col("_c") > 0, 1)).alias("_known"), F.sum(F.log10(F.col("_c") + 1.0)).alias("_seen"), F.sum(F.when(~F.col("_copied"), F.col("_p"))).alias("_log_p"))
    out = rows.drop("tail", "of", "copied").join(rest, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    base = F.col("seen") + zero("_seen") - F.col("n_tokens") * F.log10(F.lit(float(train + distinct + 1)))
    score = F.col("cue_p") + F.col("log_p") + zero("_log_p") + zero("phrase_p")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(train).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), (-score / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))


def op2_context_mixing(spark, sf_dir: str) -> DataFrame:
    return score_documents(common.documents(spark, sf_dir))
