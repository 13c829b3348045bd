"""N-gram Jaccard join with signature trees.

A document is its set of word shingles. Equal sets are one class. Classes meet in groups, and signature trees find the links within
the groups.

Groups. Sets of which the larger has at most `top` shingles differ, if they link, in at most K = 2 * top * (1 - t) / (1 + t)
shingles. So of K + 1 + spare parts, into which a hash deals the shingles, more than `spare` are equal in both. Each class
emits the hash of each of its filled parts, and linked classes share one unless both leave more than `spare` parts empty;
such classes also emit their first (1 - t) * n + 1 shingles in hash order, of which linked ones share one. Sizes fall into bands, each
with its `top`; a class emits for its own band and for those that larger partners may be in. A part holds several shingles, so
a passage that many documents share makes no group: only nearly equal sets meet.

Trees. In a group, a leaf of a signature tree holds some classes, a node the OR of their token bitmaps and the range of their
sizes. A dual traversal drops every pair of nodes whose largest possible overlap is too small, whose sizes are too far apart,
or that are in one component already. The trees are walked three times:

1. Each class goes with its whole set to its largest group, in blocks of bounded size that all hold the group's least class. What
   the traversal leaves is verified at once, by spanning forests of the largest possible overlaps, until the block is settled.
2. In groups that still hold several components, blocks meet pair by pair but for those of one component. Of each task only
   a spanning forest of candidates is verified, on whole sets.
3. Candidates that are left between components only tell clusters of classes: a task hands on a spanning forest of them, never all
   pairs. Each class of a cluster brings its whole set once, and clusters are settled as in 1, in pairs of blocks if they are
   larger than a block. This makes the result exact.

Shingles and sets are told apart by 64-bit and 128-bit hashes.

Defined cases: a text that is null or without words has an empty set and links with nothing; a text with fewer words than a
shingle has one shingle of all of them; rows with a null id link with nothing and have a null component; rows that repeat
an id are rows of one document, whose smallest reachable id is taken over each row's own links; an empty table gives an empty table;
other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components, roots_of

WORDS, PERCENT = 4, 85
#: Words of 64 bits in a bitmap; classes in a leaf; children of a node; classes in a block, and shingles of their sets.
BITMAP, LEAF, FANOUT, BLOCK, BLOCK_SHINGLES = 16, 32, 4, 1024, 1 << 19
#: Each band's largest size is GROWTH times that of the one below; a signature's last BAND_BITS bits are its band.
GROWTH, BAND_BITS = 1.6, 6
#: Member pairs that are compared at once; pairs held before they are cut to a spanning forest.
AT_ONCE, HELD = 1 << 16, 1 << 20
#: Hashes of words that a worker remembers.
MEMORY = 250_000

#: Odd multipliers, one for each place in a shingle, and those of the final mixing.
PLACES = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1 for i in range(1, 65)], np.uint64)
_VALUE, _PART, _FIRST = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


class WordHasher:
    def __init__(self):
        import xxhash

        self.hash, self.known = xxhash.xxh3_64_intdigest, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes, in rising order."""
    n = len(hashes)
    if n == 0:
        return hashes
    w = min(n, width)
    out = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        out += mixed(hashes[i : n - w + 1 + i] * PLACES[i])
    return np.unique(mixed(out))


@lru_cache
def band_tops() -> np.ndarray:
    """The largest size of each band."""
    tops = [1]
    while len(tops) < 1 << BAND_BITS:
        tops.append(max(tops[-1] + 1, int(tops[-1] * GROWTH)))
    return np.array(tops, np.int64)


@lru_cache
def band_parts(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Per band: the number of parts, and how many of them a class may leave empty without further signatures."""
    differ = 2 * band_tops() * (100 - percent) // (100 + percent)
    spare = np.where(differ > 0, 2 + differ // 8, 0)
    return differ + 1 + spare, spare


def signatures(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Per set its signatures; any two sets that reach the threshold share one."""
    n = np.array([len(s) for s in sets], np.int64)
    first, last = (np.searchsorted(band_tops(), x) for x in (n, 100 * n // percent))
    parts, spare = band_parts(percent)
    out: list[list[np.ndarray]] = [[] for _ in sets]
    for turn in range(int((last - first).max(initial=-1)) + 1):
        mine = np.flatnonzero((n > 0) & (first + turn <= last))
        band = first[mine] + turn
        count = parts[band]
        base = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(len(mine)), n[mine])
        h = mixed(np.concatenate([sets[i] for i in mine]) + (band.astype(np.uint64) * _PART)[doc]) if len(mine) else np.zeros(0, np.uint64)
        part = h % count.astype(np.uint64)[doc]
        cell = base[doc] + part.astype(np.int64)
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, cell, mixed(h ^ _VALUE))
        filled = np.zeros(base[-1], bool)
        filled[cell] = True
        number = np.arange(base[-1]) - np.repeat(base[:-1], count)
        name = sign(mixed(sums + number.astype(np.uint64) * _PART), np.repeat(band, count))
        for k, i in enumerate(mine.tolist()):
            here = slice(base[k], base[k + 1])
            out[i].append(name[here][filled[here]])
            if count[k] - len(out[i][-1]) > spare[band[k]]:
                prefix = sets[i][: n[i] - (percent * n[i] + 99) // 100 + 1]
                out[i].append(sign(mixed(prefix ^ _FIRST), band[k]))
    return [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in out]


def sign(name: np.ndarray, band) -> np.ndarray:
    return name >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | np.asarray(band).astype(np.uint64)


def block_size(sig: Column) -> Column:
    """How many classes of a signature's band make a block."""
    sizes = [int(max(2, min(BLOCK, BLOCK_SHINGLES // top))) for top in band_tops()]
    return F.element_at(F.array(*[F.lit(s) for s in sizes]), F.pmod(sig, F.lit(1 << BAND_BITS)).cast("int") + 1)


def bitmap(found: np.ndarray, width: int = 64 * BITMAP) -> bytes:
    out = np.zeros(width, np.uint8)
    out[(found % np.uint64(width)).astype(int)] = 1
    return np.packbits(out).tobytes()


def wide_bitmap(found: np.ndarray) -> bytes:
    """As many bits as shingles, rounded up to a power of two; empty where the short bitmap has as many."""
    n = len(found)
    return bitmap(found, 1 << (n - 1).bit_length()) if n > 64 * BITMAP else b""


def most_common(a: bytes, b: bytes, n: int, m: int) -> int:
    """The largest overlap of two sets that their wide bitmaps allow; the wider one is folded."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    slack = min(n - int(np.bitwise_count(x).sum()), m - int(np.bitwise_count(y).sum()))
    return int(np.bitwise_count(x & y).sum()) + slack


def _text_facts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row (row, id, text): row, id, n, the set's 128-bit hash, its bitmaps and signatures."""

    class PerSlice:
        def __init__(self):
            import xxhash

            self.words, self.digest = WordHasher(), xxhash.xxh3_128_digest

        def __call__(self, batch):
            sets = [shingles(self.words((t or "").encode().lower().split()), width) for t in batch.column("text").to_pylist()]
            return {
                "row": batch.column("row"), "id": batch.column("id"), "n": [len(s) for s in sets], "k": [self.digest(s.tobytes()) for s in sets],
                "bits": [bitmap(s) for s in sets], "wide": [wide_bitmap(s) for s in sets], "sigs": signatures(sets, percent),
            }

    schema = f"row bigint, id {dict(docs.dtypes)['id']}, n bigint, k binary, bits binary, wide binary, sigs array<bigint>"
    return common.map_texts(docs, PerSlice, schema)


def _sets(texts: DataFrame, width: int, extra: str = "") -> DataFrame:
    """Rows (node, k, text and the column `extra`, declared as in a schema) with tokens; only where k is the set's hash."""
    name = extra.split(" ")[0]

    class PerSlice:
        def __init__(self):
            import xxhash

            self.words, self.digest = WordHasher(), xxhash.xxh3_128_digest

        def __call__(self, batch):
            out: dict[str, list] = {c: [] for c in ["node", "tokens", name] if c}
            for i, (node, k, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "k", "text")))):
                found = shingles(self.words((text or "").encode().lower().split()), width).tobytes()
                if self.digest(found) == k:
                    out["node"].append(node)
                    out["tokens"].append(found)
                    if name:
                        out[name].append(batch.column(name)[i].as_py())
            return out

    return common.map_texts(texts, PerSlice, "node bigint, tokens binary" + (f", {extra}" if extra else ""))


class Tree:
    """Signature trees over all groups of a table, one above the other; level 0 is the members, the last level the roots.

    sizes: members per group, which stand together. side: members of side 0 are compared with all, two of one other side never.
    """

    def __init__(self, n: np.ndarray, comp: np.ndarray, bits: np.ndarray, sizes: np.ndarray | None = None, side: np.ndarray | None = None):
        slack = n - np.bitwise_count(bits).sum(axis=1)
        side = np.zeros(len(n), np.int64) if side is None else side
        self.levels = [(bits, n, n, slack, comp, comp, side, side)]
        self.below: list[np.ndarray] = []  # per level above 0: the first child of each node, and the end
        sizes, step = np.array([len(n)]) if sizes is None else sizes, LEAF
        while True:
            nodes = -(-sizes // step)
            group_at = np.cumsum(sizes) - sizes
            at = np.repeat(group_at, nodes) + (np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)) * step
            b, lo, hi, s, c, d, e, f = self.levels[-1]
            self.below.append(np.append(at, len(b)))
            low, high = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((np.bitwise_or.reduceat(b, at), low(lo, at), high(hi, at), high(s, at), low(c, at), high(d, at), low(e, at), high(f, at)))
            if (nodes <= 1).all():
                return
            sizes, step = nodes, FANOUT

    def most(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The largest overlap that pairs of nodes may have."""
        b, _, hi, s, *_ = self.levels[level]
        out = np.empty(len(x), np.int64)
        for k in range(0, len(x), AT_ONCE):
            i, j = x[k : k + AT_ONCE], y[k : k + AT_ONCE]
            out[k : k + AT_ONCE] = np.bitwise_count(b[i] & b[j]).sum(axis=1, dtype=np.int64) + np.minimum(s[i], s[j])
        return np.minimum(out, np.minimum(hi[x], hi[y]))

    def possible(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a link between two components."""
        _, lo, hi, _, c, d, e, f = self.levels[level]
        one = (c[x] == d[x]) & (c[y] == d[y]) & (c[x] == c[y])
        apart = (e[x] == f[x]) & (e[y] == f[y]) & (e[x] == e[y]) & (e[x] > 0)
        ok = (100 * hi[x] >= percent * lo[y]) & (100 * hi[y] >= percent * lo[x]) & ~one & ~apart
        at = np.flatnonzero(ok)
        i, j = x[at], y[at]
        ok[at] = (100 + percent) * self.most(level, i, j) >= percent * (lo[i] + lo[j])
        return ok

    def candidates(self, percent: int):
        """Pairs of members that no bound rules out, in parts."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        work = [(top, roots, roots)]
        while work:
            level, x, y = work.pop()
            ok = self.possible(level, x, y, percent)
            x, y = x[ok], y[ok]
            if level == 0:
                yield x, y
                continue
            first = self.below[level - 1]
            wide, high = first[x + 1] - first[x], first[y + 1] - first[y]
            ends = np.cumsum(wide * high)
            cut = 0
            while cut < len(x):
                # as many pairs as open into AT_ONCE pairs of children, and one at least
                end = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + AT_ONCE, side="right")))
                i, j, w, h = x[cut:end], y[cut:end], wide[cut:end], high[cut:end]
                number = np.arange((w * h).sum()) - np.repeat(np.cumsum(w * h) - w * h, w * h)
                per = np.repeat(h, w * h)
                a, b = np.repeat(first[i], w * h) + number // per, np.repeat(first[j], w * h) + number % per
                keep = a <= b if level > 1 else a < b
                if keep.any():
                    work.append((level - 1, a[keep], b[keep]))
                cut = end

    def share(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.levels[0][1]
        return self.most(0, x, y) / (n[x] + n[y])

    def forest(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of a spanning forest of the components, chosen by the largest possible overlap."""
        label = np.unique(self.levels[0][4], return_inverse=True)[1]
        none = np.zeros(0, np.int64)
        x, y, held, count = none, none, [], 0
        for part in _and_end(self.candidates(percent)):
            if part is not None and len(part[0]):
                held.append(part)
                count += len(part[0])
            if count > HELD or part is None:
                x, y = (np.concatenate([v, *[p[k] for p in held]]) for k, v in enumerate((x, y)))
                best = spanning_forest(label[x], label[y], self.share(x, y))
                x, y, held, count = x[best], y[best], [], 0
        return x, y

    def links(self, percent: int, linked) -> tuple[np.ndarray, np.ndarray]:
        """Links that join what is linked at all; linked(x, y) says which pairs of members are."""
        label = np.unique(self.levels[0][4], return_inverse=True)[1]
        root = np.arange(label.max() + 1)
        found = []
        for x, y in self.candidates(percent):
            share = self.share(x, y)
            while True:
                keep = root[label[x]] != root[label[y]]
                x, y, share = x[keep], y[keep], share[keep]
                if not len(x):
                    break
                best = spanning_forest(root[label[x]], root[label[y]], share)
                good = best[linked(x[best], y[best])]
                found.append((x[good], y[good]))
                root = roots_of(label[x[good]], label[y[good]], root)
                rest = np.ones(len(x), bool)
                rest[best] = False
                x, y, share = x[rest], y[rest], share[rest]
        return tuple(np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in (0, 1))


def spanning_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the edges (a, b) of a spanning forest of the greatest weight; in each turn every tree takes its best edge."""
    at = np.argsort(-weight, kind="stable")
    a, b, chosen = a[at], b[at], [at[:0]]
    own = np.arange(max(a.max(), b.max()) + 1 if len(a) else 0)
    while (apart := a != b).any():
        at, a, b = at[apart], a[apart], b[apart]
        tree, first = np.unique(np.stack([a, b], axis=1).ravel(), return_index=True)
        edge = first // 2
        chosen.append(at[np.unique(edge)])
        up = own.copy()
        up[tree] = a[edge] + b[edge] - tree
        both = (up[up] == own) & (own < up)
        up[both] = own[both]
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
    return np.concatenate(chosen)


def _and_end(batches):
    yield from batches
    yield None


def _whole_groups(batches, keys: list[str]):
    """Tables of whole groups from record batches sorted by keys, with the index of each group's first row."""
    import pyarrow as pa

    held: list = []
    for batch in _and_end(batches):
        if batch is not None and batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([*held, batch] if batch is not None else held) if held or batch is not None else None
        if table is None:
            return
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        if batch is None:
            yield table, starts
            return
        held = table.slice(starts[-1]).combine_chunks().to_batches()
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts[:-1]


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets have in common."""
    return np.fromiter((len(x) + len(y) - len(np.unique(np.concatenate([x, y]))) if len(x) != len(y) or not np.array_equal(x, y) else len(x) for x, y in zip(a, b)), np.int64, len(a))


def _reach(n: np.ndarray, m: np.ndarray, common_: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common_ >= percent * (n + m - common_)


def _settled(blocks: DataFrame, percent: int, keys: list[str]) -> DataFrame:
    """Links (a, b) that join all linked classes of each block (keys) of rows (node, tokens), which may have (root, side)."""

    def run(batches):
        import pyarrow as pa

        for table, starts in _whole_groups(batches, keys):
            node = table.column("node").to_numpy()
            root, side = (table.column(c).to_numpy() if c in table.column_names else other for c, other in (("root", node), ("side", np.zeros(len(node)))))
            sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in table.column("tokens")]
            n = np.array([len(s) for s in sets], np.int64)
            bits = np.frombuffer(b"".join(map(bitmap, sets)), np.uint64).reshape(-1, BITMAP)
            tree = Tree(n, root, bits, np.diff(np.append(starts, len(n))), side.astype(np.int64))
            x, y = tree.links(percent, lambda x, y: _reach(n[x], n[y], _overlaps([sets[i] for i in x], [sets[i] for i in y]), percent))
            if len(x):
                yield pa.RecordBatch.from_pydict({"a": np.maximum(node[x], node[y]), "b": np.minimum(node[x], node[y])})

    order = [*keys, *[c for c in blocks.columns if c == "root"]]
    return blocks.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, "a bigint, b bigint")


def _group_trees(table, starts: np.ndarray) -> tuple[Tree, np.ndarray]:
    """Trees over whole groups of members (node, n, root, side, bits), and which row each of their leaves' members is."""
    n, root, side = (table.column(c).to_numpy() for c in ("n", "root", "side"))
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITMAP)
    sizes = np.diff(np.append(starts, len(n)))
    order = np.lexsort((n, root, np.repeat(np.arange(len(sizes)), sizes)))
    return Tree(n[order], root[order], bits[order], sizes, side[order].astype(np.int64)), order


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (a, b) of the candidate pairs within the groups of members (sig, x, y, node, n, root, side, bits)."""
    keys = ["sig", "x", "y"]

    def run(batches):
        import pyarrow as pa

        for table, starts in _whole_groups(batches, keys):
            tree, order = _group_trees(table, starts)
            x, y = tree.forest(percent)
            if len(x):
                x, y = (table.column("node").to_numpy()[order[v]] for v in (x, y))
                yield pa.RecordBatch.from_pydict({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def _in_doubt(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold together the classes of each task's members that are candidates by both bitmaps, fewer than classes.

    members: (sig, x, y, node, n, root, side, bits, wide).
    """
    keys = ["sig", "x", "y"]

    def run(batches):
        import pyarrow as pa

        for table, starts in _whole_groups(batches, keys):
            tree, order = _group_trees(table, starts)
            n, wide = tree.levels[0][1], table.column("wide")
            node, label = np.unique(table.column("node").to_numpy()[order], return_inverse=True)
            up, edges = list(range(len(node))), []

            def top(v):
                while up[v] != v:
                    up[v] = v = up[up[v]]
                return v

            for x, y in tree.candidates(percent):
                for i, j, p, q in zip(x.tolist(), y.tolist(), label[x].tolist(), label[y].tolist()):
                    v, w = top(p), top(q)
                    if v != w:
                        a, b = wide[order[i]].as_py(), wide[order[j]].as_py()
                        if not (a and b) or (100 + percent) * most_common(a, b, int(n[i]), int(n[j])) >= percent * (n[i] + n[j]):
                            up[v] = w
                            edges.append((p, q))
            if edges:
                x, y = node[np.array(edges).T]
                yield pa.RecordBatch.from_pydict({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def _clusters(scratch: common.Scratch, edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(sig, node, g) of the classes that the edges hold together; sig ends in the band of the cluster's largest set."""
    found = scratch.save(components(scratch, edges).withColumnRenamed("root", "cluster"))
    tops = F.array(*[F.lit(int(t)) for t in band_tops()])
    band = F.size(F.filter(tops, lambda t: t < F.col("_n"))).cast("bigint")
    sizes = found.join(heads.select("node", "n"), "node").groupBy("cluster").agg(F.count(F.lit(1)).alias("g"), F.max("n").alias("_n"))
    sizes = scratch.save(sizes.select("cluster", "g", F.shiftleft("cluster", BAND_BITS).bitwiseOR(band).alias("sig")))
    return scratch.save(found.join(common.counted_broadcast(sizes, sizes.count()), "cluster").select("sig", "node", "g"))


def _with_both(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _possible_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the wide bitmaps allow."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(f"n_{s}").to_numpy() for s in "ab")
                good = np.ones(len(n), bool)
                for i, (a, b) in enumerate(zip(*(batch.column(f"wide_{s}").to_pylist() for s in "ab"))):
                    if a and b:
                        good[i] = (100 + percent) * most_common(a, b, int(n[i]), int(m[i])) >= percent * (n[i] + m[i])
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return _with_both(pairs, classes, ["n", "wide"]).mapInArrow(run, "a bigint, b bigint")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the threshold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                a, b = ([np.frombuffer(t.as_buffer(), np.uint64) for t in batch.column(f"tokens_{s}")] for s in "ab")
                n, m = (np.array([len(s) for s in v], np.int64) for v in (a, b))
                yield batch.select(["a", "b"]).filter(pa.array(_reach(n, m, _overlaps(a, b), percent)))

    return _with_both(pairs, sets, ["tokens"]).mapInArrow(run, "a bigint, b bigint")


def _members(scratch: common.Scratch, heads: DataFrame, hot_at: int) -> DataFrame:
    """(sig, node, g, rep) of all classes that share a signature: the size of its group and the least class there.

    Nearly equal sets share most of their signatures; of groups of the same classes (told by 128 bits) only the first stays.
    """
    rows = heads.select("node", F.explode(F.array_distinct("sigs")).alias("sig"))
    sample = heads.filter(F.pmod(F.xxhash64("node"), F.lit(common.SAMPLED)) == 0).select(F.explode("sigs").alias("sig"))
    total = heads.agg(F.sum(F.size("sigs"))).first()[0] or 0
    hot = common.hot_keys(scratch, sample, ["sig"], total, hot_at)
    same = {"g": F.count(F.lit(1)), "rep": F.min("node"), "_of": F.bit_xor(F.xxhash64("node")), "_also": F.bit_xor(F.xxhash64("node", F.lit(1)))}
    found = scratch.save(common.with_groups(rows, ["sig"], same, hot).filter("g > 1"))
    first = scratch.save(found.filter("node = rep").groupBy(*same).agg(F.min("sig").alias("sig")).select("sig"))
    out = scratch.save(found.join(common.counted_broadcast(first, first.count()), "sig", "left_semi").select("sig", "node", "g", "rep"))
    scratch.drop(found, first)
    return out


def _homes(members: DataFrame) -> DataFrame:
    """Per class: the blocks (sig, blk) in which it is compared first. Each class is in its largest group, the least of a group in all of its blocks."""
    blocks = F.ceil(F.col("g") / block_size(F.col("sig")))
    own = members.groupBy("node").agg(F.max(F.struct("g", "sig")).alias("h")).select("node", "h.g", "h.sig").withColumn("blk", F.pmod(F.xxhash64("node"), blocks))
    split = members.withColumn("_blocks", blocks).filter("_blocks > 1 and node = rep").select("sig", "node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("blk"))
    return own.select("node", "sig", "blk").unionByName(split.select("node", "sig", "blk")).groupBy("node").agg(F.collect_set(F.struct("sig", "blk")).alias("homes"))


def _open_blocks(members: DataFrame, roots: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(sig, x, y, node, root, side) of members of groups with several components, dealt into pairs of blocks (x, y).

    A component of more than a block makes blocks of its own, which meet all others but each other; smaller ones share blocks.
    So a group that one component fills is copied no more often than the rest has blocks.
    """
    lead = members.join(common.counted_broadcast(roots, roots.count()), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = scratch.save(lead.groupBy("sig").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("sig"))
    open_ = scratch.save(lead.join(common.counted_broadcast(several, several.count()), "sig", "left_semi").select("sig", "node", "root", "g", block_size(F.col("sig")).alias("most")))
    small = open_.filter("g <= most").select("sig", F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), "node", "root", F.lit(0).alias("side"))
    large = open_.filter("g > most")
    parts = large.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("_n"), F.first("most").alias("_most"), F.first("g").alias("_g"))
    own = F.col("_n") > F.col("_most")
    parts = scratch.save(parts.select(F.col("sig").alias("_sig"), F.col("root").alias("_root"), F.when(own, F.col("root")).alias("pure"), F.ceil(F.when(own, F.col("_n")).otherwise(F.col("_g")) / F.col("_most")).alias("_of")))
    dealt = large.join(parts, (F.col("sig") == F.col("_sig")) & (F.col("root") == F.col("_root")))
    dealt = dealt.withColumn("block", F.xxhash64("pure", F.pmod(F.xxhash64(F.when(F.col("pure").isNull(), F.col("root")).otherwise(F.col("node"))), F.col("_of"))))
    dealt = scratch.save(dealt.select("sig", "node", "root", "pure", "block"))
    blocks = scratch.save(dealt.select("sig", "pure", "block").distinct())
    a, b = (blocks.select(F.col("sig").alias(f"sig_{k}"), F.col("pure").alias(f"pure_{k}"), F.col("block").alias(k)) for k in "ab")
    meet = a.join(b, F.col("sig_a") == F.col("sig_b")).filter("a = b and pure_a is null or a <> b and not coalesce(pure_a = pure_b, false)")
    meet = meet.select(F.col("sig_a").alias("sig"), F.col("a").alias("block"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    spread = dealt.join(meet, ["sig", "block"]).withColumn("side", F.expr("case when x = y then 0 when block = x then 1 else 2 end"))
    return small.unionByName(spread.select("sig", "x", "y", "node", "root", "side"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, hot_at: int = common.HOT) -> DataFrame:
    """Per row: the id, n_shingles and component_id (the smallest id reachable by links)."""
    scratch = common.Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    facts = scratch.save(_text_facts(docs.withColumn("row", F.monotonically_increasing_id()), width, percent))
    filled = facts.filter("n > 0 and id is not null")
    # a class is named by the row that is its head
    classes = scratch.save(filled.groupBy("k").agg(F.min(F.struct("id", "row")).alias("head"), F.count(F.lit(1)).alias("size")).select("k", F.col("head.id").alias("cid"), F.col("head.row").alias("node"), "size"))
    many = classes.count()
    heads = facts.withColumnRenamed("row", "node").join(common.counted_broadcast(classes.select("node"), many), "node", "left_semi")
    members = _members(scratch, heads, hot_at)

    def with_texts(nodes: DataFrame) -> DataFrame:
        """Rows of nodes with k and the text of the class."""
        wanted = scratch.save(nodes.join(classes.select("node", F.col("cid").alias("id"), "k"), "node"))
        return docs.join(common.counted_broadcast(wanted, wanted.count()), "id").drop("id")

    homes = _sets(with_texts(_homes(members)), width, "homes array<struct<sig:bigint,blk:bigint>>").select("node", "tokens", F.explode("homes").alias("h")).select("h.sig", "h.blk", "node", "tokens")
    links = scratch.save(_settled(homes, percent, ["sig", "blk"]))
    roots = scratch.save(components(scratch, links))
    scratch.drop(links)

    def sets_of(nodes: DataFrame) -> DataFrame:
        return scratch.save(_sets(with_texts(nodes.distinct()), width).dropDuplicates(["node"]))

    for forest in (True, False):
        spread = scratch.save(_open_blocks(members, roots, scratch))
        if not spread.limit(1).count():
            break
        if forest:
            pairs = scratch.save(_candidates(spread.join(heads.select("node", "n", "bits"), "node"), percent))
            pairs = scratch.save(_possible_pairs(pairs, heads.select("node", "n", "wide"), percent))
            links = scratch.save(_links(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), percent))
        else:
            edges = scratch.save(_in_doubt(spread.join(heads.select("node", "n", "bits", "wide"), "node"), percent))
            doubt = _clusters(scratch, edges, heads)
            blocks = _open_blocks(doubt, roots, scratch).join(sets_of(doubt.select("node")), "node")
            links = scratch.save(_settled(blocks, percent, ["sig", "x", "y"]))
        scratch.drop(spread)
        old = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = scratch.save(components(scratch, links.unionByName(old)))

    named = classes.join(common.counted_broadcast(roots, roots.count()), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch.save(named)
    scratch.drop(members)
    least = named.groupBy("root").agg(F.min("cid").alias("component_id"))
    by_class = scratch.save(named.join(least, "root").select("k", "size", "component_id"))
    rows = facts.select("id", F.col("n").alias("n_shingles"), "k")
    alone = rows.filter("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    joined = common.join_groups(rows.filter("n_shingles > 0 and id is not null"), by_class, "k", "size", facts.count()).select("id", "n_shingles", "component_id")
    return alone.unionByName(joined).withColumnRenamed("id", id_col)


def op9_signature_tree_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(common.documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.seen) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""
