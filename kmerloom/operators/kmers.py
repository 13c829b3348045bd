"""K-mer counts as tables.

Reads never touch, so counting the k-mers of each read is all that an index of them would answer. k-mers of bases alone,
with k up to 31 (62 in counting), are packed into one BIGINT or two; the others go as strings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions import sequence as S
from ..session import bound_batches, saved

#: Starts per window: substring walks a string from its beginning, so long reads are cut before their k-mers are.
STARTS = 128
PACKED = 31
#: Bases that a task counts at once; counts that are broadcast at most (64 MB).
AT_ONCE, PILE_ROWS = 1 << 22, 1 << 22
#: Bases that are looked up at once; a longer read is alone.
SLICE = 1 << 20
#: Codes of a block of counts; a place in it is of two bytes.
BLOCK = 1 << 16
#: Bases of the k-mers whose hashes part longer ones, and parts.
SHORT, BINS = 11, 1024


def positions(reads: DataFrame, k: int, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """(id, pos from 0, kmer) of every k-mer; a read shorter than k has none."""
    window = F.explode(F.sequence(F.lit(0), F.length(seq_col) - k, F.lit(STARTS)))
    cut = reads.filter(F.length(seq_col) >= k).select(id_col, seq_col, window.alias("_from"))
    cut = cut.select(id_col, "_from", F.substring(F.col(seq_col), F.col("_from") + 1, F.lit(STARTS + k - 1)).alias("_w"))
    cut = cut.select(id_col, "_from", "_w", F.explode(F.sequence(F.lit(0), F.length("_w") - k)).alias("_at"))
    return cut.select(id_col, (F.col("_from") + F.col("_at")).alias("pos"), F.substring(F.col("_w"), F.col("_at") + 1, F.lit(k)).alias("kmer"))


def unpack(code: str, k: int) -> Column:
    """The k-mer of a packed code."""
    return F.translate(F.lpad(F.conv(F.col(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def pack(kmer) -> Column:
    """The packed code of a k-mer of bases alone."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


_BASE = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _BASE[_c] = _i


def codes_of(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed k-mers of a read, and which of them are of bases alone; a read shorter than k has none."""
    b = _BASE[np.frombuffer(seq, np.uint8)]
    if len(b) < k:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    bad = np.concatenate([[0], np.cumsum(b == 255)])
    return _codes(b, k), bad[k:] == bad[:-k]


def _codes(b: np.ndarray, k: int) -> np.ndarray:
    """The packed k-mers of bases 0 to 3."""
    m = len(b) - k + 1
    code, width, done = b.astype(np.int64), 1, 0
    out = np.zeros(m, np.int64)
    # k as a sum of powers of two: a run of 2w bases is two runs of w
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            out = (out << (2 * width)) | code[done : done + m]
            done += width
        if bit + 1 < k.bit_length():
            code = (code[: len(code) - width] << (2 * width)) | code[width:]
            width *= 2
    return out


def _inside(cuts: np.ndarray, k: int) -> np.ndarray:
    """Of the places of k-mers in reads one after another: whether they end within the read where they begin."""
    out = np.ones(max(cuts[-1] - k + 1, 0), bool)
    over = (cuts[1:-1, None] - np.arange(1, k)).ravel()
    out[over[(over >= 0) & (over < len(out))]] = False
    return out


def complements(code: np.ndarray, k: int) -> np.ndarray:
    """The packed reverse complements: every base is flipped, and the pairs of bits are turned round."""
    x = ~code.astype(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = ((x >> np.uint64(shift)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(shift))
    return (x.byteswap() >> np.uint64(64 - 2 * k)).astype(np.int64)


def _only_bases(good: np.ndarray) -> None:
    if not good.all():
        raise ValueError("reads were said to be of bases alone, but hold other symbols")


def _dense_counts(reads: DataFrame, k: int, seq_col: str, plain: bool) -> DataFrame:
    """_packed_counts of small k: a task adds up in an array with a place for each code, and blocks of codes are shuffled and summed."""

    def count(batches):
        import pyarrow as pa

        n, size = np.zeros(4**k, np.int64), 0

        def blocks():
            both = n + n[complements(np.arange(4**k), k)]
            for at in range(0, 4**k, BLOCK):
                place = np.flatnonzero(both[at : at + BLOCK])
                if len(place):
                    parts = [x[at : at + BLOCK][place].astype(np.uint32).tobytes() for x in (n, both)]
                    yield pa.RecordBatch.from_pydict({"block": [at // BLOCK], "place": [place.astype(np.uint16).tobytes()], "fwd": parts[:1], "both": parts[1:]})

        for _, _, data, cuts in _sliced(batches):
            code, good = codes_of(data, k)
            if plain:
                _only_bases(_BASE[data] != 255)
            n += np.bincount(code[good & _inside(cuts, k)], minlength=4**k)
            size += len(data)
            if size >= 1 << 30:
                yield from blocks()
                n[:], size = 0, 0
        yield from blocks()

    def add(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for block, place, fwd, both in zip(*[c.to_pylist() for c in batch.columns]):
                at = np.frombuffer(place, np.uint16)
                if block not in sums:
                    sums[block] = np.zeros((2, BLOCK), np.int64)
                sums[block][0, at] += np.frombuffer(fwd, np.uint32)
                sums[block][1, at] += np.frombuffer(both, np.uint32)
        for block, (fwd, both) in sums.items():
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_pydict({"code": at + block * BLOCK, "n_fwd": fwd[at], "n_both": both[at]})

    bound_batches(reads.sparkSession)
    parts = reads.select(F.lit(0).alias("id"), seq_col).mapInArrow(count, "block bigint, place binary, fwd binary, both binary")
    return parts.repartition("block").mapInArrow(add, "code bigint, n_fwd bigint, n_both bigint")


def _packed_counts(reads: DataFrame, k: int, seq_col: str, plain: bool = False, least: int = 1) -> DataFrame:
    """(code, n_fwd, n_both) of n_both from `least` on; with k over PACKED also `rest`, the code of the bases after the first PACKED."""
    return _dense_counts(reads, k, seq_col, plain).filter(F.col("n_both") >= least) if 4**k <= AT_ONCE else _stretch_counts(reads, k, seq_col, plain, least)


def _least_hashes(base: np.ndarray, k: int) -> np.ndarray:
    """For each k-mer the least hash of its short k-mers, which is the same on both strands."""
    m = min(k, SHORT)
    code = _codes(base, m)
    h = ((np.minimum(code, complements(code, m)).astype(np.uint64) ^ np.uint64(0x155555)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    h ^= h >> np.uint32(15)
    wide, done, w = len(h) - (k - m), 1, k - m + 1
    while done * 2 <= w:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[:wide], h[w - done : w - done + wide])


def _summed(words: list[np.ndarray], ahead: np.ndarray, back: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Equal keys of one word or two once each, with the sums of both strands. Two words are put in order by a hash and told apart whole."""
    mixed = words[0] if len(words) == 1 else (words[0] * 0x5851F42D4C957F2D) ^ (words[1] * 0x14057B7EF767814F)
    order = np.argsort(mixed)
    new = lambda: np.logical_or.reduce([np.append(True, w[order][1:] != w[order][:-1]) for w in words])
    edge = new()
    if len(words) > 1 and (edge[1:] & (mixed[order][1:] == mixed[order][:-1])).any():
        order = np.lexsort(words[::-1])
        edge = new()
    first = np.flatnonzero(edge)
    return [w[order][first] for w in words], np.add.reduceat(ahead[order], first), np.add.reduceat(back[order], first)


def _canonical(base: np.ndarray, k: int, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """_summed of the k-mers that begin `at` places, each as the lesser of both strands."""
    code = _codes(base, min(k, PACKED))
    if k <= PACKED:
        there = code[at]
        turned = complements(there, k)
        key = np.minimum(there, turned) << 1 | (turned < there)
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] >> 1 != key[:-1] >> 1))
        back = np.add.reduceat(key & 1, first)
        return [key[first] >> 1], np.diff(np.append(first, len(key))) - back, back
    low = _codes(base, k - PACKED)
    words = [code[at], low[at + PACKED]]
    other = [complements(code[at + k - PACKED], PACKED), complements(low[at], k - PACKED)]
    turned = (other[0] < words[0]) | ((other[0] == words[0]) & (other[1] < words[1]))
    return _summed([np.where(turned, y, x) for x, y in zip(words, other)], (~turned).astype(np.int64), turned.astype(np.int64))


def _strands(words: list[np.ndarray], ahead: np.ndarray, back: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Words, n_fwd and n_both of both strands of k-mers; a palindrome comes once and counts twice."""
    if k <= PACKED:
        other = [complements(words[0], k)]
    else:
        tail = k - PACKED
        last = (words[0] << 2 * tail & (1 << 2 * PACKED) - 1) | words[1] if tail < PACKED else words[1]
        other = [complements(last, PACKED), complements(words[0] >> 2 * (PACKED - tail), tail)]
    same = np.logical_and.reduce([x == y for x, y in zip(words, other)])
    both = (ahead + back) * np.where(same, 2, 1)
    return [np.concatenate([x, y[~same]]) for x, y in zip(words, other)], np.concatenate([ahead, back[~same]]), np.concatenate([both, both[~same]])


def _stretch_counts(reads: DataFrame, k: int, seq_col: str, plain: bool, least: int = 1, by: str | None = None) -> DataFrame:
    """_packed_counts of k up to 2 * PACKED. k-mers in a row that share their least hash are shuffled as one stretch of two bits a base.

    Both strands of a k-mer have the same hash, so each of BINS parts counts its k-mers alone. With `by`, the name of a count, there
    is a row for each part and value n of it that is not 0: (n, kmers, and the words of the least and of the greatest k-mer).
    """

    def cut(batches):
        import pyarrow as pa

        for _, _, data, cuts in _sliced(batches):
            base = _BASE[data]
            if plain:
                _only_bases(base != 255)
            if len(base) < k:
                continue
            bad = np.concatenate([[0], np.cumsum(base == 255)])
            good, hashes = (bad[k:] == bad[:-k]) & _inside(cuts, k), _least_hashes(base, k)
            first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (good[1:] != good[:-1])))
            size = np.diff(np.append(first, len(good)))[good[first]]
            first = first[good[first]]
            bins = (hashes[first] % BINS).astype(np.uint16)
            order = np.argsort(bins, kind="stable")
            first, size, bins = first[order], size[order].astype(np.uint32), bins[order]
            turns = np.flatnonzero(np.diff(bins)) + 1
            rows = []
            for a, b in zip([0, *turns], [*turns, len(bins)] if len(bins) else []):
                long = size[a:b].astype(np.int64) + k - 1
                ends = np.cumsum(long)
                some = base[np.repeat(first[a:b] - ends + long, long) + np.arange(ends[-1])]
                some = np.append(some, np.zeros(-len(some) % 4, np.uint8)).reshape(-1, 4)
                narrow = size[a:b].astype(np.uint8) if size[a:b].max() < 256 else size[a:b]
                rows.append((int(bins[a]), int(b - a), narrow.tobytes(), (some[:, 0] | some[:, 1] << 2 | some[:, 2] << 4 | some[:, 3] << 6).tobytes()))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("bin", "stretches", "sizes", "bits"), map(list, zip(*rows)))))

    def count(batches):
        import pyarrow as pa

        def finish(held, sums):
            size = np.concatenate([x for x, _ in held]).astype(np.int64)
            long, base = size + k - 1, np.concatenate([x for _, x in held])
            at = np.repeat(np.cumsum(long) - long - np.cumsum(size) + size, size) + np.arange(size.sum())
            found = _canonical(base, k, at)
            if sums is None:
                return found
            return _summed([np.concatenate(x) for x in zip(sums[0], found[0])], *[np.concatenate(x) for x in zip(sums[1:], found[1:])])

        def rows(sums):
            words, ahead, both = _strands(*sums, k)
            n = ahead if by == "n_fwd" else both
            kept = np.flatnonzero(n >= max(least, 1) if by else both >= least)
            words, ahead, both, n = [w[kept] for w in words], ahead[kept], both[kept], n[kept]
            columns = [*words, ahead, both]
            if by and len(n):
                order = np.argsort(n.astype(np.uint16) if n.max() < 1 << 16 else n, kind="stable")
                n, words = n[order], [w[order] for w in words]
                first = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
                each = np.diff(np.append(first, len(n)))
                columns = [n[first], each]
                for best, worst in ((np.minimum, 1 << 62), (np.maximum, -1)):
                    alive = np.ones(len(n), bool)
                    for w in words:
                        top = best.reduceat(np.where(alive, w, worst), first)
                        columns.append(top)
                        alive &= w == np.repeat(top, each)
            elif by:
                return
            for a in range(0, len(columns[0]), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + SLICE].astype(np.int64)) for c in columns], names)

        now, held, size, sums = None, [], 0, None
        for batch in batches:
            for b, many, sizes, bits in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (b != now or size >= AT_ONCE):
                    sums, held, size = finish(held, sums), [], 0
                if sums is not None and b != now:
                    yield from rows(sums)
                    sums = None
                now, each = b, np.frombuffer(sizes, np.uint8 if len(sizes) == many else np.uint32)
                raw, total = np.frombuffer(bits, np.uint8), int(each.sum(dtype=np.int64))
                held.append((each, np.stack([raw >> s & 3 for s in (0, 2, 4, 6)], 1).ravel()[: total + many * (k - 1)]))
                size += total
        if held:
            yield from rows(finish(held, sums))

    parts = ["code", *(["rest"] if k > PACKED else [])]
    names = ["n", "kmers", *[f"{x}_{p}" for x in ("least", "greatest") for p in parts]] if by else [*parts, "n_fwd", "n_both"]
    bound_batches(reads.sparkSession)
    stretches = reads.select(F.lit(0).alias("id"), seq_col).mapInArrow(cut, "bin bigint, stretches bigint, sizes binary, bits binary")
    return stretches.repartition("bin").sortWithinPartitions("bin").mapInArrow(count, ", ".join(f"{x} bigint" for x in names))


def _spelled(packed: DataFrame, k: int, *counts: str) -> DataFrame:
    kmer = unpack("code", k) if k <= PACKED else F.concat(unpack("code", PACKED), unpack("rest", k - PACKED))
    return packed.select(kmer.alias("kmer"), *counts)


def spectrum(reads: DataFrame, k: int, n: str, seq_col: str = "seq", plain: bool = False) -> DataFrame:
    """(n, kmers, least, greatest): for each value of a count n_fwd or n_both its k-mers; they are spelled out after they are counted."""
    facts = [F.count(F.lit(1)).alias("kmers"), F.min("kmer").alias("least"), F.max("kmer").alias("greatest")]
    if k > 2 * PACKED or 4**k <= AT_ONCE:
        table = counts_of(reads, k, 1, seq_col, plain) if n == "n_both" else forward_counts(reads, k, seq_col, plain)
        return table.groupBy(n).agg(*facts)
    high, tail = min(k, PACKED), k - PACKED
    ends = [unpack(f"{x}_code", high) if tail <= 0 else F.concat(unpack(f"{x}_code", high), unpack(f"{x}_rest", tail)) for x in ("least", "greatest")]
    found = _stretch_counts(reads, k, seq_col, plain, by=n).select(F.col("n").alias(n), "kmers", ends[0].alias("least"), ends[1].alias("greatest"))
    if not plain:
        odd = _odd_counts(reads, k, seq_col)
        found = found.unionByName((both_counts(odd).select("kmer", "n_both") if n == "n_both" else odd).groupBy(n).agg(*facts))
    return found.groupBy(n).agg(F.sum("kmers").alias("kmers"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def _odd_counts(reads: DataFrame, k: int, seq_col: str) -> DataFrame:
    """forward_counts of the k-mers that have other symbols than bases."""
    odd = reads.filter(F.col(seq_col).rlike("[^ACGT]")).select(F.lit(0).alias("read_id"), F.col(seq_col).alias("seq"))
    return positions(odd, k).filter(F.col("kmer").rlike("[^ACGT]")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n_fwd"))


def forward_counts(reads: DataFrame, k: int, seq_col: str = "seq", plain: bool = False) -> DataFrame:
    """(kmer, n_fwd): occurrences as read, of every k-mer over $ACGNT. `plain`: reads are of bases alone, else it is an error."""
    if k > 2 * PACKED:
        return positions(reads.select(F.lit(0).alias("read_id"), F.col(seq_col).alias("seq")), k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n_fwd"))
    packed = _spelled(_packed_counts(reads, k, seq_col, plain).filter("n_fwd > 0"), k, "n_fwd")
    return packed if plain else packed.unionByName(_odd_counts(reads, k, seq_col))


def counts_of(reads: DataFrame, k: int, least: int = 1, seq_col: str = "seq", plain: bool = False) -> DataFrame:
    """both_counts of forward_counts. k-mers of bases are turned round before the shuffle and spelled out after the pruning."""
    if k > 2 * PACKED:
        return both_counts(forward_counts(reads, k, seq_col), least)
    packed = _spelled(_packed_counts(reads, k, seq_col, plain, least), k, "n_fwd", "n_both")
    return packed if plain else packed.unionByName(both_counts(_odd_counts(reads, k, seq_col), least))


def both_counts(forward: DataFrame, least: int = 1) -> DataFrame:
    """(kmer, n_fwd, n_both): n_both adds the reverse complement's count, so a palindrome counts twice.

    K-mers with n_both under `least` are left out; with least at most min_count, correction gives the same.
    """
    own = forward.select("kmer", "n_fwd", F.col("n_fwd").alias("n"))
    other = forward.select(S.reverse_complement("kmer").alias("kmer"), F.lit(0).cast("bigint").alias("n_fwd"), F.col("n_fwd").alias("n"))
    both = own.unionByName(other).groupBy("kmer").agg(F.sum("n_fwd").alias("n_fwd"), F.sum("n").alias("n_both"))
    return both.filter(F.col("n_both") >= least)


def extensions(counts: DataFrame, n: str = "n_both") -> DataFrame:
    """(prefix, n_a, n_c, n_g, n_t): counts of each (k-1)-mer with one base after it."""
    last = F.substring("kmer", -1, 1)
    sums = [F.sum(F.when(last == b, F.col(n)).otherwise(0)).alias(f"n_{b.lower()}") for b in "ACGT"]
    return counts.filter(last.isin(*"ACGT")).groupBy(F.expr("substring(kmer, 1, length(kmer) - 1)").alias("prefix")).agg(*sums)


def prefixed(counts: DataFrame, n: str = "n_fwd") -> DataFrame:
    """(suffix, n_a, n_c, n_g, n_t): counts of each (k-1)-mer with one base before it."""
    first = F.substring("kmer", 1, 1)
    sums = [F.sum(F.when(first == b, F.col(n)).otherwise(0)).alias(f"n_{b.lower()}") for b in "ACGT"]
    return counts.filter(first.isin(*"ACGT")).groupBy(F.expr("substring(kmer, 2)").alias("suffix")).agg(*sums)


def lookup(queries: DataFrame, counts: DataFrame, n: str = "n_fwd") -> DataFrame:
    """queries (kmer) with n; 0 for what never occurs, and for k-mers with $, which no read holds."""
    return queries.join(counts.select("kmer", F.col(n).alias("_n")), "kmer", "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n")


def around(queries: DataFrame, table: DataFrame, key: str = "prefix") -> DataFrame:
    """queries (a column named like the key) with the four counts of an extension or prefix table; zeros for what never occurs."""
    counts = ["n_a", "n_c", "n_g", "n_t"]
    joined = queries.join(table.select(F.col(key).alias("_key"), *counts), F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts})


def _sliced(batches, most: int = SLICE):
    """Of record batches (id, seq): ids, seqs, the bytes of the seqs and where each begins and ends, about `most` bytes at once."""
    for batch in batches:
        text = batch.column(1)
        cuts = np.frombuffer(text.buffers()[1], np.int64 if str(text.type) == "large_string" else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + most, "right")) - 1)
            yield batch.column(0).slice(a, b - a), text.slice(a, b - a), data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a]
            a = b


def _shared(table: DataFrame, k: int):
    """The broadcast of a table (code, n_both): a count for each code where k is small, else codes in order and their counts.

    Executors pack the rows, as the driver could not hold them as objects; it takes one partition at a time.
    """

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            code, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_pydict({"code": pa.array([code.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

    parts = ((np.frombuffer(r[0], np.int64), np.frombuffer(r[1], np.int64)) for r in table.mapInArrow(packed, "code binary, n binary").toLocalIterator())
    codes = None
    if 4**k <= PILE_ROWS:
        n = np.zeros(4**k, np.int64)
        for code, some in parts:
            n[code] = some
    else:
        held = list(parts)
        codes, n = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in held]]) for i in (0, 1))
        del held
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
    n = n if len(n) and n.max() >= 1 << 31 else n.astype(np.int32)
    return table.sparkSession.sparkContext.broadcast((codes, n))


def _found(known: np.ndarray | None, n: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The counts of codes in what `_shared` broadcast."""
    if known is None:
        return n[code].astype(np.int64)
    if not len(known):
        return np.zeros(len(code), np.int64)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    return np.where(known[at] == code, n[at], 0).astype(np.int64)


def piles(reads: DataFrame, counts: DataFrame, k: int, id_col: str = "read_id", seq_col: str = "seq", most: int = PILE_ROWS, per=None, plain: bool = False) -> DataFrame:
    """(id, counts): per read the counts of both strands at every position; a read shorter than k has one position of 0.

    Counts of packed k-mers number at most `most` (counted) to be broadcast, as 16 bytes each at most; reads then stay where they are.
    More of them are joined by their codes. k-mers of other symbols than bases, or longer than a code, are joined as strings.
    `per`, a kernel (ids, list array of counts -> arrays of ids and of other columns) with those columns' schema, is put in place of
    counts; with it the counts of reads that are looked up by broadcast never leave their Python worker.
    """
    kernel, schema = per or (lambda ids, lists: [ids, lists], "counts array<bigint>")
    kind = dict(reads.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {schema}"
    names = [x.name for x in _parse_datatype_string(schema)]
    bound_batches(reads.sparkSession)

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            lists, a = batch.column(1), 0
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            while a < len(lists):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
                ids, part = batch.column(0).slice(a, b - a), lists.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(kernel(ids, part), names)
                a = b

    reads = reads.select(id_col, seq_col)
    rest = reads.filter(F.col(seq_col).isNotNull() if k > PACKED else F.col(seq_col).rlike("[^ACGT]"))
    n = F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"])
    found = positions(rest, k, id_col, seq_col).join(counts.select("kmer", F.col("n_both").alias("_n")), "kmer", "left").select(id_col, "pos", F.coalesce("_n", F.lit(0)).alias("n"))
    out = found.groupBy(id_col).agg(n.alias("counts"))
    finish = lambda df: df.mapInArrow(apply, schema) if per else df
    if k > PACKED:
        return finish(reads.filter(F.length(seq_col) < k).select(id_col, F.array(F.lit(0).cast("bigint")).alias("counts")).unionByName(out))
    table = saved(counts.filter(~F.col("kmer").rlike("[^ACGT]")).select(pack("kmer").alias("code"), "n_both"))
    if table.count() > most:
        plain = reads.filter(F.col(seq_col).isNotNull() & ~F.col(seq_col).rlike("[^ACGT]"))
        short = reads.filter(F.length(seq_col) < k).select(id_col, F.array(F.lit(0).cast("bigint")).alias("counts"))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for i, seq in enumerate(batch.column(1).to_pylist()):
                    code, _ = codes_of(seq.encode(), k)
                    yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(np.full(len(code), i))), "pos": np.arange(len(code)), "code": code})

        found = plain.mapInArrow(run, f"id {kind}, pos bigint, code bigint").join(table, "code", "left").select(F.col("id").alias(id_col), "pos", F.coalesce("n_both", F.lit(0)).alias("n"))
        return finish(short.unionByName(out).unionByName(found.groupBy(id_col).agg(n.alias("counts"))))
    shared = _shared(table, k)

    def look_up(batches):
        import pyarrow as pa

        known, n = shared.value
        none = np.zeros(1, np.int64)
        for ids, texts, data, cuts in _sliced(batches):
            code, _ = codes_of(data, k)
            found = _found(known, n, code & (4**k - 1))
            bad = np.concatenate([[0], np.cumsum(_BASE[data] == 255)])[cuts]
            if plain:
                _only_bases(bad == 0)
            kept, parts = [], []
            for i, (a, b, odd, valid) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), np.diff(bad).tolist(), texts.is_valid().to_pylist())):
                if valid and not odd:
                    kept.append(i)
                    parts.append(found[a : b - k + 1] if b - a >= k else none)
                elif valid and len(texts[i].as_py()) < k:
                    kept.append(i)
                    parts.append(none)
            if kept:
                places = np.cumsum([0, *map(len, parts)])
                ids = ids if len(kept) == len(ids) else ids.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays(kernel(ids, pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.concatenate(parts)))), names)

    fast = reads.mapInArrow(look_up, schema)
    return fast if plain else finish(out).unionByName(fast)


def pileup(reads: DataFrame, counts: DataFrame, k: int, id_col: str = "read_id", seq_col: str = "seq", plain: bool = False) -> DataFrame:
    """(id, pos, n): count of both strands at every position; a read shorter than k has one position of 0."""
    return piles(reads, counts, k, id_col, seq_col, plain=plain).select(id_col, F.posexplode("counts").alias("pos", "n"))
