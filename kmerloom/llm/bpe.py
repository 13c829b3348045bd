"""BPE encoding and decoding as a streaming transducer.

The merge list bounds how far the end of what was read can change the tokens before it: for a change to move one token
to the left, a merge must use that token as its right part after a merge that had it as its left part. The longest such
chain of rising ranks, in characters, is the lookahead. Tokens that end further than it from the end of the
buffer are stable and emitted; the rest waits for more input. A word of any length needs a buffer of constant size.
Decoding is a state machine as well: it takes one id at a time and emits text as soon as its bytes are complete.

A text is read block by block. A block ends before white space, or else inside a run of one kind of characters, which then is a
word that the next block goes on with; words go through the transducer one after the other, and digests of ids and decoded text
take what it emits at once. So besides the text itself a document of any length takes constant memory (the lists of ids and the
decoded text, if they are wanted, grow with it).

Defined cases: a null text is empty; an empty text has no tokens; text of special tokens becomes their ids, as in the library;
null and repeated ids are rows like others; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import string
import sys
import unicodedata
from functools import cached_property, lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from . import common

DEFAULT_FILE = "word_bpe_49k.json"
#: Characters of a text read at once; those of a word added to the transducer's buffer at once.
BLOCK, CHUNK = 1 << 16, 512
#: Runs without white space whose tokens a worker remembers (twice as many at most), and the longest of them.
MEMORY, LONGEST = 60_000, 40


def vocabulary_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache
def _classes(last: int = sys.maxunicode) -> dict[str, str]:
    """Ranges of letters, numbers and unassigned characters up to `last`, as bodies of character classes."""
    runs: dict[str, list[list[int]]] = {"L": [], "N": [], "C": []}
    for c in range(last + 1):
        kind = unicodedata.category(chr(c))
        key = "C" if kind == "Cn" else kind[0]
        if key == "C" and kind != "Cn" or key not in runs:
            continue
        if runs[key] and runs[key][-1][1] == c - 1:
            runs[key][-1][1] = c
        else:
            runs[key].append([c, c])
    return {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in runs.items()}


#: The characters of Unicode's property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


PUNCTUATION = frozenset(string.punctuation) - {"'"}
NEVER = sys.maxsize


def merge_tokens(symbols: list[str], ranks: dict) -> list[str]:
    """Apply merges to the symbols (changed in place), lowest rank first and leftmost first."""
    get = ranks.get
    waiting = [get(pair, NEVER) for pair in zip(symbols, symbols[1:])]
    while waiting:
        rank = min(waiting)
        if rank == NEVER:
            break
        i = waiting.index(rank)
        symbols[i] += symbols[i + 1]
        del symbols[i + 1], waiting[i]
        if i:
            waiting[i - 1] = get((symbols[i - 1], symbols[i]), NEVER)
        if i < len(waiting):
            waiting[i] = get((symbols[i], symbols[i + 1]), NEVER)
    return symbols


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str) -> int | None:
    """Characters from the end of a buffer beyond which its tokens are stable; None if the list allows no bound.

    The bound needs a list in which each part of a merge is made before it, as training gives it.
    """
    made: dict[str, int] = {}
    reach: dict[str, int] = {}
    longest = 1
    for rank, (a, b) in enumerate(merges):
        if any(len(x.removesuffix(suffix)) > 1 and x not in made for x in (a, b)):
            return None
        made.setdefault(a + b, rank)
        # the token a is taken from its left neighbour's side by what stands right of it, and so on to the left
        far = len(a.removesuffix(suffix)) + reach.get(b, len(b.removesuffix(suffix)))
        reach[a] = max(reach.get(a, 0), far)
        longest = max(longest, far)
    return longest


class Transducer:
    """Symbols of one word in, stable tokens out."""

    def __init__(self, ranks: dict, lookahead: int | None, suffix: str, chunk: int = CHUNK):
        self.ranks, self.lookahead, self.suffix, self.chunk, self.rest = ranks, lookahead, suffix, chunk, ""

    def feed(self, mapped: str) -> list[str]:
        out: list[str] = []
        if self.lookahead is None:
            self.rest += mapped
            return out
        for at in range(0, len(mapped), self.chunk):
            self.rest += mapped[at : at + self.chunk]
            if len(self.rest) <= self.chunk + self.lookahead:
                continue
            done = 0
            for t in merge_tokens(list(self.rest), self.ranks):
                if done + len(t) > len(self.rest) - self.lookahead:
                    break
                out.append(t)
                done += len(t)
            self.rest = self.rest[done:]
        return out

    def end(self) -> list[str]:
        """The word's last tokens."""
        return merge_tokens([*self.rest[:-1], self.rest[-1] + self.suffix], self.ranks)


def safe_cut(text: str, low: int, high: int, markers: tuple[str, ...]) -> tuple[int, bool] | None:
    """Where text can be cut between low (not included) and high, and whether a word goes on there; None if nowhere.

    Neither normalisation nor the word pattern may look across: before ASCII white space, or inside a run of letters or of
    ASCII punctuation, away from apostrophes and special tokens.
    """
    at = max(text.rfind(c, low + 1, high) for c in " \n\t\r")
    if at > low:
        return at, False
    for at in range(high - 1, low, -1):
        a, b = text[at - 1], text[at]
        if b.isascii():
            fits = a.isascii() and (a.isalpha() and b.isalpha() or a in PUNCTUATION and b in PUNCTUATION)
        else:
            fits = a.isalpha() and b.isalpha() and len(a.lower()) == len(b.lower()) == 1 and not "\u1100" <= b <= "\u11ff" and unicodedata.normalize("NFC", a + b) == a + b
        if fits and "'" not in text[max(0, at - 3) : at + 3] and not any(text.find(m, max(0, at - len(m)), at + len(m)) >= 0 for m in markers):
            return at, True
    return None


class Encoder:
    """Text to ids. Reads a BPE file with NFC, lower case, split words and byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ranks = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.lookahead = sufficient_lookahead(merges, self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        contractions = "'s|'t|'re|'ve|'m|'ll|'d"
        #: Word patterns for texts up to a last character: few ranges make quick patterns.
        self.words = []
        for last in (0x7F, 0xFFFF, sys.maxunicode):
            kinds = _classes(last)
            self.words.append(re.compile(f"[{kinds['L']}]+|{contractions}|[{kinds['N']}]|[^{WHITE}{kinds['L']}{kinds['N']}]+"))
        self.astral = re.compile("[\U00010000-\U0010ffff]")
        self.unassigned = [re.compile(f"[{_classes(last)['C']}]") for last in (0xFFFF, sys.maxunicode)]
        self.unprinted = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
        self.markers = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        #: The file's rules without its vocabulary and merges, which the library would hold once more.
        self.rules = spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        self.decoder_spec = spec["decoder"]
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.known: dict[str, tuple[str, int, str]] = {}
        self.before: dict[str, tuple[str, int, str]] = {}

    @cached_property
    def library(self):
        """The library's normaliser and splitter, made when a text needs them."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(self.rules))

    def lowered(self, text: str) -> str | None:
        """Normalised text; None where it has characters newer than this Python's tables."""
        composed = unicodedata.normalize("NFC", text)
        if self.unassigned[bool(self.astral.search(composed))].search(composed):
            return None
        return composed.replace("Σ", "σ").lower()  # a final sigma is no special case there

    def split(self, text: str) -> list[str]:
        """Text as words of byte symbols. Characters newer than this Python's tables: by the file's own rules."""
        if text.isascii() and not self.unprinted.search(text):
            return self.words[0].findall(text.lower())
        low = self.lowered(text)
        if low is None:
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        return ["".join([self.symbols[b] for b in w.encode()]) for w in self.words[1 + bool(self.astral.search(low))].findall(low)]

    def word_tokens(self, mapped: str, chunk: int = CHUNK) -> list[str]:
        """Tokens of one word of byte symbols."""
        word = Transducer(self.ranks, self.lookahead, self.suffix, chunk)
        return word.feed(mapped) + word.end()

    def found(self, tokens: list[str]) -> tuple[str, int, str]:
        """Ids as text, their number, and (without a decoder in the file) the decoded text."""
        ids = [self.vocab[t] for t in tokens]
        return " ".join(map(str, ids)), len(ids), "" if self.decoder_spec else Decoder.parted(tokens)

    def run_tokens(self, run: str) -> tuple[str, int, str]:
        """The same of a run of normalised characters without white space; short runs are remembered, in two generations."""
        known = self.known.get(run) or self.before.get(run)
        if known is None:
            kind = 0 if run.isascii() else 1 + bool(self.astral.search(run))
            words = self.words[kind].findall(run)
            if len(words) == 1:
                known = self.found(self.word_tokens("".join([self.symbols[b] for b in run.encode()]) if kind else run))
            else:
                each = [self.run_tokens(w) for w in words]
                known = " ".join([x[0] for x in each]), sum([x[1] for x in each]), " ".join([x[2] for x in each])
        if len(run) <= LONGEST:
            if len(self.known) >= MEMORY:
                self.known, self.before = {}, self.known
            self.known[run] = known
        return known

    def parts(self, block: str) -> list:
        """Words (of byte symbols) of a block, and special tokens as tuples."""
        out: list = []
        for part in self.markers.split(block) if self.markers and "<" in block else (block,):
            out += [(part,)] if part in self.special else self.split(part)
        return out

    def block_tokens(self, block: str) -> list[tuple[str, int, str]]:
        """What is found in a block whose first and last word are whole."""
        if not (self.markers and "<" in block and self.markers.search(block)) and not self.unprinted.search(block):
            low = block.lower() if block.isascii() else self.lowered(block)
            if low is not None:
                known, work = self.known.get, self.run_tokens
                return [known(run) or work(run) for run in low.split()]
        return [self.part_tokens(p) for p in self.parts(block)]

    def part_tokens(self, part) -> tuple[str, int, str]:
        return (str(self.special[part[0]]), 1, part[0]) if isinstance(part, tuple) else self.found(self.word_tokens(part))

    def stream(self, text: str, block: int = BLOCK):
        """Lists of what is found, block by block."""
        at, word, special = 0, None, tuple(self.special)
        while at < len(text):
            end, goes_on, size = len(text), False, block
            while at + size < len(text):
                cut = safe_cut(text, at, at + size, special)
                if cut:
                    end, goes_on = cut
                    break
                size *= 2
            part, at = text[at:end], end
            if word is None and not goes_on:
                yield self.block_tokens(part)
                continue
            parts, out = self.parts(part), []
            if word is not None:
                out.append(self.found(word.feed(parts.pop(0))))
                if parts or not goes_on:
                    out.append(self.found(word.end()))
                    word = None
            if goes_on and word is None:
                word, last = Transducer(self.ranks, self.lookahead, self.suffix), parts.pop()
                out += [self.part_tokens(p) for p in parts]
                out.append(self.found(word.feed(last)))
            else:
                out += [self.part_tokens(p) for p in parts]
            yield [x for x in out if x[1]]

    def encode(self, text: str, block: int = BLOCK) -> list[int]:
        return [int(i) for found in self.stream(text, block) for ids, _, _ in found for i in ids.split(" ")]


class Decoder:
    """Ids to text, one at a time. Without a decoder in the file, tokens are parted by blanks; otherwise bytes to text."""

    def __init__(self, encoder: Encoder):
        self.names = encoder.names
        self.bytes_of = None
        if encoder.decoder_spec:
            self.bytes_of = {s: b for b, s in enumerate(encoder.symbols)}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False

    def feed(self, token_id: int) -> str:
        name = self.names[token_id]
        if self.bytes_of is not None:
            return self.utf8.decode(bytes(self.bytes_of[c] for c in name))
        lead, self.started = (" " if self.started else ""), True
        return lead + name

    #: What feed gives for tokens that are parted by blanks.
    parted = staticmethod(" ".join)

    def end(self) -> str:
        return self.utf8.decode(b"", True)

    def all(self, ids: list[int]) -> str:
        return "".join(map(self.feed, ids)) + self.end()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    key = os.path.realpath(path)
    if key not in _encoders:
        _encoders[key] = Encoder(path)
    return _encoders[key]


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256, decoded_sha256 and, with with_ids, the ids and the decoded text."""
    path = path or vocabulary_path()

    def per_slice(batch):
        e = encoder(path)
        rows: dict[str, list] = {"id": batch.column("id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        if with_ids:
            rows |= {"ids": [], "decoded": []}
        for text in batch.column("text").to_pylist():
            n, ids_sha, text_sha, decoder, ids, decoded = 0, sha256(), sha256(), Decoder(e), [], []
            for found in e.stream(text or ""):
                if not found:
                    continue
                part = " ".join([x[0] for x in found])
                if e.decoder_spec:
                    plain = "".join([decoder.feed(int(i)) for i in part.split()])
                else:
                    plain = " " * (n > 0) + " ".join([x[2] for x in found])
                ids_sha.update((" " * (n > 0) + part).encode())
                text_sha.update(plain.encode())
                n += sum([x[1] for x in found])
                if with_ids:
                    ids.append(np.array(part.split(" "), np.int32))
                    decoded.append(plain)
            last = decoder.end()
            text_sha.update(last.encode())
            rows["n_tokens"].append(n)
            rows["ids_sha256"].append(ids_sha.hexdigest())
            rows["decoded_sha256"].append(text_sha.hexdigest())
            if with_ids:
                rows["ids"].append(np.concatenate([np.zeros(0, np.int32), *ids]))
                rows["decoded"].append("".join(decoded) + last)
        return rows

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    out = common.map_texts(docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text"), per_slice, schema)
    return out.withColumnRenamed("id", id_col)


def op7_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return encode_documents(common.documents(spark, sf_dir), with_ids=False)
