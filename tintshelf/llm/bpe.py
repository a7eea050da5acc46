"""Byte-level BPE by batched NumPy merge rounds.

The words of a batch that were not met before are written as bytes into one flat array of symbols. In each round every
adjacent pair inside a word is a key (left * size + right), looked up by binary search in the sorted keys of the merge
table; each word merges its lowest-ranked pair, at all its places from the left, and words without a pair are done. Ids of
a text are the ids of its words in order. The vocabulary file (the ``tokenizers`` library's format) is a parameter; it is
read once on the driver and sent to the tasks.

Defined cases: null text counts as empty (no ids, empty decoding); a special token's string in a text is that token, as
the library has it by default; lone surrogates cannot occur in Spark's strings; rows come back as often as given, whatever
their doc_id; an empty table gives no rows; columns of the caller that are named like ours are replaced, others stay.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Word pattern of byte-level BPE (fixed value: published with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and their ids that a task remembers (it starts afresh beyond), and the longest word that is remembered.
MOST_WORDS, MOST_BYTES = 250_000, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Merge table and vocabulary as arrays; cheap to send."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        self.size = max([*vocabulary.values(), *special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.special = special
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocabulary[c]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]

    @classmethod
    def from_file(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in data["model"]["merges"]]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocabulary = {t: i for t, i in data["model"]["vocab"].items() if t not in special}
        return cls(vocabulary, merges, special)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (not empty), by rounds over one flat array."""
        length = np.array([len(w) for w in words])
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        done_symbols, done_word = [], []
        none = np.iinfo(np.int64).max
        while len(symbols):
            inside = word[1:] == word[:-1]
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(inside & (self.keys[at] == key), self.ranks[at], none)
            rank = np.r_[rank, none]
            first = np.flatnonzero(np.r_[True, ~inside])
            lowest = np.minimum.reduceat(rank, first)
            of_word = np.repeat(lowest, np.diff(np.r_[first, len(symbols)]))
            over = of_word == none
            if over.any():  # words without a pair leave
                done_symbols.append(symbols[over])
                done_word.append(word[over])
                if over.all():
                    break
                symbols, word, rank, of_word = symbols[~over], word[~over], rank[~over], of_word[~over]
                at = np.r_[at, 0][~over]
            hit = rank == of_word
            # of pairs that overlap (a run of one symbol) every second one merges, from the left
            place = np.flatnonzero(hit)
            fresh = np.r_[True, np.diff(place) > 1]
            start = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
            place = place[(place - start) % 2 == 0]
            symbols[place] = self.made[at[place]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return [np.empty(0, dtype=np.int64) for _ in words]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        symbols = symbols[np.argsort(word, kind="stable")]
        return np.split(symbols, np.cumsum(np.bincount(word, minlength=len(words)))[:-1])


@cache
def _patterns(special: tuple[str, ...]):
    import regex

    return regex.compile(PATTERN), regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None


#: The least code point that Unicode 15.1 leaves unassigned.
FIRST_RARE = "\u0378"


@cache
def _rare():
    """Code points that are not assigned in Python's Unicode: newer libraries disagree on whether they are letters."""
    import unicodedata

    import regex

    open_, ranges = None, []
    for i in range(ord(FIRST_RARE), 0x110001):
        new = i < 0x110000 and unicodedata.category(chr(i)) == "Cn"
        if new and open_ is None:
            open_ = i
        elif not new and open_ is not None:
            ranges.append(f"\\U{open_:08x}-\\U{i - 1:08x}")
            open_ = None
    return regex.compile("[" + "".join(ranges) + "]")


def _library_words(text: str) -> list[str]:
    """The words of a text with such code points, as the tokenizers library cuts them."""
    from tokenizers.pre_tokenizers import ByteLevel

    return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]


class Coder:
    """Encodes and decodes inside a task; remembers short words."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.known = bpe, {}
        self.word, self.mark = _patterns(tuple(bpe.special))

    def _plain(self, text: str) -> list[str]:
        return _library_words(text) if max(text, default="") >= FIRST_RARE and _rare().search(text) else self.word.findall(text)

    def split(self, text: str) -> list[str | tuple[str, str]]:
        """Words of a text; a special token is a word by itself, as a pair."""
        if self.mark is None or not self.mark.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.mark.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(("special", m.group()))
            at = m.end()
        return out + self._plain(text[at:])

    def learn(self, found: list) -> dict | _Both:
        """(number of ids, ids as text, bytes decoded from the ids) of all words in ``found``."""
        if len(self.known) > MOST_WORDS:
            self.known = {}
        known = self.known
        new = [w for w in set(found) if w not in known]
        own: dict = {}
        fresh = [w for w in new if isinstance(w, str)]
        for w, ids in zip(fresh, self.bpe.merge([w.encode("utf-8", "replace") for w in fresh]) if fresh else [], strict=True):
            ids = ids.tolist()
            own[w] = (len(ids), ",".join(map(str, ids)), b"".join([self.bpe.bytes_of[i] for i in ids]))
        for w in new:
            if not isinstance(w, str):
                i = self.bpe.special[w[1]]
                own[w] = (1, str(i), self.bpe.bytes_of[i])
        long = {w: v for w, v in own.items() if len(v[2]) > MOST_BYTES}
        known.update((w, v) for w, v in own.items() if w not in long)
        return _Both(known, long) if long else known

    def encode(self, text: str | None) -> list[int]:
        found = self.split(text or "")
        known = self.learn(found)
        return [int(i) for w in found for i in known[w][1].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bpe.bytes_of[i] for i in ids]).decode("utf-8", "replace")


class _Both:
    """Look-up in what is remembered, then in what only this call has."""

    def __init__(self, known: dict, long: dict):
        self.known, self.long = known, long

    def __getitem__(self, w):
        v = self.known.get(w)
        return self.long[w] if v is None else v


_ADDED = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
#: Characters of text that are split and merged together.
GROUP_CHARS = 1_000_000


def encode_documents(documents: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """The rows of ``documents`` with ``n_tokens``, digests of ids and decoded text, and the ``ids`` if wanted."""
    added = [*_ADDED.fields, *([_IDS] if keep_ids else [])]
    docs = documents.drop(*[f.name for f in added])
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(Bpe.from_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value)
        for batch in batches:
            n, ids_hex, text_hex, ids = [], [], [], []
            ends = np.cumsum(pc.utf8_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(ends):
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + GROUP_CHARS, side="right")))
                split = [coder.split(t or "") for t in batch.column(at).slice(lo, hi - lo).to_pylist()]
                known = coder.learn([w for s in split for w in s])
                for s in split:
                    got = [known[w] for w in s]
                    n.append(sum([g[0] for g in got]))
                    ids_hex.append(hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest())
                    decoded = b"".join([g[2] for g in got]).decode("utf-8", "replace")
                    text_hex.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        ids.append([int(i) for g in got for i in g[1].split(",")])
                lo = hi
            new = [pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            new += [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
