"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is written with ``▁`` for spaces and one more in front, and cut into words before each ``▁`` that follows another
character (no piece of the model crosses such a place). Words of a batch that were not met before go into one flat array of
code points, cut further wherever no piece holds two neighbouring characters. In each round every adjacent pair inside a
segment is looked up in the sorted pair keys; each segment takes its lowest rank and merges it at all places from the left
at once; then the array is compacted, and segments without a pair leave it. Characters outside the vocabulary become bytes.

The library merges one pair at a time, the best score first and of equal scores the leftmost. Merging all places of a rank
at once gives the same unless a merge can make a pair that ranks as high. That needs a piece the rules do not build from its
own characters, or scores that several pieces share; such ranks (found when the model is read) merge one place a round.

Models of the BPE kind with byte fallback, without rewriting of characters, are read with the ``sentencepiece`` library on
the driver; the path is a parameter. Nothing else of the library is used.

Defined cases: null text counts as empty (no ids, empty decoding); strings of control pieces in a text are ordinary text;
``▁`` in a text decodes as a space, as in the library; rows come back as often as given; an empty table gives no rows;
columns of the caller that are named like ours are replaced, others stay.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE, UNKNOWN_SURFACE = "▁", " ⁇ "
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words that a task remembers (it starts afresh beyond), the longest that is remembered, characters encoded together.
MOST_WORDS, MOST_CHARS, GROUP_CHARS = 400_000, 64, 4_000_000
_NONE = np.iinfo(np.int64).max
_POINTS = 0x110000


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tintshelf-each-byte", _each_byte)


def _found(sorted_keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key in sorted keys."""
    if not len(sorted_keys):
        return np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
    return at, sorted_keys[at] == key


class Pieces:
    """Pair table, characters and spellings of a model as arrays; cheap to send.

    ``scores`` of the pieces that text may be merged into, by piece; ``spelled`` holds what each id decodes to: bytes,
    and for a byte piece its one byte; ``bytes_at`` is the id of byte 0.
    """

    def __init__(self, ids: dict[str, int], scores: dict[str, float], spelled: list[bytes], kinds: np.ndarray, bytes_at: int):
        self.spelled, self.kinds, self.bytes_at, self.size = spelled, kinds, bytes_at, len(spelled)
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank_of = {p: order[s] for p, s in scores.items()}
        self.base = self.size + _POINTS  # symbols: ids, then characters outside the vocabulary by code point
        self.of_char = np.full(_POINTS, -1, dtype=np.int32)
        rows, near = [], set()
        for piece, rank in rank_of.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = ids[piece]
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                near.add(ord(piece[k - 1]) * _POINTS + ord(piece[k]))
                if a in rank_of and b in rank_of:
                    rows.append((ids[a] * self.base + ids[b], rank, ids[piece]))
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.made = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        self.near = np.array(sorted(near), dtype=np.int64)
        self.single = np.ones(len(order) + 1, dtype=bool)  # exact for any model, one place a round
        names = [p for p in rank_of if len(p) > 1]
        alone = self.merge(names)
        odd = {p for p, got in zip(names, alone, strict=True) if len(got) > 1}
        count = np.bincount([rank_of[p] for p in names], minlength=len(order) + 1)
        self.single = count > 1
        for z in odd:
            for k in range(1, len(z)):
                for part in (z[:k], z[k:]):
                    if len(part) > 1 and part in rank_of and rank_of[part] >= rank_of[z]:
                        self.single[rank_of[part]] = True

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        plain = [not (byte[i] or model.is_control(i) or model.is_unknown(i)) for i in range(n)]
        probe = " ﬁ Å  Ａ\t x "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("a model that rewrites characters or white space is not supported")
        if sum(byte) != 256 or any(model.is_unused(i) for i in range(n)):
            raise ValueError("a model without byte fallback, or with unused pieces, is not supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, ok in zip(names, plain, strict=True) if ok):
            raise ValueError("a model with pieces of several words is not supported")
        spelled, kinds = [], np.zeros(n, dtype=np.int8)
        for i, p in enumerate(names):
            if byte[i]:
                spelled.append(bytes([int(p[3:5], 16)]))
                kinds[i] = 1
            elif plain[i]:
                spelled.append(p.replace(SPACE, " ").encode())
            else:
                spelled.append(UNKNOWN_SURFACE.encode() if model.is_unknown(i) else b"")
                kinds[i] = 2
        ids = {p: i for i, p in enumerate(names) if plain[i]}
        return cls(ids, {p: model.get_score(i) for p, i in ids.items()}, spelled, kinds, byte.index(True))

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Symbols of each word (none empty) after all merge rounds."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        known = self.of_char[points]
        symbols = np.where(known >= 0, known, self.size + points)
        joined = _found(self.near, points[:-1] * _POINTS + points[1:])[1] & (word[1:] == word[:-1])
        segment = np.r_[0, np.cumsum(~joined)] if len(points) else np.empty(0, dtype=np.int64)
        place = np.arange(len(points))  # each symbol stays known by the place of its first character
        out_symbols, out_place = [], []
        while len(symbols):
            inside = segment[1:] == segment[:-1]
            at, there = _found(self.keys, symbols[:-1] * self.base + symbols[1:])
            rank = np.r_[np.where(inside & there, self.ranks[at] if len(self.ranks) else 0, _NONE), _NONE]
            start = np.flatnonzero(np.r_[True, ~inside])
            length = np.diff(np.r_[start, len(symbols)])
            lowest = np.minimum.reduceat(rank, start)
            open_ = lowest < _NONE
            if not open_.all():  # segments without a pair are finished
                over = np.repeat(~open_, length)
                out_symbols.append(symbols[over])
                out_place.append(place[over])
                if not open_.any():
                    break
                go = ~over
                symbols, segment, place, rank, at = symbols[go], segment[go], place[go], rank[go], np.r_[at, 0][go]
                lowest, length = lowest[open_], length[open_]
                start = np.r_[0, np.cumsum(length)[:-1]]
            hit = np.flatnonzero(rank == np.repeat(lowest, length))
            # neighbouring hits share a symbol: from the left every second one merges
            fresh = np.r_[True, np.diff(hit) > 1]
            run = np.flatnonzero(fresh)
            since = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            first = np.r_[True, segment[hit[1:]] != segment[hit[:-1]]]
            hit = hit[np.where(self.single[rank[hit]], first, since % 2 == 0)]
            symbols[hit] = self.made[at[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, segment, place = symbols[keep], segment[keep], place[keep]
        if not words:
            return []
        symbols, place = np.concatenate(out_symbols), np.concatenate(out_place)
        order = np.argsort(place, kind="stable")
        symbols, word = symbols[order], word[place[order]]
        return np.split(symbols, np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def ids(self, symbols: np.ndarray) -> list[int]:
        """Ids of symbols; a character outside the vocabulary gives the pieces of its bytes."""
        out: list[int] = []
        for s in symbols.tolist():
            if s < self.size:
                out.append(s)
            else:
                out += [self.bytes_at + b for b in chr(s - self.size).encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that form no character become U+FFFD each."""
        parts, run, begun = [], bytearray(), False
        for i in ids:
            if self.kinds[i] == 1:
                run += self.spelled[i]
                begun = True
                continue
            if run:
                parts.append(run.decode("utf-8", "tintshelf-each-byte"))
                run = bytearray()
            piece = self.spelled[i].decode()
            if not begun and self.kinds[i] == 0 and piece.startswith(" "):
                piece = piece[1:]
            begun = begun or piece != "" or self.kinds[i] == 0
            parts.append(piece)
        parts.append(run.decode("utf-8", "tintshelf-each-byte"))
        return "".join(parts)


class Coder:
    """Encodes inside a task; remembers short words."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def words(self, text: str | None) -> list[str]:
        return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: list[str]) -> dict[str, tuple[list[int], str, bytes]]:
        """(ids, ids as text, what they decode to) of new words; what is not to be remembered comes back."""
        if len(self.known) > MOST_WORDS:
            self.known = {}
        new = [w for w in set(words) if w not in self.known]
        long = {}
        for w, symbols in zip(new, self.pieces.merge(new), strict=True):
            ids = self.pieces.ids(symbols)
            (self.known if len(w) <= MOST_CHARS else long)[w] = (ids, ",".join(map(str, ids)), b"".join([self.pieces.spelled[i] for i in ids]))
        return {**{w: self.known[w] for w in set(words) if w in self.known}, **long} if long else self.known

    def encode(self, text: str | None) -> list[int]:
        words = self.words(text)
        known = self.learn(words)
        return [i for w in words for i in known[w][0]]

    def decode(self, ids: list[int]) -> str:
        return self.pieces.decode(ids)


_ADDED = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, chars = [], 0
    for t in texts:
        if group and chars + len(t) > GROUP_CHARS:
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t)
    if group:
        yield group


def encode_documents(documents: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """The rows of ``documents`` with ``n_tokens``, digests of ids and decoded text, and the ``ids`` if wanted."""
    added = [*_ADDED.fields, *([_IDS] if keep_ids else [])]
    docs = documents.drop(*[f.name for f in added])
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(Pieces.from_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value)
        for batch in batches:
            n, ids_hex, text_hex, ids = [], [], [], []
            for texts in _groups([t or "" for t in batch.column(at).to_pylist()]):
                split = [coder.words(t) for t in texts]
                known = coder.learn([w for s in split for w in s])
                for s in split:
                    got = [known[w] for w in s]
                    n.append(sum([len(g[0]) for g in got]))
                    ids_hex.append(hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest())
                    # the space put in front of the text goes again; bytes of one character never part
                    text_hex.append(hashlib.sha256(b"".join([g[2] for g in got])[1:]).hexdigest())
                    if keep_ids:
                        ids.append([i for g in got for i in g[0]])
            new = [pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            new += [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode_documents(documents: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The rows of ``documents`` with ``decoded``, the text of an array of ids (null: null)."""
    docs = documents.drop("decoded")
    at = docs.columns.index(column)
    sent = docs.sparkSession.sparkContext.broadcast(Pieces.from_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else sent.value.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType())]))
