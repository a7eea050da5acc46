"""SentencePiece pieces against the library; spelling variants and conversation repair against plain Python."""

import hashlib
import heapq
import random
import zlib
from itertools import groupby

import pytest

from tintshelf.llm import pieces, repair, variants
from tintshelf.llm.queries import vocabulary_path

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(MODEL))


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.Pieces.from_file(vocabulary_path(MODEL)))


def _texts():
    r = random.Random(5)
    yield from ["", " ", "a", "▁", "a▁ ▁b", "<s> </s> <unk> <0x0A>", "\x00", "ﬁ Å é\r\n\t", "日本語 テキスト", "😀👍🏽 x", "a" * 5000, " " * 300 + "the" + " " * 37, "=" * 77, "\U0010ffff�"]
    for _ in range(1500):
        kind, n = r.randrange(4), r.randrange(1, 50)
        if kind == 0:
            yield "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x250), r.randrange(0x4E00, 0x9FFF), r.randrange(0x1F300, 0x1F700), r.randrange(0xD800)])) for _ in range(n))
        else:
            yield "".join(r.choice(["ab ▁ \n\t", "aehilnorst ", "er.,-1290 "][kind - 1]) for _ in range(n))


def test_pieces_same_as_library(coder, library):
    texts = list(_texts())
    for t in texts:
        assert coder.encode(t) == library.encode(t), t
        assert coder.decode(library.encode(t)) == library.decode(library.encode(t)), t
    # all together: words of many texts in one array
    words = [w for t in texts for w in coder.words(t)]
    fresh = pieces.Coder(coder.pieces)
    known = fresh.learn(words)
    assert all([i for w in fresh.words(t) for i in known[w][0]] == library.encode(t) for t in texts)


def test_pieces_decode_any_ids(coder, library):
    r = random.Random(9)
    for _ in range(3000):
        ids = [r.choice([r.randrange(0, 259), r.randrange(0, 32_000), r.randrange(3), 28_705]) for _ in range(r.randrange(8))]
        assert coder.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("scores", [{"ab": -1.0, "bc": -1.0, "abc": -1.0}, {"bc": -5.0, "abc": -1.0, "ab": -9.0}, {"aa": -1.0, "aaaa": -1.0, "aab": -0.5, "ab": -3.0}])
def test_pieces_leftmost_first_where_ranks_tie(scores):
    """Tied scores, and pieces that rank above their parts, merge as one pair at a time would."""
    scores = {**dict.fromkeys("abc", -20.0), **scores}
    ids = {p: i for i, p in enumerate(scores)}
    import numpy as np

    model = pieces.Pieces(ids, scores, [p.encode() for p in ids], np.zeros(len(ids), dtype=np.int8), 0)
    for n in range(400):
        word = "".join(random.Random(n).choice("abc") for _ in range(1 + n % 9))
        parts = list(word)
        while True:
            have = [(-scores[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in scores]
            if not have:
                break
            i = min(have)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert model.ids(model.merge([word])[0]) == [ids[p] for p in parts], word


def test_pieces_documents(spark, docs, library):
    texts = [None, "", "x", "two words\n", "two words\n", "long " * 20_000, "z" * 30_000, "日本" * 3000]
    df = docs([(i, t) for i, t in enumerate(texts)])
    out = pieces.encode_documents(df, vocabulary_path(MODEL), keep_ids=True)
    assert set(df.columns) - {"ids", "n_tokens"} <= set(out.columns)
    for row in out.collect():
        ids = library.encode(texts[row.doc_id] or "")
        assert (row.n_tokens, row.ids) == (len(ids), ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = pieces.decode_documents(out.select("doc_id", "ids"), vocabulary_path(MODEL)).collect()
    assert all(r.decoded == (texts[r.doc_id] or "") for r in back)
    assert pieces.encode_documents(docs([]), vocabulary_path(MODEL)).count() == 0


# ---- spelling variants --------------------------------------------------------------------------------


def _words(rows):
    import re

    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] = n.get(w, 0) + 1
    return {w: k for w, k in n.items() if k >= 2}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(n):
    near = {w: [v for v in n if v != w and _near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return rows


def _rows(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_against_plain(docs):
    r = random.Random(4)
    stems = ["".join(r.choice("abcé") for _ in range(r.randrange(7, 10))) for _ in range(40)] + ["aaaaaaa", "abababab", "éééééééé", "straßenbahn", "x" * 40, *["".join(r.choice("abcé") for _ in range(n)) for n in (62, 63, 64, 65, 66, 67, 130)], "ab" * 32, "z" * 65, "z" * 200]
    pool = []
    for s in stems:
        pool += [s] * r.choice([1, 3, 30, 300])
        for _ in range(6):
            i = r.randrange(len(s))
            pool += [r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("abcÉz") + s[i + 1 :], s[:i] + r.choice("abz") + s[i:]])] * r.choice([2, 2, 3, 25])
    r.shuffle(pool)
    rows = [(i, " ".join(pool[i * 50 : i * 50 + 50])) for i in range(len(pool) // 50 + 1)]
    rows += [(None, "Repeated REPEATED word,words"), (None, None), (7, ""), (7, "tooshort tooshort tooshort"), (7, "tooshort tooshort tooshort"), (1, "Y" * 60_000 + " " + "Y" * 60_000)]
    want = _plain(_words(rows))
    got = variants.group_variants(docs(rows))
    assert _rows(got) == want
    assert got.count() == len(want) > 200
    assert any(x[3] for x in want) and any(x[5] != x[0] and x[5] != x[3] for x in want)
    assert variants.group_variants(docs([])).count() == 0
    assert variants.group_variants(docs([(1, "nothing twice here")])).count() == 0


def test_variants_long_chain_of_forms(spark):
    """Forms of forms, ties of counts, and a thousand words with one form."""
    chain = [("abcdefgh" + "x" * k, 2 * 10**k) for k in range(1, 12)]
    many = [("k" * 9, 10**6)] + [("k" * i + c + "k" * (8 - i), 5) for i in range(9) for c in "abcdefghijlmnop"]
    ties = [("tietiezz", 2), ("tietiezza", 50), ("tietiezzb", 50)]
    n = dict([*chain, *many, *ties])
    got = variants.group_words(spark.createDataFrame([*n.items()], "word string, n bigint"))
    assert _rows(got) == _plain(n)


# ---- conversation repair ------------------------------------------------------------------------------


def _damaged(rows):
    sp = lambda v: " " if v is None else v
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        h = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        mine += [] if h == 0 else [(turn, role, text)] * (2 if h == 3 else 1)
    return {c: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, m in convs.items()}


def _cheapest(rows):
    """Dijkstra over (rows read, state), by (cost, audit): an unpruned search for the least of both."""
    seen, marked = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        marked.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, said = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return marked, cost, audit, "\n".join(said)
        if (i, state) in done:
            continue
        done.add((i, state))
        forced = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[forced]
        heapq.heappush(heap, (cost + 3, audit + "I", i, forced, (*said, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, said))
            if marked[i] not in ("b", "d"):
                more = 3 if marked[i] == "t" else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, forced, (*said, f"{name}:{text}")))
                if role[:1] in step[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*said, f"{role}:{text}")))


def _expected(rows):
    out = set()
    for conv, mine in _damaged(rows).items():
        if not mine:
            out.add((conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        marked, cost, audit, said = _cheapest(mine)
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out.add((conv, gaps, marked.count("b"), marked.count("d"), marked.count("t"), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return out


def _repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS run", "'y' AS wrong", "1 AS gone", "2 AS h", "3 AS what", "4 AS behind")
    got = [tuple(r) for r in repair.repair(repair.damage(df)).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def test_repair_against_search(spark):
    r = random.Random(8)
    rows = []
    for conv in range(400):
        for turn in range(r.randrange(1, 14)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "us", "a"])
            text = r.choice(["Yes.", "No?", "open end", "Ok!", "", " \n\t", None, "same.", "same.", "ends \n", "1. two\x0b", " ", "x! "])
            rows.append((conv, r.choice([turn, turn, turn, turn + 1, turn + 7, None]), role, text))
    rows += [(None, 0, "user", "Null id."), (None, None, "assistant", "Ok."), (-5, -3, "user", "Minus."), (-5, 10**12, "assistant", "Far.")]
    assert _repaired(spark, rows) == _expected(rows)


def test_repair_long_runs(spark):
    """Runs of thousands of equal symbols, repeats of one row, very long texts, and conversations that lose all rows."""
    rows = [(1, t, "user", f"Line {t}.") for t in range(500)]
    rows += [(2, t, "assistant", "Same.") for t in range(400)]
    rows += [(3, 5, "user", "One row, many times.")] * 300
    rows += [(4, t, ["user", "assistant"][t % 2], "w. " * 20_000) for t in range(6)]
    rows += [(5, t, "system", f"No end {t}") for t in range(400)]
    gone = [(c, 1, "user", "Away.") for c in range(100, 300) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    assert gone
    rows += gone
    assert _repaired(spark, rows) == _expected(rows)
    assert _repaired(spark, rows[:0]) == set()


def test_repair_powers_equal_single_steps():
    v = repair.at_end()
    for symbol in ("u", "a", "s", "o", "ut", "at", "st", "ot", "-d"):
        one = v
        for m in range(1, 70):
            one = repair.advance(symbol, 1, one)
            assert repair.advance(symbol, m, v) == one
    assert [k for k, _ in groupby(repair.edits("u", 0))]
