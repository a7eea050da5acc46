"""Operators that SQL cannot express, against brute force, an exact round trip or held-out accuracy."""

import random

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tintshelf.llm import bpe, dom, extract, langid, layouts, tokens
from tintshelf.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = ["<|endoftext|>", " ", " ", "\n\n", "\t", "'s", "'LL", "é", "中文", "😀", "a" * 70, "aaaaaaa", "1", "²", "́", "\x00", "<|endof", "\U0001e900", "\U00018df2", "!?"]


def _texts(n=300):
    r = random.Random(3)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(20))) for _ in range(n)] + ["", "x" * 20_000, "ab " * 20_000]


def test_bpe_like_the_library(spark, docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = _texts()
    rows = [*enumerate(texts), (900, None), (901, "same"), (901, "same"), (None, "same")]
    df = docs(rows)
    got = bpe.encode_documents(df, P.path("byte_bpe_50k.json"), keep_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        want = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
    coder = bpe.Coder(bpe.Bpe.from_file(P.path("byte_bpe_50k.json")))
    for x in texts:
        ids = coder.encode(x)
        assert coder.decode(ids) == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(docs([]), P.path("byte_bpe_50k.json")).count() == 0


def test_bpe_query_digests(spark):
    import hashlib

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op7_bpe"](spark, FOLDER).collect():
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_language_of_held_out_documents(spark):
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op5_language_id"](spark, FOLDER).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(known) and len(held) > 40
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, docs):
    en, fr = "the thing that was there and this with them ", "les choses qui sont dans une maison avec eux "
    df = spark.createDataFrame([(1, en * 30, "en"), (2, fr * 30, "fr"), (3, None, "fr"), (4, "nothing", None)], "doc_id bigint, text string, lang string")
    model = langid.learn(df)
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, en), (5, fr * 5000), (6, en * 20 + fr * 20), (6, "a"), (None, en)]
    got = langid.identify(docs(rows), model).collect()
    out = [(r["doc_id"], r["lang_pred"], {m["lang"] for m in r["mixture"]}) for r in got]
    assert out[:6] == [(1, "und", set()), (2, "und", set()), (3, "und", set()), (4, "en", {"en"}), (5, "fr", {"fr"}), (6, out[5][1], {"en", "fr"})]
    assert out[6][1] in ("en", "fr") and out[7][1] == "en" and got[0]["score"] == 0
    assert 0.4 <= got[5]["score"] <= 0.6
    nobody = langid.learn(df.filter("false"))
    assert {r["lang_pred"] for r in langid.identify(docs(rows), nobody).collect()} == {"und"}
    assert langid.identify(docs([]), model).count() == 0


def test_mixture_likelihood_never_falls():
    r = np.random.default_rng(1)
    p = r.dirichlet(np.ones(50), size=3).T
    times = r.integers(1, 9, 50).astype(float)
    share, like = langid.Model._mix(p, times)
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1 - a, 41)]
    assert abs(share.sum() - 1) < 1e-9 and like >= max(times @ np.log(p @ np.array(g) + 1e-300) for g in grid) - 1e-2


def test_token_counts_like_the_library(spark, docs, tmp_path):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [*enumerate(_texts(120)), (900, None), (901, "same"), (901, "same"), (None, "same")]
    encoder = tokens.ordinary_encoder(P.path("byte_bpe_50k.tiktoken"), bpe.PATTERN)
    written = tokens.write_tokens(docs(rows), str(tmp_path / "t"), encoder, 50_256, 50_257)
    want = sorted((str(d), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in rows)
    for block in (1 << 20, 64, 1):
        got = written.join(tokens.count_tokens(spark, str(tmp_path / "t"), 50_256, 50_257, block), ["file", "ordinal"])
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == want


def test_separator_scan_edges(spark, tmp_path, monkeypatch):
    end, kind = 9, np.dtype("<u4")
    r, want = random.Random(2), []
    files = {"a": [], "b": [9], "c": [9, 9, 1], "d": [1, 2, 3], "e": [r.choice([1, 2, 9]) for _ in range(400)], "f": [1] * 50 + [9], "g": [9] * 40}
    for name, ids in files.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, dtype=kind).tobytes() + b"\1" * (name == "d"))
        start, k = 0, 0
        for i, x in enumerate([*ids, None]):
            if x == end or (x is None and i > start):
                want.append((f"{name}.bin", k, start, i - start, x == end))
                start, k = i + 1, k + 1
    monkeypatch.setattr(tokens, "GROUP_BLOCKS", 3)
    for block in (1, 2, 7, 1000):
        got = tokens.count_tokens(spark, str(tmp_path), end, 1 << 20, block)
        assert sorted(tuple(r) for r in got.select("file", "ordinal", "start", "n_tokens", "closed").collect()) == sorted(want)


def test_pages_like_their_template(spark):
    import html
    import re

    def article(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        return "\n".join(b for b in parts if b)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["op3_html_text"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_extraction_edges(spark, docs):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    trees = extract.learn(pages, sample=40)
    body = "".join(f"<p>Sentence {i}, with some words, and more of them to read.</p>" for i in range(6))
    page = f'<html><body><div class="menu"><a href="/">Home</a> <a href="/b">News</a></div><div class="post-body"><h1>A &amp; B</h1>{body}<p>a <i>b</i>\n\n c<br>d &lt;x&gt;</p></div><section class="comments"><div class="comment"><p>Nice one, thank you.</p></div></section><footer>© all</footer></body></html>'
    want = "A & B\n" + "\n".join(f"Sentence {i}, with some words, and more of them to read." for i in range(6)) + "\na b c d <x>"
    deep = "<div>" * 5000 + "<p>x</p>"
    rows = [(1, None), (2, ""), (3, "<script>var a='<p>no</p>'</script>"), (4, page), (4, page), (None, "<<<>&#x;<!-"), (5, deep), (6, "<p>" + "word " * 20_000)]
    got = extract.extract_text(docs(rows, "page_id bigint, html string"), trees).collect()
    assert [r["text"] for r in got[:5]] == ["", "", "", want, want] and len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract.learn(pages.filter("false")) is None
    assert {r["text"] for r in extract.extract_text(docs(rows, "page_id bigint, html string"), None).collect()} == {""}
    assert extract.extract_text(docs([], "page_id bigint, html string"), trees).count() == 0


def test_decoding_of_certain_pages():
    r = np.random.default_rng(4)
    texts = ["Some words, to fill a paragraph with.", "Other words. More of them, in all."]
    for k in range(30):
        order, x = dom.features(dom.parse(layouts.Layout(texts, k).page()))
        p = np.clip(r.random(len(x)), 0.01, 0.99)
        assert extract.decode(order, p) <= {id(n) for n in order}
        assert extract.decode(order, np.full(len(x), 0.99)) == {id(n) for n in order}
        assert extract.decode(order, np.full(len(x), 0.01)) == set()


def test_held_out_layouts(spark):
    trees = extract.learn(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    texts = [f"Words of number {i}, in a sentence that goes on, and ends." * (1 + i % 3) for i in range(40)]
    right = 0
    for k in range(100):
        page = layouts.Layout(texts, 10**6 + k).page()
        root = dom.parse(page)
        keep = {}
        for n in dom.nodes(root):
            mark = n.attrs.get("data-keep")
            keep[id(n)] = mark == "1" if mark else keep.get(id(n.parent), False)
        want = "\n".join(dom.block_texts(root, {i for i, v in keep.items() if v}))
        right += extract.main_texts([page.replace(' data-keep="0"', "").replace(' data-keep="1"', "")], trees)[0] == want
    assert right >= 70
