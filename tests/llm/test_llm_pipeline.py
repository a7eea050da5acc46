"""The pipeline's stages, each on its own input, against plain Python; odd rows; the columns that stages hand on."""

import hashlib
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tintshelf.llm import lines

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def _grams(w, n=5):
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def _deduped(rows):
    """Line dedup by its rule, one row after the other."""
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    seen, out = set(), []
    for r in order:
        if r["text"] is None:
            out.append((r["doc_id"], None))
            continue
        all_lines = r["text"].split("\n")
        at = [i for i, x in enumerate(all_lines) if x.strip(" \t\r")]
        s = [all_lines[i].strip(" \t\r") for i in at]
        ends = [*at[1:], len(all_lines)]
        gone = set()
        found = [(k, k + lines.RUN, tuple(s[k : k + lines.RUN])) for k in range(len(s) - lines.RUN + 1)]
        found += [(k, k + 1, s[k]) for k in range(len(s)) if len(re.split("[ \t]+", s[k])) >= lines.LONG_WORDS]
        for k, stop, key in sorted(found, key=lambda f: f[0]):
            if key in seen:
                gone.update(range(at[k], ends[stop - 1]))
            seen.add(key)
        left = "\n".join(x for i, x in enumerate(all_lines) if i not in gone)
        if not gone or left.strip(" \t\r\n"):
            out.append((r["doc_id"], left))
    return out


def _one_of_each(rows):
    """Documents left when every group of near copies keeps its first."""
    sets = [(r["doc_id"], _grams(_words(r["text"]))) for r in sorted(rows, key=lambda r: r["doc_id"])]
    label = {d: d for d, _ in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) / len(x | y) >= 0.8:
                p, q = sorted((top(a), top(b)))
                label[q] = p
    return {d for d in label if top(d) == d}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, input rows, output rows)] of every stage, each written and read again."""
    folder, docs, out = str(tmp_path_factory.mktemp("pipeline")), spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == docs.columns
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return out


def test_stages_by_plain_python(spark, stages):
    got = {name: (given, kept) for name, given, kept in stages}
    assert list(got) == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "bpe"]
    given, kept = got["language_id"]
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in given}  # every document here is in a learned language
    given, kept = got["line_dedup"]
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted(_deduped(given))
    assert all(r["n_chars"] == len(r["text"]) for r in kept)
    given, kept = got["jaccard_join"]
    assert {r["doc_id"] for r in kept} == _one_of_each(given) and len(kept) == len({r["doc_id"] for r in kept})
    given, kept = got["decontaminate"]
    items = [_grams(_words(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in given if not any(len(i & _grams(_words(r["text"]))) >= 0.8 * len(i) for i in items if i)}
    assert {r["doc_id"] for r in kept} == clean and 0 < len(clean) < len(given)
    given, kept = got["bpe"]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in kept:
        ids = t.encode(r["text"], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_run_is_its_stages(spark, stages):
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(corpus_pipeline.run(spark, FOLDER).collect()) == key(stages[-1][2])


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, th string, cls string, fit string, lines string"
    en = "this is the text that was there with them and for you in the house"
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, en), (4, en), (None, en + " too"), (5, en + "\n" + en), (6, "x" * 50_000), (7, en), (8, None)]
    docs = spark.createDataFrame([(d, t, "en" if t else None, None, None, "a", "b", "c", "d") for d, t in rows], schema)
    empty = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        assert k == 4 or out.columns == docs.columns
        kept = sorted(str(r["doc_id"]) for r in out.collect())
        if k == 0:
            assert kept[:3] == ["4", "4", "5"] and "1" not in kept and "3" not in kept
        if k == 2:  # equal texts are copies, the row given twice is one of them
            assert kept.count("4") == 1 and "7" not in kept and "1" in kept and "8" in kept
        assert stage(spark, empty, FOLDER).count() == 0


def test_documents_without_letters_go(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("... 12")).otherwise(F.col("text")))
    kept = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert kept.filter("doc_id % 2 = 0").count() == 0 and kept.count() == docs.filter("doc_id % 2 = 1").count()
