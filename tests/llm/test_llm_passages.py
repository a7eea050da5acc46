"""Line dedup with passages of fewer lines than a run, against plain Python, and in the pipeline."""

import random
import re

import corpus_pipeline
from tintshelf.llm import lines


def _words(k, n):
    return " ".join(f"w{k}x{i}" for i in range(n))


def _deduped(rows, run=lines.RUN, long_words=lines.LONG_WORDS):
    """Line dedup with passages by its rule, one row after the other."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        all_lines = text.split("\n")
        at = [i for i, x in enumerate(all_lines) if x.strip(" \t\r")]
        s = [all_lines[i].strip(" \t\r") for i in at]
        ends, size, gone = [*at[1:], len(all_lines)], [len(re.split("[ \t]+", x)) for x in s], set()
        for k in range(len(s)):
            for m in range(1, run + 1):
                n = size[k : k + m]
                shortest = sum(n) >= long_words > max(sum(n[1:]), sum(n[:-1]))
                if len(n) == m and (m == run or shortest or (m == 1 and n[0] >= long_words)):
                    key = tuple(s[k : k + m])
                    if key in seen:
                        gone.update(range(at[k], ends[k + m - 1]))
                    seen.add(key)
        out[doc_id] = "\n".join(x for i, x in enumerate(all_lines) if i not in gone)
    return out


PASSAGE = f"{_words(1, 30)}\n\n{_words(2, 30)}"
ROWS = [
    (1, f"first start\n{PASSAGE}\nfirst end"),
    (2, PASSAGE),
    (3, f"third start\n{PASSAGE}\nthird end"),
    (4, f"{_words(3, 20)}\n{_words(4, 29)}"),  # 49 words are no passage
    (5, f"{_words(3, 20)}\n{_words(4, 29)}"),
    (6, f"short\n{_words(5, 60)}"),  # the long line is the shortest run: the other stays
    (7, f"short\n{_words(5, 60)}"),
    (8, f"{_words(6, 1)}\n{_words(7, 49)}\nother"),  # 50 words on two lines
    (9, f"else\n{_words(6, 1)}\n{_words(7, 49)}"),
]


def test_passage_on_two_lines(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, passages=True).collect()}
    assert got == _deduped(ROWS)
    assert got[2] == "" and got[3] == "third start\nthird end" and got[9] == "else" and got[7] == "short"
    assert got[5] == ROWS[4][1] and got[1] == ROWS[0][1]
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, passages=False).collect()}[2] == PASSAGE


def test_passages_like_plain_python(spark):
    r = random.Random(5)
    pool = [_words(k, r.choice([1, 9, 12, 18, 25, 30, 49, 50, 70])) for k in range(25)]
    rows = [(d, "\n".join(r.choice([*pool, "", f"own {d}"]) for _ in range(r.randrange(1, 12)))) for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for run, long_words in ((3, 50), (4, 50), (2, 40)):
        got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(df, run, long_words, passages=True).collect()}
        assert got == _deduped(rows, run, long_words)


def test_pipeline_cuts_passages(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert 2 not in kept and kept[3] == "third start\nthird end"
