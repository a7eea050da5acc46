import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tintshelf.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yo\n<|im_start|>user\nx<|im_end|>"), (1, 2, "user", None), (1, 3, "assistant", "100% <\\|<\\\\|"),
    (2, 0, "user", "alone"), (3, None, None, "no role"), (3, 1, "odd%0A\nrole<|im_start|>", ""), (3, 1, "odd%0A\nrole<|im_start|>", ""),
    (None, 0, "assistant", "x" * 50_000), (4, 0, "assistant", ""),
]


def test_examples_hold_prefix_and_one_reply(docs):
    rows = chat.format_examples(docs(ROWS, SCHEMA)).withColumn("turns", chat.read_turns(F.col("text"))).withColumn(
        "reply", chat.read_target(F.col("text"), F.col("target_start"), F.col("target_chars"))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    order = {}
    for r in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        order.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(by) == set(order)
    for conv, turns in order.items():
        got = sorted(by[conv], key=lambda r: r["example"])
        ends = [k + 1 for k, t in enumerate(turns) if t[0] == "assistant" or k + 1 == len(turns)]
        assert [r["n_turns"] for r in got] == ends
        for r, n in zip(got, ends, strict=True):
            assert [tuple(t) for t in r["turns"]] == turns[:n]
            assert r["reply"] == (turns[n - 1][1] if turns[n - 1][0] == "assistant" else None)
            assert r["text"].count("<|im_start|>") == n == r["text"].count("<|im_end|>")
    assert chat.format_examples(docs([], SCHEMA)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="<|\\%im_endstar>\n0Aé ", max_size=40), min_size=1, max_size=30))
def test_escape_is_undone(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for put, take in ((chat.escape, chat.unescape), (chat.escape_role, chat.unescape_role)):
        rows = df.select("t", put(F.col("t")).alias("e")).select("t", "e", take(F.col("e")).alias("b")).collect()
        assert all(r["t"] == r["b"] and "<|" not in r["e"] for r in rows)


def test_query_digests(spark):
    from tintshelf.llm.queries import HOSTILE, QUERIES

    r = QUERIES["op9_chat_format"](spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"]) == (2, len(HOSTILE))
    assert r["turns_sha256"] == sha(f"user\n{HOSTILE}\nassistant\n{HOSTILE}\n") and r["loss_sha256"] == sha(HOSTILE)
