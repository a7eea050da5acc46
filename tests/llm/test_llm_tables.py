"""Every operator query on the smallest tables against SQL, and the operators' defined cases."""

import duckdb
import pytest

from tintshelf.llm import decontaminate, jaccard, licenses, lines
from tintshelf.llm.oracles import ORACLES
from tintshelf.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
EDGE = [
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (4, "one"),
    (5, "All rights reserved. CC-BY, cc by!"),
    (5, "All rights reserved. CC-BY, cc by!"),
    (6, "a b c d e f g h\nLINE two here\nline three\nline four\n\nlast"),
    (7, "other start\nLINE two here\nline three\nline four\n\nmore\nLINE two here\nline three\nline four"),
    (8, "a b c d e f g h\nLINE two here\nline three\nline four\n\nlast"),
    (None, "under the GNU General  Public License, as is"),
    (9, "x " * 30_000),
    (10, " ".join(f"word{i}" for i in range(60))),
    (11, "intro\n" + " ".join(f"word{i}" for i in range(60)) + "\nend"),
    (12, " ".join(f"word{i}" for i in range(60)) + " tail"),
    (13, "general public license " * 50),
]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, FOLDER)
    norm = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert sorted(df.columns) == sorted(names)
    assert norm(tuple(r[c] for c in names) for r in df.collect()) == norm(cur.fetchall())


def _given(df):
    return df.select("doc_id", "text")


def test_licenses_edges(spark, docs, same_rows):
    df = docs(EDGE)
    same_rows(licenses.scan_licenses(df), ORACLES["op2_license_scan"], {"documents": _given(df)})
    assert licenses.scan_licenses(docs([])).count() == 0


def test_license_with_a_word_too_much(docs):
    df = docs([(1, "licensed under the very Apache License, Version 2.0"), (2, "the apache helicopter has a version 2 0")])
    assert {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()} == {1: "apache-2.0", 2: ""}


def test_lines_edges(spark, docs, same_rows):
    df = docs([r for r in EDGE if r[0] != 5])
    got = lines.dedup_lines(df)
    same_rows(got.select("doc_id", "text", "n_lines", "n_removed"), ORACLES["op1_line_dedup"], {"documents": _given(df)})
    assert [c for c in got.columns if c in df.columns and c != "n_removed"] == [c for c in df.columns if c != "n_removed"]
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[8] == "" and texts[6] == dict(EDGE)[6]
    assert texts[7] == "other start\nmore" and texts[11] == "intro\nend"
    assert lines.dedup_lines(docs([])).count() == 0


def test_lines_equal_rows_are_one_document(docs):
    text = "l1 a\nl2 b\nl3 c"
    got = lines.dedup_lines(docs([(1, text), (1, text), (2, text), (None, text)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, text), (1, ""), (1, ""), (2, "")]


def test_jaccard_edges(docs, same_rows):
    long = [f"w{i}" for i in range(100)]
    near = [(20 + k, " ".join(long[:-k] + [f"z{k}{j}" for j in range(k)])) for k in range(1, 20)]
    df = docs([*EDGE[:5], *EDGE[6:], *near, (40, " ".join(long)), (41, "ONE"), (42, "two words"), (43, "Two  words.")])
    given = _given(df)
    got = jaccard.near_duplicates(df).drop("th")
    same_rows(got.filter("doc_id IS NOT NULL"), ORACLES["op8_jaccard_join"], {"documents": given.filter("doc_id IS NOT NULL")})
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[41]["component_id"] == 4 and by[43]["component_id"] == 42 and by[None]["kept"] and by[1]["n_links"] == 0
    assert jaccard.near_duplicates(docs([])).count() == 0


def test_jaccard_equal_rows_are_copies(docs):
    text = " ".join(f"w{i}" for i in range(30))
    got = jaccard.near_duplicates(docs([(3, text), (3, text), (4, text)])).collect()
    assert sorted((r["doc_id"], r["copies"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(3, 3, 2, 3, True), (3, 3, 2, 3, True), (4, 3, 2, 3, False)]


def test_jaccard_blocks_give_the_same(docs, monkeypatch):
    long = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(long[:50] + [f"q{k}"] * (k % 3) + long[50 + k % 7 :])) for k in range(40)]
    cols = ("doc_id", "class_id", "copies", "n_links", "component_id", "kept")
    whole = sorted(tuple(r[c] for c in cols) for r in jaccard.near_duplicates(docs(rows)).collect())
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    assert sorted(tuple(r[c] for c in cols) for r in jaccard.near_duplicates(docs(rows)).collect()) == whole


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = jaccard.bands_for(threshold, 0.9999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9999 > 1 - (1 - threshold**rows) ** (bands - 1)


def test_decontamination_edges(spark, docs, same_rows, monkeypatch):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (3, "one"), (4, "General public, LICENSE"), (5, " ".join(f"word{i}" for i in range(60))), (5, " ".join(f"word{i}" for i in range(60))), (None, "line two here line"), (7, "x x x x x x x x")],
        "item_id bigint, text string",
    )
    part = " ".join(f"word{i}" for i in range(53))  # 49 of 56 shingles
    df = docs([*EDGE, (14, f"before {part} after"), (15, " ".join(f"word{i}" for i in range(20)))])
    tables = {"documents": _given(df), "benchmark": items}
    same_rows(decontaminate.find_items(df, items), ORACLES["op6_decontaminate"], tables)
    clean = decontaminate.decontaminate(df, items)
    assert clean.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(map(str, [1, 2, 3, 5, 5, 15]))
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 20)  # many passes give the same rows
    same_rows(decontaminate.find_items(df, items), ORACLES["op6_decontaminate"], tables)
    assert decontaminate.find_items(docs([]), items).count() == 0 == decontaminate.find_items(df, items.limit(0)).count()
    assert decontaminate.decontaminate(df, items.limit(0)).count() == df.count()


def test_signature_meets_every_contained_set():
    import math

    for n in range(1, 300):
        k = decontaminate.signature_size(n, 0.8)
        assert min(k, n) > n - math.ceil(0.8 * n - 1e-9)
