"""String functions on worked examples."""

import pytest
from pyspark.sql import functions as F

from tintshelf.functions import text as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("name,catalog,search", [
    ("AB_C_000.jpg", "AB", "AB_C"), ("AB_000_001.jpg", "AB", "AB_000"), ("AB.jpg", "AB", "AB"), ("AB_1.jpg@c2", "AB", "AB"),
])
def test_style_codes(spark, name, catalog, search):
    assert one(spark, name.split("@")[0], T.style_code_catalog) == catalog
    assert one(spark, name, T.style_code_search) == search


@pytest.mark.parametrize("text,code", [
    ("ＫＦ23-4567\nsmall", "KF23-4567#"), ("KE23 456", "KF23-456#"), ("J0A21-123-4B", "JCA21-123-4B#"), ("GZ12-0034 x", "GZ12-0034#"),
    ("123# x", "123#"), ("Blue", "BLUE#"), ("", ""), ("12", ""), ("É12 AB-1", "AB-1#"), ("AB12_C", "AB12-C#"), ("A1234 5B", "A1234-5B#"),
])
def test_extract_style_code(spark, text, code):
    assert one(spark, text, T.extract_style_code) == code


def test_long_runs_end(spark):
    long = "A1" + "B2" * 20000 + "É"
    assert one(spark, long, T.extract_style_code) == ""
    assert one(spark, "A12" + "_3" * 20000, T.extract_hash_code) is None


def test_split_and_tokens(spark):
    assert one(spark, "Red、red，BLUE  x", T.split_tags) == ["Red", "BLUE", "x"]
    assert one(spark, "abc12def 99zebra9 zebra 1234", T.text_tokens) == ["ABC12DEF", "ZEBRA"]


def test_tags_from_path(spark):
    df = spark.createDataFrame([("/a/2024", "/a/2024/top/knit/red blue/x.jpg"), ("/a/b", "/a/b/x.jpg")], "root string, path string")
    rows = [r["t"] for r in df.select(T.tags_from_path(F.col("root"), F.col("path")).alias("t")).collect()]
    assert rows == [["year:2024", "category:top", "subcategory:knit", "subcategory:red", "subcategory:blue"], []]


def test_card_numbers_and_years(spark):
    assert one(spark, "0099", T.next_card_number) == "0100"
    assert one(spark, "99", T.next_card_number) == "100"
    assert one(spark, "GZ24-1", lambda c: T.year_from_code(c, 2026)) == "2024"
    assert one(spark, "GZ99-1", lambda c: T.year_from_code(c, 2026)) == ""
