import pytest

#: Names that the operators use inside; a caller may have columns of any of them.
CLASHING = ["th", "h", "w", "cls", "key", "band", "at", "all", "l", "ids", "n_tokens", "lang_pred", "score", "n_removed", "file", "ordinal", "label_", "v", "c", "a", "b", "grp", "rep"]


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text) rows as a frame with many further columns."""
    from pyspark.sql import functions as F

    def make(rows, schema="doc_id bigint, text string"):
        names = [x.split()[0] for x in schema.split(",")]
        df = spark.createDataFrame(rows, schema)
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in names])

    return make


@pytest.fixture(scope="session")
def same_rows():
    """Compare a frame with a SQL result over the given tables, rows in any order."""
    import duckdb

    def check(df, sql, tables):
        con = duckdb.connect()
        for name, frame in tables.items():
            con.register(f"_{name}", frame.toPandas().astype(object).where(lambda x: x.notna(), None) if not frame.isEmpty() else frame.toPandas())
            kinds = {"bigint": "BIGINT", "int": "INT", "string": "VARCHAR", "array<float>": "FLOAT[]", "array<double>": "DOUBLE[]"}
            cols = ", ".join(f'"{c}"::{kinds[t]} AS "{c}"' for c, t in frame.dtypes)
            con.execute(f"CREATE VIEW {name} AS SELECT {cols} FROM _{name}")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        norm = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)
        assert sorted(df.columns) == sorted(names)
        assert norm(tuple(r[c] for c in names) for r in df.collect()) == norm(cur.fetchall())

    return check
