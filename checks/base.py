"""Registry, table access and the views shared by queries and SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintshelf.functions import text as T
from tintshelf.operators.catalog import Catalog
from tintshelf.operators.colorcards import CardStore
from tintshelf.session import spread_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(data)`` under ``name``; ``sql`` may use the views below by name."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


class Data:
    """The driver tables of one folder and the views built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- vectors -----------------------------------------------------------------------------------------
    def vectors(self) -> DataFrame:
        code = F.format_string("GZ%02d-%04d", F.col("label") + 20, F.expr("cast((vec_id div 5) % 10 as int)"))
        v = self.table("embeddings").withColumn("style_code", code)
        name = F.concat("style_code", F.lit("_"), F.col("vec_id").cast("string"), F.lit(".jpg"))
        return v.select("vec_id", "style_code", name.alias("image_name"), F.col("embedding").cast("array<double>").alias("embedding"))

    def queries(self) -> DataFrame:
        return self.vectors().select(F.col("vec_id").alias("query_id"), "embedding")

    def images(self) -> DataFrame:
        return self.vectors().select("image_name", "embedding")

    def view_queries(self) -> DataFrame:
        """Four views per vector; view v has coordinates 16v .. 16v+15 set to 0, view 0 is the whole vector."""
        v = self.queries().withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(3))))
        masked = F.transform(
            "embedding",
            lambda x, i: F.when((F.col("view") > 0) & (F.floor(i / 16) == F.col("view")), F.lit(0.0)).otherwise(x),
        )
        return v.select("query_id", "view", masked.alias("embedding"))

    def modal(self) -> DataFrame:
        parts = [F.slice("embedding", 16 * i + 1, 16).alias(n) for i, n in enumerate(("clip", "shape", "color", "stripe"))]
        return self.vectors().select("vec_id", "image_name", "style_code", "embedding", *parts)

    # -- catalog -----------------------------------------------------------------------------------------
    def parts(self) -> DataFrame:
        code = F.format_string("GZ%02d-%04d", F.expr("10 + p_size % 20"), F.col("p_partkey"))
        return self.table("part").withColumn("style_code", code)

    def catalog(self) -> Catalog:
        p = self.parts()
        products = p.select("style_code", F.lit("").alias("cover_image"), F.col("p_name").alias("note"))
        lines = self.table("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
        name = F.format_string("%s_%d_%03d.jpg", "style_code", "l_orderkey", "l_linenumber")
        images = lines.select("style_code", name.alias("image_name"), F.col("l_linenumber").alias("sort_order")).distinct()
        year = F.when(F.col("p_partkey") % 2 == 0, (F.lit(2000) + F.col("p_size") % 30).cast("string"))
        owner = F.when(F.col("p_partkey") % 17 == 0, F.concat(F.lit("owner:u"), (F.col("p_partkey") % 5).cast("string")))
        tags = F.array(F.concat(F.lit("category:"), "p_type"), F.concat(F.lit("subcategory:"), "p_brand"), year, owner)
        product_tags = p.select("style_code", F.explode(tags).alias("tag")).filter("tag IS NOT NULL")
        extra = self.table("nation").select(F.col("n_name").alias("name"))
        tag_names = product_tags.select(F.col("tag").alias("name")).union(extra).distinct()
        return Catalog(products, images, tag_names, product_tags)

    def tag_requests(self) -> DataFrame:
        """One request per product: its brand as subcategory, its name as a free tag, the size as a year."""
        tags = F.array(
            F.concat(F.lit(" subcategory:new "), "p_brand"), F.col("p_name"),
            F.concat(F.lit("year:20"), F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")), F.col("p_name"), F.lit(" "),
        )
        return self.parts().select("style_code", tags.alias("tags"))

    # -- colours -----------------------------------------------------------------------------------------
    def cards(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            T.library_id(F.col("p_brand")).alias("library_id"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"),
            F.col("p_type").alias("note"), F.lit("D65").alias("illuminant"), F.lit(10.0).alias("angle"),
            (k * 37 % 61 + 20).cast("double").alias("l"), (k * 53 % 161 - 80).cast("double").alias("a"),
            (k * 71 % 161 - 80).cast("double").alias("b"), F.lpad(F.hex(k), 6, "0").alias("hex"), k.alias("card_key"),
        )

    def store(self) -> CardStore:
        brands = self.table("part").select("p_brand").distinct()
        libraries = brands.select(
            T.library_id(F.col("p_brand")).alias("id"), F.col("p_brand").alias("name"), F.lit("parts").alias("source_file"),
            F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("sort_order"),
        )
        cards = self.cards()
        n = self.table("part").agg(F.count("*").alias("n"), F.lit(1).alias("one"))
        bought = self.table("events").filter("event_type = 'purchase'").withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
        bought = bought.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_tag"), F.expr("event_id % n").alias("card_key"))
        favorites = bought.agg(F.max("ts").alias("created_at")).join(cards.select("card_key", "library_id", "name"), "card_key")
        return CardStore(libraries, cards.drop("card_key"), favorites.select("user_tag", "library_id", "name", "created_at"))

    def readings(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            e.alias("reading_id"), F.col("user_id").alias("device_id"), "ts", (F.col("value") % 60 + 20).alias("l"),
            (e % 161 - 80).cast("double").alias("a"), (e * 7 % 161 - 80).cast("double").alias("b"),
        )

    # -- texts and files -----------------------------------------------------------------------------------
    def code_texts(self) -> DataFrame:
        two = F.lpad(F.col("p_size").cast("string"), 2, "0")
        three = F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
        forms = [
            F.concat("p_name", F.lit(" "), "style_code", F.lit("# x")),
            F.concat(F.lit("ＫＦ"), two, F.lit("-"), three, F.lit("\n"), "p_name"),
            F.concat(F.lit("K  F "), two, F.lit("-"), three, F.lit(" "), "p_name"),
            F.concat("p_name", F.lit(" j0a"), two, F.lit("_"), three),
            F.concat("p_name", F.lit("\n "), three, F.lit("＃ small")),
            F.concat(F.lit("ke"), two, three, F.lit("*1+\n"), "p_type"),
        ]
        p = spread_scan(self.parts()).select("p_partkey", F.posexplode(F.array(*forms)).alias("form", "text"))
        parts = p.select(F.concat(F.lit("p"), "p_partkey", F.lit("/"), "form").alias("text_id"), "text")
        talks = spread_scan(self.table("conversations").select("conv_id", "turn", "text")).select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("text_id"), "text")
        return parts.unionByName(talks)

    def import_files(self) -> DataFrame:
        path = F.concat(F.lit("/shop/2024/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
        return self.table("documents").select(F.lit("/shop/2024").alias("root"), path.alias("path"), "text", F.col("text").alias("content"))

    def existing_names(self) -> DataFrame:
        n = F.lpad((F.col("quality") * 30 + F.col("toxic")).cast("string"), 3, "0")
        return self.table("labels").select(F.concat("doc_id", F.lit("_"), n, F.lit(".jpg")).alias("image_name"))

    def hash_index(self) -> DataFrame:
        known = self.table("labels").filter("toxic = 1").select("doc_id").distinct()
        return self.table("documents").join(known, "doc_id").select(F.sha2("text", 256).alias("hash")).distinct()

    def docs(self) -> DataFrame:
        return self.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("image_name"), "text")

    # -- pixels and measures -------------------------------------------------------------------------------
    def pixels(self) -> DataFrame:
        """Each embedding as an 8 x 8 image."""
        p = spread_scan(self.table("embeddings").select("vec_id", "embedding")).select("vec_id", F.posexplode("embedding").alias("i", "v"))
        v = F.col("v").cast("double") * 240

        def level(c):
            return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(c).cast("int")))

        return p.select(
            F.col("vec_id").alias("image_id"), F.expr("cast(i div 8 as int)").alias("y"), (F.col("i") % 8).alias("x"),
            level(v + 128).alias("r"), level(-v + 128).alias("g"),
            F.expr("cast((vec_id * 13 + i * 29) % 256 as int)").alias("b"),
        )

    def measure_events(self) -> DataFrame:
        names = ["bodyLength", "shoulderWidth", "chestWidth", "hemWidth", "leftSleeveLength", "rightSleeveLength", "neckWidth"]
        name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 7 + 1).cast("int"))
        payload = F.to_json(F.create_map(name, F.round("value", 2)))
        return self.table("events").select(F.col("user_id").alias("garment_id"), "ts", payload.alias("payload"))


# The same views in SQL. ``with_views`` puts the ones a statement names, and what they need, in front of it.
VIEWS: dict[str, str] = {
    "vectors": """SELECT vec_id, printf('GZ%02d-%04d', 20 + label, (vec_id // 5) % 10) AS style_code,
        printf('GZ%02d-%04d', 20 + label, (vec_id // 5) % 10) || '_' || vec_id || '.jpg' AS image_name,
        embedding::DOUBLE[] AS embedding FROM embeddings""",
    "sims": """SELECT q.vec_id AS query_id, q.style_code AS query_code, c.image_name, c.style_code, c.vec_id,
        round(list_dot_product(q.embedding, c.embedding), 12) AS score FROM vectors q, vectors c""",
    "modal": """SELECT vec_id, image_name, style_code, embedding[1:16] AS clip, embedding[17:32] AS shape,
        embedding[33:48] AS color, embedding[49:64] AS stripe FROM vectors""",
    "view_queries": """SELECT vec_id AS query_id, view, list_transform(generate_series(1, 64),
        lambda i: CASE WHEN view > 0 AND (i - 1) // 16 = view THEN 0.0 ELSE embedding[i] END) AS embedding
        FROM vectors, generate_series(0, 3) g(view)""",
    "recalled": """SELECT query_id, image_name, style_code, score FROM (SELECT *, row_number() OVER
        (PARTITION BY query_id ORDER BY score DESC, image_name) AS rn FROM sims) WHERE rn <= 90""",
    "code_scores": """SELECT query_id, style_code, max(CASE WHEN rn = 1 THEN image_name END) AS best_image,
        0.7 * max(score) + 0.3 * avg(score) AS raw_score FROM (SELECT *, row_number() OVER
        (PARTITION BY query_id, style_code ORDER BY score DESC, image_name) AS rn FROM recalled)
        WHERE rn <= 3 GROUP BY query_id, style_code""",
    "parts": "SELECT *, printf('GZ%02d-%04d', 10 + p_size % 20, p_partkey) AS style_code FROM part",
    "products": "SELECT style_code, '' AS cover_image, p_name AS note FROM parts",
    "product_images": """SELECT DISTINCT style_code, printf('%s_%d_%03d.jpg', style_code, l_orderkey, l_linenumber) AS image_name,
        l_linenumber AS sort_order FROM lineitem JOIN parts ON l_partkey = p_partkey""",
    "product_tags": """SELECT style_code, 'category:' || p_type AS tag FROM parts
        UNION ALL SELECT style_code, 'subcategory:' || p_brand FROM parts
        UNION ALL SELECT style_code, (2000 + p_size % 30)::VARCHAR FROM parts WHERE p_partkey % 2 = 0
        UNION ALL SELECT style_code, 'owner:u' || (p_partkey % 5) FROM parts WHERE p_partkey % 17 = 0""",
    "tag_names": "SELECT tag AS name FROM product_tags UNION SELECT n_name FROM nation",
    "tag_requests": """SELECT DISTINCT style_code, trim(unnest([' subcategory:new ' || p_brand, p_name,
        'year:20' || lpad((p_size % 100)::VARCHAR, 2, '0')])) AS tag FROM parts""",
    "cards": """SELECT lower(replace(p_brand, '#', '_')) AS library_id, p_name || ' ' || p_partkey AS name, p_type AS note,
        'D65' AS illuminant, 10.0::DOUBLE AS angle, (p_partkey * 37 % 61 + 20)::DOUBLE AS l, (p_partkey * 53 % 161 - 80)::DOUBLE AS a,
        (p_partkey * 71 % 161 - 80)::DOUBLE AS b, lpad(hex(p_partkey), 6, '0') AS hex, p_partkey AS card_key FROM part""",
    "libraries": """SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS id, p_brand AS name, 'parts' AS source_file,
        regexp_extract(p_brand, '(\\d+)', 1)::INT AS sort_order FROM part""",
    "favorites": """SELECT user_tag, library_id, name, created_at FROM (SELECT 'u' || user_id AS user_tag,
        event_id % (SELECT count(*) FROM part) AS card_key, max(ts) AS created_at FROM events WHERE event_type = 'purchase'
        GROUP BY ALL) JOIN cards USING (card_key)""",
    "readings": """SELECT event_id AS reading_id, user_id AS device_id, ts, value % 60 + 20 AS l,
        (event_id % 161 - 80)::DOUBLE AS a, (event_id * 7 % 161 - 80)::DOUBLE AS b FROM events""",
    "code_texts": """SELECT 'p' || p_partkey || '/' || form AS text_id, CASE form
          WHEN 0 THEN p_name || ' ' || style_code || '# x'
          WHEN 1 THEN 'ＫＦ' || two || '-' || three || chr(10) || p_name
          WHEN 2 THEN 'K  F ' || two || '-' || three || ' ' || p_name
          WHEN 3 THEN p_name || ' j0a' || two || '_' || three
          WHEN 4 THEN p_name || chr(10) || ' ' || three || '＃ small'
          ELSE 'ke' || two || three || '*1+' || chr(10) || p_type END AS text
        FROM (SELECT *, lpad(p_size::VARCHAR, 2, '0') AS two, lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS three FROM parts),
          generate_series(0, 5) g(form)
        UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations""",
    "import_files": """SELECT '/shop/2024' AS root, '/shop/2024/' || lang || '/' || source || '/' || doc_id || '.jpg' AS path,
        lang || '/' || source || '/' || doc_id || '.jpg' AS source_rel_path, doc_id, lang, source, text FROM documents""",
    "existing_names": "SELECT doc_id || '_' || lpad((quality * 30 + toxic)::VARCHAR, 3, '0') || '.jpg' AS image_name, doc_id, quality * 30 + toxic AS n FROM labels",
    "hash_index": "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "pixels": """SELECT vec_id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x,
        greatest(0, least(255, round_even(128 + 240 * v, 0)::INT)) AS r, greatest(0, least(255, round_even(128 - 240 * v, 0)::INT)) AS g,
        ((vec_id * 13 + i * 29) % 256)::INT AS b FROM (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v
        FROM embeddings, generate_series(0, 63) g(i))""",
    "postings": """SELECT DISTINCT image_name, token FROM (SELECT 'd' || doc_id AS image_name,
        unnest(list_transform(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z0-9]{4,}'),
          lambda t: regexp_replace(t, '^[0-9]+|[0-9]+$', '', 'g'))) AS token FROM documents)
        WHERE length(token) >= 4 AND regexp_matches(token, '[A-Z]')""",
    "token_idf": "SELECT token, count(*) AS df, ln(1.0 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM postings GROUP BY token",
}


def with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    start = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
    joiner = ",\n" + body[len(start):].lstrip() if body.upper().startswith(start) else "\n" + body
    return f"{start}{ctes}{joiner}"
