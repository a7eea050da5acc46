"""Sources and sinks: what is written is read back."""

from pyspark.sql import functions as F

from checks.base import Data, query
from tintshelf.operators.learn import PairModel
from tintshelf.operators.vectors import recall_sizes
from tintshelf.operators import textindex as H
from tintshelf.operators.numbering import checkpointed
from tintshelf.session import new_folder as work_folder
from tintshelf.sources import files as W
from tintshelf.sources import records as R


@query("read_labels", "SELECT doc_id || '.jpg' AS query_image, 'Q' || quality AS style_code FROM labels")
def _(d: Data):
    # One document per hundred labels, each with its list.
    folder = work_folder(d.spark) + "/labels"
    row = F.struct(F.concat("doc_id", F.lit(".jpg")).alias("query_image"), F.concat(F.lit(" Q"), "quality").alias("style_code"))
    blank = F.struct(F.lit("x.jpg").alias("query_image"), F.lit(" ").alias("style_code"))
    packed = d.table("labels").groupBy(F.expr("doc_id div 100").alias("g")).agg(F.collect_list(row).alias("labels"))
    packed.repartition(8).select(F.concat("labels", F.array(blank)).alias("labels")).write.option("maxRecordsPerFile", 1).json(folder)
    return R.read_labels(d.spark, folder)


@query("read_ground_truth", "SELECT doc_id || '.jpg' AS query_image, 'Q' || max(quality) AS style_code FROM labels GROUP BY doc_id")
def _(d):
    folder = work_folder(d.spark) + "/truth"
    one = d.table("labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    entry = F.struct(F.concat("doc_id", F.lit(".jpg")), F.concat(F.lit("Q"), "q"))
    packed = one.groupBy(F.expr("doc_id div 100").alias("g")).agg(F.map_from_entries(F.collect_list(entry)).alias("query_gt"))
    packed.repartition(8).select("query_gt").write.option("maxRecordsPerFile", 1).json(folder)
    return R.read_ground_truth(d.spark, folder)


@query("manifest_round_trip", "SELECT source_rel_path, 'I' || doc_id || '.jpg' AS image_name, lang || '|' || source AS tags FROM import_files")
def _(d):
    folder = work_folder(d.spark) + "/manifest"
    rows = d.table("documents").select(
        F.concat_ws("/", "lang", "source", F.concat("doc_id", F.lit(".jpg"))).alias("source_rel_path"), F.concat(F.lit("I"), "doc_id", F.lit(".jpg")).alias("image_name"),
        F.concat(F.lit("I"), "doc_id").alias("style_code"), F.array("lang", "source").alias("tags"),
    )
    R.write_manifest(rows, folder, "job-1")
    d.table("region").select(F.concat(F.lit("{broken "), "r_name").alias("value")).write.mode("append").text(folder)
    return R.read_manifest(d.spark, folder).select("source_rel_path", "image_name", F.array_join("tags", "|").alias("tags"))


@query("hash_index_round_trip", "SELECT sha256(text) AS hash, min('d' || lpad(doc_id::VARCHAR, 9, '0')) AS image_name FROM documents GROUP BY 1")
def _(d):
    folder = work_folder(d.spark) + "/hashes"
    R.write_hash_index(d.table("documents").select(F.sha2("text", 256).alias("hash"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("image_name")), folder)
    return R.read_hash_index(d.spark, folder)


@query("load_color_sheet", """SELECT p_name AS name, p_type AS note, (p_partkey * 37 % 61 + 20)::DOUBLE AS l, (p_partkey % 50)::DOUBLE AS a, (-p_size)::DOUBLE AS b,
    '400:' || p_size || CASE WHEN p_partkey % 4 <> 0 THEN '|410:' || (p_partkey % 90) ELSE '' END AS spectral FROM part WHERE p_size % 3 <> 0""")
def _(d):
    k = F.col("p_partkey")
    sheet = d.table("part").select(
        F.concat(F.lit(" "), "p_name").alias("名称"), F.col("p_type").alias("备注"), (k * 37 % 61 + 20).cast("string").alias("L"), (k % 50).cast("string").alias(" a"),
        F.when(F.col("p_size") % 3 == 0, F.lit("n/a")).otherwise((-F.col("p_size")).cast("string")).alias("b"),
        F.col("p_size").cast("string").alias("400nm"), F.when(k % 4 == 0, F.lit("-")).otherwise((k % 90).cast("string")).alias("410nm"),
    )
    point = F.transform("spectral", lambda p: F.concat_ws(":", p["wavelength"].cast("string"), p["value"].cast("int").cast("string")))
    return R.load_color_sheet(sheet).select("name", "note", "l", "a", "b", F.array_join(point, "|").alias("spectral"))


@query("features_round_trip", "SELECT image_name, style_code, len(embedding)::INT AS size FROM vectors")
def _(d):
    folder = work_folder(d.spark) + "/features"
    v = d.vectors().select("image_name", F.lit(0).alias("view"), "style_code", "embedding")
    R.write_features(v, folder, {"backend": "clip", "size": 64})
    R.write_features(v.limit(0), folder, {"backend": "hybrid", "size": 64})
    return R.read_features(d.spark, folder, {"size": 64, "backend": "clip"}).select("image_name", "style_code", F.size("embedding").alias("size"))


@query("text_index_round_trip", "SELECT token, df, image_name FROM postings JOIN token_idf USING (token)")
def _(d):
    folder = work_folder(d.spark) + "/index"
    postings = checkpointed(H.build_postings(d.docs()))  # read twice
    R.write_text_index(postings, H.token_idf(postings, d.table("documents").agg(F.count("*").alias("n"))), folder)
    read, idf = R.read_text_index(d.spark, folder)
    return read.join(idf, "token").select("token", "df", "image_name")


@query("changed_files", "SELECT source_rel_path AS image_name FROM import_files WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(d):
    name = F.concat_ws("/", "lang", "source", F.concat("doc_id", F.lit(".jpg")))
    now = d.table("documents").select("doc_id", name.alias("image_name"), F.col("n_chars").alias("size"), F.timestamp_seconds("doc_id").alias("modified"))
    touched = d.table("labels").filter("quality = 1").select("doc_id").distinct().withColumn("t", F.lit(1))
    before = now.join(touched, "doc_id", "left").withColumn("modified", F.col("modified") - F.expr("make_interval(0, 0, 0, 0, 0, 0, coalesce(t, 0))"))
    old = before.select(W.signature(F.col("image_name"), F.col("size"), F.col("modified")).alias("signature"))
    return W.changed_files(now, old).select("image_name")


def _image_files(d: Data) -> str:
    """Folder with one small image file per vector, every seventh named like an upload."""
    folder = work_folder(d.spark) + "/images"
    upload = F.concat(F.lit("MY-"), F.col("image_id").cast("string"), F.lit(".PNG"))
    name = F.when(F.col("image_id") % 7 == 0, upload).otherwise(F.concat(F.col("image_id").cast("string"), F.lit(".png")))
    W.write_images(d.pixels().withColumn("image_name", name), folder)
    return folder


@query("scan_images", "SELECT CASE WHEN vec_id % 7 = 0 THEN 'MY-' || vec_id || '.PNG' ELSE vec_id || '.png' END AS image_name, vec_id % 7 <> 0 AS in_catalog FROM embeddings")
def _(d):
    folder = _image_files(d)
    listed = W.scan_images(d.spark, folder).select("image_name")
    catalog = W.scan_images(d.spark, folder, variant="catalog").select("image_name", F.lit(True).alias("c"))
    return listed.join(catalog, "image_name", "left").select("image_name", F.coalesce("c", F.lit(False)).alias("in_catalog"))


@query("to_pixels", "SELECT image_id, y, x, r, g, b FROM pixels")
def _(d):
    pixels = W.to_pixels(W.read_images(d.spark, _image_files(d)))
    return pixels.withColumn("image_id", F.regexp_extract("image_id", r"(\d+)", 1).cast("bigint"))


@query("removed_files", """SELECT c_name || '.jpg' AS image_name, 'removed' AS kind FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_name || '.jpg', 'new' FROM customer WHERE c_custkey % 5 = 1""")
def _(d):
    """A fifth of the files is gone, another fifth was seen with other settings."""
    c = d.table("customer").select("c_custkey", F.concat("c_name", F.lit(".jpg")).alias("image_name"), F.lit(7).alias("size"), F.timestamp_seconds("c_custkey").alias("modified"))
    seen = c.select(W.signature(F.col("image_name"), F.col("size"), F.col("modified")).alias("signature"), F.when(F.col("c_custkey") % 5 == 1, "old").otherwise("now").alias("settings_key"))
    here = c.filter("c_custkey % 5 <> 0").drop("c_custkey")
    gone = W.removed_files(here, seen).withColumn("kind", F.lit("removed"))
    return gone.unionByName(W.changed_files(here, seen, "now").select("image_name", F.lit("new").alias("kind")))


@query("model_round_trip", "SELECT (i - 1)::INT AS i, round(avg(embedding[i]::DOUBLE), 6) AS weight FROM embeddings, generate_series(1, 10) g(i) GROUP BY i")
def _(d):
    """A model whose weights are means over the vectors, stored and loaded again."""
    folder = work_folder(d.spark) + "/model"
    means = d.vectors().agg(*[F.avg(F.get("embedding", F.lit(i))).alias(f"w{i}") for i in range(10)]).first()
    R.save_model(d.spark, PairModel(tuple(means), 0.0, (0.0,) * 10, (1.0,) * 10), folder)
    weights = R.load_model(d.spark, folder).weights
    return d.spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "i int, weight double").withColumn("weight", F.round("weight", 6))


@query("report_round_trip", "SELECT count(*) AS samples, round(avg(toxic), 9) AS pos_rate, round(avg((quality = toxic)::INT), 9) AS train_acc FROM labels")
def _(d):
    folder = work_folder(d.spark) + "/report"
    acc = F.avg((F.col("quality") == F.col("toxic")).cast("int"))
    R.write_training_report(d.table("labels").agg(F.count("*").alias("samples"), F.avg("toxic").alias("pos_rate"), acc.alias("train_acc")), folder, {"table": "labels"})
    return R.read_training_report(d.spark, folder).select("metrics.*").withColumns({c: F.round(c, 9) for c in ("pos_rate", "train_acc")})


@query("recall_size", """SELECT k::INT AS k, cap::INT AS cap, least(least(n, k * 30), CASE WHEN cap > 0 THEN cap ELSE n END)::BIGINT AS size
    FROM (SELECT count(*) AS n FROM embeddings), (SELECT DISTINCT p_size AS k FROM part), (SELECT unnest([0, 512]) AS cap)""")
def _(d):
    """How many images to recall for as many codes as a part size says (at most some dozens of sizes)."""
    n = d.table("embeddings").agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    sizes = d.table("part").select(F.col("p_size").cast("int").alias("k"), F.explode(F.array(F.lit(0), F.lit(512))).alias("cap"), F.lit(1).alias("one")).distinct()
    return sizes.join(F.broadcast(n), "one").select("k", "cap", recall_sizes(F.col("k"), 30, F.col("cap"), F.col("n")).alias("size"))
