"""Folder import over the documents: each is a photo with its text as recognised text and as content."""

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.base import Data, query
from tintshelf.operators import imports as I
from tintshelf.operators.catalog import Catalog
from tintshelf.operators.numbering import checkpointed
from tintshelf.plans.flows import folder_import
from tintshelf.session import new_folder as work_folder
from tintshelf.sources.featurestore import FeatureStore

_MARK = "coalesce(hashed, '')"
_NAMED = "(doc_id || '')"

# Proposals: the text cascade first, then the file name (three or four digits make a number code).
PROPOSED = f"""texts AS (SELECT doc_id, text, {S.hash_code('text')} AS hashed, {S.before_hash('text', 'first')} AS lined FROM documents),
    {S.style_code_cte('documents', 'doc_id')},
    votes AS (SELECT doc_id, CASE WHEN {S.effective(_MARK, 'first')} THEN hashed END AS a, nullif(coalesce(code, ''), '') AS b, nullif(lined, '') AS c,
      CASE WHEN length({_NAMED}) IN (3, 4) THEN {_NAMED} END AS n FROM texts JOIN coded USING (doc_id)),
    found AS (SELECT f.*, coalesce({{order}}, '') AS found_code, CASE {{sources}} ELSE '' END AS found_source FROM import_files f JOIN votes USING (doc_id)),
    cleaned AS (SELECT *, {S.clean('found_code', 'first')} AS proposed_style_code FROM found),
    proposed AS (SELECT *, CASE WHEN regexp_matches(proposed_style_code, '^[A-Z0-9][A-Z0-9_-]{{{{2,}}}}$') THEN 'ok' WHEN found_code <> '' THEN 'invalid_style_code' ELSE 'ocr_failed' END AS status,
      CASE WHEN found_code = '' THEN {_NAMED} ELSE coalesce(nullif({S.safe(S.rep(S.rep('found_code', '(?s)[#＃].*$'), '[*+]+', '-'))}, ''), 'UNKNOWN') END AS prefix FROM cleaned)"""
_ORDERS = {
    "text_first": ("a, b, c, n", "WHEN a IS NOT NULL THEN 'normal' WHEN b IS NOT NULL THEN 'prefixed_fallback' WHEN c IS NOT NULL THEN 'hash_prefix' WHEN n IS NOT NULL THEN 'filename'"),
    "filename_first": ("n, a, b, c", "WHEN n IS NOT NULL THEN 'filename' WHEN a IS NOT NULL THEN 'normal' WHEN b IS NOT NULL THEN 'prefixed_fallback' WHEN c IS NOT NULL THEN 'hash_prefix'"),
}


def proposed(mode: str) -> str:
    order, sources = _ORDERS[mode]
    return PROPOSED.replace("{order}", order).replace("{sources}", sources).replace("{{2,}}", "{2,}")


NAMED = """used AS (SELECT lower(doc_id::VARCHAR) AS fold, max(n) + 1 AS start FROM existing_names GROUP BY ALL),
    numbered AS (SELECT p.*, coalesce(start, 0) + row_number() OVER (PARTITION BY lower(prefix) ORDER BY source_rel_path) - 1 AS n FROM proposed p LEFT JOIN used ON fold = lower(prefix)),
    allocated AS (SELECT *, prefix || '_' || CASE WHEN n < 1000 THEN printf('%03d', n) ELSE n::VARCHAR END || '.jpg' AS proposed_filename, sha256(text) AS hash FROM numbered)"""
KEPT = """kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY source_rel_path) AS nth FROM allocated WHERE status = 'ok')
      WHERE nth = 1 AND hash NOT IN (SELECT hash FROM hash_index)),
    manifest AS (SELECT source_rel_path, proposed_filename AS image_name, regexp_replace(regexp_replace(regexp_replace(proposed_filename, '[.][^.]+$', ''), '(_[0-9]{3})+$', ''), '_[^_]*$', '') AS style_code,
      'year:2024|category:' || lang || '|subcategory:' || source AS tags FROM kept)"""
FLOW = f"WITH {proposed('text_first')}, {NAMED}, {KEPT}"


def _hashed(d: Data):
    return I.with_content_hash(d.import_files()).drop("content")


def _propose(d, mode):
    return I.propose_codes(_hashed(d), mode).select(
        "source_rel_path", "proposed_style_code", "prefix", "status", "source", F.array_join("tags", "|").alias("tags")
    )


_COLUMNS = "source_rel_path, proposed_style_code, prefix, status, found_source AS source, 'year:2024|category:' || lang || '|subcategory:' || source AS tags"


@query("propose_codes", f"WITH {proposed('text_first')} SELECT {_COLUMNS} FROM proposed")
def _(d):
    return _propose(d, "text_first")


@query("propose_codes_filename_first", f"WITH {proposed('filename_first')} SELECT {_COLUMNS} FROM proposed")
def _(d):
    return _propose(d, "filename_first")


@query("allocate_names", f"WITH {proposed('text_first')}, {NAMED} SELECT source_rel_path, proposed_filename FROM allocated")
def _(d):
    named = I.allocate_names(I.propose_codes(_hashed(d)), d.existing_names())
    return named.select("source_rel_path", "proposed_filename")


@query("dedup_by_content", """SELECT sha256(text) AS hash, min(source_rel_path) AS source_rel_path FROM import_files
    GROUP BY 1 HAVING sha256(text) NOT IN (SELECT hash FROM hash_index)""".replace("HAVING sha256(text)", "HAVING sha256(any_value(text))"))
def _(d):
    files = _hashed(d).select("hash", F.expr("substring(path, length(root) + 2)").alias("source_rel_path"))
    return I.dedup_by_content(files, d.hash_index())


@query("import_manifest", f"{FLOW} SELECT source_rel_path, image_name, style_code, tags FROM manifest")
def _(d):
    manifest, _summary = folder_import(d.import_files(), d.existing_names(), d.hash_index())
    return manifest.select("source_rel_path", "image_name", "style_code", F.array_join("tags", "|").alias("tags"))


@query("import_summary", f"""{FLOW} SELECT (SELECT count(*) FROM manifest) AS imported,
    (SELECT count(*) FROM allocated WHERE status = 'ok') - (SELECT count(*) FROM manifest) AS duplicates, (SELECT count(*) FROM allocated WHERE status <> 'ok') AS failed""")
def _(d):
    return folder_import(d.import_files(), d.existing_names(), d.hash_index())[1]


@query("apply_manifest", f"""{FLOW}, added AS (SELECT DISTINCT style_code, unnest(string_split(tags, '|')) AS tag FROM manifest WHERE style_code <> '')
    SELECT style_code, tag FROM product_tags UNION SELECT style_code, tag FROM added""")
def _(d):
    manifest, _summary = folder_import(d.import_files(), d.existing_names(), d.hash_index())
    return I.apply_manifest(d.catalog(), manifest)[0].product_tags


@query("scan_progress", """WITH o AS (SELECT lang, doc_id, source, CASE WHEN n_chars % 7 = 0 THEN 'renamed' WHEN n_chars % 5 = 0 THEN 'failed' ELSE 'success' END AS outcome,
      lpad(doc_id::VARCHAR, 9, '0') AS path FROM documents),
    r AS (SELECT *, row_number() OVER w AS processed, sum((outcome = 'success')::INT) OVER w AS success, sum((outcome = 'failed')::INT) OVER w AS failed FROM o WHERE outcome <> 'renamed'
      WINDOW w AS (PARTITION BY lang ORDER BY path)),
    t AS (SELECT lang, sum((outcome <> 'renamed')::INT) AS total, sum((outcome = 'renamed')::INT) AS already_renamed FROM o GROUP BY lang)
    SELECT lang AS job_id, processed, total::BIGINT AS total, success::BIGINT AS success, failed::BIGINT AS failed, already_renamed::BIGINT AS already_renamed FROM r JOIN t USING (lang)
    WHERE processed = 1 OR processed % 50 = 0 OR processed = total""")
def _(d):
    n = F.col("n_chars")
    outcome = F.when(n % 7 == 0, "renamed").when(n % 5 == 0, "failed").otherwise("success")
    files = d.table("documents").select(
        F.col("lang").alias("job_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("source_rel_path"), outcome.alias("outcome")
    )
    return I.scan_progress(files)


#: Buckets of the feature store; small tables then leave some untouched.
FEATURE_BUCKETS = 1024


@query("nightly_features", f"""WITH was AS (SELECT image_name, 1000 + vec_id AS size, embedding[1] AS first FROM vectors),
    now AS (SELECT image_name, size + (vec_id % 50 = 2)::INT AS size, first FROM was JOIN vectors USING (image_name) WHERE vec_id % 50 <> 1
      UNION ALL SELECT 'NEW-' || image_name, 1000 + vec_id, embedding[1] FROM vectors WHERE vec_id % 50 = 3),
    f AS (SELECT image_name, now.size, now.first, CASE WHEN now.size IS NULL THEN 'removed' WHEN was.size IS NULL THEN 'added' WHEN was.size <> now.size THEN 'changed' ELSE 'kept' END AS action,
        ('0x' || substr(md5(image_name), 1, 7))::BIGINT % {FEATURE_BUCKETS} AS bucket FROM was FULL JOIN now USING (image_name))
    SELECT image_name, action, round(first + size, 6) AS feature, CASE WHEN action = 'removed' THEN NULL ELSE bucket NOT IN (SELECT bucket FROM f WHERE action <> 'kept') END AS same_file,
      (SELECT count(DISTINCT image_name) FROM now) AS images_in_catalog FROM f""")
def _(d):
    """Two nights over all images: the second adds, changes and removes some; files of untouched buckets stay the same."""
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    v = checkpointed(d.vectors().select("vec_id", "style_code", "image_name", F.col("embedding")[0].alias("first")))
    n, listed = F.col("vec_id") % 50, ["image_name", "style_code", "first", "size", "modified"]
    was = v.withColumns({"size": 1000 + F.col("vec_id"), "modified": at})
    new = was.filter(n == 3).withColumn("image_name", F.concat(F.lit("NEW-"), "image_name"))
    now = checkpointed(was.filter(n != 1).withColumn("size", F.col("size") + (n == 2).cast("int")).select(*listed).unionByName(new.select(*listed)))

    def compute(todo):
        made = now.unionByName(was.filter(n == 1).select(*listed))
        size = F.split("signature", r"\|")[1].cast("double")
        return made.drop("size").join(todo, "image_name").withColumn("embedding", F.array(F.col("first") + size))

    store = FeatureStore(d.spark, work_folder(d.spark), {"backend": "clip"}, buckets=FEATURE_BUCKETS)
    store.refresh(was.select(*listed), compute, "night 1")
    manifest = now.select("image_name", "style_code", F.array(F.lit("year:2024")).alias("tags"))
    empty = d.catalog()
    catalog, _, found = I.nightly_follow_up(Catalog(*[getattr(empty, t).limit(0) for t in ("products", "images", "tags", "product_tags")]), manifest, store, now, compute, "night 2")
    store.refresh(now, compute, "night 2")  # a repeated night changes nothing
    before = store.rows.read("features", version=1).select("image_name", F.col("_file").alias("_before"))
    after = store.rows.read("features").select("image_name", "_file", F.round(F.col("embedding")[0], 6).alias("feature"))
    rows = found.select("image_name", "action").join(before, "image_name", "left").join(after, "image_name", "left")
    same = F.when(F.col("action") != "removed", F.coalesce(F.col("_before") == F.col("_file"), F.lit(False)))
    count = catalog.images.agg(F.count_distinct("image_name").alias("images_in_catalog"), F.lit(1).alias("one"))
    return rows.select("image_name", "action", "feature", same.alias("same_file"), F.lit(1).alias("one")).join(F.broadcast(count), "one").drop("one")
