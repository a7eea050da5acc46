"""String functions over product names, file names, texts, tags and URLs."""

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.base import Data, query
from tintshelf.functions import text as T

NAMES = "SELECT DISTINCT image_name FROM product_images"


def _names(d: Data):
    return d.catalog().images.select("image_name")


@query("style_code_catalog", rf"""SELECT image_name, {S.rep(S.rep(S.stem('image_name'), '(?:_[0-9]{3})+$'), '_[^_]*$')} AS code FROM product_images""")
def _(d):
    return _names(d).select("image_name", T.style_code_catalog(F.col("image_name")).alias("code"))


@query("style_code_search", rf"""SELECT image_name, {S.rep(S.stem("split_part(image_name || '@c1', '@', 1)"), '_[^_]*$')} AS code FROM product_images""")
def _(d):
    name = F.concat("image_name", F.lit("@c1"))
    return _names(d).select("image_name", T.style_code_search(name).alias("code"))


@query("normalize_code", f"SELECT text_id, {S.rep(S.rep(S.upper(S.strip('text')), '#$'), '[^A-Za-z0-9_-]+')} AS code FROM code_texts")
def _(d):
    return d.code_texts().select("text_id", T.normalize_code(F.col("text")).alias("code"))


@query("clean_code", f"SELECT text_id, {S.clean('text')} AS trailing, {S.clean('text', 'first')} AS first FROM code_texts")
def _(d):
    c = F.col("text")
    return d.code_texts().select("text_id", T.clean_code(c).alias("trailing"), T.clean_code(c, "first").alias("first"))


_A = S.clean("text")
_F = S.clean("text", "first")


@query("code_predicates", rf"""SELECT text_id, {S.matches(_A, '^[A-Z][A-Z0-9_-]{2,}$')} AS alpha,
    {S.matches(_F, '^[0-9]{3,4}(-[0-9]{1,2})?$')} AS numeric_hash, {S.matches(_F, S.EFFECTIVE)} AS effective,
    {S.matches(_F, '^[A-Z0-9][A-Z0-9_-]{2,}$')} AS any_code FROM code_texts""".replace("{2,}", "{2,}"))
def _(d):
    c = F.col("text")
    return d.code_texts().select(
        "text_id", T.is_alpha_code(c).alias("alpha"), T.is_numeric_hash_code(c, "first").alias("numeric_hash"),
        T.is_effective_code(c, "first").alias("effective"), T.is_any_code(c).alias("any_code"),
    )


@query("extract_hash_code", f"SELECT text_id, {S.hash_code('text')} AS code FROM code_texts")
def _(d):
    return d.code_texts().select("text_id", T.extract_hash_code(F.col("text")).alias("code"))


@query("extract_style_code", f"WITH {S.style_code_cte('code_texts', 'text_id')} SELECT text_id, coalesce(code || '#', '') AS code FROM coded")
def _(d):
    return d.code_texts().select("text_id", T.extract_style_code(F.col("text")).alias("code"))


@query("code_before_hash", f"SELECT text_id, {S.before_hash('text')} AS code FROM code_texts")
def _(d):
    return d.code_texts().select("text_id", T.code_before_hash(F.col("text")).alias("code"))


_NAME = "(replace(text, chr(10), ' ') || ' (3).jpg')"
_BASE, _STD, _NAS = S.filename_parts("name")


@query("code_from_filename", f"""WITH named AS (SELECT text_id, {_NAME} AS name FROM code_texts),
    found AS (SELECT text_id, {S.before_hash(_STD)} AS sh, {S.plain(_STD, 'trailing')} AS sp,
      {S.before_hash(_BASE, 'first')} AS nh, {S.plain(_NAS, 'first')} AS np FROM named)
    SELECT text_id, CASE WHEN sh <> '' THEN sh ELSE sp END AS standard, CASE WHEN nh <> '' THEN nh ELSE np END AS nas,
      CASE WHEN nh <> '' THEN 'filename_hash' WHEN np <> '' THEN 'filename' ELSE '' END AS source FROM found""")
def _(d):
    name = F.concat(F.translate("text", "\n", " "), F.lit(" (3).jpg"))
    nas = T.code_from_filename(name, "nas")
    return d.code_texts().select(
        "text_id", T.code_from_filename(name)["code"].alias("standard"), nas["code"].alias("nas"), nas["source"].alias("source")
    )


_ANY = "^[A-Z0-9][A-Z0-9_-]{2,}$"


@query("code_from_label_lines", f"""SELECT text_id, coalesce(
    list_filter(list_transform(regexp_split_to_array(text, '{S.BREAK}'), lambda s: {S.clean('s', 'first')}), lambda c: {S.matches('c', _ANY)})[1],
    CASE WHEN {S.matches(_F, _ANY)} THEN {_F} END, '') AS code FROM code_texts""")
def _(d):
    return d.code_texts().select("text_id", T.code_from_label_lines(F.col("text")).alias("code"))


_PRE = S.safe(S.rep("text", "#$"))
_PRE_NAS = S.safe(S.rep(S.rep("text", "(?s)[#＃].*$"), "[*+]+", "-"))


@query("filename_prefix", f"""SELECT text_id, CASE WHEN {_PRE} = '' THEN 'UNKNOWN' ELSE {_PRE} END AS standard,
    CASE WHEN {_PRE_NAS} = '' THEN 'UNKNOWN' ELSE {_PRE_NAS} END AS nas FROM code_texts""")
def _(d):
    c = F.col("text")
    return d.code_texts().select("text_id", T.filename_prefix(c).alias("standard"), T.filename_prefix(c, "nas").alias("nas"))


_FILE = "translate(text_id || ' ' || split_part(text, chr(10), 1) || '.PNG', chr(92), '/')"
_FSTEM = S.safe(S.stem(_FILE))


@query("sanitize_filename", f"SELECT text_id, CASE WHEN {_FSTEM} = '' THEN 'UNKNOWN' ELSE {_FSTEM} END || '.png' AS name FROM code_texts")
def _(d):
    name = F.concat("text_id", F.lit(" "), F.substring_index("text", "\n", 1), F.lit(".PNG"))
    return d.code_texts().select("text_id", T.sanitize_filename(name).alias("name"))


@query("sort_order_of", rf"""SELECT image_name, coalesce(try_cast(regexp_extract({S.stem('image_name')}, '_([0-9]+)$', 1) AS BIGINT), 0) AS n FROM product_images""")
def _(d):
    return _names(d).select("image_name", T.sort_order_of(F.col("image_name")).alias("n"))


_RSTEM = S.strip(S.stem("name"))


@query("is_already_renamed", rf"""WITH named AS (SELECT text_id, replace(replace(text, chr(10), ' '), '# x', '_000') || '.jpg' AS name FROM code_texts),
    f AS (SELECT text_id, {_RSTEM} AS stem, {S.before_hash(_STD)} AS h, {S.plain(_STD, 'trailing')} AS p FROM named)
    SELECT text_id, regexp_matches(stem, '_[0-9]+$') AND CASE WHEN h <> '' THEN h ELSE p END <> ''
      AND {S.strip(S.rep('stem', '_[0-9]+$'))} = CASE WHEN h <> '' THEN h ELSE p END AS renamed FROM f""")
def _(d):
    name = F.concat(F.replace(F.translate("text", "\n", " "), F.lit("# x"), F.lit("_000")), F.lit(".jpg"))
    return d.code_texts().select("text_id", T.is_already_renamed(name).alias("renamed"))


_KIND = r"regexp_extract(tag, '^(year|category|subcategory):', 1)"


@query("parse_tag", rf"""SELECT style_code, tag, CASE WHEN {_KIND} <> '' THEN {_KIND} WHEN regexp_matches(tag, '^20[0-9][0-9]$') THEN 'year' ELSE 'other' END AS type,
    CASE WHEN {_KIND} <> '' THEN trim(regexp_replace(tag, '^[a-z]+:', '')) ELSE tag END AS name FROM product_tags""")
def _(d):
    p = T.parse_tag(F.col("tag"))
    return d.catalog().product_tags.select("style_code", "tag", p["type"].alias("type"), p["name"].alias("name"))


@query("typed_tag", """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN '' ELSE 'category:' || p_name END AS tag FROM part""")
def _(d):
    kind = F.when(F.col("p_type") == "SMALL", F.lit("size")).otherwise(F.lit(" category "))
    return d.table("part").select("p_partkey", T.typed_tag(kind, F.concat(F.lit(" "), "p_name")).alias("tag"))


@query("year_from_code", r"""SELECT style_code, CASE WHEN '20' || regexp_extract(split_part(style_code, '-', 1), '([0-9]{2})$', 1) BETWEEN '2000' AND '2027'
    THEN '20' || regexp_extract(split_part(style_code, '-', 1), '([0-9]{2})$', 1) ELSE '' END AS year FROM parts""")
def _(d):
    return d.parts().select("style_code", T.year_from_code(F.col("style_code"), 2027).alias("year"))


_LIB = S.rep(S.rep("lower(text)", r"[^\pL\pN]+", "_"), "^_+|_+$")
_SLUG = S.rep(S.rep(f"lower({S.strip(S.rep(S.strip('text'), '[.][^.]+$'))})", "[^a-z0-9]+", "_"), "^_+|_+$")


@query("library_id", f"SELECT text_id, {_LIB}[1:80] AS id FROM code_texts")
def _(d):
    return d.code_texts().select("text_id", T.library_id(F.col("text")).alias("id"))


@query("library_slug", f"SELECT text_id, coalesce(nullif({_SLUG}, ''), nullif({_LIB}[1:80], ''), 'library') AS slug FROM code_texts")
def _(d):
    return d.code_texts().select("text_id", T.library_slug(F.col("text")).alias("slug"))


@query("split_tags", rf"""WITH words AS (SELECT text_id, i, w, lower(w) AS lw FROM (SELECT text_id,
      list_filter(regexp_split_to_array(text, '[、,，\s\pZ]+'), lambda x: x <> '') AS ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM code_texts)),
    firsts AS (SELECT text_id, lw, min(i) AS i, arg_min(w, i) AS w FROM words GROUP BY text_id, lw)
    SELECT text_id, string_agg(w, '|' ORDER BY i) AS tags FROM firsts GROUP BY text_id""")
def _(d):
    return d.code_texts().select("text_id", F.array_join(T.split_tags(F.col("text")), "|").alias("tags"))


@query("tags_from_path", """SELECT path, 'year:2024|category:' || lang || '|subcategory:' || source AS tags,
    '年份：2024；类别：' || lang || '；细类：' || source AS display FROM import_files""")
def _(d):
    root, path = F.col("root"), F.col("path")
    return d.import_files().select(
        "path", F.array_join(T.tags_from_path(root, path), "|").alias("tags"), T.tag_display_from_path(root, path).alias("display")
    )


@query("text_tokens", r"""WITH t AS (SELECT 'd' || doc_id AS image_name, unnest(list_transform(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z0-9]{4,}'),
      lambda t: regexp_replace(t, '^[0-9]+|[0-9]+$', '', 'g'))) AS token FROM documents)
    SELECT image_name, string_agg(DISTINCT token, '|' ORDER BY token) AS tokens FROM t
    WHERE length(token) >= 4 AND regexp_matches(token, '[A-Z]') GROUP BY image_name""")
def _(d):
    t = d.docs().select("image_name", T.text_tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return t.select("image_name", F.array_join(F.array_sort("t"), "|").alias("tokens"))


_URL = "(url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'Q=5&max_edge=10')"
_KEPT = f"list_filter(string_split(split_part({_URL}, '?', 2), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(max_edge|q)='))"


@query("thumb_params", f"""SELECT page_id, split_part({_URL}, '?', 1) || '?' || array_to_string(list_concat(['max_edge=180', 'q=68'], {_KEPT}), '&') AS set_url,
    CASE WHEN len({_KEPT}) > 0 THEN split_part({_URL}, '?', 1) || '?' || array_to_string({_KEPT}, '&') ELSE split_part({_URL}, '?', 1) END AS strip_url FROM pages""")
def _(d):
    joint = F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    url = F.concat("url", joint, F.lit("Q=5&max_edge=10"))
    return d.table("pages").select("page_id", T.set_thumb_params(url).alias("set_url"), T.strip_thumb_params(url).alias("strip_url"))


@query("filter_key", """SELECT p_partkey, p_name || '::' || least(p_type, p_brand) || '|' || greatest(p_type, p_brand) || '::' || (2000 + p_size) || '::' || p_type || '::' AS key FROM part""")
def _(d):
    none = F.array().cast("array<string>")
    year = F.array((F.col("p_size") + 2000).cast("string"), F.lit(" "))
    key = T.filter_key(F.concat(F.lit(" "), "p_name"), F.array("p_type", F.concat("p_brand", F.lit(" "))), year, F.array("p_type"), none)
    return d.table("part").select("p_partkey", key.alias("key"))


@query("next_card_number", """SELECT p_partkey, lpad((p_partkey + 1)::VARCHAR, greatest(5, length((p_partkey + 1)::VARCHAR))::INT, '0') AS next,
    CASE WHEN p_size % 2 = 0 THEN '国彩' ELSE '' END AS vendor FROM part""")
def _(d):
    number = F.col("p_partkey").cast("string")
    number = F.lpad(number, F.greatest(F.lit(5), F.length(number)), F.lit("0"))  # lpad cuts what is longer
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("国彩 1"))).otherwise(F.col("p_name"))
    return d.table("part").select("p_partkey", T.next_card_number(number).alias("next"), T.known_prefix(name).alias("vendor"))


_DEV = "lower(event_type || CASE WHEN user_id % 3 = 0 THEN ' ColorMeter' WHEN user_id % 3 = 1 THEN ' iPhone' ELSE '' END)"


@query("device_score", f"""SELECT event_id, CASE WHEN contains({_DEV}, 'meter') THEN 100.0 ELSE 0.0 END - CASE WHEN contains({_DEV}, 'iphone') THEN 50.0 ELSE 0.0 END
      + greatest(-20.0, least(20.0, floor((80 - value) / 2 + 0.5)))::DOUBLE AS card,
    (CASE WHEN contains({_DEV}, 'meter') THEN 100.0 ELSE 0.0 END + CASE WHEN regexp_matches({_DEV}, 'pt|rm|cr|wr|ys|nh|3nh|fru|bn|cm') THEN 20.0 ELSE 0.0 END
      + length({_DEV}))::DOUBLE AS bridge FROM events""".replace("THEN 100.0 ELSE 0.0 END -", "THEN 100.0::DOUBLE ELSE 0.0 END -"))
def _(d):
    word = F.when(F.col("user_id") % 3 == 0, F.lit(" ColorMeter")).when(F.col("user_id") % 3 == 1, F.lit(" iPhone")).otherwise(F.lit(""))
    name = F.concat("event_type", word)
    return d.table("events").select(
        "event_id", T.device_score(name, -F.col("value")).alias("card"), T.device_score(name, variant="bridge").alias("bridge")
    )
