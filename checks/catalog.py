"""Catalog queries and maintenance."""

from pyspark.sql import functions as F

from checks.base import Data, query
from tintshelf.functions import text as T
from tintshelf.operators import catalog as L
from tintshelf.operators import maintenance as M

OWNED = "(SELECT style_code FROM product_tags WHERE tag ILIKE 'owner:%')"


@query("filter_by_code", "SELECT style_code, note FROM products WHERE style_code ILIKE '%2_-0%'")
def _(d: Data):
    return L.filter_by_code(d.catalog().products, " 2_-0").select("style_code", "note")


@query("exclude_owned", f"SELECT style_code FROM products WHERE style_code NOT IN {OWNED}")
def _(d):
    c = d.catalog()
    return L.exclude_owned(c.products, c.product_tags).select("style_code")


_TAGGED = """(SELECT style_code FROM product_tags GROUP BY style_code HAVING sum((tag IN ('2004', 'year:2004'))::INT) > 0
    AND sum((tag = 'category:SMALL')::INT) > 0)"""


@query("filter_by_tags", f"SELECT style_code FROM products WHERE style_code IN {_TAGGED}")
def _(d):
    c = d.catalog()
    return L.filter_by_tags(c.products, c.product_tags, ["year:2004", "category:SMALL", " "]).select("style_code")


@query("list_products", f"""WITH page AS (SELECT * FROM products WHERE style_code ILIKE '%gz1%' AND style_code NOT IN {OWNED} ORDER BY style_code DESC LIMIT 500 OFFSET 100)
    SELECT p.style_code, note, (SELECT count(*) FROM product_images i WHERE i.style_code = p.style_code) AS image_count,
      (SELECT string_agg(image_name, '|' ORDER BY sort_order, image_name) FROM product_images i WHERE i.style_code = p.style_code) AS images FROM page p""")
def _(d):
    page = L.list_products(d.catalog(), query="gz1", limit=5000, offset=100, exclude_owner=True)
    images = F.array_join(F.transform("images", lambda i: i["image_name"]), "|")
    return page.select("style_code", "note", "image_count", F.when(F.size("images") > 0, images).alias("images"))


@query("count_products", f"SELECT count(*) AS products FROM products WHERE style_code IN {_TAGGED} AND style_code NOT IN {OWNED}")
def _(d):
    return L.count_products(d.catalog(), tags=["2004", "category:SMALL"], exclude_owner=True)


@query("filter_by_code_wildcards", r"""SELECT style_code FROM (SELECT style_code || CASE WHEN p_size % 3 = 0 THEN '\x' WHEN p_size % 3 = 1 THEN '%_\' ELSE '' END AS style_code FROM parts)
    WHERE style_code ILIKE '%-0%\_%' OR style_code ILIKE '%5%\%'""")
def _(d):
    """Search texts and codes that hold a backslash, ``%`` and ``_``."""
    end = F.when(F.col("p_size") % 3 == 0, "\\x").when(F.col("p_size") % 3 == 1, "%_\\").otherwise("")
    p = d.parts().select(F.concat("style_code", end).alias("style_code"))
    return L.filter_by_code(p, "-0%\\_").union(L.filter_by_code(p, "5%\\")).distinct()


@query("products_by_codes", """SELECT style_code, note, (SELECT count(*) FROM product_images i WHERE i.style_code = p.style_code) AS image_count,
      (SELECT coalesce(string_agg(image_name, '|' ORDER BY sort_order, image_name), '') FROM product_images i WHERE i.style_code = p.style_code) AS images,
      (SELECT coalesce(string_agg(tag, '|' ORDER BY lower(tag), tag), '') FROM product_tags t WHERE t.style_code = p.style_code) AS raw_tags
    FROM products p WHERE style_code IN (SELECT printf('GZ%02d-%04d', 10 + p_size % 20, l_partkey)
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R')""")
def _(d):
    parts = d.parts().select("p_partkey", F.concat(F.lit(" "), "style_code", F.lit(" ")).alias("style_code"))
    back = d.table("lineitem").filter("l_returnflag = 'R'").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return L.products_by_codes(d.catalog(), back.select("style_code")).select(
        "style_code", "note", "image_count", F.array_join(F.transform("images", lambda i: i["image_name"]), "|").alias("images"),
        F.array_join("raw_tags", "|").alias("raw_tags"),
    )


@query("image_counts", "SELECT style_code, count(*) AS image_count FROM product_images GROUP BY style_code")
def _(d):
    return L.image_counts(d.catalog().images)


@query("assemble_products", """WITH t AS (SELECT style_code, tag, CASE WHEN regexp_matches(tag, '^20[0-9][0-9]$') THEN tag ELSE regexp_replace(tag, '^(category|subcategory):', '') END AS name FROM product_tags),
    g AS (SELECT style_code, string_agg(tag, '|' ORDER BY lower(tag), tag) AS raw_tags, string_agg(CASE WHEN tag NOT LIKE 'owner:%' THEN name END, '|' ORDER BY lower(tag), tag) AS tags,
      coalesce(string_agg(CASE WHEN tag LIKE '20%' THEN name END, '|'), '') AS year FROM t GROUP BY style_code),
    i AS (SELECT style_code, count(*) AS image_count, string_agg(image_name, '|' ORDER BY sort_order, image_name) AS images FROM product_images GROUP BY style_code)
    SELECT p.style_code, coalesce(image_count, 0) AS image_count, coalesce(images, '') AS images, raw_tags, tags, year
    FROM products p LEFT JOIN g USING (style_code) LEFT JOIN i USING (style_code)""")
def _(d):
    c = d.catalog()
    p = L.assemble_products(c.products, c.images, c.product_tags)
    return p.select(
        "style_code", "image_count", F.array_join(F.transform("images", lambda i: i["image_name"]), "|").alias("images"),
        F.array_join("raw_tags", "|").alias("raw_tags"), F.array_join("tags", "|").alias("tags"),
        F.array_join("tag_groups.year", "|").alias("year"),
    )


@query("list_tags", "SELECT name FROM tag_names ORDER BY lower(name)")
def _(d):
    return L.list_tags(d.catalog().tags)


@query("used_tags", "SELECT DISTINCT tag AS name FROM product_tags")
def _(d):
    return L.used_tags(d.catalog().product_tags)


@query("tag_groups", """SELECT 'category' AS kind, i::INT AS default_position, n AS name FROM (SELECT unnest(['单品', '罗纹', '毛织配件', '布匹']) AS n, unnest([0, 1, 2, 3]) AS i)
    UNION ALL SELECT 'subcategory', 0, '暂无'
    UNION ALL SELECT DISTINCT CASE WHEN tag LIKE '20%' THEN 'year' ELSE split_part(tag, ':', 1) END, NULL, regexp_replace(tag, '^[a-z]+:', '') FROM product_tags WHERE tag NOT LIKE 'owner:%'""")
def _(d):
    return L.tag_groups(L.used_tags(d.catalog().product_tags))


@query("list_image_names", "SELECT style_code, image_name, sort_order FROM product_images")
def _(d):
    return L.list_image_names(d.catalog().images)


@query("pick_covers", "SELECT style_code, arg_min(image_name, (sort_order, image_name)) AS cover_image FROM product_images GROUP BY style_code")
def _(d):
    return M.pick_covers(d.catalog().images)


def _now():
    """Time of the changes below; products have no times before."""
    return F.lit("2024-05-06 07:08:09").cast("timestamp")


# The files seen by a sync: one per order line of a return, in the catalog under its old name, plus uploads.
def _files(d: Data):
    images = d.catalog().images
    moved = images.filter("sort_order <= 2").select(F.regexp_replace("image_name", "^GZ1", "HZ1").alias("image_name"))
    return moved.unionByName(images.filter("sort_order > 5").select("image_name")).unionByName(
        d.table("supplier").select(F.concat(F.lit("MY-"), "s_name", F.lit(".jpg")).alias("image_name"))
    )


SYNC = r"""files AS (SELECT regexp_replace(image_name, '^GZ1', 'HZ1') AS image_name FROM product_images WHERE sort_order <= 2
      UNION SELECT image_name FROM product_images WHERE sort_order > 5),
    seen AS (SELECT regexp_replace(regexp_replace(regexp_replace(image_name, '[.][^.]+$', ''), '(_[0-9]{3})+$', ''), '_[^_]*$', '') AS style_code, image_name,
      regexp_extract(image_name, '_([0-9]+)[.]jpg$', 1)::INT AS sort_order FROM files),
    merged AS (SELECT * FROM product_images ANTI JOIN seen USING (image_name) UNION ALL BY NAME SELECT * FROM seen),
    covers AS (SELECT style_code, arg_min(image_name, (sort_order, image_name)) AS c FROM merged WHERE style_code IN (SELECT style_code FROM seen) GROUP BY style_code),
    everyone AS (SELECT style_code, cover_image, note FROM products UNION ALL SELECT DISTINCT style_code, NULL, '' FROM seen WHERE style_code NOT IN (SELECT style_code FROM products))"""


@query("sync_catalog", f"""WITH {SYNC} SELECT style_code, coalesce(c, cover_image) AS cover_image, note, style_code NOT IN (SELECT style_code FROM products) AS created,
    style_code IN (SELECT style_code FROM seen) AS updated FROM everyone LEFT JOIN covers USING (style_code)""")
def _(d):
    return _times(M.sync_catalog(_files(d), d.catalog(), _now())[0].products)


@query("sync_catalog_images", f"WITH {SYNC} SELECT style_code, image_name, sort_order FROM merged")
def _(d):
    return M.sync_catalog(_files(d), d.catalog())[0].images


@query("sync_catalog_stats", f"""WITH {SYNC} SELECT count(DISTINCT style_code) AS products_total,
    count(DISTINCT CASE WHEN style_code NOT IN (SELECT style_code FROM products) THEN style_code END) AS products_added, count(*) AS images_added_or_updated FROM seen""")
def _(d):
    return M.sync_catalog(_files(d), d.catalog())[1]


def _times(products):
    return products.select("style_code", "cover_image", "note", *[F.coalesce(F.col(f"{c}_at") == _now(), F.lit(False)).alias(c) for c in ("created", "updated")])


def _product_requests(d: Data):
    """Every third size group is sent again with two images: a new one, and the first one of its part."""
    covers = M.pick_covers(d.catalog().images)
    p = d.parts().join(covers, "style_code", "left").filter("p_size % 3 = 0")
    names = F.array(F.concat("style_code", F.lit("_new.jpg")), F.concat(F.lit(" "), F.coalesce("cover_image", F.lit(""))))
    tags = F.array(F.lit("year:2024"), F.concat(F.lit("category:"), "p_type"))
    return p.select("style_code", F.concat(F.lit("again "), "p_name").alias("note"), names.alias("image_names"), tags.alias("tags"))


UPSERT = """covers AS (SELECT style_code, arg_min(image_name, (sort_order, image_name)) AS c FROM product_images GROUP BY style_code),
    sent AS (SELECT style_code, p_name FROM parts WHERE p_size % 3 = 0),
    imgs AS (SELECT style_code, image_name, sort_order FROM product_images UNION ALL
      SELECT s.style_code, s.style_code || '_new.jpg', coalesce((SELECT max(sort_order) + 1 FROM product_images i WHERE i.style_code = s.style_code), 0)::INT FROM sent s)"""


@query("upsert_products", f"""WITH {UPSERT} SELECT p.style_code, CASE WHEN s.style_code IS NULL THEN p.cover_image ELSE coalesce(c, p.style_code || '_new.jpg') END AS cover_image,
    CASE WHEN s.style_code IS NULL THEN note ELSE 'again ' || p_name END AS note, false AS created, s.style_code IS NOT NULL AS updated FROM products p LEFT JOIN sent s USING (style_code) LEFT JOIN covers USING (style_code)""")
def _(d):
    return _times(M.upsert_products(_product_requests(d), d.catalog(), _now()).products)


@query("upsert_products_images", f"WITH {UPSERT} SELECT style_code, image_name, sort_order FROM imgs")
def _(d):
    return M.upsert_products(_product_requests(d), d.catalog()).images


@query("replace_tags", "SELECT style_code, tag FROM tag_requests")
def _(d):
    return M.replace_tags(d.tag_requests(), d.catalog()).product_tags


@query("replace_tags_times", "SELECT style_code, style_code IN (SELECT style_code FROM tag_requests WHERE tag LIKE 'year:201%') AS updated FROM products")
def _(d):
    asked = d.tag_requests().filter(F.exists("tags", lambda t: t.like("year:201%")))
    return _times(M.replace_tags(asked, d.catalog(), _now()).products).select("style_code", "updated")


@query("add_tags", "SELECT style_code, tag FROM product_tags UNION SELECT style_code, tag FROM tag_requests")
def _(d):
    return M.add_tags(d.tag_requests(), d.catalog()).product_tags


@query("replace_tags_by_type", """SELECT style_code, tag FROM product_tags WHERE NOT (tag LIKE 'subcategory:%' OR regexp_matches(tag, '^20[0-9][0-9]$'))
    UNION SELECT style_code, tag FROM tag_requests WHERE tag LIKE 'subcategory:%' OR tag LIKE 'year:%'""")
def _(d):
    return M.replace_tags_by_type(d.tag_requests(), d.catalog(), ["year", "subcategory"]).product_tags


@query("create_tags", "SELECT name FROM tag_names UNION SELECT r_name FROM region")
def _(d):
    names = d.table("region").select(F.concat(F.lit(" "), "r_name").alias("name"))
    return M.create_tags(names, d.catalog()).tags


@query("delete_tags", "SELECT style_code, tag FROM product_tags WHERE tag NOT IN (SELECT 'category:' || p_type FROM part WHERE p_size = 1) AND tag NOT LIKE 'owner:%'")
def _(d):
    owners = d.catalog().tags.filter("name LIKE 'owner:%'").select("name")
    names = d.table("part").filter("p_size = 1").select(F.concat(F.lit("category:"), "p_type").alias("name")).union(owners)
    return M.delete_tags(names, d.catalog()).product_tags


@query("delete_unused_tags", "SELECT DISTINCT tag AS name FROM product_tags")
def _(d):
    return M.delete_unused_tags(d.catalog()).tags


@query("delete_products", "SELECT style_code, image_name FROM product_images WHERE style_code NOT IN (SELECT style_code FROM parts WHERE p_type = 'SMALL')")
def _(d):
    codes = d.parts().filter("p_type = 'SMALL'").select("style_code")
    return M.delete_products(codes, d.catalog()).images.select("style_code", "image_name")


@query("delete_images", """WITH gone AS (SELECT * FROM product_images WHERE sort_order <= 3 OR style_code LIKE 'GZ15%'), left_over AS (SELECT * FROM product_images ANTI JOIN gone USING (style_code, image_name)),
    c AS (SELECT style_code, arg_min(image_name, (sort_order, image_name)) AS cover FROM left_over GROUP BY style_code)
    SELECT style_code, coalesce(CASE WHEN style_code IN (SELECT style_code FROM gone) THEN cover END, cover_image) AS cover_image FROM products LEFT JOIN c USING (style_code)
    WHERE NOT (style_code IN (SELECT style_code FROM gone) AND style_code NOT IN (SELECT style_code FROM left_over))""")
def _(d):
    c = d.catalog()
    gone = c.images.filter("sort_order <= 3 OR style_code LIKE 'GZ15%'").select("style_code", "image_name")
    return M.delete_images(gone, c).products.select("style_code", "cover_image")


_YEAR = "'year:20' || style_code[3:4]"


@query("backfill_year_tags", f"SELECT style_code, tag FROM product_tags UNION SELECT style_code, {_YEAR} FROM parts WHERE style_code[3:4]::INT <= 27")
def _(d):
    return M.backfill_year_tags(d.catalog(), 2027)[0].product_tags


@query("backfill_year_tags_overwrite", f"""SELECT style_code, tag FROM product_tags WHERE NOT (regexp_matches(tag, '^20[0-9][0-9]$') AND style_code[3:4]::INT <= 27)
    UNION SELECT style_code, {_YEAR} FROM parts WHERE style_code[3:4]::INT <= 27""")
def _(d):
    return M.backfill_year_tags(d.catalog(), 2027, overwrite=True)[0].product_tags


@query("backfill_year_tags_stats", "SELECT sum((style_code[3:4]::INT <= 27)::INT)::BIGINT AS updated, sum((style_code[3:4]::INT > 27)::INT)::BIGINT AS skipped, count(*) AS total FROM parts")
def _(d):
    return M.backfill_year_tags(d.catalog(), 2027)[1]
