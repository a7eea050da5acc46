"""Catalog maintenance: every operation returns new tables (plain Parquet has no MERGE); write them as a new version."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintshelf.functions import text as T
from tintshelf.operators.catalog import Catalog


def pick_covers(images: DataFrame) -> DataFrame:
    """(style_code, cover_image): first image by (sort_order, image_name)."""
    return images.groupBy("style_code").agg(
        F.min(F.struct("sort_order", "image_name"))["image_name"].alias("cover_image")
    )


def _with_covers(products: DataFrame, images: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """Recompute the cover of the touched codes, and their time of change; the others keep theirs."""
    covers = pick_covers(images.join(touched, "style_code", "left_semi")).withColumnRenamed("cover_image", "_cover")
    new = {"cover_image": F.coalesce("_cover", "cover_image"), "updated_at": F.when(F.col("_cover").isNotNull(), now).otherwise(F.col("updated_at"))}
    return products.join(covers, "style_code", "left").select(*[new.get(c, F.col(c)).alias(c) for c in products.columns])


def _time(now: Column | None) -> Column:
    return (F.current_timestamp() if now is None else now).cast("timestamp")


def _tags_seen(catalog: Catalog, product_tags: DataFrame) -> DataFrame:
    return catalog.tags.select("name").unionByName(product_tags.select(F.col("tag").alias("name"))).distinct()


def sync_catalog(files: DataFrame, catalog: Catalog, now: Column | None = None, small: bool = False) -> tuple[Catalog, DataFrame]:
    """Take in image files(image_name): new products, images by name, covers of the touched products; plus counts.

    ``now`` is the time of creation and change that touched products get (the current time if none is given). Names starting ``MY-`` are user uploads and are left alone.
    ``small``: the caller has counted the files and they fit into every task, so the catalog's images need no shuffle to meet them.
    """
    seen = files.filter(~F.startswith("image_name", F.lit("MY-"))).select(
        T.strip(T.style_code_catalog(F.col("image_name"))).alias("style_code"), "image_name",
        T.sort_order_of(F.col("image_name")).cast("int").alias("sort_order"),
    ).filter("style_code <> ''").dropDuplicates(["image_name"])
    touched = seen.select("style_code").distinct()
    fresh = touched.join(catalog.products, "style_code", "left_anti")
    names, codes = (F.broadcast(x) if small else x for x in (seen.select("image_name"), touched))

    def merged(old: DataFrame) -> DataFrame:
        return old.join(names, "image_name", "left_anti").select("style_code", "image_name", "sort_order").unionByName(seen)

    images = merged(catalog.images)
    of_touched = merged(catalog.images.join(codes, "style_code", "left_semi"))  # covers need no other images
    now = _time(now)
    new = fresh.select("style_code", F.lit("").alias("note"), now.alias("created_at"), now.alias("updated_at"))
    products = catalog.products.unionByName(new, allowMissingColumns=True)
    stats = touched.withColumn("kind", F.lit("total")).unionByName(
        fresh.withColumn("kind", F.lit("added"))
    ).unionByName(seen.select("style_code", F.lit("image").alias("kind"))).agg(
        F.count_if(F.col("kind") == "total").alias("products_total"),
        F.count_if(F.col("kind") == "added").alias("products_added"),
        F.count_if(F.col("kind") == "image").alias("images_added_or_updated"),
    )
    return replace(catalog, products=_with_covers(products, of_touched, touched, now), images=images), stats


def upsert_products(requests: DataFrame, catalog: Catalog, now: Column | None = None) -> Catalog:
    """requests(style_code, note, image_names array, tags array), one row per code; ``now`` as in ``sync_catalog``.

    The note is overwritten; new images are numbered after the code's highest sort order in list order; an image
    known elsewhere only changes its code; tags are added.
    """
    r = requests.withColumn("style_code", T.strip(F.col("style_code"))).withColumn(
        "image_names", F.filter(F.transform("image_names", T.strip), lambda n: n != "")
    ).filter("style_code <> '' AND size(image_names) > 0")
    top = catalog.images.groupBy("style_code").agg((F.max("sort_order") + 1).alias("start"))
    wanted = r.select("style_code", F.posexplode("image_names").alias("pos", "image_name")).groupBy("image_name").agg(
        F.min(F.struct("pos", "style_code")).alias("at"), F.max("style_code").alias("owner")
    )
    # An image asked for by several codes ends up with the last code, as after one request per code in code order.
    wanted = wanted.select("image_name", F.col("owner").alias("style_code"), F.col("at.pos").alias("pos"))
    old = catalog.images.select("image_name", F.col("sort_order").alias("old_order"))
    changed = wanted.join(old, "image_name", "left").join(top, "style_code", "left").select(
        "style_code", "image_name",
        F.coalesce("old_order", F.coalesce("start", F.lit(0)) + F.col("pos")).cast("int").alias("sort_order"),
    )
    images = catalog.images.join(wanted, "image_name", "left_anti").select("style_code", "image_name", "sort_order").unionByName(changed)
    new = r.select("style_code", F.coalesce("note", F.lit("")).alias("_note"))
    now = _time(now)
    given = {
        "note": F.coalesce("_note", "note"),
        "created_at": F.when(F.col("_old").isNull(), now).otherwise(F.col("created_at")),
        "updated_at": F.when(F.col("_note").isNotNull(), now).otherwise(F.col("updated_at")),
    }
    products = catalog.products.withColumn("_old", F.lit(True)).join(new, "style_code", "full").select(
        *[given.get(c, F.col(c)).alias(c) for c in catalog.products.columns]
    )
    with_tags = add_tags(r.select("style_code", "tags"), replace(catalog, products=products))
    return replace(with_tags, products=_with_covers(products, images, r.select("style_code"), now), images=images)


def _clean_requests(requests: DataFrame, catalog: Catalog) -> DataFrame:
    """Requests of known products with trimmed, non-blank, distinct tags. Rows of unknown codes are dropped here;
    ``unknown_codes`` lists them."""
    clean = F.array_distinct(F.filter(F.transform("tags", T.strip), lambda t: t != ""))
    r = requests.select(T.strip(F.col("style_code")).alias("style_code"), F.coalesce(clean, F.array().cast("array<string>")).alias("tags"))
    return r.join(catalog.products, "style_code", "left_semi")


def unknown_codes(requests: DataFrame, catalog: Catalog) -> DataFrame:
    return requests.select(T.strip(F.col("style_code")).alias("style_code")).join(catalog.products, "style_code", "left_anti")


def replace_tags(requests: DataFrame, catalog: Catalog, now: Column | None = None) -> Catalog:
    """requests(style_code, tags array): the product's tags become exactly these, its time of change ``now``."""
    r = _clean_requests(requests, catalog)
    kept = catalog.product_tags.join(r, "style_code", "left_anti").select("style_code", "tag")
    new = kept.unionByName(r.select("style_code", F.explode("tags").alias("tag")).distinct())
    asked = r.select("style_code", F.lit(True).alias("_asked")).distinct()
    changed = F.when(F.col("_asked"), _time(now)).otherwise(F.col("updated_at"))
    products = catalog.products.join(asked, "style_code", "left").select(
        *[changed.alias(c) if c == "updated_at" else F.col(c) for c in catalog.products.columns]
    )
    return replace(catalog, products=products, product_tags=new, tags=_tags_seen(catalog, new))


def add_tags(requests: DataFrame, catalog: Catalog) -> Catalog:
    r = _clean_requests(requests, catalog)
    new = catalog.product_tags.select("style_code", "tag").unionByName(r.select("style_code", F.explode("tags").alias("tag"))).distinct()
    return replace(catalog, product_tags=new, tags=_tags_seen(catalog, new))


def add_tag_rows(rows: DataFrame, catalog: Catalog) -> Catalog:
    """rows(style_code, tag): as ``add_tags``, one row for each tag; no product's tags are gathered."""
    r = rows.select(T.strip(F.col("style_code")).alias("style_code"), T.strip(F.col("tag")).alias("tag")).filter("tag <> ''")
    r = r.distinct().join(catalog.products, "style_code", "left_semi")
    new = catalog.product_tags.select("style_code", "tag").unionByName(r).distinct()
    return replace(catalog, product_tags=new, tags=_tags_seen(catalog, new))


def replace_tags_by_type(requests: DataFrame, catalog: Catalog, types: list[str]) -> Catalog:
    """Replace only the tags of the given types; other requested tags are ignored, other old ones stay."""
    kinds = [t.strip() for t in types if t.strip()]

    def chosen(tag: Column) -> Column:
        return T.parse_tag(tag)["type"].isin(*kinds)

    r = _clean_requests(requests, catalog)
    codes = r.select("style_code").withColumn("_asked", F.lit(True)).distinct()
    old = catalog.product_tags.join(codes, "style_code", "left").filter(
        F.col("_asked").isNull() | ~chosen(F.col("tag"))
    ).select("style_code", "tag")
    new = old.unionByName(
        r.select("style_code", F.explode("tags").alias("tag")).filter(chosen(F.col("tag")))
    ).distinct()
    return replace(catalog, product_tags=new, tags=_tags_seen(catalog, new))


def create_tags(names: DataFrame, catalog: Catalog) -> Catalog:
    clean = names.select(T.strip(F.col("name")).alias("name")).filter("name <> ''")
    return replace(catalog, tags=catalog.tags.select("name").unionByName(clean).distinct())


def delete_tags(names: DataFrame, catalog: Catalog) -> Catalog:
    """Drop tags and their use on products."""
    gone = names.select(T.strip(F.col("name")).alias("name"))
    return replace(
        catalog,
        tags=catalog.tags.join(gone, "name", "left_anti"),
        product_tags=catalog.product_tags.join(gone.withColumnRenamed("name", "tag"), "tag", "left_anti").select("style_code", "tag"),
    )


def delete_unused_tags(catalog: Catalog) -> Catalog:
    used = catalog.product_tags.select(F.col("tag").alias("name"))
    return replace(catalog, tags=catalog.tags.join(used, "name", "left_semi"))


def delete_products(codes: DataFrame, catalog: Catalog) -> Catalog:
    gone = codes.select(T.strip(F.col("style_code")).alias("style_code"))
    return replace(
        catalog,
        products=catalog.products.join(gone, "style_code", "left_anti"),
        images=catalog.images.join(gone, "style_code", "left_anti"),
        product_tags=catalog.product_tags.join(gone, "style_code", "left_anti"),
    )


def delete_images(gone: DataFrame, catalog: Catalog, now: Column | None = None) -> Catalog:
    """gone(style_code, image_name): a product that loses its last image goes too, others get a new cover."""
    hit = catalog.images.join(gone, ["style_code", "image_name"], "left_semi")
    touched = hit.select("style_code").distinct()
    images = catalog.images.join(gone, ["style_code", "image_name"], "left_anti")
    empty = touched.join(images, "style_code", "left_anti")
    left = delete_products(empty, replace(catalog, images=images))
    return replace(left, products=_with_covers(left.products, left.images, touched, _time(now)))


def backfill_year_tags(catalog: Catalog, max_year: int, overwrite: bool = False) -> tuple[Catalog, DataFrame]:
    """Give every product the year its code implies; also (updated, skipped, total)."""
    derived = T.year_from_code(F.col("style_code"), max_year)
    p = catalog.products.select("style_code", F.when(derived != "", F.concat(F.lit("year:"), derived)).alias("year_tag"))
    year_like = F.col("tag").rlike(r"^(year:)?20\d{2}$")
    if overwrite:
        todo = p.filter("year_tag IS NOT NULL")
        marked = catalog.product_tags.join(todo.select("style_code", F.lit(True).alias("_todo")), "style_code", "left")
        kept = marked.filter(F.col("_todo").isNull() | ~year_like).select("style_code", "tag")
    else:
        has = catalog.product_tags.select("style_code", F.col("tag").alias("year_tag"))
        todo = p.filter("year_tag IS NOT NULL").join(has, ["style_code", "year_tag"], "left_anti")
        kept = catalog.product_tags.select("style_code", "tag")
    new = kept.unionByName(todo.select("style_code", F.col("year_tag").alias("tag"))).distinct()
    stats = p.select("style_code").withColumn("u", F.lit(0)).unionByName(todo.select("style_code", F.lit(1).alias("u"))).agg(
        F.sum("u").alias("updated"), F.count_if(F.col("u") == 0).alias("total")
    ).select("updated", (F.col("total") - F.col("updated")).alias("skipped"), "total")
    return replace(catalog, product_tags=new, tags=_tags_seen(catalog, new)), stats
