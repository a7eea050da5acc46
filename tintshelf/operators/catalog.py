"""Product catalog queries: filters, pages, counts, nested product documents, tag lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintshelf.functions import text as T


@dataclass(frozen=True)
class Catalog:
    """products(style_code, cover_image, note, created_at, updated_at), images(style_code, image_name, sort_order),
    tags(name), product_tags(style_code, tag). Products without times get null times."""

    products: DataFrame
    images: DataFrame
    tags: DataFrame
    product_tags: DataFrame

    def __post_init__(self):
        missing = {c: F.lit(None).cast("timestamp") for c in ("created_at", "updated_at") if c not in self.products.columns}
        if missing:
            object.__setattr__(self, "products", self.products.withColumns(missing))


def contains_like(text: str) -> str:
    """LIKE pattern for a substring: ``%`` and ``_`` stay wildcards, a backslash stands for itself."""
    return "%" + text.replace("\\", "\\\\") + "%"


def filter_by_code(products: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring of the code; ``%`` and ``_`` in the query are wildcards.

    A match after the first dash is always a match of the whole code, so one test covers both.
    """
    q = query.strip()
    return products.filter(F.col("style_code").ilike(contains_like(q))) if q else products


def exclude_owned(products: DataFrame, product_tags: DataFrame) -> DataFrame:
    owned = product_tags.filter(F.col("tag").ilike("owner:%")).select("style_code")
    return products.filter(~F.col("style_code").ilike("MY-%")).join(owned, "style_code", "left_anti")


def _spellings(tag: str) -> list[str]:
    name = tag.removeprefix("year:").strip() if tag.startswith("year:") else tag
    is_year = tag.startswith("year:") or (len(tag) == 4 and tag.startswith("20") and tag.isdigit())
    return list(dict.fromkeys([tag] + ([f"year:{name}", name] if is_year and name else [])))


def filter_by_tags(products: DataFrame, product_tags: DataFrame, tags: list[str]) -> DataFrame:
    """Products that carry every requested tag; a year counts in either of its two spellings."""
    wanted = [_spellings(t.strip()) for t in dict.fromkeys(tags) if t.strip()]
    if not wanted:
        return products
    every = sorted({s for group in wanted for s in group})
    flags = [F.max(F.col("tag").isin(group)).alias(f"t{i}") for i, group in enumerate(wanted)]
    hits = product_tags.filter(F.col("tag").isin(every)).groupBy("style_code").agg(*flags)
    for i in range(len(wanted)):
        hits = hits.filter(F.col(f"t{i}"))
    return products.join(hits.select("style_code"), "style_code", "left_semi")


def filtered(catalog: Catalog, query: str = "", tags: list[str] = (), exclude_owner: bool = False) -> DataFrame:
    p = filter_by_code(catalog.products, query)
    p = filter_by_tags(p, catalog.product_tags, list(tags))
    return exclude_owned(p, catalog.product_tags) if exclude_owner else p


def list_products(
    catalog: Catalog, query: str = "", tags: list[str] = (), limit: int = 200, offset: int = 0,
    exclude_owner: bool = False, include_images: bool = True,
) -> DataFrame:
    """One page of product documents, newest code first. Details are read for the page's codes only."""
    page = filtered(catalog, query, tags, exclude_owner).orderBy(F.desc("style_code"))
    page = page.offset(max(0, int(offset))).limit(max(1, min(int(limit), 500)))
    return assemble_products(page, catalog.images, catalog.product_tags, include_images)


def count_products(catalog: Catalog, query: str = "", tags: list[str] = (), exclude_owner: bool = False) -> DataFrame:
    return filtered(catalog, query, tags, exclude_owner).agg(F.count("*").alias("products"))


def products_by_codes(catalog: Catalog, codes: DataFrame) -> DataFrame:
    """Product documents for the trimmed, non-blank codes of ``codes(style_code)``, ascending."""
    wanted = codes.select(T.strip(F.col("style_code")).alias("style_code")).filter("style_code <> ''").distinct()
    found = catalog.products.join(wanted, "style_code", "left_semi")
    return assemble_products(found, catalog.images, catalog.product_tags).orderBy("style_code")


def image_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("style_code").agg(F.count("*").alias("image_count"))


def _distinct_names(tags: Column, kinds: tuple[str, ...]) -> Column:
    return F.array_distinct(
        F.transform(F.filter(tags, lambda t: t["type"].isin(*kinds)), lambda t: t["name"])
    )


def assemble_products(
    products: DataFrame, images: DataFrame, product_tags: DataFrame, include_images: bool = True
) -> DataFrame:
    """Nested product documents, one row each: ordered images, raw_tags, tags, and year/category/subcategory groups.

    The list of a product's images is one value of its row. Where that is too much, ask for no images and take
    the flat rows of ``list_image_names``.
    """
    keys = products.select("style_code")
    mine = images.join(keys, "style_code", "left_semi")
    if include_images:  # one pass over the images: the list knows its length
        counts = mine.groupBy("style_code").agg(F.array_sort(F.collect_list(F.struct("sort_order", "image_name"))).alias("images"))
        counts = counts.withColumn("image_count", F.size("images").cast("bigint"))
    else:
        counts = image_counts(mine)
    parsed = T.parse_tag(F.col("tag"))
    rows = product_tags.join(keys, "style_code", "left_semi").select(
        "style_code", F.struct(F.lower("tag").alias("fold"), F.col("tag").alias("raw"), parsed["type"].alias("type"), parsed["name"].alias("name")).alias("t")
    )
    tags = rows.filter("t.name <> ''").groupBy("style_code").agg(F.array_sort(F.collect_set("t")).alias("t"))
    out = products.join(counts, "style_code", "left").join(tags, "style_code", "left")
    t = F.coalesce("t", F.array().cast("array<struct<fold:string,raw:string,type:string,name:string>>"))
    columns = [
        *products.columns,
        F.coalesce("image_count", F.lit(0)).alias("image_count"),
        F.transform(t, lambda x: x["raw"]).alias("raw_tags"),
        _distinct_names(t, T.TAG_KINDS).alias("tags"),
        F.struct(*[_distinct_names(t, (kind,)).alias(kind) for kind in T.TAG_KINDS]).alias("tag_groups"),
    ]
    if not include_images:
        return out.select(*columns)
    none = F.array().cast(counts.schema["images"].dataType)
    return out.select(*columns, F.coalesce("images", none).alias("images"))


def list_tags(tags: DataFrame) -> DataFrame:
    return tags.select("name").orderBy(F.lower("name"), "name")


def used_tags(product_tags: DataFrame) -> DataFrame:
    return product_tags.select(F.col("tag").alias("name")).distinct().orderBy(F.lower("name"), "name")


def tag_groups(names: DataFrame) -> DataFrame:
    """(kind, default_position, name) in display order: fixed defaults first, then the names in use.

    ``names(name)`` holds raw tags; the order needs no per-kind window, so any vocabulary size works.
    """
    spark: SparkSession = names.sparkSession
    fixed = [("category", i, n) for i, n in enumerate(T.DEFAULT_CATEGORIES)]
    fixed += [("subcategory", i, n) for i, n in enumerate(T.DEFAULT_SUBCATEGORIES)]
    defaults = spark.createDataFrame(fixed, "kind string, default_position int, name string")
    tag = T.parse_tag(F.col("name"))
    used = names.select(tag["type"].alias("kind"), tag["name"].alias("name")).filter(
        F.col("kind").isin(*T.TAG_KINDS) & (F.col("name") != "")
    )
    rows = defaults.unionByName(used.withColumn("default_position", F.lit(None).cast("int")))
    rows = rows.groupBy("kind", "name").agg(F.min("default_position").alias("default_position"))
    return rows.orderBy("kind", F.asc_nulls_last("default_position"), F.lower("name"), "name")


def list_image_names(images: DataFrame) -> DataFrame:
    return images.select("style_code", "image_name", "sort_order").orderBy("style_code", "sort_order", "image_name")
