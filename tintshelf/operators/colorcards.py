"""Colour-card libraries: listings, nearest colours, upserts, favourites."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintshelf.functions import color as C
from tintshelf.functions import text as T
from tintshelf.operators.catalog import contains_like
from tintshelf.operators.colorboxes import Boxes, Shelf
from tintshelf.operators.numbering import number_within
from tintshelf.session import spread

CARD_COLUMNS = ("library_id", "name", "note", "illuminant", "angle", "l", "a", "b", "hex", "spectral")
SPECTRAL = "array<struct<wavelength:int,value:double>>"
# Edge lengths of the Lab grid; values past the gamut fall into the outermost cells, so the grid has at most
# 12 * 18 * 18 cells however many cards there are.
GRID_L, GRID_AB = 10.0, 16.0
#: Cards that every task may hold (about 100 bytes each).
MAX_BROADCAST_CARDS = 500_000


@dataclass(frozen=True)
class CardStore:
    """libraries(id, name, source_file, sort_order), cards(library_id, name, note, illuminant, angle, l, a, b, hex,
    spectral), favorites(user_tag, library_id, name, created_at). A card is identified by (library_id, name).
    Cards without spectra get empty ones."""

    libraries: DataFrame
    cards: DataFrame
    favorites: DataFrame

    def __post_init__(self):
        object.__setattr__(self, "cards", _with_spectral(self.cards))


def _with_spectral(rows: DataFrame) -> DataFrame:
    """Rows with a ``spectral`` list; missing or null is empty."""
    given = F.col("spectral") if "spectral" in rows.columns else F.lit(None)
    return rows.withColumn("spectral", F.coalesce(given.cast(SPECTRAL), F.array().cast(SPECTRAL)))


def list_libraries(store: CardStore) -> DataFrame:
    counts = store.cards.groupBy(F.col("library_id").alias("id")).agg(F.count("*").alias("n"))
    return store.libraries.join(counts, "id", "left").select(
        "id", "name", "source_file", F.coalesce("n", F.lit(0)).alias("color_count"), "sort_order"
    ).orderBy("sort_order", F.lower("name"), "name")


def _named(store: CardStore) -> DataFrame:
    libraries = store.libraries.select(
        F.col("id").alias("library_id"), F.col("name").alias("library_name"), "sort_order"
    )
    return store.cards.join(libraries, "library_id")


def _keyword(keyword: str) -> Column:
    like = contains_like(keyword.strip())
    return F.col("name").ilike(like) | F.coalesce(F.col("note"), F.lit("")).ilike(like) | F.col("library_name").ilike(like)


def list_cards(store: CardStore, library: str = "", keyword: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of cards; ``library`` is a clean library id."""
    cards = _named(store)
    if library:
        cards = cards.filter(F.col("library_id") == library)
    if keyword.strip():
        cards = cards.filter(_keyword(keyword))
    order = ["sort_order", F.lower("library_name"), F.lower("name"), "library_id", "name"]
    return cards.orderBy(*order).offset(max(0, int(offset))).limit(max(1, min(int(limit), 300)))


def list_favorites(store: CardStore, user: str, keyword: str = "", limit: int = 300, offset: int = 0) -> DataFrame:
    """A user's favourite cards, newest first."""
    mine = store.favorites.filter(F.col("user_tag") == user.strip())
    cards = _named(store).join(mine, ["library_id", "name"])
    if keyword.strip():
        cards = cards.filter(_keyword(keyword))
    order = [F.desc("created_at"), F.desc("library_id"), F.desc("name")]
    return cards.orderBy(*order).offset(max(0, int(offset))).limit(max(1, min(int(limit), 1000)))


# ---- nearest colours ------------------------------------------------------------------------------------------


def _cell(l: Column, a: Column, b: Column) -> Column:
    def step(v: Column, low: float, size: float, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - low) / size).cast("int")))

    return (step(l, -10, GRID_L, 12) * 18 + step(a, -144, GRID_AB, 18)) * 18 + step(b, -144, GRID_AB, 18)


def _route(points: DataFrame, cells: Boxes, k: int, first: bool) -> DataFrame:
    """(l, a, b, reach, cell). ``first``: the closest cells that together hold k cards; else all others within reach."""

    def route(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 4096):
                part = pdf.iloc[start : start + 4096]
                bound = cells.lower_bound(part[["l", "a", "b"]].to_numpy(np.float64))
                order = np.argsort(bound, axis=1, kind="stable")
                n = cells.n[order]
                home = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(home, order, np.cumsum(n, axis=1) - n < k, axis=1)
                pick = home if first else ~home & (bound <= part["reach"].to_numpy(np.float64)[:, None] + 1e-6)
                row, cell = np.nonzero(pick)
                lists = np.split(cells.ids[cell], np.searchsorted(row, np.arange(1, len(part))))
                yield part[["l", "a", "b", "reach"]].assign(cells=lists)

    routed = points.mapInPandas(route, "l double, a double, b double, reach double, cells array<int>")
    return routed.select("l", "a", "b", "reach", F.explode("cells").alias("cell"))


def _score(routed: DataFrame, shelf: DataFrame, k: int) -> DataFrame:
    pairs = C.with_delta_e(routed.join(shelf, "cell"), ("l", "a", "b"), ("cl", "ca", "cb"))
    # A plain filter would be pushed below the staged projections and repeat the whole formula; a generator is not.
    de = F.round("delta_e_00", 6)
    within = F.explode(F.when(de <= F.col("reach"), F.array(de)).otherwise(F.array().cast("array<double>")))
    return _nearest(pairs.select("l", "a", "b", "library_id", "name", within.alias("delta_e_00")), k)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("l", "a", "b").orderBy("delta_e_00", "library_id", "name")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest_by_join(points: DataFrame, shelf: DataFrame, k: int) -> DataFrame:
    """The k closest cards of every distinct colour, by joins over a Lab grid: for more cards than a task can hold."""
    lab = ["l", "a", "b"]
    shelf = shelf.select("library_id", "name", *[F.col(c).alias(f"c{c}") for c in lab], _cell(*[F.col(c) for c in lab]).alias("cell"))
    summary = shelf.groupBy("cell").agg(
        F.count("*").alias("n"),
        *[F.min(f"c{c}").alias(f"{c}0") for c in lab], *[F.max(f"c{c}").alias(f"{c}1") for c in lab],
    ).collect()  # at most one row per grid cell
    cells = Boxes([[r[f"{c}0"] for c in lab] for r in summary], [[r[f"{c}1"] for c in lab] for r in summary], [r["n"] for r in summary])
    cells.ids = np.array([r["cell"] for r in summary], dtype=np.int32)
    near = _score(_route(points, cells, k, True), shelf, k)
    reach = near.groupBy(*lab).agg(F.max("delta_e_00").alias("far"), F.count("*").alias("got"))
    held = points.drop("reach").join(reach, lab, "left").withColumn(
        "reach", F.when(F.col("got") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    ).drop("far", "got")
    rest = _score(_route(held, cells, k, False), shelf, k)
    return _nearest(near.drop("rank").unionByName(rest.drop("rank")), k)


def _nearest_in_tasks(points: DataFrame, shelf: DataFrame, k: int) -> DataFrame:
    """The same, with all cards in every task: their number has been checked."""
    rows = shelf.orderBy("library_id", "name").select("library_id", "name", "l", "a", "b").toPandas()
    lab = rows[["l", "a", "b"]].to_numpy(np.float64)
    # Colours in the order of their first cards: the k closest cards are of the k closest colours, as each has a card.
    _, first, colour = np.unique(lab, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    colour = place[colour.reshape(-1)]
    of_colour, size = np.argsort(colour, kind="stable"), np.bincount(colour, minlength=len(order))
    sent = points.sparkSession.sparkContext.broadcast((rows["library_id"].to_numpy(object), rows["name"].to_numpy(object), Shelf(lab[first[order]]), of_colour, size))

    def match(batches):
        library, name, colours, of_colour, size = sent.value
        start = np.cumsum(size) - size
        for pdf in batches:
            asked = pdf[["l", "a", "b"]].to_numpy(np.float64)
            for part in colours.chunks(asked):
                row, at, distance, _ = colours.closest(asked[part], k)
                n = size[at]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                card = of_colour[np.repeat(start[at], n) + nth]
                row, card, distance, rank = Shelf._best(np.repeat(row, n), card, np.repeat(distance, n), k)
                where = part[row]
                yield pd.DataFrame({"l": asked[where, 0], "a": asked[where, 1], "b": asked[where, 2], "library_id": library[card], "name": name[card], "delta_e_00": distance, "rank": rank})

    return points.select("l", "a", "b").mapInPandas(match, "l double, a double, b double, library_id string, name string, delta_e_00 double, rank int")


def nearest_colors(
    readings: DataFrame, cards: DataFrame, k: int = 12, libraries: list[str] | None = None, max_broadcast_cards: int = MAX_BROADCAST_CARDS
) -> DataFrame:
    """readings(reading_id, l, a, b) to their k closest cards: (reading_id, rank, library_id, name, delta_e_00).

    Exact, without pairing every reading with every card. Equal readings are matched once, and of equally
    coloured cards only the first k by name can appear. Up to ``max_broadcast_cards`` cards go to all tasks, which
    hold them in boxes of a few cards and look only into boxes that a proven bound cannot exclude; more cards lie
    in a Lab grid that is joined with the readings. Ties go to (library_id, name). Distances are rounded to 6 places.
    """
    k = max(1, min(int(k), 100))
    if libraries:
        cards = cards.filter(F.col("library_id").isin(list(libraries)))
    first = Window.partitionBy("l", "a", "b").orderBy("library_id", "name")
    shelf = cards.select("library_id", "name", *[F.col(c).cast("double").alias(c) for c in "lab"]).withColumn(
        "_rn", F.row_number().over(first)
    ).filter(F.col("_rn") <= k).drop("_rn")
    asked = readings.select("reading_id", *[F.col(c).cast("double").alias(c) for c in "lab"])
    lab = ["l", "a", "b"]
    points = spread(asked.select(*lab), *lab).distinct().withColumn("reach", F.lit(float("inf")))
    few = shelf.limit(max_broadcast_cards + 1).count() <= max_broadcast_cards
    best = (_nearest_in_tasks if few else _nearest_by_join)(points, shelf, k)
    return asked.join(best, lab).select("reading_id", "rank", "library_id", "name", "delta_e_00")


# ---- maintenance ------------------------------------------------------------------------------------------------


def _last(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Last row per key by ``order``, without a window over the key."""
    rest = [c for c in rows.columns if c not in key and c != order]
    top = rows.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return top.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [order, *rest]])


def _text(name: str) -> Column:
    return T.strip(F.coalesce(F.col(name), F.lit("")))


def _hex() -> Column:
    return C.lab_to_hex(F.col("l"), F.col("a"), F.col("b"))


def replace_libraries(store: CardStore, libraries: DataFrame, rows: DataFrame) -> CardStore:
    """Load whole libraries: libraries(id, name, source_file, sort_order), rows(library_id, seq, name, note, ..,
    spectral).

    Old cards of these libraries go, and with them favourites whose card is not among the new ones. Blank
    names are dropped, the last of equal names wins, a missing hex is computed.
    """
    new = _with_spectral(rows).withColumn("name", _text("name")).filter("name <> ''")
    new = _last(new.select("library_id", "name", "seq", "note", "illuminant", "angle", "l", "a", "b", "hex", "spectral"), ["library_id", "name"])
    new = new.select(
        "library_id", "name", _text("note").alias("note"), _text("illuminant").alias("illuminant"), "angle",
        *[F.col(c).cast("double").alias(c) for c in "lab"], F.upper(F.coalesce(F.nullif(F.col("hex"), F.lit("")), _hex())).alias("hex"), "spectral",
    )
    loaded = libraries.select(F.col("id").alias("library_id"))
    cards = store.cards.join(loaded, "library_id", "left_anti").select(*CARD_COLUMNS).unionByName(new)
    libs = store.libraries.join(libraries, "id", "left_anti").unionByName(libraries.select(*store.libraries.columns))
    favorites = store.favorites.join(cards.select("library_id", "name"), ["library_id", "name"], "left_semi")
    return CardStore(libs, cards, favorites.select(*store.favorites.columns))


def upsert_libraries(store: CardStore, requests: DataFrame) -> CardStore:
    """requests(seq, id, name): new libraries are put behind the last one in request order, known ones renamed.

    Libraries are a small dimension; only distinct new ids are numbered.
    """
    r = requests.select("seq", F.coalesce(F.nullif(T.library_id(F.col("id")), F.lit("")), T.library_id(F.col("name"))).alias("id"), _text("name").alias("name"))
    r = r.filter("id <> '' AND name <> ''")
    ends = r.groupBy("id").agg(F.min("seq").alias("seq"), F.max(F.struct("seq", "name"))["name"].alias("new_name"))
    fresh = ends.join(store.libraries, "id", "left_anti")
    fresh = number_within(fresh.withColumn("_all", F.lit(1)), ["_all"], ["seq", "id"], "nth")
    top = store.libraries.agg(F.coalesce(F.max("sort_order"), F.lit(0)).alias("top"), F.lit(1).alias("_all"))
    fresh = fresh.join(F.broadcast(top), "_all").select(  # one row
        "id", F.col("new_name").alias("name"), F.lit("manual").alias("source_file"),
        (F.col("top") + F.col("nth") + 1).cast("int").alias("sort_order"),
    )
    known = store.libraries.join(ends.select("id", "new_name"), "id", "left").select(
        "id", F.coalesce("new_name", "name").alias("name"), "source_file", "sort_order"
    )
    return replace(store, libraries=known.unionByName(fresh))


def upsert_cards(store: CardStore, requests: DataFrame) -> CardStore:
    """requests(seq, library_id, library_name, name, note, illuminant, angle, l, a, b, spectral): insert or overwrite
    by (library, name), creating libraries as needed; the hex is always recomputed, a request without spectrum empties it."""
    lib = F.coalesce(F.nullif(T.library_id(F.col("library_id")), F.lit("")), T.library_id(F.col("library_name")))
    r = _with_spectral(requests).withColumn("library_id", lib).withColumn("name", _text("name")).filter("library_id <> '' AND name <> ''")
    lib_name = F.coalesce(F.nullif(_text("library_name"), F.lit("")), F.col("library_id"))
    store = upsert_libraries(store, r.select("seq", F.col("library_id").alias("id"), lib_name.alias("name")))
    new = _last(r.select("library_id", "name", "seq", "note", "illuminant", "angle", "l", "a", "b", "spectral"), ["library_id", "name"])
    new = new.select(
        "library_id", "name", _text("note").alias("note"), _text("illuminant").alias("illuminant"), "angle",
        *[F.col(c).cast("double").alias(c) for c in "lab"], _hex().alias("hex"), "spectral",
    )
    old = store.cards.join(new, ["library_id", "name"], "left_anti").select(*CARD_COLUMNS)
    return replace(store, cards=old.unionByName(new))


def add_favorites(store: CardStore, requests: DataFrame) -> CardStore:
    """requests(user_tag, library_id, name, created_at): insert or ignore, existing cards only."""
    r = requests.withColumn("user_tag", _text("user_tag")).filter("user_tag <> ''")
    r = r.join(store.cards, ["library_id", "name"], "left_semi")
    r = r.groupBy("user_tag", "library_id", "name").agg(F.min("created_at").alias("created_at"))
    fresh = r.join(store.favorites, ["user_tag", "library_id", "name"], "left_anti")
    return replace(store, favorites=store.favorites.unionByName(fresh.select(*store.favorites.columns)))


def user_library(user: Column) -> Column:
    return F.concat(F.lit("my_color_"), F.substring(T.library_id(user), 1, 60))


def add_picked_favorites(store: CardStore, requests: DataFrame) -> CardStore:
    """requests(seq, user_tag, name, l, a, b, hex, created_at): a picked colour joins the user's own library and favourites."""
    picked = F.upper(T.strip(F.translate(F.coalesce(F.col("hex"), F.lit("")), "#", "")))
    r = requests.withColumn("user_tag", _text("user_tag")).filter("user_tag <> ''").withColumn("picked", picked)
    shown = F.coalesce(F.nullif(F.col("picked"), F.lit("")), _hex())
    r = r.withColumn("name", F.coalesce(F.nullif(_text("name"), F.lit("")), F.concat(F.lit("取色 #"), shown)))
    r = r.withColumn("library_id", user_library(F.col("user_tag")))
    cards = r.select(
        "seq", "library_id", F.lit("我的收藏").alias("library_name"), "name", F.col("name").alias("note"),
        F.lit("D65").alias("illuminant"), F.lit(10.0).alias("angle"), "l", "a", "b",
    )
    store = upsert_cards(store, cards)
    given = _last(r.select("library_id", "name", "seq", "picked"), ["library_id", "name"]).filter("picked <> ''")
    fixed = store.cards.join(given.select("library_id", "name", "picked"), ["library_id", "name"], "left").select(
        *[F.coalesce("picked", "hex").alias("hex") if c == "hex" else F.col(c) for c in CARD_COLUMNS]
    )
    return add_favorites(replace(store, cards=fixed), r.select("user_tag", "library_id", "name", "created_at"))


def remove_favorites(store: CardStore, requests: DataFrame) -> CardStore:
    """requests(user_tag, library_id, name): drop favourites; a card in the user's own library goes with it."""
    r = requests.withColumn("user_tag", _text("user_tag"))
    own = r.filter(F.col("library_id") == user_library(F.col("user_tag"))).select("library_id", "name")
    cards = store.cards.join(own, ["library_id", "name"], "left_anti")
    favorites = store.favorites.join(r, ["user_tag", "library_id", "name"], "left_anti")
    favorites = favorites.join(own, ["library_id", "name"], "left_anti")
    return replace(store, cards=cards.select(*CARD_COLUMNS), favorites=favorites.select(*store.favorites.columns))


def remove_cards(store: CardStore, gone: DataFrame) -> CardStore:
    """gone(library_id, name): cards of ``custom_`` libraries with their favourites; others are refused (kept)."""
    g = gone.filter(F.startswith("library_id", F.lit("custom_")))
    return replace(
        store,
        cards=store.cards.join(g, ["library_id", "name"], "left_anti").select(*CARD_COLUMNS),
        favorites=store.favorites.join(g, ["library_id", "name"], "left_anti").select(*store.favorites.columns),
    )


def remove_libraries(store: CardStore, gone: DataFrame, allow_builtin: bool = False) -> CardStore:
    """gone(id): libraries with cards and favourites; built-in ones only when allowed."""
    g = gone.select(T.library_id(F.col("id")).alias("id"))
    if not allow_builtin:
        g = g.filter(F.startswith("id", F.lit("custom_")))
    by_card = g.withColumnRenamed("id", "library_id")
    return CardStore(
        store.libraries.join(g, "id", "left_anti"),
        store.cards.join(by_card, "library_id", "left_anti").select(*CARD_COLUMNS),
        store.favorites.join(by_card, "library_id", "left_anti").select(*store.favorites.columns),
    )
