"""Connected components of a link table, in DataFrame operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintshelf.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(v, c) for every id in ``links`` (a, b): c is the smallest id that links reach.

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains shorten by
    half. Hubs are summed partially before the shuffle; labels are stored each round, so that the joins have an exchange
    on either side that adaptive execution can split. Empty links give no rows.
    """
    both = stored(links.select("a", "b").filter("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b")).distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("v"), "c"))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("c").alias("m"))
        lower = stored(labels.join(near, labels["v"] == near["a"], "left").select("v", F.least("c", "m").alias("c"), F.col("c").alias("old")))
        root = lower.select(F.col("v").alias("r"), F.col("c").alias("rc"))
        nxt = stored(lower.join(root, lower["c"] == root["r"], "left").select("v", F.least("c", "rc").alias("c"), "old"))
        changed = nxt.filter("c <> old").limit(1).count()
        labels = nxt.select("v", "c")
        if not changed:
            return labels


def tile_links(ids: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
    """What a tile's links (positions i, j) tell of its members (rep, links, near): weight of the links, smallest id joined here.

    ``ids`` are sorted. One row for each member with a link, never one for a pair.
    """
    n = len(ids)
    links = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]  # and the label of that label
        if (low == label).all():
            break
        label = low
    keep = links > 0
    return pd.DataFrame({"rep": ids[keep], "links": links[keep].astype(np.int64), "near": ids[label[keep]]})
