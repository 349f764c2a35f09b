"""Connected components of links between whole numbers, by large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). A node's
least neighbour comes from a grouped minimum, which is partly taken before the
shuffle, so a node with many links is no hot group; the join that follows is
one that adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _step(links: DataFrame, both: bool) -> DataFrame:
    """Links (u, v) with u > v. Large-star (both): a node links its greater neighbours to its least; small-star: its lesser ones and itself."""
    if both:
        seen = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = seen.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every node of links (a, b) but the roots: the least node of each component.

    Loops and repeated links are dropped; links with a null are no links.
    Each round is written to the shared folder, which cuts the lineage. The
    driver gets a count and a sum a round, never links.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "links", narrow=True)
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(e)
    while was[0]:
        e = materialize(_step(_step(e, True), False), "links", narrow=True)
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links each node of the links (a, b) to the least of its component: at most one link a node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]
