"""Lanes: clusters of a session's videos by their descriptors, and measures of them.

Sessions are the unit of work: a session's clips, tens to some thousands, are clustered
in one task, and sessions run side by side. Pair measures are joins within a session.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import vectors as V


def merges(distance: np.ndarray) -> np.ndarray:
    """(left, right, height) of the n - 1 merges of n items by least mean distance, a cluster going by its earliest member.

    Of equal distances the pair of the earliest members merges first. A cluster keeps the
    nearest of those after it; a merge brings nothing nearer than the nearer of its parts,
    so what a cluster keeps stays a lower bound, and is looked up anew only where it comes up
    as the least and one of the two has merged since. Sums of distances are kept, not means,
    so that equal means stay equal. Time is about n^2, memory n^2.
    """
    n = len(distance)
    total = distance.astype(float)
    size = np.ones(n)
    near, bound = np.zeros(n, int), np.full(n, np.inf)
    alive = np.ones(n, bool)

    def look(i: int) -> None:
        mean = total[i, i + 1 :] / (size[i] * size[i + 1 :])
        mean[~alive[i + 1 :]] = np.inf
        k = int(np.argmin(mean)) if len(mean) else -1
        near[i], bound[i] = (i + 1 + k, mean[k]) if k >= 0 and mean[k] < np.inf else (-1, np.inf)

    for i in range(n):
        look(i)
    known = np.ones(n, bool)
    out = np.zeros((max(0, n - 1), 3))
    for step in range(n - 1):
        while not known[i := int(np.argmin(bound))]:
            look(i)
            known[i] = True
        j = near[i]
        out[step] = i, j, bound[i]
        total[i] += total[j]
        total[:, i] = total[i]
        size[i] += size[j]
        alive[j], bound[j] = False, np.inf
        look(i)
        known[i] = True
        # clusters before i: the merged one may be as near as what they keep, and what they keep may be gone
        mean = total[:i, i] / (size[:i] * size[i])
        before = alive[:i]
        gone = before & ((near[:i] == i) | (near[:i] == j))
        nearer = before & ((mean < bound[:i]) | ((mean == bound[:i]) & (i < near[:i])))
        known[:i][gone] = False
        at = np.flatnonzero(nearer)
        near[at], bound[at], known[at] = i, mean[at], known[at] | (mean[at] < bound[at])
        # those between keep what they have unless it was j
        known[i + 1 : j][alive[i + 1 : j] & (near[i + 1 : j] == j)] = False
    return out


def average_linkage(distance: np.ndarray, counts: list[int]) -> dict[int, np.ndarray]:
    """Labels from 1, in the order of earliest members, for each count of clusters; counts above n give n clusters."""
    n = len(distance)
    member, out, steps = np.arange(n), {}, merges(distance)
    for left in range(n, 0, -1):
        if left in counts:
            _, label = np.unique(member, return_inverse=True)
            out[left] = label + 1
        if left > 1:
            i, j = steps[n - left, :2].astype(int)
            member[member == j] = i
    for k in counts:
        if k > n and n:
            out[k] = out.get(n, np.arange(1, n + 1))
    return out


def lanes(videos: DataFrame, session: str, video: str, vector: str, counts: list[int]) -> DataFrame:
    """(session, lane_count, video, lane): average-linkage clusters for each count up to the session's size.

    Videos without a vector become lanes of their own, after the others, for each count.
    """
    kinds = {c: videos.schema[c].dataType.simpleString() for c in (session, video)}

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(video)
        has = df[df[vector].notna()]
        x = np.array([np.asarray(v, float) for v in has[vector]]) if len(has) else np.zeros((0, 0))
        distance = np.clip(1 - np.maximum(x @ x.T, 0), 0, 1) if len(has) else np.zeros((0, 0))
        parts = []
        wanted = [k for k in counts if k <= max(1, len(has))]
        for k, label in average_linkage(distance, wanted).items():
            rest = df[df[vector].isna()]
            names = [*has[video], *rest[video]]
            parts.append(pd.DataFrame({session: df[session].iloc[0], "lane_count": k, video: names, "lane": [*label, *range(label.max() + 1, label.max() + 1 + len(rest))]}))
        return pd.concat(parts) if parts else pd.DataFrame({session: [], "lane_count": [], video: [], "lane": []})

    return videos.select(session, video, vector).groupBy(session).applyInPandas(run, f"`{session}` {kinds[session]}, lane_count int, `{video}` {kinds[video]}, lane int")


def distances(items: DataFrame, group: str, item: str, vector: str) -> DataFrame:
    """(group, a, b, d) for a < b within a group."""
    left = items.select(group, F.col(item).alias("a"), F.col(vector).alias("va"))
    right = items.select(group, F.col(item).alias("b"), F.col(vector).alias("vb"))
    return left.join(right, group).where("a < b").select(group, "a", "b", V.distance(F.col("va"), F.col("vb")).alias("d"))


def spread(items: DataFrame, group: str, item: str, vector: str) -> DataFrame:
    """(group, spread): the greatest distance within a group; 0 for one item."""
    far = distances(items, group, item, vector).groupBy(group).agg(F.max("d").alias("far"))
    return items.select(group).distinct().join(far, group, "left").select(group, F.coalesce("far", F.lit(0.0)).alias("spread"))


def mean_vectors(items: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, mean), pos from 0; null vectors are left out."""
    return items.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroids(items: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): the mean of a group's vectors at unit length; groups without a vector have none."""
    rows = mean_vectors(items, group, vector).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("x"))
    return rows.select(group, V.l2_normalized(F.transform("x", lambda r: r["mean"])).alias("centroid"))


def silhouette(items: DataFrame, item: str, label: str, vector: str, within: str | None = None) -> DataFrame:
    """(within, silhouette): the mean over items of (b - a) / max(a, b); 0 for items alone in their cluster, and for one cluster or none.

    Distances are summed by pairs of item and cluster before anything is compared, so one
    row for each of them leaves the join.
    """
    base = items.select((F.col(within) if within else F.lit(0)).alias("w"), F.col(item).alias("i"), F.col(label).alias("l"), F.col(vector).alias("v"))
    other = base.select("w", F.col("i").alias("j"), F.col("l").alias("m"), F.col("v").alias("u"))
    per = base.join(other, "w").where("i <> j").groupBy("w", "i", "l", "m").agg(F.avg(V.distance(F.col("v"), F.col("u"))).alias("d"))
    ab = per.groupBy("w", "i").agg(F.max(F.when(F.col("l") == F.col("m"), F.col("d"))).alias("a"), F.min(F.when(F.col("l") != F.col("m"), F.col("d"))).alias("b"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") < 1e-6), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    out = ab.groupBy("w").agg(F.avg(score).alias("silhouette"))
    sessions = base.select("w").distinct()
    full = sessions.join(out, "w", "left").select("w", F.coalesce("silhouette", F.lit(0.0)).alias("silhouette"))
    return full.withColumnRenamed("w", within) if within else full.drop("w")


def lane_order(lane_members: DataFrame, lane: str, path: str, *within: str) -> DataFrame:
    """(*within, lane, first): lanes are labelled in the order of their least path."""
    return lane_members.groupBy(*within, lane).agg(F.min(path).alias("first"))
