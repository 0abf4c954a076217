"""Ordered merge with any criteria, and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Criterion = Callable[[dict, dict, list[dict]], bool]


def same(field: str) -> Criterion:
    return lambda acc, cur, parts: acc[field] == cur[field]


def reaches(threshold: int = 0) -> Criterion:
    """The candidate begins at most ``threshold`` bases after the end that was reached."""
    return lambda acc, cur, parts: acc["start_pos"] <= cur["start_pos"] <= acc["end_pos"] + 1 + threshold


def exact() -> Criterion:
    return lambda acc, cur, parts: acc["start_pos"] == cur["start_pos"] and acc["end_pos"] == cur["end_pos"]


def reaches_back() -> Criterion:
    """The candidate ends within the running one, or just before it."""
    return lambda acc, cur, parts: acc["start_pos"] - 1 <= cur["end_pos"] <= acc["end_pos"]


def either(*criteria: Criterion) -> Criterion:
    return lambda acc, cur, parts: any(c(acc, cur, parts) for c in criteria)


def touches() -> Criterion:
    """Overlap or contact on either side."""
    return either(reaches(), reaches_back())


def near_end(distance: int) -> Criterion:
    """The candidate begins at most so far from the end that was reached, on either side."""
    return lambda acc, cur, parts: -distance <= cur["start_pos"] - acc["end_pos"] <= distance


def near_start(distance: int) -> Criterion:
    """The candidate ends at most so far from where the running one begins."""
    return lambda acc, cur, parts: -distance <= cur["end_pos"] - acc["start_pos"] <= distance


def near(distance: int) -> Criterion:
    return either(near_end(distance), near_start(distance))


DEFAULT = (same("seqid"), reaches(), same("strand"), same("featuretype"))


def fold_rows(rows: list[dict], criteria: tuple[Criterion, ...] = DEFAULT) -> list[dict]:
    """Merge rows in the order given: each joins the running one if all criteria hold."""
    out: list[dict] = []
    parts: list[dict] = []
    for cur in rows:
        if out and all(c(out[-1], cur, parts) for c in criteria):
            out[-1]["end_pos"] = max(out[-1]["end_pos"], cur["end_pos"])
            out[-1]["n_parts"] += 1
            parts.append(cur)
        else:
            out.append(dict(cur) | {"n_parts": 1})
            parts = [cur]
    return out


def merge_with(features: DataFrame, criteria: tuple[Criterion, ...] = DEFAULT, reach: int = 0) -> DataFrame:
    """``fold_rows`` over features in order of (seqid, start, end, id).

    The fold is cut where a row begins over ``reach`` bases after all before it end:
    no criterion that needs overlap within ``reach`` merges across, so each cluster
    is folded alone, and a task holds one cluster.
    """
    w = Window.partitionBy("seqid").orderBy("start_pos", "end_pos", "id")
    before = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(F.col("start_pos") <= before + 1 + reach, 0).otherwise(1)
    own = features.select("id", "seqid", "featuretype", "start_pos", "end_pos", "strand")
    clusters = own.withColumn("_c", cut).withColumn("_c", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["start_pos", "end_pos", "id"]).drop(columns="_c").to_dict("records")
        return pd.DataFrame(fold_rows(rows, criteria))

    return clusters.groupBy("seqid", "_c").applyInPandas(run, "id string, seqid string, featuretype string, start_pos long, end_pos long, strand string, n_parts long")


def bootstrap_mean(df: DataFrame, key: str, value: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """95 % interval of the mean by Poisson bootstrap: (mean, low, high).

    Every row draws a Poisson weight for each replicate from a generator seeded by
    its key, so rows need not meet; partial sums are added up.  With many rows the
    interval is that of resampling with replacement.
    """
    def run(frames):
        total = np.zeros((2, replicates))
        for frame in frames:
            for h, v in zip(frame["h"], frame["v"]):
                w = np.random.default_rng([seed, h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF]).poisson(1.0, replicates)
                total[0] += w
                total[1] += w * v
        yield pd.DataFrame({"r": np.arange(replicates), "n": total[0], "s": total[1]})

    own = df.filter(F.col(value).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(value).cast("double").alias("v"))
    sums = own.mapInPandas(run, "r int, n double, s double").groupBy("r").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    bounds = sums.filter("n > 0").agg(F.percentile(F.col("s") / F.col("n"), F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    mean = own.agg(F.avg("v").alias("mean"))
    return mean.withColumn("p", bounds.scalar()).select("mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
