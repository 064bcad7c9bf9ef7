"""Isotonic calibration as a table of steps: fitted range by range of confidence, merged where ranges meet, applied by a join."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirador.sources.scratch import Tables

RANGES = 128
#: Distinct confidences that are worth a range of their own; with few there are fewer ranges, which changes no result.
WORTH = 4096
#: Ranges that are merged in one task at most.
TOGETHER = 8
STEP_TYPE = "lo double, hi double, total long, n long, weighted double"


def range_bounds(values: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """Up to ranges - 1 values that cut a table of distinct values into about equal ranges; NaN counts for none."""
    parts = [i / ranges for i in range(1, ranges)]
    if not parts:
        return []
    found = values.where(~F.isnan(column)).agg(F.percentile_approx(column, parts, 20 * ranges).alias("q")).first()["q"]
    return sorted(set(found or []))


def ranges_for(values: DataFrame, ranges: int | None = None) -> int:
    """How many ranges a table of distinct values is cut into: as given, else by their number."""
    return ranges or min(RANGES, values.count() // WORTH + 1)


def range_of(value: Column, bounds: list[float]) -> Column:
    """The number of the range that a value lies in; NaN is in the last."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>"), lambda b: b <= value))


def pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Steps of rows or steps: neighbours whose means do not rise are one step. Sums are whole numbers, so means compare exactly."""
    out: list[list] = []
    for lo, hi, total, n, weighted in rows.sort_values("lo")[["lo", "hi", "total", "n", "weighted"]].itertuples(index=False):
        step = [lo, hi, int(total), int(n), weighted]
        while out and out[-1][2] * step[3] >= step[2] * out[-1][3]:
            before = out.pop()
            step = [before[0], step[1], before[2] + step[2], before[3] + step[3], before[4] + step[4]]
        out.append(step)
    return pd.DataFrame(out, columns=["lo", "hi", "total", "n", "weighted"])


@dataclass
class Calibration:
    """steps: part (range of lo), lo, hi, y, n, weighted (sum of confidences), next_lo and next_y (null for the last); bounds: of the ranges."""

    steps: DataFrame
    bounds: list[float]


def _runs(ends: list, together: int) -> dict[int, int]:
    """Ranges to merge by the first of their run: neighbours of which the last step of one does not lie below the first of the next."""
    out: dict[int, int] = {}
    begin, size = None, 0
    for a, b in zip(ends, ends[1:], strict=False):
        if a["last"]["total"] * b["first"]["n"] >= b["first"]["total"] * a["last"]["n"]:
            if begin is None or size >= together or a["part"] not in out:
                begin, size = a["part"], 1
                if a["part"] in out:  # that run is full; what is left waits for the next turn
                    begin = None
                    continue
            out[a["part"]] = out[b["part"]] = begin
            size += 1
        else:
            begin = None
    return out


def isotonic_steps(targets: DataFrame, ranges: int | None = None, together: int = TOGETHER) -> Calibration:
    """The isotonic fit of targets (x, a float, and y, 0 or 1), as steps of equal value.

    Rows are pooled by confidence, the distinct confidences cut into ranges by quantiles, and each range is fitted by itself. Then
    ranges whose steps violate the order where they meet are merged, `together` at most in a task, until none violates it: what
    has been pooled stays pooled in the fit of the whole. A step belongs to the range of its beginning, so ranges keep their
    size. The driver sees two steps of each range. Null and NaN confidences and null targets take no part; no rows are an error."""
    spark = targets.sparkSession
    x = F.col("x").cast("double")
    rows = targets.where("x is not null and y is not null").where(~F.isnan("x")).groupBy(x.alias("lo")).agg(F.sum(F.col("y").cast("long")).alias("total"), F.count("*").alias("n"))
    with Tables(spark) as tables:
        points = tables.write(rows.select("lo", F.col("lo").alias("hi"), "total", "n", (F.col("lo") * F.col("n")).alias("weighted")), "points")
        if points.isEmpty():
            raise ValueError("no confidence and target pairs to calibrate on")
        bounds = range_bounds(points, "lo", ranges_for(points, ranges))
        placed = lambda df: df.withColumn("part", range_of(F.col("lo"), bounds))
        steps = tables.write(placed(placed(points).groupBy("part").applyInPandas(pool, STEP_TYPE)), "steps")
        side = F.struct("lo", "total", "n")
        while True:
            ends = sorted(steps.groupBy("part").agg(F.min(side).alias("first"), F.max(side).alias("last")).collect())  # a row for each range
            merged = _runs(ends, together)
            if not merged:
                break
            run = F.create_map(*[F.lit(v) for kv in merged.items() for v in kv])
            pooled = steps.where(F.col("part").isin(*merged)).groupBy(F.try_element_at(run, "part").alias("run")).applyInPandas(pool, STEP_TYPE)
            steps = tables.write(steps.where(~F.col("part").isin(*merged)).unionByName(placed(pooled)), "steps")
        value = lambda s: s["total"] / s["n"]
        after = {a["part"]: (b["first"]["lo"], value(b["first"])) for a, b in zip(ends, ends[1:], strict=False)}
        told = spark.createDataFrame([(p, *v) for p, v in after.items()] or [(-1, 0.0, 0.0)], "part int, after_lo double, after_y double")
        from pyspark.sql import Window

        w = Window.partitionBy("part").orderBy("lo")
        y = (F.col("total") / F.col("n")).cast("double")
        steps = steps.withColumn("y", y).withColumns({"next_lo": F.lead("lo").over(w), "next_y": F.lead("y").over(w)}).join(F.broadcast(told), "part", "left")
        out = steps.select("part", "lo", "hi", "y", "n", "weighted", F.coalesce("next_lo", "after_lo").alias("next_lo"), F.coalesce("next_y", "after_y").alias("next_y"))
        return Calibration(tables.write(out, "calibration", keep=True), bounds)


def apply_steps(rows: DataFrame, model: Calibration, column: str = "raw_confidence", into: str = "calibrated_confidence", most: int = 100_000) -> DataFrame:
    """rows with the calibrated value: of the step that a confidence lies in, between two steps on the line between them, beyond
    all steps that of the nearest; null stays null and NaN NaN. Rows meet the steps of their range alone; steps are broadcast
    if there are `most` at most."""
    s = model.steps
    last = len(model.bounds)
    first = s.agg(F.min("lo").alias("lo")).first()["lo"]
    until = F.coalesce(range_of(F.col("next_lo"), model.bounds), F.lit(last))
    begin = F.when(F.col("lo") == first, 0).otherwise(F.col("part"))
    spread = s.select("lo", "hi", "y", "next_lo", "next_y", F.explode(F.sequence(begin, F.greatest(begin, F.when(F.col("next_lo").isNull(), last).otherwise(until)))).alias("_range"))
    spread = spread.select("_range", *[F.col(c).alias(f"_{c}") for c in ("lo", "hi", "y", "next_lo", "next_y")])
    spread = F.broadcast(spread) if s.count() <= most else spread
    x = F.col(column).cast("double")
    known = rows.withColumn("_x", F.when(~F.isnan(x), x)).withColumn("_at", F.when(F.col("_x").isNotNull(), range_of(F.col("_x"), model.bounds)))
    inside = (F.col("_at") == F.col("_range")) & ((F.col("_x") >= F.col("_lo")) | (F.col("_lo") == first)) & (F.col("_next_lo").isNull() | (F.col("_x") < F.col("_next_lo")))
    line = F.col("_y") + (F.col("_next_y") - F.col("_y")) * (F.col("_x") - F.col("_hi")) / (F.col("_next_lo") - F.col("_hi"))
    value = F.when(F.col("_x").isNull(), x).when((F.col("_x") <= F.col("_hi")) | F.col("_next_lo").isNull(), F.col("_y")).otherwise(line)
    return known.join(spread, inside, "left").withColumn(into, value).select(*[c for c in rows.columns if c != into], into)


def thresholds(model: Calibration) -> DataFrame:
    """One row, the artifact: method, x_thresholds and y_thresholds (both ends of each step), num_samples and the two means."""
    ends = F.when(F.col("hi") > F.col("lo"), F.array(F.struct(F.col("lo").alias("x"), "y"), F.struct(F.col("hi").alias("x"), "y"))).otherwise(F.array(F.struct(F.col("lo").alias("x"), "y")))
    n = F.sum("n")
    got = model.steps.agg(F.array_sort(F.flatten(F.collect_list(ends))).alias("p"), n.cast("int").alias("num_samples"), (F.sum("weighted") / n).alias("mean_raw_confidence"), (F.sum(F.col("y") * F.col("n")) / n).alias("mean_calibrated_confidence"))
    return got.select(F.lit("isotonic_regression").alias("method"), F.transform("p", lambda v: v["x"]).alias("x_thresholds"), F.transform("p", lambda v: v["y"]).alias("y_thresholds"), "num_samples", "mean_raw_confidence", "mean_calibrated_confidence")
