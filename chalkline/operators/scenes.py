"""Scenes from the cuts of a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.operators.folds import spaced
from chalkline.operators.joins import within
from chalkline.operators.timeline import KEYS
from chalkline.operators.windows import Window

c = F.col


def segment(rows: DataFrame, cut: str, least_s: float = 0.4) -> DataFrame:
    """Scenes of each recording: KEYS, `start`, `end`, `view_type`, `n`.

    Scenes begin with the recording and with its cuts, cuts being half of `least_s` apart at least; a scene shorter than
    `least_s` is part of the one before. `view_type` is that of the row nearest to the middle, the earlier of two.
    """
    ends = rows.groupBy(*KEYS).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    cuts = spaced(rows.where(c(cut)).select(*KEYS, "t"), least_s / 2, "t")
    starts = cuts.unionByName(ends.select(*KEYS, c("first").alias("t"))).distinct()
    order = Window.partitionBy(*KEYS).orderBy("t")
    joined = starts.join(ends, KEYS)
    long = joined.withColumn("_next", F.coalesce(F.lead("t").over(order), c("last"))).where((c("_next") - c("t") >= least_s) | (c("t") == c("first")))
    spans = long.withColumn("end", F.coalesce(F.lead("t").over(order), c("last"))).select(*KEYS, c("t").alias("start"), "end", (c("last") == c("end")).alias("final"))
    found = within(rows.select(*KEYS, "t", "view_type"), spans, KEYS, "t", "start", "end").where((c("t") < c("end")) | c("final"))
    middle = F.abs(c("t") - (c("start") + c("end")) / 2)
    return found.groupBy(*KEYS, "start", "end").agg(F.min_by("view_type", F.struct(middle, c("t"))).alias("view_type"), F.count(F.lit(1)).alias("n"))
