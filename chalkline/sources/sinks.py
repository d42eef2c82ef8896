"""Rows of the exported files, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.scalars import time_text
from chalkline.operators.shots import running_offsets

c = F.col


def shot_rows(shots: DataFrame) -> DataFrame:
    """The shot list: times and scores with three decimals, flags false where they are missing."""
    r = lambda x: F.round(x, 3)
    flag = lambda x: (F.coalesce(c(x), F.lit(False)) if x in shots.columns else F.lit(False))
    return shots.select(
        "job_id", "shot_id", *[r(c(x)).alias(x) for x in ("clip_start", "cue_strike", "clip_end")], r(F.greatest(F.lit(0.0), c("clip_end") - c("clip_start"))).alias("duration"),
        r(c("shot_confidence")).alias("confidence"), r(c("importance")).alias("importance"), flag("possible_replay").alias("possible_replay"),
        flag("manual_review_required").alias("review_required"), "included",
    )


def _joined(shots: DataFrame) -> DataFrame:
    """The clips of a job one after another, by number: their place on the joined recording and their rank."""
    order = Window.partitionBy("job_id").orderBy("shot_id")
    return running_offsets(shots, ["job_id"], "clip_start", "clip_end", "shot_id").withColumn("rank", F.row_number().over(order))


def _with_head(rows: DataFrame, head: list[str], body: Column) -> DataFrame:
    """Lines of a file per job (`line_no`, `line`): the head, then each row's array of lines, in order of rank."""
    n, each = len(head), F.posexplode(body).alias("k", "line")
    lines = rows.select("job_id", "rank", F.size(body).alias("m"), each).select("job_id", (F.lit(n + 1) + (c("rank") - 1) * c("m") + c("k")).alias("line_no"), "line")
    first = rows.select("job_id").distinct().select("job_id", F.posexplode(F.array(*[F.lit(x) for x in head])).alias("k", "line")).select("job_id", (c("k") + 1).alias("line_no"), "line")
    return lines.unionByName(first)


def decision_list(shots: DataFrame, title: str = "Export", source: Column | None = None) -> DataFrame:
    """An edit decision list per job: job_id, `line_no`, `line`. Events are numbered from 1 and name their shot and source
    (else the job); times are written with colons throughout."""
    colons = lambda x: F.replace(time_text(c(x)), F.lit("."), F.lit(":"))
    event = F.concat(F.lpad(c("rank").cast("string"), F.greatest(F.lit(3), F.length(c("rank").cast("string"))), F.lit("0")), F.lit("  AX       V     C        "), F.concat_ws(" ", *[colons(x) for x in ("clip_start", "clip_end", "rec_in", "rec_out")]))
    body = F.array(event, F.concat(F.lit("* FROM CLIP NAME: shot_"), _four()), F.concat(F.lit("* SOURCE FILE: "), source if source is not None else c("job_id").cast("string")))
    return _with_head(_joined(shots), [f"TITLE: {title}", "FCM: NON-DROP FRAME", ""], body)


def _four() -> Column:
    text = c("shot_id").cast("string")
    return F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0"))


def chapters(shots: DataFrame) -> DataFrame:
    """Chapters of the joined clips; a shot without a strike is named by its number only."""
    ms = lambda x: F.rint(c(x) * 1000).cast("bigint")
    title = F.concat(F.lit("Shot "), _four(), F.coalesce(F.concat(F.lit(" @ "), F.format_string("%.3f", c("cue_strike")), F.lit("s")), F.lit("")))
    return _joined(shots).select("job_id", "shot_id", "rank", ms("rec_in").alias("start_ms"), ms("rec_out").alias("end_ms"), F.when(c("cue_strike").isNull(), F.concat(F.lit("Shot "), _four())).otherwise(title).alias("title"))


def chapter_metadata(shots: DataFrame) -> DataFrame:
    """The chapters as lines of a metadata file per job: job_id, `line_no`, `line`."""
    body = F.array(
        F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), c("start_ms").cast("string")), F.concat(F.lit("END="), c("end_ms").cast("string")), F.concat(F.lit("title="), c("title"))
    )
    return _with_head(chapters(shots), [";FFMETADATA1"], body)


def chapter_list(shots: DataFrame) -> DataFrame:
    """Where each clip lies on the joined recording and in its source, as tab-separated lines per job; a missing strike is empty."""
    three = lambda x: F.when(c(x).isNotNull(), F.format_string("%.3f", c(x))).otherwise("")
    line = F.concat_ws("\t", three("rec_in"), three("clip_start"), three("clip_end"), c("shot_id").cast("string"), three("cue_strike"))
    return _with_head(_joined(shots), ["# edited_time\tsource_start\tsource_end\tshot_id\tcue_strike"], F.array(line))


def training_labels(shots: DataFrame) -> DataFrame:
    """One label record a shot, as JSON; fields that `shots` lacks are null."""
    own = lambda name, alias=None: (c(name) if name in shots.columns else F.lit(None).cast("double")).alias(alias or name)
    record = F.struct(
        "shot_id", own("preparation_start"), own("cue_strike"), own("ball_motion_start"), own("ball_motion_end"), c("clip_end").alias("reaction_end"), own("possible_replay"), own("user_modified"),
        own("shot_confidence", "confidence"),
    )
    return shots.select("job_id", "shot_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("label"))


def label_documents(shots: DataFrame, jobs: DataFrame) -> DataFrame:
    """One JSON document a job with its labels in order. jobs: job_id, `source_path`, `version`; a job without shots has none."""
    labels = training_labels(shots).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("shot_id", "label"))), lambda x: x["label"]).alias("_l"))
    rows = jobs.join(labels, "job_id", "left")
    text = F.concat(F.lit('{"head":'), F.to_json(F.struct("source_path", "job_id", "version")), F.lit(',"labels":['), F.coalesce(F.array_join("_l", ","), F.lit("")), F.lit("]}"))
    flat = F.regexp_replace(text, r'^\{"head":\{(.*)\},"labels"', r'{$1,"labels"')
    return rows.select("job_id", flat.alias("document"))


def write_rows(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Write rows partitioned by job: one folder a job, as the files are per recording."""
    writer = rows.write.partitionBy("job_id").mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(form).save(path)


def analysis_documents(shots: DataFrame, scenes: DataFrame) -> DataFrame:
    """One JSON document a job, with its shots and scenes nested."""
    nest = lambda df, name: df.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*[x for x in df.columns if x != "job_id"]))).alias(name))
    both = nest(shots, "shots").join(nest(scenes, "scenes"), "job_id", "full")
    return both.select("job_id", F.to_json(F.struct("job_id", "shots", "scenes")).alias("document"))
