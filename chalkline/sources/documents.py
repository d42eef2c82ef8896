"""Nested JSON documents and media metadata as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.scalars import fraction, variable_rate

c = F.col

#: A label file: shots under one of three names, or a bare list.
_LABEL = "struct<cue_strike: double, timestamp: double, event_type: string, ball_motion_end: double, end: double>"
MEDIA = ("mp4", "mov", "mkv", "avi", "webm", "m4v", "mpg", "mpeg")


def truth_events(documents: DataFrame, key: str, body: str) -> DataFrame:
    """True events of label documents: key, `cue_strike`, `ball_motion_end`.

    A document is an object with a non-empty list under labels, shots or events (the first that has one), or a bare
    list. An item counts if it has a cue_strike, or a timestamp and the type cue_strike; its end is ball_motion_end or end,
    else 3 s later. 0 and an empty list count as missing. Documents that cannot be parsed give nothing.
    """
    wrapped = F.from_json(body, f"struct<labels: array<{_LABEL}>, shots: array<{_LABEL}>, events: array<{_LABEL}>>")
    filled = lambda a: F.when(F.size(a) > 0, a)
    bare = F.when(F.trim(c(body)).startswith("["), F.from_json(body, f"array<{_LABEL}>"))
    items = F.coalesce(bare, *[filled(wrapped[name]) for name in ("labels", "shots", "events")])
    rows = documents.select(key, F.inline(items))
    some = lambda x: F.nullif(c(x), F.lit(0.0))
    strike = F.coalesce(some("cue_strike"), F.when(c("event_type") == "cue_strike", c("timestamp")))
    return rows.select(key, strike.alias("cue_strike"), F.coalesce(some("ball_motion_end"), some("end")).alias("_end")).where("cue_strike is not null").select(
        key, "cue_strike", F.coalesce("_end", c("cue_strike") + 3.0).alias("ball_motion_end")
    )


def read_text_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole files below a path, as `folder` (the last one of their path), `name` and `body`."""
    files = spark.read.text(pattern, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("body"), F.input_file_name().alias("_p"))
    parts = F.split("_p", "/")
    return files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "body")


def dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and truth of a data set with one folder a video: (folder, p), (folder, g) with their ends.

    Predictions come from predictions.json, else analysis.json; folders without both sides are left out.
    """
    files = read_text_documents(spark, folder).where(c("name").isin("predictions.json", "analysis.json", "ground_truth.json"))
    sides = files.groupBy("folder").agg(
        F.coalesce(F.max(F.when(c("name") == "predictions.json", c("body"))), F.max(F.when(c("name") == "analysis.json", c("body")))).alias("predicted"),
        F.max(F.when(c("name") == "ground_truth.json", c("body"))).alias("truth"),
    ).where("predicted is not null and truth is not null")
    named = lambda side, t: truth_events(sides, "folder", side).select("folder", c("cue_strike").alias(t), "ball_motion_end")
    return named("predicted", "p"), named("truth", "g")


def read_analyses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Analysis documents, one JSON object a file, read with a fixed schema; missing fields are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """Media files below a folder, without duplicates, by path: `path`, `length`, `modificationTime`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*MEDIA)).distinct().orderBy("path")


_STREAM = (
    "struct<codec_type: string, codec_name: string, width: int, height: int, avg_frame_rate: string, r_frame_rate: string, nb_frames: string, duration: string,"
    " display_aspect_ratio: string, pix_fmt: string, sample_rate: string, channels: int, tags: map<string,string>, side_data_list: array<struct<rotation: double>>>"
)


def media_metadata(probes: DataFrame, key: str, body: str, max_hours: float = 12.0) -> DataFrame:
    """Container metadata from probe JSON: key, sizes, rates, codecs, rotation, `variable`, and `problem` (null if usable)."""
    probe = F.from_json(body, f"struct<streams: array<{_STREAM}>, format: struct<duration: string, size: string, format_name: string>>")
    first = lambda kind: F.get(F.filter("_p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    rows = probes.select(key, probe.alias("_p")).withColumns({"v": first("video"), "a": first("audio")})
    rate = F.when(fraction(c("v.avg_frame_rate")) > 0, fraction(c("v.avg_frame_rate"))).otherwise(fraction(c("v.r_frame_rate")))
    stated = F.coalesce(F.nullif(fraction(c("_p.format.duration")), F.lit(0.0)), F.nullif(fraction(c("v.duration")), F.lit(0.0)))
    duration = F.coalesce(stated, F.try_divide(fraction(c("v.nb_frames")), rate), F.lit(0.0))
    turned = F.coalesce(F.get(F.filter(F.transform("v.side_data_list", lambda s: s["rotation"]), lambda r: r.isNotNull()), F.lit(0)), F.try_element_at("v.tags", F.lit("rotate")).try_cast("double"), F.lit(0.0))
    aspect = F.when(c("v.display_aspect_ratio").rlike(r"^[1-9]\d*:[1-9]\d*$"), c("v.display_aspect_ratio")).otherwise(F.concat_ws(":", c("v.width").cast("string"), c("v.height").cast("string")))
    out = rows.select(
        key, c("v.width").alias("width"), c("v.height").alias("height"), rate.alias("fps"), variable_rate(c("v.avg_frame_rate"), c("v.r_frame_rate")).alias("variable"), duration.alias("duration"),
        fraction(c("v.nb_frames")).cast("bigint").alias("frames"), c("v.codec_name").alias("video_codec"), c("v.pix_fmt").alias("pixel_format"), aspect.alias("aspect"), turned.cast("int").alias("rotation"),
        c("a.codec_name").alias("audio_codec"), c("a.sample_rate").try_cast("int").alias("audio_rate"), c("a.channels").alias("channels"), c("a").isNotNull().alias("has_audio"),
        c("_p.format.format_name").alias("container"), c("_p.format.size").try_cast("bigint").alias("bytes"),
    )
    return out.withColumn("problem", _problem(F.coalesce(c("width"), F.lit(0)), F.coalesce(c("height"), F.lit(0)), c("duration"), max_hours))


def _problem(width: Column, height: Column, duration: Column, max_hours: float) -> Column:
    return F.when((width <= 0) | (height <= 0), "no picture").when(duration <= 0, "no duration").when(duration > max_hours * 3600, "too long")
