"""Queries of this package and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.views import VIEWS, canonical_view
from chalkline.llm.language import document_languages
from chalkline.llm.leak import leaked_items
from chalkline.llm.mixing import mix_sources
from chalkline.llm.nearest import match_nearest
from chalkline.llm.runs import collapse_runs
from chalkline.sources.tables import load


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of one camera view in a job."""
    rows = load(spark, folder, "frame_features", "job_id", "t", "view_type")
    runs = collapse_runs(rows, ["job_id"], "t", canonical_view(F.col("view_type")))
    return runs.select("job_id", F.col("event").alias("view_type"), "start_ms", "end_ms", "n_readings")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The strike candidate nearest to each shot's strike and motion end."""
    shots = load(spark, folder, "shots", "job_id", "shot_id", "cue_strike", "ball_motion_end")
    anchors = shots.select(
        "job_id", "shot_id",
        F.inline(F.array(*[F.struct(F.lit(a).alias("anchor"), F.col(a).alias("at")) for a in ("cue_strike", "ball_motion_end")])),
    )
    candidates = load(spark, folder, "strike_candidates", "job_id", "candidate_id", "timestamp")
    found = match_nearest(anchors, candidates, ["job_id"], ["shot_id", "anchor"], "at", "candidate_id", "timestamp", 0.75)
    return found.select("job_id", "shot_id", "anchor", "candidate_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of test items."""
    documents = load(spark, folder, "documents", "doc_id", "text")
    return leaked_items(documents, load(spark, folder, "eval_items", "item_id", "text")).select("doc_id", "item_id")


TARGETS = ("mix_name", "source", "target_share", "max_repeats", "total_tokens")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix, with how often each is used."""
    return mix_sources(load(spark, folder, "documents", "doc_id", "text", "source"), load(spark, folder, "mix_targets", *TARGETS))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What each source contributes to each mix, against its target."""
    return mix_sources(load(spark, folder, "documents", "doc_id", "text", "source"), load(spark, folder, "mix_targets", *TARGETS))[1]


def p9_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document and of its paragraphs in another one."""
    return document_languages(load(spark, folder, "documents", "doc_id", "text", "lang"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a missing or wrong label, and paragraphs in another language than the document."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    found = p9_languages(spark, folder).where(F.col("lang").isNotNull() & ((F.col("para_no") > 0) | wrong))
    return found.select("doc_id", "para_no", "lang")


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p7_found": p7_found, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_languages": p9_languages}

_LETTERS = "regexp_replace(lower(regexp_replace(view_type, '^.*[.:]', '')), '[^a-z]', '', 'g')"
_NAMES = ", ".join(f"({i}, '{v}', '{v.replace('_', '')}')" for i, v in enumerate(VIEWS))
_P3 = f"""
with v(i, view, letters) as (values {_NAMES}),
d as (select distinct view_type, {_LETTERS} letters from frame_features where view_type is not null),
near as (select view_type, min_by(view, levenshtein(d.letters, v.letters) * 100 + i) view,
                min(levenshtein(d.letters, v.letters)) e from d, v where d.letters <> '' group by all),
named as (select view_type, case when e <= 2 then view else 'other' end view from near),
g as (select *, case when t - lag(t) over (partition by job_id order by t) < 3600 then 0 else 1 end h
      from (select distinct job_id, t from frame_features)),
s as (select *, sum(h) over (partition by job_id order by t rows unbounded preceding) sitting from g),
n as (select job_id, t, view, count(*) c from frame_features join named using (view_type) group by all),
r as (select job_id, t, arg_min(view, (-c, view)) view from n group by all),
w as (select r.*, sitting, case when lag(view) over o = view and lag(sitting) over o = sitting then 0 else 1 end x
      from r join s using (job_id, t) window o as (partition by job_id order by t)),
z as (select *, sum(x) over (partition by job_id order by t rows unbounded preceding) run from w)
select job_id, view view_type, round(min(t) * 1000)::bigint start_ms, round(max(t) * 1000)::bigint end_ms, count(*) n_readings
from z group by job_id, run, view having count(*) >= 2
"""
_P5 = """
with a as (select distinct job_id, shot_id, 'cue_strike' anchor, cue_strike x from shots where cue_strike is not null
           union select distinct job_id, shot_id, 'ball_motion_end', ball_motion_end from shots where ball_motion_end is not null),
m as (select a.job_id, shot_id, anchor, x, candidate_id, round("timestamp" * 1000)::bigint c, round(x * 1000)::bigint y
      from a join strike_candidates s on s.job_id = a.job_id and s."timestamp" between x - 0.76 and x + 0.76)
select job_id, shot_id, anchor, arg_min(candidate_id, (abs(c - y), c, candidate_id)) candidate_id
from m where abs(c - y) <= 750 group by job_id, shot_id, anchor, x
"""
SQL = {"p3_found": _P3, "p5_found": _P5}
