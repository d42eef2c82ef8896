from pyspark.sql import functions as F

from chalkline.operators.stateful import label_phases
from chalkline.streaming.phases import session_activity, stream_phases, windowed_activity
from helpers import SCHEMA, tracked


def run(spark, df, path, build, mode="append"):
    df.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
    query = build(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_phases_as_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = [tracked(i / 10, False, strike_score=0.9 if i == 5 else 0.0, cue_ball_detected=True, **(dict(moving_ball_count=1) if 6 <= i <= 9 else dict(ball_residual_motion=0.0))) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    batch = {r.t: r.state for r in label_phases(df).collect()}
    got = run(spark, df.coalesce(1), tmp_path, stream_phases)
    assert {r.t: r.state for r in got.collect()} == batch


def test_windows_and_sessions(spark, tmp_path):
    df = spark.createDataFrame([(1, x, 0.5) for x in (0, 10, 70, 9000, 9001, 90000)], "job_id bigint, s int, motion_raw double").withColumn("at", F.timestamp_seconds("s"))
    got = run(spark, df.coalesce(1), tmp_path / "w", lambda d: windowed_activity(d, "at"))
    assert sorted(r.n for r in got.collect()) == [1, 2, 2]
    got = run(spark, df.coalesce(1), tmp_path / "s", lambda d: session_activity(d, "at"))
    assert sorted(r.n for r in got.collect()) == [2, 3]
