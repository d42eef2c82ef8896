import math
import os
import random

from chalkline.llm.nearest import NearestState, match_nearest


def test_against_brute_force(spark):
    rnd = random.Random(2)
    left = [(rnd.choice([1, 1, 2, None]), i, rnd.choice(["x", "y"]), round(rnd.uniform(0, 1300), 3)) for i in range(600)]
    left += left[:40] + [(1, 9001, "x", None), (1, 9002, "x", math.nan), (1, 9003, "x", 1e300), (1, 9004, "x", 599.9), (1, 9005, "x", 700.0)]
    right = [(rnd.choice([1, 1, 2, None]), 5000 + i, round(rnd.uniform(0, 1300), 3)) for i in range(500)]
    right += right[:40] + [(1, 7001, 600.3), (1, 7002, 700.5), (1, 7003, 699.5), (1, 7004, 700.5), (2, 7005, None)]
    a = spark.createDataFrame([(*r, 0) for r in left], "job bigint, id int, anchor string, at double, ms int")
    b = spark.createDataFrame([(*r, 0) for r in right], "job bigint, cid bigint, t double, shard int")
    got = sorted(tuple(r) for r in match_nearest(a, b, ["job"], ["id", "anchor"], "at", "cid", "t", 0.75).collect())
    want = set()
    for job, i, anchor, at in left:
        if job is None or at is None or math.isnan(at):
            continue
        near = [(abs(round(t * 1000) - round(at * 1000)), round(t * 1000), cid) for j, cid, t in right if j == job and t is not None]
        near = [x for x in near if x[0] <= 750]
        if near:
            d, _, cid = min(near)
            want.add((job, i, anchor, cid, d))
    assert got == sorted(want)
    assert (1, 9005, "x", 7003, 500) in want


def test_empty_sides(spark):
    a = spark.createDataFrame([], "job bigint, id int, at double")
    b = spark.createDataFrame([(1, 2, 3.0)], "job bigint, cid bigint, t double")
    assert match_nearest(a, b, ["job"], ["id"], "at", "cid", "t", 0.75).count() == 0
    a = spark.createDataFrame([(1, 2, 3.0)], "job bigint, id int, at double")
    assert match_nearest(a, b.limit(0), ["job"], ["id"], "at", "cid", "t", 0.75).count() == 0


def _stream(spark, path, batches, schema):
    """A stream that delivers one batch of rows at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
    files = sorted(path.glob("*/part*.parquet"))
    for i, f in enumerate(files):
        os.utime(f, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_entities_keep_their_own_clocks_over_batches(spark, tmp_path):
    # Job 1 is at ten hours from the first batch on; job 2 comes in the third batch, at ten seconds, its candidate in the fourth.
    left = [[(1, 1, 36000.0)], [(1, 2, 36100.0)], [(2, 3, 10.0), (1, 4, 40000.0)], [(1, 5, 50000.0), (2, 6, 5000.0)]]
    right = [[(1, 11, 36000.5)], [(1, 12, 36100.2), (1, 15, 49999.9)], [(1, 13, 40000.6)], [(2, 14, 10.3)]]
    a = _stream(spark, tmp_path / "a", left, "job bigint, id int, at double")
    b = _stream(spark, tmp_path / "b", right, "job bigint, cid bigint, t double")
    got = match_nearest(a, b, ["job"], ["id"], "at", "cid", "t", 0.75, unmatched=True).collect()
    assert sorted((r.id, r.cid, r.distance_ms) for r in got if r.cid) == [(1, 11, 500), (2, 12, 200), (3, 14, 300), (4, 13, 600), (5, 15, 100)]
    assert [r.id for r in got if r.cid is None] == [6]


def test_rows_are_emitted_at_their_horizon_and_candidates_evicted(spark, tmp_path):
    state = NearestState(str(tmp_path), ["_k0"], ["_l0"], 750, 10_000)
    schema = "_k0 bigint, _l0 int, right_id bigint, ms bigint, is_right boolean"
    state.process(spark.createDataFrame([(1, 1, None, 1_000, False), (1, None, 7, 1_100, True), (2, 2, None, 900_000, False)], schema), 0)
    assert spark.read.parquet(state.out(0)).count() == 0  # no watermark has passed
    state.process(spark.createDataFrame([(1, None, 8, 11_750, True)], schema), 1)
    assert [(r._l0, r.right_id, r.distance_ms) for r in spark.read.parquet(state.out(1)).collect()] == [(1, 7, 100)]
    state.process(spark.createDataFrame([(1, None, 9, 60_000, True)], schema), 2)
    assert [r.right_id for r in spark.read.parquet(f"{tmp_path}/buffers/2/right").collect()] == [9]
    assert [r._l0 for r in spark.read.parquet(f"{tmp_path}/buffers/2/left").collect()] == [2]
    state.process(spark.createDataFrame([], schema), 3, closing=True)
    assert [(r._l0, r.right_id) for r in spark.read.parquet(state.out(3)).collect()] == [(2, None)]
