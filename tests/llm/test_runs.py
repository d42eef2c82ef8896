import random

from pyspark.sql import functions as F

from chalkline.functions.views import VIEWS, canonical_view
from chalkline.llm.runs import collapse_runs


def brute(rows, pause=3600):
    out = set()
    for job in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == job and r[1] is not None]
        times = sorted({t for _, t, _ in own})
        sitting, n = {}, 0
        for a, b in zip([None, *times], times):
            n += a is not None and b - a >= pause
            sitting[b] = n
        read = {}
        for _, t, v in own:
            if v:
                read.setdefault(t, []).append(v)
        seq = [(t, min(set(v), key=lambda x: (-v.count(x), x))) for t, v in sorted(read.items())]
        i = 0
        while i < len(seq):
            j = i
            while j + 1 < len(seq) and seq[j + 1][1] == seq[i][1] and sitting[seq[j + 1][0]] == sitting[seq[i][0]]:
                j += 1
            if j > i:
                out.add((job, seq[i][1], round(seq[i][0] * 1000), round(seq[j][0] * 1000), j - i + 1))
            i = j + 1
    return out


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows, view = [], "a"
    for job in (1, 1, None):
        t = 0.0
        for _ in range(1500):
            t += rnd.choice([0.5, 1.0, 30.0, 1800.0, 3599.999, 3600.0])
            view = rnd.choice([view, view, view, "a", "b"])
            rows.append((job, round(t, 3), rnd.choice([view, view, view, None])))
    rows += rows[:200] + [(1, None, "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "job bigint, t double, v string, shard int")
    got = {tuple(r)[:5] for r in collapse_runs(df, ["job"], "t", F.col("v")).collect()}
    assert got == brute(rows)


def test_spellings(spark):
    cases = {"CameraViewType.MAIN_TABLE": "main_table", "view:replay": "replay", "'wide_arena'": "wide_arena", "\tAUDIENCE\n": "audience", "MainTable": "main_table", "main_tabel": "main_table", "ball_coseup": "ball_closeup", "": None, "  ": None, "zzzzzzzz": "other"}
    cases |= {v: v for v in VIEWS}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string")
    got = dict(df.select("v", canonical_view(F.col("v"))).collect())
    assert got == cases | {None: None}


def test_empty(spark):
    assert collapse_runs(spark.createDataFrame([], "job bigint, t double, v string"), ["job"], "t", F.col("v")).count() == 0
