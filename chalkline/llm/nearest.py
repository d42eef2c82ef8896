"""Records paired with the nearest record in time of the same entity, as a stateful streaming join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.operators.sequence import shard_of, to_ms
from chalkline.session import remove, scratch_path

#: Shard of the clock, in ms: with the entity, the group in which rows meet.
SHARD_MS = 600_000


class NearestState:
    """Buffers of both sides and each entity's clock, as tables in the shared folder, one version a batch.

    The watermark is the entity's own: the latest time seen of it, of either side, less `lateness_ms`. Clocks of different
    entities say nothing about each other, so an entity that comes late loses nothing to one that is far ahead.
    """

    def __init__(self, root: str, keys: Sequence[str], left_id: Sequence[str], tolerance_ms: int, lateness_ms: int) -> None:
        self.root, self.keys, self.left_id, self.tolerance, self.lateness = root, list(keys), list(left_id), tolerance_ms, lateness_ms

    def process(self, rows: DataFrame, batch: int, closing: bool = False) -> None:
        """Take in a batch: emit left rows whose horizon the watermark has passed, keep the others, evict candidates.

        Everything is read from the version of the batch before and written to that of this batch, so that a batch that
        is repeated after a failure gives the same.
        """
        spark = rows.sparkSession
        left = rows.where("not is_right").select(*self.keys, *self.left_id, "ms")
        right = rows.where("is_right").select(*self.keys, "right_id", "ms")
        clock = rows.groupBy(*self.keys).agg(F.max("ms").alias("clock"))
        if batch:
            left, right, clock = (new.unionByName(self._read(spark, name, batch - 1, new)) for name, new in (("left", left), ("right", right), ("clock", clock)))
            clock = clock.groupBy(*self.keys).agg(F.max("clock").alias("clock"))
        left = left.distinct().withColumn("shard", shard_of("ms", SHARD_MS))
        self._write(clock, "clock", batch)
        clock = self._read(spark, "clock", batch, clock)
        # The clock comes to the rows by (entity, shard), one row each, so that a hot entity stays spread.
        horizon = left.select(*self.keys, "shard").distinct().join(clock, self.keys)
        due = F.lit(True) if closing else F.col("clock") >= F.col("ms") + self.tolerance + self.lateness
        found = self._nearest(left, right).join(horizon, [*self.keys, "shard"])
        emitted = found.where(due).select(*self.keys, *self.left_id, "ms", "best")
        emitted.select(*self.keys, *self.left_id, "ms", "best.right_id", F.col("best.gap").alias("distance_ms")).write.mode("overwrite").parquet(self.out(batch))
        if closing:
            return
        self._write(left.join(horizon, [*self.keys, "shard"]).where(~due).select(*self.keys, *self.left_id, "ms"), "left", batch)
        # A candidate is needed as long as a left row within the tolerance may still come or wait.
        self._write(right.distinct().join(clock, self.keys).where(F.col("ms") >= F.col("clock") - self.lateness - 2 * self.tolerance).drop("clock"), "right", batch)
        if batch > 1:
            remove(spark, self._version(batch - 2))

    def _nearest(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Left rows with `best` (gap, right_ms, right_id) or null: the candidates before and after in one sorted group.

        A right row near the edge of a shard goes to both. No pairs are formed: a left row sees the last candidate up to
        its time and the next one after it.
        """
        edges = F.array_distinct(F.array(shard_of(F.col("ms") - self.tolerance, SHARD_MS), shard_of("ms", SHARD_MS), shard_of(F.col("ms") + self.tolerance, SHARD_MS)))
        candidates = right.select(*self.keys, F.explode(edges).alias("shard"), "ms", "right_id").groupBy(*self.keys, "shard", "ms").agg(F.min("right_id").alias("right_id"))
        both = left.withColumn("is_right", F.lit(0)).unionByName(
            candidates.select("*", F.lit(1).alias("is_right"), F.struct(F.col("ms").alias("right_ms"), "right_id").alias("candidate")), allowMissingColumns=True
        ).drop("right_id")
        over = f"over (partition by {', '.join(f'`{k}`' for k in self.keys)}, shard order by ms, is_right desc)"
        window = Window.partitionBy(*self.keys, "shard").orderBy("ms", F.desc("is_right")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        around = both.withColumns({"before": F.last("candidate", ignorenulls=True).over(window), "after": F.expr(f"lead(candidate, 1) ignore nulls {over}")})
        with_gap = lambda c: F.when(
            F.abs(F.col(c)["right_ms"] - F.col("ms")) <= self.tolerance,
            F.struct(F.abs(F.col(c)["right_ms"] - F.col("ms")).alias("gap"), F.col(c)["right_ms"].alias("right_ms"), F.col(c)["right_id"].alias("right_id")),
        )
        # Of equally near ones the earlier: structs compare by gap, then time, then id.
        return around.where("is_right = 0").select(*self.keys, *self.left_id, "ms", "shard", F.least(with_gap("before"), with_gap("after")).alias("best"))

    def out(self, batch: int) -> str:
        return f"{self.root}/out/{batch}"

    def _version(self, batch: int) -> str:
        return f"{self.root}/buffers/{batch}"

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self._version(batch)}/{name}")

    def _read(self, spark: SparkSession, name: str, batch: int, like: DataFrame) -> DataFrame:
        return spark.read.schema(like.schema).parquet(f"{self._version(batch)}/{name}")


def match_nearest(
    left: DataFrame, right: DataFrame, entity: Sequence[str], left_id: Sequence[str], left_t: str, right_id: str, right_t: str,
    tolerance_s: float, lateness_s: float = 3600.0, unmatched: bool = False,
) -> DataFrame:
    """Each left row that has a partner at most `tolerance_s` away, with the nearest: entity, left_id, right_id, `distance_ms`.

    Both sides are buffered per entity and shard of its clock. Once the entity's watermark - its latest time less
    `lateness_s` - passes a left row's time and tolerance, the row is emitted with its nearest partner (`unmatched`: or
    with nulls, if it has none), and candidates that no row can need any more are evicted. When the input ends, the
    rows still waiting are emitted. Of equally near partners the earlier counts, then the smaller id.

    `left` and `right` are streams or tables; a table is written to the shared folder and streamed from there in one
    batch, whatever the order of its rows. A row that comes in a later batch than one of its own entity that is more
    than `lateness_s` ahead may find its partner evicted. Rows with a null entity or a null or infinite time have no
    partner. Repeated rows count once; copies of a right id with different times are different partners. Other columns
    are ignored. Empty tables give no rows. Buffers, progress and output live in the shared folder, so the query
    survives lost executors.
    """
    spark = left.sparkSession
    root = scratch_path(spark, "nearest")
    keys, ids = [f"_k{i}" for i in range(len(entity))], [f"_l{i}" for i in range(len(left_id))]
    named = lambda df, names, as_: [F.col(f"`{c}`").alias(k) for c, k in zip(names, as_)]
    present = " and ".join(["ms is not null", *[f"`{k}` is not null" for k in keys]])
    a = left.select(*named(left, entity, keys), *named(left, left_id, ids), to_ms(f"`{left_t}`").alias("ms"), F.lit(False).alias("is_right")).where(present)
    b = right.select(*named(right, entity, keys), F.col(f"`{right_id}`").alias("right_id"), to_ms(f"`{right_t}`").alias("ms"), F.lit(True).alias("is_right")).where(present)
    sides = []
    for name, side in (("left", a), ("right", b)):
        if not side.isStreaming:
            side.write.parquet(f"{root}/{name}")
            side = spark.readStream.schema(side.schema).parquet(f"{root}/{name}")
        sides.append(side)
    state = NearestState(root, keys, ids, round(tolerance_s * 1000), round(lateness_s * 1000))
    batches = []

    def take(rows: DataFrame, batch: int) -> None:
        state.process(rows, batch)
        batches.append(batch)

    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    query = both.writeStream.foreachBatch(take).trigger(availableNow=True).option("checkpointLocation", f"{root}/progress").start()
    query.awaitTermination()
    rest = spark.createDataFrame([], both.schema)
    last = max(batches, default=-1) + 1
    state.process(rest, last, closing=True)
    found = spark.read.schema(spark.read.parquet(state.out(last)).schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")
    found = found if unmatched else found.where("right_id is not null")
    return found.select(
        *[F.col(k).alias(c) for c, k in zip(entity, keys)], *[F.col(k).alias(c) for c, k in zip(left_id, ids)], F.col("right_id").alias(right_id), "distance_ms"
    )
