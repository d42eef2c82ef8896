"""Recordings of any length for operators that look only a little way around each row.

A recording is cut into pieces of equally many rows. Each piece sees the rows of its neighbours that its own rows can see,
and gives back only its own; so what runs over a piece gives what it would give over the recording.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.joins import within
from chalkline.operators.sequence import join_by
from chalkline.operators.timeline import KEYS
from chalkline.session import cut

#: Rows of a piece.
SIZE = 4096
#: Seconds in a shard of the clock, within which rows are numbered.
WIDTH_S = 3600.0
#: A piece's `sitting` is its recording's times this, plus its number.
_PIECES = 1 << 20


def numbered(rows: DataFrame) -> DataFrame:
    """Adds `_row`, the number of a row in its recording by `t`, from 0: numbers within shards of the clock, and one
    count for each shard that goes on to the later ones."""
    by = [*KEYS, "_shard"]
    placed = rows.withColumn("_shard", F.floor(F.col("t") / WIDTH_S))
    along = Window.partitionBy(*KEYS).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by).orderBy("t")) - 1
    return join_by(placed, before, by).withColumn("_row", F.col("_base") + inside).drop("_base", "_shard")


def cut_pieces(rows: DataFrame, reach_s: float, reach_rows: int = 1, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows by piece, those of the neighbours that can be seen marked `_halo`, with the piece in place of `sitting`; and
    the pieces: KEYS (the recording's), `_piece`, first and last `t` (`_first`, `_last`), and where the next begins (`_begins`)."""
    size = size or SIZE
    # The rows are counted, numbered and spread: they are computed once and written to the shared folder.
    near = cut(rows, "rows")
    near = (near if "_row" in rows.columns else numbered(near)).withColumns({"_piece": F.floor(F.col("_row") / size), "_at": F.pmod("_row", F.lit(size))})
    by = [*KEYS, "_piece"]
    along = Window.partitionBy(*KEYS).orderBy("_piece")
    pieces = near.groupBy(*by).agg(F.min("t").alias("_first"), F.max("t").alias("_last")).withColumns({"_ended": F.lag("_last").over(along), "_begins": F.lead("_first").over(along)})
    placed = join_by(near, pieces.select(*by, "_ended", "_begins"), by)
    earlier = F.col("_ended").isNotNull() & ((F.col("_at") < reach_rows) | (F.col("t") - F.col("_ended") <= reach_s))
    later = F.col("_begins").isNotNull() & ((F.col("_at") >= size - reach_rows) | (F.col("_begins") - F.col("t") <= reach_s))
    place = lambda d, halo: F.struct((F.col("_piece") + d).alias("p"), F.lit(halo).alias("h"))
    places = F.filter(F.array(place(0, False), F.when(earlier, place(-1, True)), F.when(later, place(1, True))), lambda x: x.isNotNull())
    spread = placed.withColumn("_to", F.explode(places)).withColumn("sitting", F.col("sitting") * _PIECES + F.col("_to.p")).withColumn("_halo", F.col("_to.h"))
    return spread.drop("_row", "_piece", "_at", "_ended", "_begins", "_to"), pieces


def of_recordings(rows: DataFrame) -> DataFrame:
    """Rows of pieces with their recording as `sitting` again."""
    return rows.withColumn("sitting", F.shiftright("sitting", 20))


def in_piece(events: DataFrame, pieces: DataFrame, t: str) -> DataFrame:
    """Events (KEYS, a time) with the piece they fall into as `sitting`; those before the first or after the last row of a
    recording, by less than the pause that ends one, go to its first or last piece."""
    spans = pieces.select(
        *KEYS, "_piece", F.when(F.col("_piece") == 0, F.col("_first") - WIDTH_S).otherwise(F.col("_first")).alias("_lo"), F.coalesce("_begins", F.col("_last") + WIDTH_S).alias("_hi")
    )
    found = within(events, spans, KEYS, t, "_lo", "_hi", closed=False)
    return found.withColumn("sitting", F.col("sitting") * _PIECES + F.col("_piece")).drop("_piece", "_lo", "_hi")


def by_pieces(rows: DataFrame, step: Callable[[DataFrame], DataFrame], reach_s: float, reach_rows: int = 1, size: int | None = None) -> DataFrame:
    """`step` over the pieces of each recording: a function of KEYS and `t` that keeps `_halo` and whose result for a row
    depends on the rows at most `reach_s` seconds or `reach_rows` rows away.

    `step` may drop rows. A piece holds at least the rows that lie within reach.
    """
    return of_recordings(step(cut_pieces(rows, reach_s, reach_rows, size)[0]).where("not _halo").drop("_halo"))
