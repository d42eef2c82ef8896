"""Camera view names, however they are spelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the camera views.
VIEWS = (
    "main_table",
    "player_closeup",
    "ball_closeup",
    "wide_arena",
    "audience",
    "scoreboard",
    "commentator",
    "replay",
    "slow_motion_replay",
    "advertisement",
    "other",
)
#: Edits (insertions, deletions, replacements) up to which a spelling is taken for a view.
MAX_EDITS = 2


def canonical_view(raw: Column) -> Column:
    """The view meant by `raw`: null for null or a text without letters, `other` for what resembles no view.

    Case, spaces, separators, quotes and a prefix like `CameraViewType.` or `view:` do not matter; a misspelling goes
    to the nearest name within MAX_EDITS, of equally near ones to the first in VIEWS.
    """
    bare = F.regexp_replace(raw, r"^.*[.:]", "")
    letters = F.regexp_replace(F.lower(bare), "[^a-z]", "")
    names = {v.replace("_", ""): v for v in VIEWS}
    exact = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), letters)
    near = [F.struct(F.levenshtein(letters, F.lit(n), MAX_EDITS).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(names)]
    best = F.array_min(F.filter(F.array(*near), lambda x: x["d"] >= 0))["i"]
    fuzzy = F.coalesce(F.element_at(F.array(*[F.lit(v) for v in names.values()]), best + 1), F.lit("other"))
    return F.when(F.coalesce(letters, F.lit("")) == "", F.lit(None)).otherwise(F.coalesce(exact, fuzzy))
