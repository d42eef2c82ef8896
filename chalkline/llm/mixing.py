"""Mixing sources to target weights by hash thresholds, sizes counted in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.session import cut

#: Default vocabulary: byte-level BPE for many languages, one "token rank" per line.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the vocabulary's merges apply.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of the hash that one pass of the histogram tells apart, and bits used in all.
STEP, BITS = 10, 60


@cache
def tokenizer(path: str):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def plain_source(source: Column) -> Column:
    """A source's plain spelling: lower case, words joined by underscores; null for null and blank."""
    name = F.regexp_replace(F.regexp_replace(F.lower(source), r"[\s_-]+", "_"), r"^_+|_+$", "")
    return F.when(name != "", name)


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """`doc_id`, `source` (plain spelling), `tokens` of the whole text; a null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(text)) if text else 0 for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", plain_source(F.col("source")).alias("source"), "text")
    return rows.mapInArrow(count, f"doc_id {kind}, source string, tokens bigint")


def _thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add `below`: of a source, documents whose hash is below it hold at most `rest` tokens, and no more would fit.

    Each pass sums tokens by source and the next STEP bits of the hash, only over the bucket in which each budget runs out
    (at first everything); budgets of several mixes share a source's histogram. It ends when no such bucket
    has two different hashes.
    """
    state = wanted.withColumns({"prefix": F.lit(0).cast("bigint"), "open": F.col("rest") > 0, "below": F.lit(None).cast("bigint")})
    done = state.where(~F.col("open")).withColumn("below", F.lit(0).cast("bigint"))
    state = state.where("open")
    used = 0
    finished = done
    while used < BITS:
        shift = BITS - used - STEP
        heads = state.select("source", "prefix").distinct()
        here = sized.withColumn("prefix", F.shiftright("h", BITS - used))
        histogram = here.join(heads, ["source", "prefix"], "left_semi").groupBy("source", "prefix", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("tokens").alias("tokens"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        upto = Window.partitionBy("source", "prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = histogram.withColumn("upto", F.sum("tokens").over(upto))
        joined = state.drop("below").join(ranked, ["source", "prefix"])
        # The first bucket that no longer fits; where all fit, everything does.
        over = F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"), "lo", "hi")
        crossed = joined.groupBy("mix_name", "source").agg(
            *[F.first(c).alias(c) for c in ("rest", "full", "prefix")],
            F.min(F.when(F.col("upto") > F.col("rest"), over)).alias("x"),
        )
        edge = F.when(F.col("x").isNull(), F.shiftleft(F.col("prefix") + 1, BITS - used)).otherwise(F.col("x.lo"))
        single = F.col("x").isNull() | (F.col("x.lo") == F.col("x.hi"))
        step = cut(
            crossed.select(
                "mix_name", "source", F.coalesce("x.left", "rest").alias("rest"), "full", F.coalesce("x.bucket", "prefix").alias("prefix"),
                (~single).alias("open"), F.when(single | F.lit(used + STEP >= BITS), edge).alias("below"),
            ),
            "thresholds",
        )
        used += STEP
        finished = finished.unionByName(step.where("below is not null").select(finished.columns))
        state = step.where("below is null")
        if state.isEmpty():
            break
    return finished.select("mix_name", "source", "full", "below")


def mix_sources(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixes and their report.

    First result: `mix_name`, `doc_id`, `source`, `tokens`, `copies` - the documents of each mix. Second: a row
    per mix and source with `target_share`, `target_tokens`, `available_tokens`, `n_docs` (documents used), `max_copies`,
    `actual_tokens`, `actual_share` (of the mix's total_tokens) and `reached` (within one document of the target).

    A source gives its documents as often as its budget (target_share x total_tokens) holds them whole, at most
    max_repeats times; of the rest, those in order of the hash of their id as far as they fit, so a mix never exceeds a
    budget and each document's copies differ by at most one from its source's others. Sources are matched by their plain
    spelling; documents without a source are in no mix. Null texts have 0 tokens. Repeated rows of a document stay
    together. Null or negative shares, repeats or totals count as 0; of repeated targets the largest holds. A target
    without documents is reported with 0. Other columns are ignored.

    documents is tokenized once; sizes go to the shared folder, and all later passes read those narrow rows only.
    """
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 64 - BITS)
    sized = cut(token_counts(documents, path).where("source is not null").withColumn("h", h), "sizes")
    goals = targets.groupBy("mix_name", plain_source(F.col("source")).alias("source")).agg(
        F.max(F.coalesce(F.greatest(F.col("target_share"), F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.coalesce(F.greatest(F.col("max_repeats"), F.lit(0)), F.lit(0))).alias("max_repeats"),
        F.max(F.coalesce(F.greatest(F.col("total_tokens"), F.lit(0)), F.lit(0))).alias("total_tokens"),
    )
    stock = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.max("tokens").alias("largest"))
    goals = goals.join(stock, "source", "left").withColumns(
        {"budget": F.floor(F.col("target_share") * F.col("total_tokens") + 1e-6), "available": F.coalesce("available", F.lit(0))}
    )
    times = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0)
    goals = goals.withColumn("full", F.least(times, F.col("max_repeats")).cast("bigint"))
    rest = F.when(F.col("full") < F.col("max_repeats"), F.col("budget") - F.col("full") * F.col("available")).otherwise(0)
    goals = cut(goals.withColumn("rest", rest.cast("bigint")), "goals")
    cuts = _thresholds(sized, goals.where("available > 0").select("mix_name", "source", "full", "rest"))
    copies = F.col("full") + (F.col("h") < F.col("below")).cast("bigint")
    mixed = (
        sized.join(cuts, "source").withColumn("copies", copies).where("copies > 0")
        .select("mix_name", "doc_id", "source", "tokens", F.col("copies").cast("int").alias("copies"))
    )
    got = mixed.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("max_copies")
    )
    share = F.when(F.col("total_tokens") > 0, F.coalesce("actual_tokens", F.lit(0)) / F.col("total_tokens")).otherwise(0.0)
    report = goals.join(got, ["mix_name", "source"], "left").select(
        "mix_name", "source", "target_share", F.col("budget").alias("target_tokens"), F.col("available").alias("available_tokens"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"),
        F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"), share.alias("actual_share"),
        (F.col("budget") - F.coalesce("actual_tokens", F.lit(0)) <= F.coalesce("largest", F.lit(0))).alias("reached"),
    )
    return mixed, report
