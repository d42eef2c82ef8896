import random

import pytest

from chalkline.llm.mixing import TOKENIZER, mix_sources, plain_source, token_counts, tokenizer
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(3)
    docs = []
    for i in range(900):
        source = "big" if i % 3 else rnd.choice(["Small-One", " small one ", "SMALL_ONE", "tiny", None, ""])
        docs.append((i, " ".join(rnd.choice(["court", "held", "Vertrag", "naïve", "12", "\n\n"]) for _ in range(rnd.randint(0, 80))), source, 5))
    docs += [(1000, None, "big", 5), (1001, "", "tiny", 5), docs[1], docs[1]]
    targets = [
        ("m", "big", 0.5, 1, 20_000), ("m", "small_one", 0.3, 3, 20_000), ("m", "tiny", 0.9, 2, 20_000), ("m", "absent", 0.1, 2, 20_000),
        ("n", "big", 0.25, 1, 20_000), ("n", "tiny", None, 2, 20_000), ("n", "small_one", 0.1, 0, 20_000), ("m", "big", 0.5, 1, 20_000),
    ]
    a = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens int")
    b = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int, total_tokens bigint")
    rows, report = mix_sources(a, b)
    return docs, [r.asDict() for r in rows.collect()], {(r.mix_name, r.source): r.asDict() for r in report.collect()}


def test_budgets_hold_and_are_used(mixed):
    docs, rows, report = mixed
    encode = tokenizer(TOKENIZER).encode_ordinary
    size = {d: len(encode(t or "")) for d, t, _, _ in docs}
    largest = max(size.values())
    for key, r in report.items():
        own = [x for x in rows if (x["mix_name"], x["source"]) == key]
        assert r["actual_tokens"] == sum(x["tokens"] * x["copies"] for x in own) <= r["target_tokens"]
        assert all(x["tokens"] == size[x["doc_id"]] for x in own)
        assert len({x["copies"] for x in own}) <= 2
    big = report["m", "big"]
    assert big["target_tokens"] - big["actual_tokens"] <= 3 * largest and big["max_copies"] == 1 and big["reached"]
    assert report["m", "tiny"]["max_copies"] == 2 and not report["m", "tiny"]["reached"]
    assert report["m", "tiny"]["actual_tokens"] == 2 * report["m", "tiny"]["available_tokens"]
    assert report["m", "absent"]["actual_tokens"] == report["n", "tiny"]["actual_tokens"] == report["n", "small_one"]["actual_tokens"] == 0


def test_smaller_budgets_are_nested_and_copies_stay_together(mixed):
    docs, rows, _ = mixed
    ids = {m: [x["doc_id"] for x in rows if x["mix_name"] == m and x["source"] == "big"] for m in "mn"}
    assert set(ids["n"]) < set(ids["m"])
    assert ids["m"].count(1) in (0, 3)


def test_tokens_are_those_of_the_tokenizer(spark):
    texts = ["The court held.", "Ünïcödé — 12 345\n\n\tx", "", None, "a" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("source", F.lit("A b"))
    got = {r.doc_id: (r.source, r.tokens) for r in token_counts(df).collect()}
    encode = tokenizer(TOKENIZER).encode_ordinary
    assert got == {i: ("a_b", len(encode(t or ""))) for i, t in enumerate(texts)}
    assert tokenizer(TOKENIZER).decode(encode(texts[1])) == texts[1]


def test_empty(spark):
    a = spark.createDataFrame([], "doc_id bigint, text string, source string")
    b = spark.createDataFrame([("m", "x", 1.0, 1, 100)], "mix_name string, source string, target_share double, max_repeats int, total_tokens bigint")
    rows, report = mix_sources(a, b)
    assert rows.count() == 0 and report.first().actual_tokens == 0
    assert mix_sources(a, b.limit(0))[1].count() == 0


def test_spelling(spark):
    df = spark.createDataFrame([("Moot  Archive",), ("moot-archive ",), ("_MOOT_ARCHIVE",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(plain_source(F.col("s"))).collect()] == ["moot_archive"] * 3 + [None, None]
