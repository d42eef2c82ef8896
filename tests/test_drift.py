import datetime as dt
import json

from chalkline.operators.drift import consistent_table, field_columns, first_names, schema_changes, whole_table

SCHEMA = "file_id bigint, job_id bigint, written_at timestamp, record_key bigint, payload string, path string, extra int"


def table(spark, files):
    rows = []
    for job, file, day, records in files:
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
        for key, record in records:
            rows.append((file, job, at, key, record if isinstance(record, (str, type(None))) else json.dumps(record), "x", 1))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return sorted(tuple(r) for r in schema_changes(table(spark, files)).collect())


def test_all_kinds_of_change(spark):
    files = [
        (1, 9, 0, [(1, {"a": 1.5, "b": True, "c": 1, "n": None}), (2, {"a": 2.5, "b": False, "c": 2, "n": 1}), (2, {"a": 2.5, "b": False, "c": 2})]),
        # a is renamed and becomes text, c is retyped, d comes, broken lines count for nothing
        (1, 3, 40, [(1, {"x": "1.50", "b": True, "c": 1.0, "d": 5}), (2, {"c": 2.0, "x": "2.5", "b": False, "d": 6}), (3, '{"z": 1} tail'), (3, '{"z": 1'), (3, "[1]"), (3, "null"), (3, None), (3, "")]),
        # b goes, x is written in an object, in ms
        (1, 5, 41, [(2, {"x": {"value": 2500}, "c": 2.0, "d": None}), (4, {"x": {"value": 1}, "c": 3.0, "d": None})]),
        # d comes back with a type after a file of nulls
        (1, 6, 400, [(2, {"x": {"value": 2500}, "c": 2.0, "d": "6"}), (4, {"x": {"value": 1}, "c": 3.0})]),
    ]
    assert changes(spark, files) == sorted(
        [
            (3, "renamed", "a", "x"), (3, "retyped", "x", ""), (3, "retyped", "c", ""), (3, "added", "d", ""), (3, "removed", "n", ""),
            (5, "removed", "b", ""), (5, "retyped", "x", ""), (6, "retyped", "d", ""),
        ]
    )


def test_long_runs_of_nulls_keep_the_type(spark):
    files = [(1, 0, 0, [(1, {"a": 1})])] + [(1, i, i, [(1, {"a": None})]) for i in range(1, 9)] + [(1, 9, 9, [(1, {"a": 1.0})]), (1, 10, 10, [(1, {"a": None})])]
    assert changes(spark, files) == [(9, "retyped", "a", "")]


def test_values_that_differ_are_no_rename_and_names_are_used_once(spark):
    files = [
        (None, 1, 0, [(1, {"a": 1.0, "b": 7}), (2, {"a": 2.0, "b": 8})]),
        (None, 2, 1, [(1, {"p": 1.0, "q": 1.0}), (2, {"p": 2.0, "q": 2.1})]),
    ]
    assert changes(spark, files) == [(2, "added", "q", ""), (2, "removed", "b", ""), (2, "renamed", "a", "p")]


def test_one_table_with_failed_casts(spark):
    files = [(1, 1, 0, [(1, {"s": 1.25, "ok": "Y"}), (2, {"sec": {"v": "2.5"}, "ok": 0}), (3, {"s": "soon", "ok": "maybe"}), (4, "broken"), (5, {"s": 1743.0, "ok": True}), (6, {"s": 1250, "ok": 1})])]
    columns = {"s": ("seconds", ("s", "sec")), "ok": ("boolean", ("ok",))}
    got = {r.record_key: (r.s, r.ok, r.failed) for r in consistent_table(table(spark, files), columns).collect()}
    assert got == {1: (1.25, True, {}), 2: (2.5, False, {}), 3: (None, None, {"s": "soon", "ok": "maybe"}), 5: (1743.0, True, {}), 6: (1.25, True, {})}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert schema_changes(df).count() == 0
    assert consistent_table(df, {"a": ("double", ("a",))}).count() == 0


def test_every_field_gets_a_typed_column(spark):
    files = [
        (1, 1, 0, [(1, {"s": 1.25, "ok": True, "view": "main", "n": 3, "other": 5.5, "tags": ["a", "b"], "job_id": "x", "O'k \"q\"": 1}), (2, {"s": 2.5, "ok": False, "view": ["side"], "n": 4.0, "other": 6.5, "tags": "a|c"})]),
        # s is called sec and view viewType; other stays
        (1, 2, 1, [(2, {"sec": 2500, "ok": "no", "viewType": ["side"], "n": "4", "other": {"v": 6.5}, "tags": ["c"]}), (3, {"sec": {"value": 3.5}, "ok": "maybe", "viewType": "main", "n": 5, "other": 1, "e": {"p": 1}})]),
    ]
    lines = table(spark, files)
    columns = field_columns(lines, first_names(lines))
    assert {k: (v[0], sorted(v[1])) for k, v in columns.items()} == {
        "s": ("seconds", ["s"]), "ok": ("boolean", ["ok"]), "view": ("string", ["view"]), "n": ("bigint", ["n"]),
        "other": ("seconds", ["other"]), "tags": ("array<string>", ["tags"]), "e": ("string", ["e"]), "job_id_2": ("string", ["job_id"]), "O'k \"q\"": ("bigint", ["O'k \"q\""]),
    }
    got = {(r.file_id, r.record_key): r for r in whole_table(lines).collect()}
    assert [got[k].s for k in sorted(got)] == [1.25, 2.5, 2.5, 3.5]
    assert [got[k].ok for k in sorted(got)] == [True, False, False, None]
    assert [got[k].view for k in sorted(got)] == ["main", "side", "side", "main"]
    assert [got[k].n for k in sorted(got)] == [3, 4, 4, 5]
    assert [got[k].other for k in sorted(got)] == [5.5, 6.5, 6.5, 0.001]
    assert [got[k].tags for k in sorted(got)] == [["a", "b"], ["a", "c"], ["c"], None]
    assert got[1, 1]["O'k \"q\""] == 1 and got[1, 1]["job_id_2"] == "x" and got[2, 3]["e"] == '{"p":1}'
    assert got[2, 3].failed == {"ok": "maybe"}


def test_a_name_that_stands_for_another_field_later(spark):
    files = [
        (1, 1, 0, [(1, {"a": 1.5, "b": 7.5}), (2, {"a": 2.5, "b": 8.5})]),
        (1, 2, 1, [(1, {"a": 1.5, "bb": 7.5}), (2, {"a": 2.5, "bb": 8.5})]),
        (1, 3, 2, [(1, {"b": 1.5, "bb": 7.5}), (2, {"b": 2.5, "bb": 8.5})]),
        (1, 4, 3, [(2, {"b": 2500, "bb": 8500})]),
        (2, 5, 0, [(7, {"bb": 0.5}), (8, {"bb": 0.25})]),
        (None, None, 0, [(9, {"a": 9.5})]),
    ]
    got = sorted((r.file_id or 0, r.record_key, r.a, r.b) for r in whole_table(table(spark, [(j, f, d, x) for j, f, d, x in files])).collect())
    assert got == [(0, 9, 9.5, None), *[(f, k, k + 0.5, k + 6.5) for f in (1, 2, 3) for k in (1, 2)], (4, 2, 2.5, 8.5), (5, 7, None, 0.5), (5, 8, None, 0.25)]


def test_a_name_given_again_beside_the_renamed_field_loses_nothing(spark):
    files = [
        (1, 1, 0, [(1, {"a": 1.5}), (2, {"a": 2.5})]),
        (1, 2, 1, [(1, {"x": 1.5}), (2, {"x": 2.5})]),
        (1, 3, 2, [(1, {"x": 1.5, "a": 9.5}), (2, {"x": 2.5, "a": 8.5})]),
    ]
    got = {(r.file_id, r.record_key): (r.a, r.x) for r in whole_table(table(spark, files)).collect()}
    assert got[3, 1] == (9.5, 1.5) and got[3, 2] == (8.5, 2.5) and got[1, 1] == (1.5, None)


def test_a_field_renamed_and_wrapped_into_a_list(spark):
    files = [
        (1, 1, 0, [(1, {"a": "x", "b": [1, 2]}), (2, {"a": "y", "b": [3, 4]})]),
        (1, 2, 1, [(1, {"p": ["x"], "q": 1}), (2, {"p": ["y"], "q": 3})]),
    ]
    assert changes(spark, files) == [(2, "added", "q", ""), (2, "removed", "b", ""), (2, "renamed", "a", "p"), (2, "retyped", "p", "")]
