"""Schemas that drift between files: path-value maps, changes from file to file, one typed table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.operators.sequence import with_next
from chalkline.session import cut


@dataclass(frozen=True)
class FileColumns:
    """Names of the columns that place a line: its file, the file's group and time, and the record it is about."""

    file: str = "file_id"
    group: str = "job_id"
    time: str = "written_at"
    record: str = "record_key"
    payload: str = "payload"


def parse_lines(lines: DataFrame, payload: str, *keep: Column) -> DataFrame:
    """`keep` and `doc`: the line as a variant object, null where it is not one complete JSON object.

    The parser stops after the first value, so the line is parsed as the only element of a list: text after the object
    then is an error. A line with the same key twice counts as malformed. Each line is parsed once: the parsed value is
    a column of its own, since an expression used several times would be computed as often.
    """
    text = F.col(f"`{payload}`").cast("string")
    listed = lines.select(*keep, F.regexp_replace(text, r"^\s+|\s+$", "").alias("_text"), F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).alias("_list"))
    one = F.col("_text").startswith("{") & F.col("_text").endswith("}") & F.isnull(F.try_variant_get("_list", "$[1]", "variant"))
    first = F.try_variant_get("_list", "$[0]", "variant")
    return listed.withColumn("doc", F.when(one, first)).drop("_text", "_list")


def raw_type(schema: Column) -> Column:
    """JSON type of a variant from its schema: integer, decimal, string, boolean, array, object; null for a JSON null.

    1.0 is a decimal: the parser keeps it as a decimal number where 1 is a whole one, unless that has over 18 digits.
    """
    long = schema.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return (
        F.when(schema == "BIGINT", "integer")
        .when(schema == "STRING", "string")
        .when(schema.startswith("DECIMAL"), F.when(long, "integer").otherwise("decimal"))
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.isin("DOUBLE", "FLOAT"), "decimal")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
    )


def path_values(lines: DataFrame, c: FileColumns = FileColumns()) -> DataFrame:
    """A row for each top-level field of each good line: file, group, time, record, `path`, `value` (variant), `type`."""
    keep = [F.col(f"`{name}`").alias(alias) for name, alias in ((c.file, "file"), (c.group, "grp"), (c.time, "time"), (c.record, "record"))]
    placed = parse_lines(lines, c.payload, *keep)
    exploded = placed.lateralJoin(placed.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    fields = exploded.select("file", "grp", "time", "record", F.col("key").alias("path"), "value", F.schema_of_variant("value").alias("_schema"))
    return fields.where("path is not null").withColumn("type", raw_type(F.col("_schema"))).drop("_schema")


def plain_value(value: Column) -> Column:
    """A value however it is written, as text: wrapped ({"value": x}, {"v": x}, [x]), quoted, yes/no or 1/0 alike.

    Numbers come out as whole thousandths, truth values as 1000 and 0, so that 12.5, "12.500" and {"v": 12.5} agree.
    """
    each = [F.try_variant_get(value, path, "string") for path in ("$.value", "$.v")]
    only = F.when(F.isnull(F.try_variant_get(value, "$[1]", "variant")), F.try_variant_get(value, "$[0]", "string"))
    inner = F.coalesce(*each, only, F.try_variant_get(value, "$", "string"))
    text = F.trim(inner)
    low = F.lower(text)
    as_number = text.try_cast("decimal(28,6)")
    return (
        F.when(low.isin("true", "t", "yes", "y", "on"), "1000")
        .when(low.isin("false", "f", "no", "n", "off"), "0")
        .when(as_number.isNotNull(), F.round(as_number * 1000, 0).cast("decimal(28,0)").cast("string"))
        .otherwise(text)
    )


def file_stats(values: DataFrame) -> DataFrame:
    """Per file and path: lines with the path, lines with a value, and the commonest type of the values (`type`)."""
    by = ["grp", "file", "path"]
    counted = values.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("time"))
    return counted.groupBy(*by).agg(
        F.min("time").alias("time"),
        F.sum("n").alias("n_lines"),
        F.coalesce(F.sum(F.when(F.col("type").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
        F.max(F.when(F.col("type").isNotNull(), F.struct("n", "type"))).getField("type").alias("type"),
    )


def file_pairs(stats: DataFrame) -> DataFrame:
    """Each file with the next one of its group, as `prior`, `file`: by time, then by file."""
    files = stats.groupBy("grp", "file").agg(F.min("time").alias("time")).select(
        "grp", "file", F.struct("time", "file").alias("at"), F.date_trunc("month", "time").alias("month")
    )
    return (
        with_next(files, ["grp"], "at", "month", "next").where("next is not null")
        .select(F.col("file").alias("prior"), F.col("next.file").alias("file"))
    )


def schema_changes(lines: DataFrame, c: FileColumns = FileColumns(), values: DataFrame | None = None) -> DataFrame:
    """Changes of top-level fields from a file to its group's next: `file_id`, `change_kind`, `field_name`, `new_name`.

    change_kind: added, removed, retyped, renamed (`new_name`, else ''). Files of a group follow each other by time,
    then file. A file without a good line, and lines without a file, are left out. Lines that are not one complete JSON object count for nothing;
    repeated lines change nothing; a null group is a group. A field is renamed when it is gone and a new one has its
    values in every record that both files hold with a value; of several such pairs each name is used once, most
    records first, then by name. A field with only nulls in a file keeps its earlier type. Empty in, empty out.

    Lines are parsed once, into path-values in the shared folder (`values`, if they are there already), and reduced to one
    row per file and path before anything is compared; files are paired through monthly shards of their group; only
    values of fields that come or go are compared, record by record.
    """
    values = (values or cut(path_values(lines, c), "path-values")).where("file is not null")
    stats = cut(file_stats(values), "file-stats")
    pairs = file_pairs(stats)
    typed = stats.select(F.col("file").alias("at"), "path", "type")
    earlier = pairs.join(typed, F.col("prior") == F.col("at")).select("prior", "file", "path", F.col("type").alias("type_before"), F.lit(True).alias("was"))
    later = pairs.join(typed, F.col("file") == F.col("at")).select("prior", "file", "path", F.col("type").alias("type_now"), F.lit(True).alias("now"))
    both = cut(earlier.join(later, ["prior", "file", "path"], "full"), "file-fields")
    gone, new = both.where("now is null"), both.where("was is null")
    renames = cut(_renames(values, gone, new), "renames")
    old_used = renames.select("file", F.col("old").alias("path"))
    new_used = renames.select("file", F.col("new").alias("path"))
    none = F.lit("").alias("new_name")
    changes = (
        gone.join(old_used, ["file", "path"], "left_anti").select("file", F.lit("removed").alias("kind"), "path", none)
        .unionByName(new.join(new_used, ["file", "path"], "left_anti").select("file", F.lit("added").alias("kind"), "path", none))
        .unionByName(renames.select("file", F.lit("renamed").alias("kind"), F.col("old").alias("path"), F.col("new").alias("new_name")))
        .unionByName(_retyped(both, stats, renames).select("file", F.lit("retyped").alias("kind"), "path", none))
    )
    return changes.select(
        F.col("file").alias("file_id"), F.col("kind").alias("change_kind"), F.col("path").alias("field_name"), "new_name"
    )


def _renames(values: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Renamed fields (prior, file, old, new, type_before, type_now) of a step, each name once."""
    wanted = gone.select(F.col("file").alias("to"), F.col("prior").alias("at"), F.col("path").alias("name"), F.lit(True).alias("old")).unionByName(
        new.select(F.col("file").alias("to"), F.col("file").alias("at"), F.col("path").alias("name"), F.lit(False).alias("old"))
    )
    found = values.join(wanted, [F.col("file") == F.col("at"), F.col("path") == F.col("name")]).select(
        "to", "record", "name", "old", plain_value(F.col("value")).alias("plain")
    )
    # One value for each record and field: of lines that repeat a record, the smallest.
    single = found.where("plain is not null").groupBy("to", "record", "name", "old").agg(F.min("plain").alias("plain"))
    left = single.where("old").select("to", "record", F.col("name").alias("was"), F.col("plain").alias("a"))
    right = single.where("not old").select("to", "record", F.col("name").alias("now"), F.col("plain").alias("b"))
    # Seconds may have become milliseconds on the way, or the other way round.
    a, b = F.col("a").try_cast("decimal(28,0)"), F.col("b").try_cast("decimal(28,0)")
    same = (F.col("a") == F.col("b")) | F.coalesce((a * 1000 == b) | (b * 1000 == a), F.lit(False))
    pairs = (
        left.join(right, ["to", "record"]).groupBy("to", "was", "now")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_and(same).alias("all"), F.countDistinct("a").alias("kinds"))
        .where("all")
    )
    # Greedy choice within a step: a handful of names, folded in order, each used once.
    first = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("kinds")).alias("k"), "was", "now")))
    ranked = pairs.groupBy("to").agg(first.alias("p"))

    def taken(chosen: Column, x: Column) -> Column:
        return F.exists(chosen, lambda y: (y["was"] == x["was"]) | (y["now"] == x["now"]))

    chosen = F.aggregate("p", F.slice("p", 1, 0), lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    named = ranked.select(F.col("to").alias("file"), F.explode(chosen).alias("x")).select("file", F.col("x.was").alias("old"), F.col("x.now").alias("new"))
    return named.join(gone.select("prior", "file", F.col("path").alias("old"), "type_before"), ["file", "old"]).join(
        new.select("file", F.col("path").alias("new"), "type_now"), ["file", "new"]
    )


def _retyped(both: DataFrame, stats: DataFrame, renames: DataFrame) -> DataFrame:
    """Fields (file, path) whose type is another than the last one known, through renames and files with only nulls."""
    links = (
        both.where("was and now").select("prior", "file", "path", F.col("path").alias("old"), "type_before", "type_now")
        .unionByName(renames.select("prior", "file", F.col("new").alias("path"), "old", "type_before", "type_now"))
    )
    known = links.where("type_now is not null and type_before is not null and type_now <> type_before").select("file", "path")
    # A field with only nulls points to the file before; pointers are doubled until each meets a type or the first file.
    open_ends = links.where("type_now is not null and type_before is null").select("file", "path", F.col("prior").alias("at"), "old", "type_now")
    back = cut(links.where("type_now is null").select(F.col("file").alias("at"), F.col("path").alias("old"), F.col("prior").alias("to"), F.col("old").alias("to_old"), F.col("type_before").alias("found")), "null-fields")
    while not (waiting := back.where("found is null").join(back.select(F.col("at").alias("to"), F.col("old").alias("to_old")), ["to", "to_old"])).isEmpty():
        del waiting
        onward = back.select(F.col("at").alias("to"), F.col("old").alias("to_old"), F.col("to").alias("_to"), F.col("to_old").alias("_old"), F.col("found").alias("_found"))
        step = back.join(onward, ["to", "to_old"], "left")
        moves = F.col("found").isNull() & F.col("_to").isNotNull()
        back = cut(
            step.select(
                "at", "old", F.when(moves, F.col("_to")).otherwise(F.col("to")).alias("to"),
                F.when(moves, F.col("_old")).otherwise(F.col("to_old")).alias("to_old"), F.coalesce("found", "_found").alias("found"),
            ),
            "null-fields",
        )
    late = open_ends.join(back, ["at", "old"]).where("found is not null and found <> type_now").select("file", "path")
    return known.unionByName(late)


def _element(value: Column) -> Column:
    """The only element of a one-element list, else null."""
    return F.when(F.isnull(F.try_variant_get(value, "$[1]", "variant")), F.try_variant_get(value, "$[0]", "variant"))


def _field(doc: Column, name: str) -> Column:
    """A top-level field of an object, whatever its name."""
    for quote in "'\"":
        if quote not in name:
            return F.try_variant_get(doc, f"$[{quote}{name}{quote}]", "variant")
    return F.try_variant_get(doc, "$", "map<string,variant>")[F.lit(name)]


def first_names(lines: DataFrame, c: FileColumns = FileColumns(), values: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """`file`, `path`, `first`: the name that each file's field had in the first file of its group that holds it.

    Fields are followed from file to file under their name or through a rename; one that comes back after a file without
    it starts anew. A name can so stand for different fields in two files. In a file where two fields had the same first name
    all keep their own. Pointers to the file before are doubled until
    each meets the first file.
    """
    values = values or cut(path_values(lines, c), "path-values")
    stats = cut(file_stats(values.where("file is not null")), "file-stats")
    pairs = file_pairs(stats)
    here = stats.select("file", "path")
    before = stats.select(F.col("file").alias("prior"), "path")
    renames = (changes or schema_changes(lines, c, values)).where("change_kind = 'renamed'").select(F.col("file_id").alias("file"), F.col("new_name").alias("path"), F.col("field_name").alias("old"))
    links = (
        here.join(pairs, "file").join(before, ["prior", "path"]).select("file", "path", F.col("prior").alias("to"), F.col("path").alias("old"))
        .unionByName(renames.join(pairs, "file").select("file", "path", F.col("prior").alias("to"), "old"))
    )
    back = cut(here.join(links, ["file", "path"], "left"), "field-links")
    while True:
        onward = back.where("to is not null").select(F.col("file").alias("to"), F.col("path").alias("old"), F.col("to").alias("_to"), F.col("old").alias("_old"))
        step = cut(back.join(onward, ["to", "old"], "left"), "field-links")
        if step.where("_to is not null").isEmpty():
            found = back.select("file", "path", F.coalesce("old", "path").alias("first"))
            clear = found.groupBy("file").agg((F.count("first") == F.countDistinct("first")).alias("clear"))
            return found.join(clear, "file").select("file", "path", F.when(F.col("clear"), F.col("first")).otherwise(F.col("path")).alias("first"))
        back = step.select("file", "path", F.coalesce("_to", "to").alias("to"), F.when(F.col("_to").isNotNull(), F.col("_old")).otherwise(F.col("old")).alias("old"))


def whole_table(lines: DataFrame, c: FileColumns = FileColumns()) -> DataFrame:
    """`consistent_table` of every top-level field of the lines, see `field_columns`; file by file under its name there.

    Lines without a file have no history: their fields go by name.
    """
    values = cut(path_values(lines, c), "path-values")
    changes = cut(schema_changes(lines, c, values), "changes")
    firsts = cut(first_names(lines, c, values, changes), "first-names")
    columns = field_columns(lines, firsts, c, values=values, changes=changes)
    names = firsts.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("first", "path"))).alias("_names"))
    return consistent_table(lines.join(names, F.col(f"`{c.file}`") == F.col("file"), "left").drop("file"), columns, c, lists=True, names="_names")


def field_columns(
    lines: DataFrame, firsts: DataFrame, c: FileColumns = FileColumns(), taken: Sequence[str] = ("file_id", "job_id", "record_key", "failed"),
    values: DataFrame | None = None, changes: DataFrame | None = None,
) -> dict[str, tuple[str, list[str]]]:
    """Columns for `consistent_table` that hold every top-level path of the lines: type and first names, commonest first.

    Fields are told by their first names (`first_names`). Names that a rename links are one column unless both are
    fields of one file; renames seen in most files are taken first. The type is that of at least half of the column's
    values: boolean, array<string>, seconds (any number with a fraction; whole ones then are thousandths), bigint, else
    string. A column is named after its commonest name, with a number added if that is `taken` or differs in case only.

    The driver sees one row per name, per pair of names in a file and per rename.
    """
    values = (values or path_values(lines, c)).join(firsts, ["file", "path"], "left").withColumn("path", F.coalesce("first", "path"))
    inner = F.coalesce(*[F.try_variant_get(F.coalesce(_element(F.col("value")), F.col("value")), p, "variant") for p in ("$.value", "$.v", "$")])
    seen = values.select("path", inner.alias("inner"), (F.col("type") == "array").alias("listed"), F.isnotnull(F.try_variant_get("value", "$[1]", "variant")).alias("several"))
    seen = seen.select("path", "listed", "several", raw_type(F.schema_of_variant("inner")).alias("kind"), F.trim(F.try_variant_get("inner", "$", "string")).alias("text"))
    number = F.when(F.col("kind") != "boolean", F.col("text").try_cast("double"))
    decimal = F.col("text").contains(".") & number.isNotNull()
    truth = (F.col("kind") == "boolean") | F.lower("text").isin("true", "t", "yes", "y", "false", "f", "no", "n")
    counts = {
        r["path"]: r.asDict()
        for r in seen.groupBy("path").agg(
            F.count("text").alias("n"), F.count_if(truth).alias("truth"), F.count(number).alias("number"), F.count_if(decimal).alias("decimal"),
            F.count_if(decimal & (number != F.floor(number))).alias("fraction"), F.count_if("listed").alias("listed"), F.count_if("several").alias("several"),
        ).collect()
    }
    files = firsts.select("file", F.col("first").alias("path"))
    other = files.select("file", F.col("path").alias("other"))
    together = {(r[0], r[1]) for r in files.join(other, "file").where("path < other").select("path", "other").distinct().collect()}
    renames = (changes or schema_changes(lines, c)).where("change_kind = 'renamed'")
    old, new = F.col("field_name"), F.col("new_name")
    links = renames.groupBy(F.least(old, new).alias("a"), F.greatest(old, new).alias("b")).count().collect()
    group = {name: {name} for name in counts}
    for a, b, _ in sorted(links, key=lambda r: (-r[2], r[0], r[1])):
        if a in group and b in group and group[a] is not group[b] and not any((min(x, y), max(x, y)) in together for x in group[a] for y in group[b]):
            group[a] |= group[b]
            for name in group[b]:
                group[name] = group[a]
    out: dict[str, tuple[str, list[str]]] = {}
    used = {t.lower() for t in taken}
    for names in sorted({id(g): sorted(g, key=lambda x: (-counts[x]["n"], x)) for g in group.values()}.values()):
        column, k = names[0], 1
        while column.lower() in used:
            k += 1
            column = f"{names[0]}_{k}"
        used.add(column.lower())
        out[column] = (_kind({k: sum(counts[x][k] for x in names) for k in ("n", "truth", "number", "decimal", "fraction", "listed", "several")}), names)
    return out


def _kind(n: dict[str, int]) -> str:
    if n["several"] and 2 * n["listed"] >= n["n"]:
        return "array<string>"
    if n["truth"] and 2 * n["truth"] >= n["n"]:
        return "boolean"
    if n["number"] and 2 * n["number"] >= n["n"]:
        return "seconds" if n["fraction"] and 2 * n["fraction"] >= n["decimal"] else "bigint"
    return "string"


def consistent_table(lines: DataFrame, columns: dict[str, tuple[str, Sequence[str]]], c: FileColumns = FileColumns(), lists: bool = False, names: str | None = None) -> DataFrame:
    """One typed row per good line: file, group, record, the `columns`, and `failed` casts.

    `columns` maps a column to its type and the names its field has had; the first with a value counts. `failed` maps a
    column to the text that could not be cast (the column then is null). Types are Spark's, or seconds: times that are
    written as decimals in seconds and as whole numbers in milliseconds. Wrapped and quoted values are unwrapped first,
    with `lists` also one-element lists. An array<string> can be written as texts joined by "|".
    `names` is a column with a map from the names in `columns` to those in the line's file, if they differ by file; where
    it is null the names are taken as they are.
    """
    keep = [F.col(f"`{name}`").alias(alias) for name, alias in ((c.file, "file_id"), (c.group, "job_id"), (c.record, "record_key"), *([(names, names)] if names else []))]
    placed = parse_lines(lines, c.payload, *keep).where(F.schema_of_variant("doc").startswith("OBJECT"))
    # Step by step, each value computed once: the raw values as one list, their texts by one lambda, then the casts.
    if names is None:
        each = [F.coalesce(*[_field(F.col("doc"), a) for a in aliases]) for _, aliases in columns.values()]
    else:
        placed = placed.withColumn("_map", F.try_variant_get("doc", "$", "map<string,variant>"))
        own = [F.coalesce(*[F.col("_map")[F.col(names)[a]] for a in aliases]) for _, aliases in columns.values()]
        each = [F.when(F.col(names).isNotNull(), o).otherwise(F.coalesce(*[F.col("_map")[F.lit(a)] for a in aliases])) for o, (_, aliases) in zip(own, columns.values())]
    raws = placed.select("file_id", "job_id", "record_key", F.array(*each).alias("_raw"))

    def unwrapped(raw: Column) -> Column:
        return F.coalesce(*[F.try_variant_get(raw, path, "variant") for path in ("$.value", "$.v", "$")])

    def described(inner: Column) -> Column:
        return F.struct(F.try_variant_get(inner, "$", "string").alias("text"), raw_type(F.schema_of_variant(inner)).alias("type"))

    bare = F.transform("_raw", lambda raw: unwrapped(F.coalesce(_element(raw), raw) if lists else raw))
    described_rows = raws.withColumn("_inner", bare).withColumn("_all", F.transform("_inner", described))
    out, texts = [], []
    for k, (kind, _) in enumerate(columns.values()):
        text, of = F.col("_all")[k]["text"], F.col("_all")[k]["type"]
        if kind == "boolean":
            low = F.lower(F.trim(text))
            value = F.when(low.isin("true", "t", "yes", "y", "1"), True).when(low.isin("false", "f", "no", "n", "0"), False)
        elif kind == "seconds":
            number = text.try_cast("double")
            whole = (of == "integer") | ((of == "string") & text.rlike(r"^\s*\d{4,}\s*$"))
            value = F.when(whole, number / 1000).otherwise(number)
        elif kind == "bigint":
            number = text.try_cast("decimal(38,6)")
            value = F.when(number == F.floor(number), number.try_cast("bigint"))
        elif kind == "array<string>":
            value = F.coalesce(F.try_variant_get(unwrapped(F.col("_raw")[k]), "$", kind), F.split(text, r"\|"))
        else:
            value = text.try_cast(kind)
        out.append(value.alias(f"_{k}"))
        texts.append(text)
    typed = described_rows.select("file_id", "job_id", "record_key", "_all", *out)
    failed = [F.when(texts[k].isNotNull() & F.isnull(f"_{k}"), F.struct(F.lit(name).alias("key"), texts[k].alias("value"))) for k, name in enumerate(columns)]
    report = F.map_from_entries(F.filter(F.array(*failed), lambda x: x.isNotNull()))
    return typed.select("file_id", "job_id", "record_key", *[F.col(f"_{k}").alias(name) for k, name in enumerate(columns)], report.alias("failed"))
