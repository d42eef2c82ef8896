"""The general data-preparation queries, over the tables of one folder."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.operators.drift import path_values, plain_value, schema_changes, whole_table
from chalkline.operators.grid import complete_grid
from chalkline.operators.intervals import periods_and_gaps
from chalkline.operators.spikes import Reading, flag_readings
from chalkline.operators.timeline import micro
from chalkline.sources.tables import load

READINGS = (Reading("residual_motion_max"), Reading("max_ball_speed", zero_is_normal=True), Reading("camera_motion_magnitude"))
SERIES = ("audio_onset", "residual_motion_mean")


def p1_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every implausible reading with the reason and the value."""
    rows = load(spark, folder, "frame_features", "row_id", "job_id", "layer", "t", *[r.name for r in READINGS])
    return flag_readings(rows, ["job_id", "layer"], "t", "row_id", READINGS)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible readings of the three measurements."""
    return p1_flags(spark, folder).select("row_id", "field_name")


def p2_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Both series of every job, one value a second, missing seconds filled or marked."""
    rows = load(spark, folder, "frame_features", "job_id", "t", *SERIES)
    return complete_grid(rows, ["job_id"], "t", SERIES)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds of a sitting without a usable reading of the series."""
    return p2_grid(spark, folder).where("status <> 'observed'").select("job_id", "field_name", "slot")


def p2_status(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of every second: observed with its value (in millionths), filled or unsupported."""
    value = F.when(F.col("status") == "observed", micro(F.col("value")))
    return p2_grid(spark, folder).select("job_id", "field_name", "slot", "status", value.alias("observed"))


RAW = ("file_id", "job_id", "written_at", "record_key", "payload")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of the fields of older analysis files, from file to file."""
    return schema_changes(load(spark, folder, "raw_records", *RAW))


def p4_table(spark: SparkSession, folder: str) -> DataFrame:
    """The older files as one table of all their fields, with the texts of the casts that failed in a row."""
    return whole_table(load(spark, folder, "raw_records", *RAW))


def p4_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of every field of the older files under its name there, with its type and its text, whatever it is wrapped in."""
    values = path_values(load(spark, folder, "raw_records", *RAW))
    plain = values.select("*", plain_value(F.col("value")).alias("plain"))
    # Lists and objects that are no wrapping of one value are told by their type only: their text has no one form.
    return plain.selectExpr("file as file_id", "record as record_key", "path as field_name", "type as json_type", r"if(plain rlike '^[\\[{]', null, plain) as plain")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods and gaps of shots and scenes."""
    parts = [
        periods_and_gaps(load(spark, folder, table, "job_id", start, end), ["job_id"], start, end).withColumn(
            "table_name", F.lit(table)
        )
        for table, start, end in (("shots", "clip_start", "clip_end"), ("scenes", "start", "end"))
    ]
    return parts[0].unionByName(parts[1]).select("job_id", "table_name", "kind", "start_ms", "end_ms")


QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p2_found": p2_found, "p2_grid": p2_grid, "p2_status": p2_status, "p4_found": p4_found, "p4_table": p4_table, "p4_values": p4_values, "p6_found": p6_found}

_P6 = """
, {t}_v as (select distinct job_id, cast(round({a} * 1000) as bigint) lo, cast(round({b} * 1000) as bigint) hi from {t}
            where {a} is not null and {b} is not null and isfinite({a}) and isfinite({b})),
{t}_h as (select *, case when lo > max(hi) over w + 1 or max(hi) over w is null then 1 else 0 end h
          from {t}_v where hi > lo window w as (partition by job_id order by lo, hi rows between unbounded preceding and 1 preceding)),
{t}_i as (select *, sum(h) over (partition by job_id order by lo, hi rows unbounded preceding) i from {t}_h),
{t}_p as (select job_id, min(lo) lo, max(hi) hi from {t}_i group by job_id, i),
{t}_n as (select *, lead(lo) over (partition by job_id order by lo) nx from {t}_p),
{t}_o as (select job_id, '{t}' table_name, 'period' kind, lo start_ms, hi end_ms from {t}_p
          union all select job_id, '{t}', 'gap', hi, nx from {t}_n where nx - hi < 3600000)
"""

_P2 = """
with r as (select job_id, t, floor(t)::bigint slot, audio_onset a, residual_motion_mean m from frame_features where isfinite(t)),
d as (select distinct job_id, t from r),
g as (select *, case when t - lag(t) over (partition by job_id order by t) < 3600 then 0 else 1 end h from d),
s as (select *, sum(h) over (partition by job_id order by t rows unbounded preceding) sitting from g),
b as (select job_id, sitting, floor(min(t))::bigint lo, floor(max(t))::bigint hi from s group by all),
c as (select job_id, unnest(generate_series(lo, hi)) slot from b),
v as (select job_id, slot, bool_or(coalesce(isfinite(a) and a >= 0, false)) a, bool_or(coalesce(isfinite(m) and m >= 0, false)) m from r group by all)
select c.job_id, f.field_name, c.slot from c cross join (values ('audio_onset'), ('residual_motion_mean')) f(field_name)
left join v on v.job_id = c.job_id and v.slot = c.slot
where not coalesce(case f.field_name when 'audio_onset' then v.a else v.m end, false)
"""

_P2_STATUS = _P2[: _P2.index("v as (")] + """
v as (select job_id, slot, avg(case when isfinite(a) and a >= 0 then a end) a, avg(case when isfinite(m) and m >= 0 then m end) m from r group by all),
n as (select c.job_id, c.slot, count(v.a) + count(v.m) near from c left join v on v.job_id = c.job_id and v.slot between c.slot - 2 and c.slot + 2 group by all),
o as (select c.job_id, c.slot, c.slot - b.lo off, v.a, v.m from c join b on b.job_id = c.job_id and c.slot between b.lo and b.hi left join v on v.job_id = c.job_id and v.slot = c.slot),
x as (select off, count(a) + count(m) known from o group by all),
y as (select job_id, count(a) na, count(m) nm from o group by all)
select o.job_id, f.field_name, o.slot, case when val is not null then 'observed' when own > 0 and (near >= 2 or (own >= 2 and known >= 2)) then 'filled' else 'unsupported' end status, round_even(val * 1000000, 0)::bigint observed
from o join n using (job_id, slot) join x using (off) join y using (job_id), lateral (values ('audio_onset', o.a, y.na), ('residual_motion_mean', o.m, y.nm)) f(field_name, val, own)
"""

_WIDTH = repr(math.log(1.02 / 0.98))
_SOURCE = "job_id, layer, field"
_HOUR = _SOURCE + ', "hour"'


def _p1_levels(name: str, by: str) -> str:
    """Quartiles, and the fences three ranges or a factor ten beyond them; what is beyond, if a hundredth, has its own."""
    return f"""{name}_q as (select {by}, count(*) n, (quantile_cont(b, 0.25) + 0.5) * {_WIDTH} q1, (quantile_cont(b, 0.75) + 0.5) * {_WIDTH} q3 from k group by all),
{name}_b as (select {by}, count(*) above, (quantile_cont(b, 0.25) + 0.5) * {_WIDTH} b1, (quantile_cont(b, 0.75) + 0.5) * {_WIDTH} b3 from k join {name}_q using ({by}) where (b + 0.5) * {_WIDTH} > q3 + (q3 - q1) * 3 group by all),
{name}_l as (select {by}, count(*) below from k join {name}_q using ({by}) where (b + 0.5) * {_WIDTH} < q1 - (q3 - q1) * 3 group by all),
{name} as (select {by}, n, exp(q1) "floor", case when above >= greatest(n * 0.01, 8) then b3 + greatest((b3 - b1) * 3, ln(10)) else q3 + greatest((q3 - q1) * 3, ln(10)) end upper,
   case when below >= greatest(n * 0.01, 8) then null else q1 - greatest((q3 - q1) * 3, ln(10)) end lower from {name}_q left join {name}_b using ({by}) left join {name}_l using ({by}))"""


def _p1_steps(name: str, by: str) -> str:
    return f"""{name} as (select *, q3 + (q3 - q1) * 6 fence, (q3 - q1) / 32 still from
   (select {by}, count(*) n, exp((quantile_cont(b, 0.25) + 0.5) * {_WIDTH}) q1, exp((quantile_cont(b, 0.75) + 0.5) * {_WIDTH}) q3 from kk group by all))"""


def _p1_spike(x: str) -> str:
    return f"({x} > 0 and (coalesce(ln(greatest({x}, \"floor\")) - base > greatest(coalesce(fence, 0), ln(3)), false) or coalesce(ln({x}) > upper, false)))"


def _p1_drop(x: str) -> str:
    return f"(field <> 1 and {x} > 0 and (coalesce(top - ln({x}) > greatest(coalesce(fence, 0), ln(3)) and {x} < \"floor\", false) or coalesce(ln({x}) < lower, false)))"


def _p1_alike(a: str, b: str) -> str:
    return f"coalesce({a} = {b} or case when {a} > 0 and {b} > 0 then abs(ln({a}) - ln({b})) <= coalesce(still, 0) else false end, false)"


_P1 = f"""
with r as (select row_id, job_id, layer, round(t * 1000)::bigint ms, floor(round(t * 1000) / 3600000)::bigint "hour", residual_motion_max v0, max_ball_speed v1, camera_motion_magnitude v2 from frame_features),
l as (select * from (select row_id, job_id, layer, ms, "hour", 0 field, v0 v from r union all select row_id, job_id, layer, ms, "hour", 1, v1 from r union all select row_id, job_id, layer, ms, "hour", 2, v2 from r) where v is not null),
ok as (select * from l where not isnan(v) and v >= 0 and v < 'infinity'::double),
k as materialized (select job_id, layer, "hour", field, floor(ln(v) / {_WIDTH})::int b from ok where v > 0),
{_p1_levels("whole", _SOURCE)},
{_p1_levels("own", _HOUR)},
hours as (select distinct job_id, layer, "hour" from k),
lv as (select h.job_id, h.layer, h."hour", w.field, w."floor", case when o.n >= 200 and o.upper is not null then (w.upper + o.upper) / 2 else w.upper end upper, case when o.n >= 200 and o.lower is not null then (w.lower + o.lower) / 2 else w.lower end lower
   from hours h join whole w on w.job_id = h.job_id and w.layer = h.layer left join own o on o.job_id = h.job_id and o.layer = h.layer and o."hour" = h."hour" and o.field = w.field),
g as (select job_id, layer, field, ms, "hour", max(v) x, min(v) m from ok where ms is not null group by all),
s as (select g.*, "floor", upper, lower, ln(greatest(x, "floor")) y, case when x > 0 then ln(x) end z from g left join lv using (job_id, layer, field, "hour")),
a as (select *, case when ms - lag(ms) over o <= 30000 then lag(y) over o end p1, case when ms - lag(ms, 2) over o <= 30000 then lag(y, 2) over o end p2,
   case when lead(ms) over o - ms <= 30000 then lead(y) over o end n1, case when lead(ms, 2) over o - ms <= 30000 then lead(y, 2) over o end n2,
   case when ms - lag(ms) over o <= 30000 then lag(z) over o end pz1, case when ms - lag(ms, 2) over o <= 30000 then lag(z, 2) over o end pz2,
   case when lead(ms) over o - ms <= 30000 then lead(z) over o end nz1, case when lead(ms, 2) over o - ms <= 30000 then lead(z, 2) over o end nz2
   from s window o as (partition by job_id, layer, field order by ms)),
ar as materialized (select *, greatest(least(p1, p2), least(n1, n2)) base, least(greatest(pz1, pz2), greatest(nz1, nz2)) top from a),
kk as (select job_id, layer, "hour", field, floor(ln(greatest(abs(y - p1), 0.0001)) / {_WIDTH})::int b from ar where y > ln("floor") and p1 > ln("floor")),
{_p1_steps("wst", _SOURCE)},
{_p1_steps("ost", _HOUR)},
st as (select h.job_id, h.layer, h."hour", w.field, case when o.n >= 200 then (w.fence + o.fence) / 2 else w.fence end fence, case when o.n >= 200 then (w.still + o.still) / 2 else w.still end still
   from (select distinct job_id, layer, "hour" from kk) h join wst w on w.job_id = h.job_id and w.layer = h.layer left join ost o on o.job_id = h.job_id and o.layer = h.layer and o."hour" = h."hour" and o.field = w.field),
j as (select ar.*, fence, still from ar left join st using (job_id, layer, field, "hour")),
od as materialized (select *, {_p1_spike("x")} or {_p1_drop("m")} odd from j),
c as (select *, case when {_p1_alike("x", "lag(x) over o")} then 0 else 1 end fresh from od where not odd and (field <> 1 or x > 0) window o as (partition by job_id, layer, field order by ms)),
i as (select *, sum(fresh) over (partition by job_id, layer, field order by ms rows unbounded preceding) run from c),
u as (select job_id, layer, field, ms, x c, count(*) over (partition by job_id, layer, field, run) len from i),
e as (select l.row_id, l.field, l.v, od.base, od.top, od.fence, od.still, lv."floor", lv.upper, lv.lower, u.c, u.len from l left join od on od.job_id = l.job_id and od.layer = l.layer and od.field = l.field and od.ms = l.ms
   left join lv on lv.job_id = l.job_id and lv.layer = l.layer and lv.field = l.field and lv."hour" = l."hour"
   left join u on u.job_id = l.job_id and u.layer = l.layer and u.field = l.field and u.ms = l.ms),
o as (select row_id, field, v "value", case when isnan(v) or v < 0 or isinf(v) then 'impossible' when {_p1_spike("v")} then 'spike' when {_p1_drop("v")} then 'dropout' when len >= 7 and {_p1_alike("v", "c")} then 'stuck' else '' end reason from e)
select row_id, ['residual_motion_max', 'max_ball_speed', 'camera_motion_magnitude'][field + 1] field_name"""

_TEXT = """coalesce(case json_type(v) when 'OBJECT' then coalesce(json_extract_string(v, '$.value'), json_extract_string(v, '$.v'), v::varchar)
   when 'ARRAY' then case when json_array_length(v) = 1 then json_extract_string(v, '$[0]') else v::varchar end
   when 'NULL' then null else json_extract_string(v, '$') end)"""
_P4 = f"""
with l as (select file_id, job_id, written_at, record_key, payload::json j from raw_records where json_valid(payload) and json_type(try_cast(payload as json)) = 'OBJECT'),
k as (select *, unnest(json_keys(j)) name from l),
e as (select file_id, job_id, written_at, record_key, name, json_extract(j, '$."' || name || '"') v from k),
y as (select *, case json_type(v) when 'NULL' then null when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'DOUBLE' then 'decimal' else 'integer' end kind,
   trim({_TEXT}) txt from e),
x as (select *, case when lower(txt) in ('true', 't', 'yes', 'y', 'on') then '1000' when lower(txt) in ('false', 'f', 'no', 'n', 'off') then '0'
   when try_cast(txt as decimal(28, 6)) is not null then round(try_cast(txt as decimal(28, 6)) * 1000)::bigint::varchar else txt end plain from y),
fo as (select job_id, file_id, row_number() over (partition by job_id order by min(written_at), file_id) o from l group by 1, 2),
tc as (select job_id, file_id, name, kind, count(*) n from x group by all),
ft as (select job_id, file_id, o, name, arg_max(kind, (n, kind)) filter (kind is not null) kind from tc join fo using (job_id, file_id) group by all),
isl as (select *, o - row_number() over (partition by job_id, name order by o) g from ft),
kn as (select *, last_value(kind ignore nulls) over (partition by job_id, name, g order by o rows unbounded preceding) known from isl),
gone as (select a.job_id, n.file_id, n.o, a.name, a.known from kn a join fo n on n.job_id = a.job_id and n.o = a.o + 1 left join kn b on b.job_id = a.job_id and b.o = a.o + 1 and b.name = a.name where b.name is null),
new as (select b.job_id, b.file_id, b.o, b.name, b.kind from kn b left join kn a on a.job_id = b.job_id and a.o = b.o - 1 and a.name = b.name where a.name is null and b.o > 1),
vals as (select job_id, o, record_key, name, min(plain) plain from x join fo using (job_id, file_id) where plain is not null group by all),
cmp as (select g.job_id, g.o, g.name was, w.name now_, count(*) n, count(distinct a.plain) kinds,
   bool_and(a.plain = b.plain or coalesce(try_cast(a.plain as hugeint) * 1000 = try_cast(b.plain as hugeint) or try_cast(b.plain as hugeint) * 1000 = try_cast(a.plain as hugeint), false)) fits
   from gone g join new w on w.job_id = g.job_id and w.o = g.o join vals a on a.job_id = g.job_id and a.o = g.o - 1 and a.name = g.name
   join vals b on b.job_id = g.job_id and b.o = g.o and b.name = w.name and b.record_key = a.record_key group by all),
rk as (select *, row_number() over (partition by job_id, o, was order by n desc, kinds desc, now_) i, row_number() over (partition by job_id, o, now_ order by n desc, kinds desc, was) j from cmp where fits),
ren as (select * from rk where i = 1 and j = 1)
select file_id, 'renamed' change_kind, was field_name, now_ new_name from ren join fo using (job_id, o)
union all select file_id, 'removed', name, '' from gone anti join (select job_id, o, was name from ren) using (job_id, o, name)
union all select file_id, 'added', name, '' from new anti join (select job_id, o, now_ name from ren) using (job_id, o, name)
union all select b.file_id, 'retyped', b.name, '' from kn b join kn a on a.job_id = b.job_id and a.o = b.o - 1 and a.name = b.name where b.kind <> a.known
union all select w.file_id, 'retyped', w.name, '' from ren join new w on w.job_id = ren.job_id and w.o = ren.o and w.name = ren.now_ join gone g on g.job_id = ren.job_id and g.o = ren.o and g.name = ren.was where w.kind <> g.known
"""


SQL = {
    "p1_found": _P1 + " from o where reason <> ''",
    "p1_flags": _P1 + ", reason, \"value\" from o where reason <> ''",
    "p4_found": _P4,
    "p4_values": _P4[: _P4.index("fo as (")].rstrip().rstrip(",") + " select file_id, record_key, name field_name, kind json_type, case when not regexp_matches(plain, '^[\\[{]') then plain end plain from x",
    "p2_found": _P2,
    "p2_status": _P2_STATUS,
    "p6_found": "with z as (select 1)"
    + _P6.format(t="shots", a="clip_start", b="clip_end")
    + _P6.format(t="scenes", a='"start"', b='"end"')
    + "select * from shots_o union all select * from scenes_o",
}
