"""The registered queries as plain SQL, written from the semantics and not from the Spark code."""

from __future__ import annotations

from checks.fixture import (
    DEEP_RANKS,
    DEEP_TRIM,
    EMPTY_EVENT,
    KINDS,
    SECONDS,
    SENSORS,
    TENSORS,
    TEST_SIZE,
    TRIM,
    VALIDATION_SIZE,
    WINDOW,
)
from seriesprep.schema import CLASS_NAMES, SOURCE_NAMES, SPLIT_SEED

WIDTH = SECONDS * 1_000_000


def q(name: str) -> str:
    return f'"{name}"'


def each(template: str, separator: str = ",\n  ") -> str:
    """The template once per sensor, with {s} the quoted column and {n} the bare name."""
    return separator.join(template.format(s=q(s), n=s) for s in SENSORS)


def with_(*tables: str) -> str:
    return "with " + ",\n".join(tables) + "\n"


def rounded(name: str, digits: int = 6) -> str:
    return f"round({q(name)} + 1e-{digits + 3}, {digits}) + 0.0 as {q(name)}"


def sensor_list() -> str:
    return ", ".join(rounded(s) for s in SENSORS)


RAW = f"""raw as (
  select user_id as instance_id, event_id, ts,
    {", ".join(f"case when event_type = '{k}' then value end as {q(s)}" for k, s in zip(KINDS, SENSORS))},
    cast(user_id % 9 as int) as class_code,
    cast(regexp_extract(props, '([0-9]+)', 1) as int) as k
  from events)"""

SAMPLES = (
    RAW
    + f""",
samples as (
  select instance_id, event_id, ts, {each("{s}", ", ")}, class_code,
    cast(case when k < 40 then 0 when k < 60 then null
      when k < 80 then case when class_code = 0 then 0 else 100 + class_code end
      else class_code end as double) as class
  from raw)"""
)

SPARSE = (
    SAMPLES
    + """,
sparse as (
  select * replace (
    case when instance_id % 7 <> 0 then "s-view" end as "s-view",
    case when instance_id % 7 <> 1 or (row_number() over (
      partition by instance_id, "s-error" is null order by ts)) = 1 then "s-error" end as "s-error")
  from samples)"""
)

BINS = f"""anchors as (
  select instance_id, min(epoch_us(ts)) as t0, max(epoch_us(ts)) as t1, count(*) as n_rows,
    min(class_code) as class_code
  from samples group by instance_id),
bins as (
  select instance_id, (epoch_us(ts) - t0) // {WIDTH} as bin,
    {each("avg({s}) as {s}")}, min(class) as class
  from samples join anchors using (instance_id) group by all)"""

DENSE = (
    BINS
    + f""",
spine as (
  select instance_id, t0, class_code, unnest(range(0, (t1 - t0) // {WIDTH} + 1)) as bin
  from anchors),
dense as (
  select instance_id, bin, t0, class_code, {each("{s}", ", ")}, class
  from spine left join bins using (instance_id, bin))"""
)


def near(source: str, order: str) -> str:
    """Nearest known value and position of each column at or before, and at or after, a row."""
    parts = []
    for name in (*SENSORS, "class"):
        known = f"case when {q(name)} is not null then {order} end"
        parts += [
            f'last_value({q(name)} ignore nulls) over up as {q("pv:" + name)}',
            f'last_value({known} ignore nulls) over up as {q("pp:" + name)}',
            f'first_value({q(name)} ignore nulls) over down as {q("nv:" + name)}',
            f'first_value({known} ignore nulls) over down as {q("np:" + name)}',
        ]
    joined = ",\n    ".join(parts)
    return f"""near as (
  select *, {joined}
  from {source}
  window up as (partition by instance_id order by {order}
      rows between unbounded preceding and current row),
    down as (partition by instance_id order by {order}
      rows between current row and unbounded following))"""


def line(order: str) -> str:
    return (
        '"pv:{n}" + ("nv:{n}" - "pv:{n}") * (' + order + ' - "pp:{n}")'
        ' / nullif("np:{n}" - "pp:{n}", 0)'
    )


FILLED = f"""{DENSE},
{near("dense", "bin")},
filled as (
  select instance_id, bin, class_code,
    {each('coalesce({s}, ' + line("bin") + ', "pv:{n}", "nv:{n}", 0) as {s}')},
    coalesce("pv:class", "nv:class", class_code) as class
  from near)"""

VALID = f"""validity as (
  select instance_id,
    bool_and({each("coalesce({s}, 0) between -1 and 300", " and ")}
      and ts is not null
      and (coalesce(class, 0) between 0 and 8 or coalesce(class, 0) between 101 and 108)) as valid
  from samples group by instance_id)"""

# Samples of the valid events only, under the name the later tables read.
VALID_SAMPLES = SAMPLES.replace("samples as (", "every as (") + ",\n" + VALID.replace(
    "from samples", "from every"
) + """,
samples as (
  select every.* from every join validity using (instance_id) where valid)"""


def metrics(source: str, k: int, where: str = "true") -> str:
    """``mu`` and ``sigma`` per variable, plus the per-event means and stds they come from."""

    def long(table: str) -> str:
        return " union all ".join(
            f"select instance_id, '{s}' as variable, {q(s)} as value from {table}" for s in SENSORS
        )

    def trimmed(name: str, table: str) -> str:
        return f"""{name}_long as ({long(table)}),
{name}_rank as (
  select *,
    row_number() over (partition by variable, value is null order by value, instance_id) as lo,
    row_number() over (partition by variable, value is null order by value desc, instance_id) as hi
  from {name}_long),
{name} as (
  select variable, avg(case when value is not null and lo > {k} and hi > {k} then value end) as value
  from {name}_rank group by variable)"""

    sq = ", ".join(
        f"sum(pow({q(s)} - (select value from mu where variable = '{s}'), 2)) as {q('ss:' + s)},"
        f" count({q(s)}) as {q('n:' + s)}"
        for s in SENSORS
    )
    std = each(
        """case when "n:{n}" = 0 then 0.0
      when "n:{n}" = 1 and "ss:{n}" > 0 then 'infinity'::double
      when "n:{n}" = 1 then null
      else sqrt("ss:{n}" / ("n:{n}" - 1)) end as {s}"""
    )
    return f"""chosen as (select * from {source} where {where}),
event_means as (select instance_id, {each("avg({s}) as {s}", ", ")} from chosen group by 1),
{trimmed("mu", "event_means")},
squares as (select instance_id, {sq} from chosen group by 1),
event_stds as (select instance_id, {std} from squares),
{trimmed("sigma", "event_stds")}"""


def scalar(table: str, name: str) -> str:
    return f"(select value from {table} where variable = '{name}')"


SCALED = "scaled as (\n  select instance_id, bin, class_code, class,\n    " + ",\n    ".join(
    f"({q(s)} - {scalar('mu', s)}) / nullif({scalar('sigma', s)}, 0) as {q(s)}" for s in SENSORS
) + "\n  from filled)"


def windows(source: str) -> str:
    return f"""stacked as (
  select instance_id, class_code, bin - {WINDOW - 1} as window_idx,
    cast(case when class >= 100 then class - 100 else class end as int) as label,
    list([{each("{s}", ", ")}]) over (partition by instance_id order by bin
      rows between {WINDOW - 1} preceding and current row) as x
  from {source}),
windows as (
  select *, flatten(x) as flat,
    array_to_string(list_transform(range(0, 9), lambda c: cast(c = label as int)), '') as y_text
  from stacked where len(x) = {WINDOW})"""


CHECKSUM = """round(list_sum(list_transform(flat, lambda v, i: v * i)) + 1e-7, 4) + 0.0 as x_sum,
  round(flat[1] + 1e-9, 6) + 0.0 as x_first, round(flat[len(flat)] + 1e-9, 6) + 0.0 as x_last"""

PREPARED = with_(VALID_SAMPLES, FILLED, metrics("samples", TRIM), SCALED, windows("scaled"))

FILES = """files as (
  select user_id as instance_id, cast(user_id % 9 as int) as class_code,
    concat('/data/', cast(user_id % 9 as varchar), '/',
      case (user_id // 9) % 3
        when 0 then concat('WELL-', lpad(cast(user_id % 21 as varchar), 5, '0'), '_20240101',
          lpad(cast(user_id % 24 as varchar), 2, '0'), '0000')
        when 1 then concat('SIMULATED_', lpad(cast(user_id as varchar), 5, '0'))
        else concat('DRAWN_', lpad(cast(user_id as varchar), 5, '0')) end, '.parquet') as path,
    count(*) as num_timesteps
  from events group by user_id)"""


def names_case(expression: str, names) -> str:
    cases = " ".join(f"when {i} then '{name}'" for i, name in enumerate(names))
    return f"case {expression} {cases} end"


DESCRIBED = (
    FILES
    + f""",
described as (
  select *, regexp_extract(path, '([^/]+)[.]parquet$', 1) as stem,
    sha256(regexp_extract(path, '([0-9]+/[^/]+)[.]parquet$', 1)) as event_key,
    {names_case("class_code", CLASS_NAMES)} as class_type,
    case when path like '%/WELL-%' then 'REAL' when path like '%/SIMULATED%' then 'SIMULATED'
      when path like '%/DRAWN%' then 'HAND_DRAWN' end as source,
    cast(nullif(regexp_extract(path, '/WELL-([0-9]+)_', 1), '') as int) as well_id,
    try_strptime(nullif(regexp_extract(path, '_([0-9]{{14}})[.]', 1), ''), '%Y%m%d%H%M%S') as recorded
  from files)"""
)

EVENT_SUMS = f"""sums as (
  select event_key as event_id, s.class_code, count(*)::bigint as n_rows, count(ts)::bigint as n_times,
    count(class)::bigint as n_labelled, coalesce(sum(class), 0)::double as label_sum,
    {each("round(sum({s}) + 1e-7, 4) + 0.0 as {s}", ", ")}
  from samples s join described d using (instance_id) group by event_key, s.class_code)"""

VERSIONS = f"""{FILES},
listing as (
  select concat(case when instance_id % 5 = 0 then '/data/raw'
      else concat('/data/dataset_converted_v', instance_id % 3 + 1, '.', instance_id % 12, '.',
        instance_id % 7) end, substr(path, 6)) as path,
    num_timesteps as length
  from files),
versions as (
  select regexp_extract(path, '^(/data/dataset_converted_v[^/]*)/', 1) as directory,
    true as has_data, sum(length)::bigint as total_bytes
  from listing group by 1),
numbered as (
  select *, regexp_extract(directory, '_v([0-9.]+)$', 1) as version,
    cast(split_part(version, '.', 1) as bigint) * 10000
      + cast(split_part(version, '.', 2) as bigint) * 100
      + cast(split_part(version, '.', 3) as bigint) as version_number
  from versions where directory <> '')"""


def quota(name: str, source: str, pool: str, share: float) -> str:
    """Largest-remainder shares of ``pool`` over the strata; a single row is not divided."""
    return f"""{name}_a as (
  select *, case when {pool} >= 2 then {pool} else 0 end as c,
    sum(case when {pool} >= 2 then {pool} else 0 end) over () as all_rows
  from {source}),
{name}_b as (
  select *, cast(ceil({share!r}::double * all_rows) as bigint) as target from {name}_a),
{name}_c as (
  select *, coalesce((target * c)::bigint // nullif(all_rows, 0)::bigint, 0) as floor_part,
    coalesce((target * c)::bigint % nullif(all_rows, 0)::bigint, 0) as rest from {name}_b),
{name}_d as (
  select *, row_number() over (order by rest desc, source_code, code) as rk,
    target - sum(floor_part) over () as missing from {name}_c),
{name} as (
  select source_code, code, n, {"n_test, " if name == "quota_validation" else ""}
    floor_part + case when rk <= missing then 1 else 0 end as n_{name[6:]}
  from {name}_d)"""


def split_of(source: str) -> str:
    return f"""events_s as (
  select *, case source when 'REAL' then 0 when 'SIMULATED' then 1 else 2 end as source_code,
    class_code as code, sha256(concat('{SPLIT_SEED}|', cast(instance_id as varchar))) as order_hash
  from {source}),
strata as (select source_code, code, count(*) as n from events_s group by all),
{quota("quota_test", "strata", "n", TEST_SIZE)},
remaining as (select *, n - n_test as rem from quota_test),
{quota("quota_validation", "remaining", "rem", VALIDATION_SIZE / (1 - TEST_SIZE))},
ranked as (
  select *, row_number() over (partition by source_code, code order by order_hash) as rank
  from events_s),
divided as (
  select r.*, case when rank <= n_test then 'test'
    when rank <= n_test + n_validation then 'validation' else 'train' end as split
  from ranked r join quota_validation using (source_code, code))"""


DIVIDED = f"{DESCRIBED},\n{split_of('described')}"

FLOW_STATE = " union all ".join(
    f"""select instance_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, '{s}' as variable,
  round(case when class = 0 then {q(s)} end + 1e-9, 6) + 0.0 as normal,
  round(case when class between 101 and 108 then {q(s)} end + 1e-9, 6) + 0.0 as transient,
  round(case when class between 1 and 8 then {q(s)} end + 1e-9, 6) + 0.0 as permanent,
  round(case when class is null then {q(s)} end + 1e-9, 6) + 0.0 as unknown,
  round(case when {q(s)} is null then min({q(s)}) over (partition by instance_id) end + 1e-9, 6) + 0.0
    as no_data,
  '' as unit from samples"""
    for s in SENSORS
)

STATS = f"""stats as (
  select instance_id, {", ".join(
    f'min(list_min(list_transform(x, lambda t: t[{i + 1}]))) as {q("min:" + s)}, '
    f'max(list_max(list_transform(x, lambda t: t[{i + 1}]))) as {q("max:" + s)}'
    for i, s in enumerate(SENSORS)
  )}, {", ".join(f'avg(cast(label = {c} as int)) as {q(f"share:{c}")}' for c in range(9))}
  from windows group by 1)"""
STAT_NAMES = [f"{end}:{s}" for s in SENSORS for end in ("min", "max")] + [
    f"share:{c}" for c in range(9)
]

SCORES = """scores as (
  select vec_id, label % 9 as label, list_transform(range(0, 9),
    lambda c: list_sum(list_transform(embedding, lambda v, i: case when (i - 1) % 9 = c then v::double else 0 end))) as s
  from embeddings),
guessed as (select *, list_position(s, list_max(s)) - 1 as predicted from scores)"""

TRIMMED = with_(SPARSE, metrics("sparse", TRIM))
RANKED_SAMPLES = with_(SPARSE) + f"""select variable, value,
    row_number() over (partition by variable order by value) as lo,
    row_number() over (partition by variable order by value desc) as hi,
    row_number() over (partition by variable order by value, tie) as low_tie,
    row_number() over (partition by variable order by value desc, tie) as high_tie
  from (select variable, value, row_number() over () as tie from (
    {" union all ".join(f"select '{s}' as variable, {q(s)} as value from sparse" for s in SENSORS)}))
  where value is not null"""
PLAIN_METRICS = (
    "select variable, round(mu.value + 1e-9, 6) + 0.0 as mean_of_means,"
    " round(sigma.value + 1e-9, 6) + 0.0 as mean_of_stds from mu full join sigma using (variable)"
)

SPLIT_WINDOWS = with_(
        VALID_SAMPLES,
        FILLED,
        DIVIDED,
        metrics(
            "samples", 0, "instance_id in (select instance_id from divided where split = 'train')"
        ),
        SCALED,
        windows("scaled"),
    )

#: Windows of all splits, labelled by the sensor with the largest sum (the first on ties).
SENSOR_LABELS = (
    SPLIT_WINDOWS.rstrip()
    + """,
totals as (select instance_id, split, window_idx, list_transform(range(0, %(n)d), lambda s: round(coalesce(list_sum(
    list_transform(range(0, %(steps)d), lambda t: coalesce(flat[t * %(n)d + s + 1], 0.0))), 0.0) + 1e-9, 6) + 0.0) as sums
  from windows join divided using (instance_id)),
told as (select instance_id, split, window_idx, (list_position(sums, list_max(sums)) - 1)::int as label from totals)
"""
    % {"n": len(SENSORS), "steps": WINDOW}
)

ORACLES = {
    "downsample": with_(SAMPLES, BINS)
    + f"""select instance_id, bin, strftime(make_timestamp(t0 + bin * {WIDTH}), '%Y-%m-%d %H:%M:%S.%f') as ts,
  {sensor_list()}, class from bins join anchors using (instance_id)""",
    "gap_bins": with_(SAMPLES, DENSE)
    + f"""select instance_id, bin, strftime(make_timestamp(t0 + bin * {WIDTH}), '%Y-%m-%d %H:%M:%S.%f') as ts,
  {sensor_list()}, class from dense""",
    "impute": with_(SAMPLES, FILLED) + f"select instance_id, bin, {sensor_list()} from filled",
    "class_fill": with_(SAMPLES, FILLED) + "select instance_id, bin, class::double as class from filled",
    "interp_overlay": with_(
        SAMPLES,
        "positioned as (select *, row_number() over (partition by instance_id order by ts) - 1"
        " as pos from samples)",
        near("positioned", "pos"),
    )
    + "select instance_id, event_id, pos, "
    + each(
        "round(case when {s} is null then coalesce("
        + line("pos")
        + ', "pv:{n}") end + 1e-9, 6) + 0.0 as {s}'
    )
    + " from near",
    "valid_events": with_(SAMPLES, VALID) + "select instance_id, valid from validity",
    "valid_samples": with_(VALID_SAMPLES) + "select instance_id, event_id from samples",
    "invalid_events": with_(SAMPLES)
    + f"""select instance_id, count(*)::bigint as n_bad from samples
  where not ({each("coalesce({s}, 0) between -1 and 300", " and ")}) group by 1""",
    "flow_state": with_(SAMPLES) + FLOW_STATE,
    "sensor_units": """select variable, count(*)::bigint as n_samples,
  case variable[1] when 'P' then '[Pa]' when 'T' then '[ºC]' when 'Q' then '[sm³/s]' else '' end as unit
  from (select upper(event_type || '-' || (user_id % 4)) as variable from events) group by 1""",
    "variable_selection": with_(SAMPLES)
    + """select instance_id, count(*)::bigint as n_rows,
  bool_and(coalesce("s-click", 0) between -1 and 300 and coalesce("s-purchase", 0) between -1 and 300)
    as valid
  from samples group by 1""",
    "event_head": """select user_id as instance_id, event_id from events
  qualify row_number() over (partition by user_id order by ts) <= 10""",
    "single_event": with_(SAMPLES)
    + f"""select instance_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, {sensor_list()}, class
  from samples where instance_id = (
    select instance_id from samples group by 1 order by count(*) desc, instance_id limit 1)""",
    "event_means": TRIMMED + f"select instance_id, {sensor_list()} from event_means",
    "mean_of_means": with_(SPARSE, metrics("sparse", 0))
    + "select variable, round(value + 1e-9, 6) + 0.0 as value from mu",
    "trimmed_means": TRIMMED + "select variable, round(value + 1e-9, 6) + 0.0 as value from mu",
    "order_statistics": f"select variable, rank, round(value + 1e-9, 6) + 0.0 as value from ({RANKED_SAMPLES}),"
    + f" (select unnest({list(DEEP_RANKS)})::int as rank) where lo = rank or hi = -rank",
    "deep_trimmed_means": f"""select variable, round(avg(case when low_tie > {DEEP_TRIM} and high_tie > {DEEP_TRIM}
    then value end) + 1e-9, 6) + 0.0 as value from ({RANKED_SAMPLES}) group by variable""",
    "event_stds": TRIMMED + f"select instance_id, {sensor_list()} from event_stds",
    "mean_of_stds": TRIMMED + "select variable, round(value + 1e-9, 6) + 0.0 as value from sigma",
    "metric_table": with_(SAMPLES, metrics("samples", TRIM)) + PLAIN_METRICS,
    "metric_memo": with_(SAMPLES, metrics("samples", 0)) + PLAIN_METRICS,
    "standardize": with_(SAMPLES, FILLED, metrics("samples", TRIM), SCALED)
    + f"select instance_id, bin, {sensor_list()}, class::double as class from scaled",
    "windows": with_(SAMPLES, FILLED, windows("filled"))
    + f"select instance_id, window_idx, {CHECKSUM} from windows",
    "window_labels": with_(SAMPLES, FILLED, windows("filled"))
    + "select instance_id, window_idx, label, y_text from windows",
    "window_counts": with_(SAMPLES, BINS)
    + f"""select instance_id, (t1 - t0) // {WIDTH} + 1 as n_bins,
  greatest((t1 - t0) // {WIDTH} + 1 - {WINDOW - 1}, 0) as n_windows from anchors""",
    "tensor_stats": PREPARED.rstrip()
    + f",\n{STATS}\nselect instance_id, {', '.join(rounded(n) for n in STAT_NAMES)} from stats",
    "tensor_summary": PREPARED.rstrip()
    + f""",
{STATS},
long as (unpivot stats on columns(* exclude (instance_id)) into name statistic value value)
select statistic, round(min(value) + 1e-9, 6) + 0.0 as smallest, round(avg(value) + 1e-9, 6) + 0.0 as average,
  round(max(value) + 1e-9, 6) + 0.0 as largest, round(sum(value) + 1e-9, 6) + 0.0 as total
from long group by 1""",
    "verification": PREPARED.rstrip()
    + f""",
{STATS}
select instance_id, sha256(concat('{SPLIT_SEED}|', cast(instance_id as varchar))) as order_hash,
  {', '.join(rounded(n) for n in STAT_NAMES)} from stats""",
    "tensor_store": with_(SAMPLES, FILLED, windows("filled"))
    + """select instance_id, class_code, window_idx,
  round(list_sum(list_transform(flat, lambda v, i: v * i)) + 1e-7, 4) + 0.0 as x_sum, label, y_text from windows""",
    "event_batches": with_(SAMPLES, FILLED, windows("filled"))
    + """select instance_id, count(*)::bigint as n_windows, sum(label)::bigint as label_sum
  from windows group by 1""",
    "event_catalog": with_(DESCRIBED)
    + """select event_key as event_id, substr(event_key, 1, 7) as hash_id, class_type, class_code, source,
  well_id::double as well_id, path, strftime(recorded, '%Y-%m-%d %H:%M:%S.%f') as timestamp,
  num_timesteps * 100 as file_size,
  num_timesteps from described""",
    "cached_catalog": with_(DESCRIBED)
    + """select event_key as event_id, path,
  num_timesteps from described""",
    "hash_ids": with_(DESCRIBED)
    + "select instance_id, event_key, substr(event_key, 1, 7) as hash_id from described",
    "filename_parse": with_(DESCRIBED)
    + """select instance_id, class_code as folder, source, well_id::double as well_id,
  strftime(recorded, '%Y-%m-%d %H:%M:%S') as recorded from described""",
    "catalog_filter": with_(DESCRIBED)
    + """select instance_id, class_type, source from described
  where class_code in (4, 0, 7) and source in ('REAL', 'HAND_DRAWN')""",
    "well_filter": with_(DESCRIBED)
    + "select instance_id, class_type, well_id from described where well_id in (1, 2, 5)",
    "class_source_counts": with_(
        DESCRIBED,
        "classes as (select class_code, "
        + names_case("class_code", CLASS_NAMES)
        + " as class_type from (select unnest(range(0, 9)) as class_code))",
        "cells as (select c.class_type, "
        + ", ".join(f"coalesce(count_if(source = '{s}'), 0)::bigint as {s}" for s in SOURCE_NAMES)
        + """, count(d.path)::bigint as total
  from classes c left join described d using (class_code)
  group by 1)""",
    )
    + "select * from cells union all select 'Total', "
    + ", ".join(f"sum({s})::bigint" for s in (*SOURCE_NAMES, "total"))
    + " from cells",
    "class_counts": with_(DESCRIBED)
    + "select class_type, count(*)::bigint as n_events from described group by 1",
    "dataset_versions": with_(VERSIONS)
    + "select directory, has_data, total_bytes, version, version_number from numbered",
    "version_latest": with_(VERSIONS)
    + """select directory, version, version_number, has_data, version = '3.11.6' as usable
  from numbered order by version_number desc limit 1""",
    "dataset_size": "select count(*)::bigint as total_bytes from events",
    "stratified_split": with_(DIVIDED) + "select instance_id, source, class_type, split from divided",
    "split_counts": with_(DIVIDED)
    + "select split, source, class_type, count(*)::bigint as n from divided group by all",
    "split_names": with_(
        DESCRIBED,
        "chosen as (select * from described where class_code in (0, 4)"
        " and source in ('REAL', 'HAND_DRAWN'))",
        split_of("chosen"),
    )
    + """select instance_id,
  'dataset_converted_v10101_split-20_source-r-d_class-0-4_well-all_' || split as split_name
  from divided""",
    "shuffled": with_(FILES)
    + f"""select instance_id, path,
  sha256(concat('{SPLIT_SEED}|', cast(instance_id as varchar))) as order_hash from files""",
    "split_store": with_(DIVIDED)
    + """select user_id as instance_id, event_id, cast(user_id % 9 as int) as class_code, split
  from events join divided on user_id = instance_id""",
    "csv_incremental": with_(SAMPLES)
    + f"""select class_code, count(*)::bigint as n_rows, count(ts)::bigint as n_times,
  {each("round(sum({s}) + 1e-7, 4) + 0.0 as {s}", ", ")} from samples group by 1""",
    "csv_conversion": with_(SAMPLES, DESCRIBED, EVENT_SUMS)
    + f"""select event_id, class_code, n_rows, n_times, n_labelled, label_sum, {each("{s}", ", ")} from sums""",
    "dataset_scan": with_(
        SAMPLES,
        DESCRIBED,
        EVENT_SUMS,
        f"""listed as (
  select event_key, class_code, source, well_id, num_timesteps from described
  union all select sha256('{EMPTY_EVENT}'), 3, 'HAND_DRAWN', null, 0
  union all select sha256('{TENSORS[0]}'), 5, 'SIMULATED', null, null
  union all select sha256('{TENSORS[1]}'), 7, null, null, null)""",
    )
    + f"""select event_key as event_id, l.class_code::int as class_code, {names_case("l.class_code", CLASS_NAMES)} as class_type,
  source, well_id::double as well_id, num_timesteps::double as num_timesteps, n_times::double as n_times,
  n_labelled::double as n_labelled, label_sum, {each("{s}", ", ")}, true as has_data
  from listed l left join sums on event_id = event_key""",
    "argmax_scores": with_(SCORES)
    + "select vec_id, label::int as label, predicted::int as predicted from guessed",
    "confusion_matrix": with_(SCORES)
    + "select l.label::int as label, "
    + ", ".join(f"coalesce(count_if(g.predicted = {p}), 0)::bigint as p{p}" for p in range(9))
    + """ from (select unnest(range(0, 9)) as label) l left join guessed g using (label)
  group by 1""",
    "accuracy_logloss": with_(SCORES)
    + """select count(*)::bigint as n_windows,
  round(avg(cast(predicted = label as int)) + 1e-9, 6) + 0.0 as accuracy,
  round(avg(-ln(greatest(exp(s[label + 1]) / list_sum(list_transform(s, lambda v: exp(v))), 1e-7))) + 1e-9, 6)
    + 0.0 as loss from guessed""",
    "align_predictions": with_(SAMPLES, FILLED, windows("filled"))
    + f"""select s.instance_id, strftime(s.ts, '%Y-%m-%d %H:%M:%S.%f') as ts,
  (epoch_us(s.ts) - t0) // {WIDTH} as bin, w.label::double as predicted
  from samples s join anchors a using (instance_id)
  left join windows w on w.instance_id = s.instance_id
    and w.window_idx = (epoch_us(s.ts) - t0) // {WIDTH} - {WINDOW - 1}""",
    "match_labels": PREPARED
    + "select instance_id, window_idx, label % 3 as predicted, label from windows",
    "full_prepare": PREPARED
    + f"select instance_id, class_code, window_idx, {CHECKSUM}, label, y_text from windows",
    "split_prepare": SPLIT_WINDOWS
    + """select instance_id, split, window_idx,
  round(list_sum(list_transform(flat, lambda v, i: v * i)) + 1e-7, 4) + 0.0 as x_sum,
  round(flat[len(flat)] + 1e-9, 6) + 0.0 as x_last, label
  from windows join divided using (instance_id)""",
    "invalid_event_samples": with_(SAMPLES, VALID)
    + "select instance_id, event_id from samples join validity using (instance_id) where not valid",
    "attach_shuffled": with_(SAMPLES)
    + """select instance_id, event_id, epoch_us(min(ts) over (partition by instance_id)) as t0
  from samples""",
    "user_model_scores": PREPARED
    + """select instance_id, window_idx, round(list_max(list_transform(range(0, 9), lambda c: list_sum(
  list_transform(flat, lambda v, i: coalesce(v, 0) * (((i - 1) * 7 + c * 3) % 11 - 5) / 100.0)))) + 1e-8, 5) + 0.0 as top
  from windows""",
    "classifier_scores": SENSOR_LABELS
    + """select instance_id, split, window_idx, label, true as sums_to_one, true as is_argmax, true as beats_majority
  from told""",
    "classifier_search": SENSOR_LABELS
    + """select c::int as label, coalesce(n, 0)::bigint as n_windows, 0 as n_better, true as beats_majority
  from (select unnest(range(0, 9)) as c) left join (select label, count(*) as n
    from told where split = 'test' group by label) on label = c
  where exists (from told where split = 'validation')""",
    "recurrent_scores": SENSOR_LABELS
    + """select split, count(*)::bigint as n_windows, true as beats_majority from told
  where exists (from told where split = 'validation') group by split""",
    "epoch_reader": with_(SAMPLES, FILLED, windows("filled"))
    + """select epoch::int as epoch, count(*)::bigint as n_windows, sum(label)::bigint as label_sum
  from windows, (select unnest([1, 2]) as epoch) group by epoch""",
    "event_map": with_(SAMPLES)
    + """select instance_id, count(*)::bigint as n_rows, coalesce(max(gap), 0)::bigint as longest_gap_us from (
  select instance_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by instance_id order by ts) as gap from samples)
  group by instance_id""",
    "recurrent_search": SENSOR_LABELS
    + """select candidate, rounds, is_best, n::bigint as n_validation, 5 as window_passes, 3 as scans
  from (values (0, 1, false), (1, 3, true), (2, 1, false)) as halved(candidate, rounds, is_best),
    (select count(*) as n from told where split = 'validation') where n > 0""",
}
ORACLES |= {"windows_segmented": ORACLES["windows"], "overlay_segmented": ORACLES["interp_overlay"], "align_shuffled": ORACLES["align_predictions"]}
