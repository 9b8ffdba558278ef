"""SQL for DuckDB that gives the rows of the queries in catalog."""

from __future__ import annotations

from .adaptor import ELECTRODE_SQL, HPPC_SQL, LIFE_SQL, RAW_SQL, SOC_SQL

DIAGNOSTIC = """
diag as (select distinct run_id, cycle_index, case cycle_index when 0 then 'reset' else 'hppc' end as cycle_type
         from raw where cycle_index in (0, 3))
"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in (RAW_SQL, *parts))


def _aggregates(source: str, full: float) -> str:
    return f"""
gaps as (select *, (epoch_us(date_time) - epoch_us(lag(date_time) over w)) / 1e6 as gap, lag(temperature) over w as t0
         from {source} window w as (partition by run_id, cycle_index order by data_point)),
agg as (
  select run_id, cycle_index, max(charge_capacity) as charge_capacity, max(discharge_capacity) as discharge_capacity,
         max(charge_energy) as charge_energy, max(discharge_energy) as discharge_energy,
         max_by(internal_resistance, data_point) filter (where internal_resistance is not null) as dc_internal_resistance,
         max(temperature) as temperature_maximum, sum(temperature) / count(temperature) as temperature_average, min(temperature) as temperature_minimum,
         min_by(date_time, data_point) as date_time,
         round((epoch_us(min_by(date_time, data_point) filter (where charge_capacity >= {full}::double)) - epoch_us(min_by(date_time, data_point))) / 1e6, 2) as charge_duration,
         case when count(*) = count(temperature) then coalesce(sum((temperature + t0) / 2 * gap / 60 order by data_point), 0) end as time_temperature_integrated,
         case when max(gap) > 3600 then max(gap) else 0 end as paused, min(voltage) as vmin, max(voltage) as vmax
  from gaps group by all)"""


def _cv(source: str, where: str) -> str:
    return f"""
chg as (select *, row_number() over w - 1 as rn, count(*) over (partition by run_id, cycle_index) as n, lead(test_time) over w - test_time as dt,
               abs(lead(voltage) over w - voltage) as dv, abs(lead(current) over w - current) as di
        from {source} where {where} window w as (partition by run_id, cycle_index order by data_point)),
hit as (select run_id, cycle_index, any_value(n) as n,
               coalesce(min(rn) filter (where rn < n - 1 and not (coalesce(dt < 1, false) or coalesce(dv / nullif(dt, 0) > 1e-5, false) or coalesce(di / nullif(dt, 0) < 1e-4, false))), any_value(n) - 1) as i
        from chg group by all),
start as (select chg.run_id, chg.cycle_index, test_time as from_time from chg join hit using (run_id, cycle_index) where rn = case when i = 0 then hit.n - 1 else i - 1 end),
cv as (select run_id, cycle_index, max_by(test_time, rn) - min_by(test_time, rn) as CV_time, max_by(current, rn) as CV_current,
              max_by(charge_capacity, rn) - min_by(charge_capacity, rn) as CV_capacity
       from chg join start using (run_id, cycle_index) where test_time >= from_time group by all)"""


_TIME = "strftime(date_time, '%Y-%m-%d %H:%M:%S.%f') as date_time"

SUMMARY = (
    _aggregates("raw", 1.1 * 0.8)
    + ","
    + _cv("raw", "current > 0")
    + """,
regular as (select agg.*, CV_time, CV_current, CV_capacity from agg left join cv using (run_id, cycle_index) where (run_id, cycle_index) not in (select (run_id, cycle_index) from diag)),
eff as (select * exclude (charge_energy, discharge_energy), case when charge_energy <> 0 then discharge_energy / charge_energy end as energy_efficiency,
               case when abs(charge_energy) <= 1e6 then charge_energy end as charge_energy, case when abs(discharge_energy) <= 1e6 then discharge_energy end as discharge_energy from regular),
summary as (
  select * exclude (vmin, vmax), sum(charge_capacity) over w as charge_throughput, sum(charge_energy) over w as energy_throughput
  from eff
  window w as (partition by run_id order by cycle_index rows unbounded preceding)
  qualify cycle_index < max(cycle_index) over (partition by run_id) or count(*) over (partition by run_id) = 1
     or (vmin < 2.1 and vmax > 2.5 and discharge_capacity > 0.1 * charge_capacity))"""
)

CLASSES = """
inc as (select run_id, cycle_index, step_index, charge_capacity - lag(charge_capacity) over w as c, discharge_capacity - lag(discharge_capacity) over w as d,
               max(charge_capacity) over p - min(charge_capacity) over p as cr, max(discharge_capacity) over p - min(discharge_capacity) over p as dr
        from raw window w as (partition by run_id, cycle_index, step_index order by data_point), p as (partition by run_id, cycle_index, step_index)),
means as (select run_id, cycle_index, step_index, count(*) as n_points,
                 sum(c) filter (where not coalesce(c / nullif(cr, 0) > 0.99, false)) / nullif(count(c) filter (where not coalesce(c / nullif(cr, 0) > 0.99, false)), 0) as c,
                 sum(d) filter (where not coalesce(d / nullif(dr, 0) > 0.99, false)) / nullif(count(d) filter (where not coalesce(d / nullif(dr, 0) > 0.99, false)), 0) as d
          from inc group by all),
decided as (select *, case when c is null and d is null then null when c is null then not d > 0 when d is null then c > 0
                           when c > d and c > 0 then true when c < d and d > 0 then false end as x from means),
classes as (select run_id, cycle_index, step_index, coalesce(x, true) as is_charge, x is not null as determined, n_points from decided)"""


def _curves(name: str, source: str, bounds: str, keys: str, x: str, columns: list[str], n: int) -> str:
    """Tables that end in ``name``: the curves of source at the grids of bounds (keys, lo, hi)."""
    on = " and ".join(f"s.{k} = g.{k}" for k in keys.split(", "))

    def value(c: str) -> str:
        hit = f"(select coalesce(min_by(struct_pack(y := s.{c}), s.data_point).y, max_by(s.{c}, s.data_point) filter (where s.{c} is not null)) from {source} s where {on} and s.{x} = g.{x})"
        left = f"(select arg_max(struct_pack(x := s.{x}, y := s.{c}), (s.{x}, s.data_point)) from {source} s where {on} and s.{x} < g.{x} and s.{c} is not null)"
        right = f"(select arg_min(struct_pack(x := s.{x}, y := s.{c}), (s.{x}, s.data_point)) from {source} s where {on} and s.{x} > g.{x} and s.{c} is not null)"
        return f"{hit} as h_{c}, {left} as l_{c}, {right} as r_{c}"

    final = ", ".join(
        f"case when h_{c} is not null then h_{c} when l_{c} is null then null when r_{c} is null then l_{c}.y else l_{c}.y + (r_{c}.y - l_{c}.y) * (({x} - l_{c}.x) / (r_{c}.x - l_{c}.x)) end as {c}"
        for c in columns
    )
    return f"""
grid_{name} as (select distinct {keys}, case when i = {n - 1} then hi else lo + i * ((hi - lo) / {n - 1}) end as {x} from {bounds}, generate_series(0, {n - 1}) t(i) where lo is not null),
near_{name} as (select g.*, {", ".join(map(value, columns))} from grid_{name} g),
{name} as (select {keys}, {x}, {final} from near_{name})"""


STEP_KEYS = "run_id, cycle_index, step_index"
CURVE = ["current", "charge_capacity", "discharge_capacity", "temperature"]


def _side(name: str, charge: bool, axis: str, n: int) -> str:
    chosen = f"steps_{name} as (select * from classes where is_charge = {charge} and n_points > 1)"
    own = f"src_{name} as (select raw.* from raw semi join steps_{name} using ({STEP_KEYS}))"
    if axis == "voltage":
        bounds = f"bounds_{name} as (select {STEP_KEYS}, 2.0::double as lo, 3.5::double as hi from steps_{name})"
    else:
        bounds = f"bounds_{name} as (select s.run_id, cycle_index, step_index, lo, hi from steps_{name} s join (select run_id, min({axis}) as lo, max({axis}) as hi from raw group by run_id) r using (run_id))"
    return ",\n".join((chosen, own, bounds, _curves(name, f"src_{name}", f"bounds_{name}", STEP_KEYS, axis, [c for c in CURVE if c != axis], n).strip()))


DIAG_KEYS = "run_id, cycle_index, step_index, step_index_counter"
DIAG_COLUMNS = ["voltage", "current", "test_time", "charge_capacity", "discharge_capacity", "charge_energy", "discharge_energy", "internal_resistance", "temperature"]

OCCURRENCES = """
islands as (select *, case when step_index is not distinct from lag(step_index) over w and row_number() over w > 1 then 0 else 1 end as new,
                   min(data_point) over (partition by run_id, cycle_index, step_index) as first_seen
            from raw window w as (partition by run_id, cycle_index order by data_point)),
occ as (select *, cast(sum(new) over (partition by run_id, cycle_index order by data_point rows unbounded preceding) as bigint) as step_index_counter,
               dense_rank() over (partition by run_id, cycle_index order by first_seen) - 1 as step_type from islands)"""


def _diag_axis(name: str, axis: str, flat: bool) -> str:
    test = "(v1 - v0) < 0.002" if flat else "not ((v1 - v0) < 0.002)"
    lo, hi = ("t0", "t1") if flat else ("v0", "v1")
    columns = [c for c in DIAG_COLUMNS if c != axis]
    rise = ", ".join(f"({c}_capacity - lag({c}_capacity) over w) / nullif(voltage - lag(voltage) over w, 0) as {c}_dQdV" for c in ("charge", "discharge"))
    return ",\n".join(
        (
            f"bounds_{name} as (select {DIAG_KEYS}, {lo} as lo, {hi} as hi from span where {test})",
            f"src_{name} as (select drows.* from drows semi join bounds_{name} using ({DIAG_KEYS}))",
            _curves(name, f"src_{name}", f"bounds_{name}", DIAG_KEYS, axis, columns, 7).strip(),
            f"out_{name} as (select {DIAG_KEYS}, {', '.join(DIAG_COLUMNS)}, {rise} from {name} window w as (partition by {DIAG_KEYS} order by {axis}) qualify count(*) over (partition by {DIAG_KEYS}) > 1)",
        )
    )


ORACLES = {
    "raw_view": _with() + f" select * exclude (date_time), {_TIME} from raw",
    "cycle_summary": _with(DIAGNOSTIC, SUMMARY) + f" select * exclude (date_time), {_TIME} from summary",
    "diagnostic_summary": _with(DIAGNOSTIC, "drows as (select raw.*, cycle_type, min(step_index) over (partition by run_id, cycle_index) as s0 from raw join diag using (run_id, cycle_index))", _aggregates("drows", 0.88), _cv("drows", "step_index = s0"))
    + f""" select agg.* exclude (vmin, vmax, date_time, dc_internal_resistance), {_TIME}, CV_time, CV_current, CV_capacity, cycle_type,
           discharge_energy / nullif(charge_energy, 0) as energy_efficiency, discharge_capacity / nullif(charge_capacity, 0) as coulombic_efficiency
           from agg left join cv using (run_id, cycle_index) join diag using (run_id, cycle_index)""",
    "step_occurrences": _with(OCCURRENCES) + " select run_id, data_point, cycle_index, step_index, step_index_counter, step_type from occ",
    "step_direction": _with(CLASSES) + " select * from classes",
    # The accumulator is a sequential program, so the check is one: a fold over each run's rows in order.
    "reset_accumulator": _with(
        """
st as (select *, case when current > 0 then abs(current) else 0.0::double end as val,
              (event_id % 3 = 0) and coalesce(step_index <> lead(step_index) over w, false) as is_end, row_number() over w as rn
       from raw window w as (partition by run_id order by data_point)),
seg as (select *, coalesce(sum(is_end::int) over (partition by run_id order by data_point rows between unbounded preceding and 1 preceding), 0) as s,
               lag(cycle_index) over (partition by run_id order by data_point) as c0 from st),
ends as (select run_id, s, max(case when is_end then val end) as end_val, max(is_end::int) as closed,
                max(case when rn = 2 or (rn > 2 and s > 0) then (rn = first_rn and c0 <> cycle_index)::int else 0 end) as changed
         from (select *, case when s = 0 then 2 else min(rn) over (partition by run_id, s) end as first_rn from seg) group by run_id, s),
acc as (
  with recursive fold(run_id, s, carried, total) as (
    select run_id, s, 0.0::double, coalesce(end_val, 0) from ends where s = 0
    union all
    select e.run_id, e.s, case when e.changed = 1 and e.closed = 1 then 0.0::double else f.total end,
           case when e.changed = 1 and e.closed = 1 then 0.0::double else f.total end + coalesce(e.end_val, 0)
    from fold f join ends e on e.run_id = f.run_id and e.s = f.s + 1)
  select * from fold)"""
    )
    + " select seg.run_id, data_point, cycle_index, val + carried as total from seg join acc on seg.run_id = acc.run_id and seg.s = acc.s",
    "rule_cycles": _with(
        "moves as (select run_id, data_point, step_index as sequence, lag(step_index) over w as s0, cycle_index as l, lag(cycle_index) over w as l0 from raw window w as (partition by run_id order by data_point))"
    )
    + """ select run_id, data_point, sequence, cast(2 + sum(case when s0 is null then 0 when l <> l0 then 2 when s0 <> sequence then (s0 + 2 * sequence) % 3 else 0 end)
           over (partition by run_id order by data_point rows unbounded preceding) as bigint) as cycle_index from moves""",
    "discharge_curves": _with(CLASSES, _side("dis", False, "voltage", 13)) + " select *, 'discharge' as step_type from dis",
    "cycle_curves": _with(CLASSES, _side("dis", False, "voltage", 9), _side("chg", True, "charge_capacity", 9))
    + """ select run_id, cycle_index, step_index, voltage, current, charge_capacity, discharge_capacity, temperature, 'discharge' as step_type, 'voltage' as axis from dis
          union all select run_id, cycle_index, step_index, null, current, charge_capacity, discharge_capacity, temperature, 'charge', 'charge_capacity' from chg""",
    "diagnostic_curves": _with(
        DIAGNOSTIC,
        OCCURRENCES,
        "drows as (select occ.*, cycle_type from occ join diag using (run_id, cycle_index))",
        f"span as (select {DIAG_KEYS}, cycle_type, step_type, min(voltage) as v0, max(voltage) as v1, min(test_time) as t0, max(test_time) as t1 from drows group by all)",
        _diag_axis("flat", "test_time", True),
        _diag_axis("wide", "voltage", False),
    )
    + f" select u.*, cycle_type, step_type from (select * from out_flat union all select * from out_wide) u join span using ({DIAG_KEYS})",
}


def _life(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in (LIFE_SQL, *parts))


NOMINAL = """
nom as (select run_id, count(*) as n, max_by(discharge_capacity, position) as last_q,
               case when count(*) > 40 then median(discharge_capacity) filter (where position < 40) else 1.1::double end as nominal from life group by run_id)"""


def _lives(at: list[float]) -> str:
    values = ", ".join(f"({t}::double)" for t in at)
    return f"""
lives as (select run_id, threshold, case when last_q / nominal <= threshold then pos else n + 1 end as cycle_life, case when last_q / nominal <= threshold then cyc end as cycle_index
          from (select nom.*, threshold, (select min(position) from life l where l.run_id = nom.run_id and discharge_capacity < threshold * nominal) as pos,
                       (select min(cycle_index) from life l where l.run_id = nom.run_id and discharge_capacity < threshold * nominal) as cyc
                from nom, (values {values}) t(threshold)))"""


TRAJECTORY = [0.98, 0.95, 0.92, 0.89, 0.86, 0.83, 0.8]

FRACTIONS = """
reg as (select run_id, cycle_index, sum(discharge_energy) over (partition by run_id order by cycle_index rows unbounded preceding) as tp,
               cycle_index - lag(cycle_index) over (partition by run_id order by cycle_index) as step
        from life where cycle_index <> 0 and (run_id, cycle_index) not in (select (run_id, cycle_index) from ldiag)),
init as (select run_id, (select max_by(tp, cycle_index) from reg r where r.run_id = g.run_id and r.cycle_index < g.gap_at) as tp0, last_reg
         from (select run_id, min(cycle_index) filter (where step > 1) as gap_at, max(cycle_index) as last_reg from reg group by run_id) g),
dia as (select *, sum(discharge_energy) over w as tp, discharge_energy / first_value(discharge_energy) over w as frac from ldiag window w as (partition by run_id order by cycle_index rows unbounded preceding)),
nx as (select d.run_id, d.cycle_index, d.cycle_type, frac as fractional_metric, tp0 as initial_regular_throughput,
              coalesce((select max(tp) from reg r where r.run_id = d.run_id and r.cycle_index < d.cycle_index) / tp0, 0) as normalized_regular_throughput,
              coalesce((select max(tp) from dia r where r.run_id = d.run_id and r.cycle_index < d.cycle_index) / tp0, 0) as normalized_diagnostic_throughput,
              cast(floor(epoch_us(date_time) / 1000000) as bigint) as epoch_time
       from dia d join init on d.run_id = init.run_id where tp0 is not null and d.cycle_index <= last_reg)"""


def _statistics(prefix: str, quantity: str) -> str:
    g1 = "skewness(d) * (count(d) - 2) / sqrt(count(d) * (count(d) - 1))"
    found = ("var_pop(d)", "min(d)", "avg(d)", g1, "kurtosis(d) + 3", "sum(abs(d))", "sum(d * d)")
    names = ("var", "min", "mean", "skew", "kurtosis", "sum", "sum_square")
    columns = ", ".join(f"round(log10(nullif(abs({f}), 0)), 6) as {prefix}_{n}" for f, n in zip(found, names))
    return f"""st_{prefix} as (select run_id, {columns} from (
      select run_id, voltage, max({quantity}) filter (where cycle_index = 100) - max({quantity}) filter (where cycle_index = 10) as d from lcurves group by all) where d is not null group by run_id)"""


STATS = {"charging_capacity": "charge_capacity", "discharging_capacity": "discharge_capacity", "charging_energy": "charge_energy", "discharging_energy": "discharge_energy"}

_pairs = [(t, c) for t in ("reset", "rpt_0.2C", "rpt_1C") for c in ("discharge_capacity", "discharge_energy", "charge_capacity", "charge_energy")]
_nth = "max({c}) filter (where cycle_type = '{t}' and nth = {p})"


def _change(t: str, c: str) -> str:
    a, b = _nth.format(c=c, t=t, p=0), _nth.format(c=c, t=t, p=1)
    return f"({b} - {a}) / nullif({a}, 0)"


def _delta_q() -> str:
    d = "discharge_capacity"
    p = lambda f, a, b: f"{f} filter (where position between {a} and {b})"
    at = lambda c, k: f"max({c}) filter (where position = {k})"
    ir = "nullif(dc_internal_resistance, 0)"
    columns = {
        "discharge_capacity_cycle_2": at(d, 1),
        "max_discharge_capacity_difference": f"{p(f'max({d})', 0, 99)} - {at(d, 1)}",
        "discharge_capacity_cycle_100": at(d, 99),
        "integrated_time_temperature_cycles_1:100": f"coalesce({p('sum(time_temperature_integrated)', 0, 99)}, 0)",
        "charge_time_cycles_1:5": p("avg(charge_duration)", 1, 5),
        "max_temperature_cycles_1:100": p("max(temperature_maximum)", 1, 99),
        "min_temperature_cycles_1:100": p("min(temperature_minimum)", 1, 99),
        "slope_discharge_capacity_cycle_number_2:100": p(f"regr_slope({d}, position)", 1, 99),
        "intercept_discharge_capacity_cycle_number_2:100": p(f"regr_intercept({d}, position)", 1, 99),
        "slope_discharge_capacity_cycle_number_91:100": p(f"regr_slope({d}, position)", 90, 99),
        "intercept_discharge_capacity_cycle_number_91:100": p(f"regr_intercept({d}, position)", 90, 99),
        "min_internal_resistance_cycles_2:100": p(f"min({ir})", 1, 99),
        "internal_resistance_cycle_2": at("dc_internal_resistance", 1),
        "internal_resistance_difference_cycles_2:100": f"{at('dc_internal_resistance', 99)} - {at('dc_internal_resistance', 1)}",
        "nominal_capacity_by_median": p(f"median({d})", 0, 39),
    }
    g1 = "skewness(d) * (count(d) - 2) / sqrt(count(d) * (count(d) - 1))"
    shape = {"min": "min(d)", "mean": "avg(d)", "variance": "var_pop(d)", "skew": g1, "kurtosis": "kurtosis_pop(d)", "first": "min_by(d, voltage)"}
    curve = ", ".join(f'round(log10(nullif(abs({f}), 0)), 6) as "abs_{k}_discharge_capacity_difference_cycles_2:100"' for k, f in shape.items())
    return (
        _life(
            f"cd as (select run_id, voltage, max({d}) filter (where cycle_index = 99) - max({d}) filter (where cycle_index = 9) as d from lcurves group by all)",
            f"shape as (select run_id, {curve} from cd where d is not null group by run_id)",
            "main as (select run_id, " + ", ".join(f'round({f}, 6) as "{k}"' for k, f in columns.items()) + " from life group by run_id having count(*) > 99)",
        )
        + " select * from main left join shape using (run_id)"
    )


def _message(column: str, bad: str, text: str) -> str:
    at = f"min(idx) filter (where {bad})"
    value = f"min_by({column}, idx) filter (where {bad})"
    return f"case when count(*) filter (where {bad}) > 0 then '{text} ' || {at} || ':{{sep}}value=' || cast({value} as varchar) end"


ORACLES |= {
    "diagnostic_from_steps": _with("sets as (select run_id, cycle_index, list_sort(list_distinct(list(step_index))) as s from raw group by all)")
    + " select run_id, cycle_index, case when s = [0, 1, 2, 3, 4] then 'hppc' else 'rpt' end as cycle_type from sets where s = [0, 1, 2, 3, 4] or s = [0, 3] or s = [1, 2, 4]",
    "validation": _with("rows as (select *, data_point - min(data_point) over (partition by run_id) as idx from raw)")
    + " select run_id, reason = '' as valid, reason from (select run_id, coalesce("
    + ", ".join(
        (
            _message("charge_capacity", "charge_capacity > 1.5", "charge_capacity is higher than allowed max 1.5 at index").format(sep=" "),
            "case when max(cycle_index) < 1 then 'cycle_index needs to reach at least 1 for processing, instead found:value=' || min_by(cycle_index, idx) end",
            _message("temperature", "temperature > 34", "temperature is higher than allowed max 34.0 at index").format(sep=" "),
            _message("temperature", "temperature < 20", "temperature is lower than allowed min 20.0 at index").format(sep=""),
            _message("voltage", "voltage > 3.25", "voltage is higher than allowed max 3.25 at index").format(sep=" "),
            _message("voltage", "voltage < 2.0", "voltage is lower than allowed min 2.0 at index").format(sep=""),
            "case when min(voltage) > 2.002 then 'voltage needs to reach under None for processing, instead found:value=' || min_by(voltage, idx) end",
        )
    )
    + ", '') as reason from rows group by run_id)",
    "cell_life": _life(NOMINAL, _lives([0.98, 0.9, 0.8, 0.7])) + " select * from lives",
    "capacity_at_cycles": _life() + " select run_id, " + ", ".join(f"coalesce(max(discharge_capacity) filter (where position = {p}), 0) as cycle_{p}" for p in (20, 60, 100, 140, 180)) + " from life group by run_id",
    "cycles_to_capacity": _life(NOMINAL, _lives(TRAJECTORY)) + " select run_id, " + ", ".join(f'max(cycle_life) filter (where threshold = {t}::double) as "capacity_{t}"' for t in TRAJECTORY) + " from lives group by run_id",
    "fraction_remaining": _life() + " select * from (select run_id, cycle_index, discharge_energy / min_by(discharge_energy, cycle_index) over (partition by run_id) as fractional_metric from ldiag where cycle_type = 'rpt_0.2C') where cycle_index > 60",
    "fraction_remaining_nx": _life(FRACTIONS) + " select * from nx",
    "threshold_targets": _life(
        FRACTIONS,
        "pts as (select run_id, cycle_index, normalized_regular_throughput as x, fractional_metric as y, row_number() over (partition by run_id order by cycle_index desc) as back from nx where cycle_type = 'rpt_0.2C')",
        """ends as (select run_id, min(y) > 0.85::double as beyond, min(x) as lo, max(x) as xm, max(x) filter (where back = 1) as x1, max(y) filter (where back = 1) as y1,
                     max(x) filter (where back = 2) as x0, max(y) filter (where back = 2) as y0 from pts group by run_id)""",
        "bnd as (select *, case when beyond then x0 + (0.85::double - 0.1::double - y0) * (x1 - x0) / nullif(y1 - y0, 0) else xm end as hi from ends)",
        "g as (select distinct bnd.*, case when i = 100 then hi else lo + i * ((hi - lo) / 100) end as x from bnd, generate_series(0, 100) t(i) where hi is not null)",
        """v as (select g.*, (select coalesce(min_by(p.y, p.cycle_index), null) from pts p where p.run_id = g.run_id and p.x = g.x) as hit,
                  (select arg_max(struct_pack(x := p.x, y := p.y), (p.x, p.cycle_index)) from pts p where p.run_id = g.run_id and p.x < g.x) as l,
                  (select arg_min(struct_pack(x := p.x, y := p.y), (p.x, p.cycle_index)) from pts p where p.run_id = g.run_id and p.x > g.x) as r from g)""",
        """w as (select run_id, x, abs(case when beyond and x > x1 then y1 + (x - x1) * ((y1 - y0) / nullif(x1 - x0, 0)) when hit is not null then hit when l is null then null when r is null then l.y
                  else l.y + (r.y - l.y) * ((x - l.x) / (r.x - l.x)) end - 0.85::double) as off from v)""",
    )
    + " select run_id, round(arg_min(x, (off, x)), 6) as crossing from w where off is not null group by run_id",
    "delta_q_features": _delta_q(),
    "cycle_statistic_features": _life(*[_statistics(k, v) for k, v in STATS.items()]) + " select * from st_charging_capacity " + " ".join(f"full join st_{k} using (run_id)" for k in list(STATS)[1:]),
    "diagnostic_differences": _life("nth as (select *, row_number() over (partition by run_id, cycle_type order by cycle_index) - 1 as nth from ldiag)")
    + " select run_id, " + ", ".join(f'{_change(t, c)} as "diag_sum_diff_0_1_{t}{c}"' for t, c in _pairs) + " from nth group by run_id",
    "exclusion": _life(
        FRACTIONS,
        "f as (select * from nx where cycle_type = 'rpt_0.2C')",
        "g as (select *, last_value(fractional_metric ignore nulls) over (partition by run_id order by cycle_index) as filled from f)",
        "h as (select *, lag(filled) over (partition by run_id order by cycle_index) as before from g)",
        "e as (select run_id, case when arg_max_null(filled, cycle_index) > 1 then coalesce(arg_max_null(before, cycle_index), arg_max_null(filled, cycle_index)) else arg_max_null(filled, cycle_index) end as frac, min(cycle_index) filter (where fractional_metric < 0.8) as below, max(cycle_index) as last_at from h group by run_id)",
        "c as (select *, case when frac < 0.8 then below else last_at end as cutoff from e)",
        "x as (select c.*, (select charge_throughput from life l where l.run_id = c.run_id and position = 80) as t80, (select max_by(charge_throughput, cycle_index) from life l where l.run_id = c.run_id and l.cycle_index <= c.cutoff) / 1.0 as efc from c)",
    )
    + """ select run_id, frac as fractional_capacity_at_EOT, frac < 0.8 as is_below_fractional_capacity_at_EOT, t80 as first_n_cycles_throughput, efc as equivalent_full_cycles_at_EOL,
           coalesce(t80 > 75, false) as is_above_first_n_cycles_throughput, coalesce(efc > 110, false) as is_above_equivalent_full_cycles_at_EOL,
           coalesce(frac < 0.8, false) and coalesce(t80 > 75, false) and coalesce(efc > 110, false) as to_include from x""",
    "feature_matrix": _life(NOMINAL, _lives([0.9, 0.8]), "caps as (select run_id, coalesce(max(discharge_capacity) filter (where position = 20), 0) as a, coalesce(max(discharge_capacity) filter (where position = 160), 0) as b from life group by run_id)")
    + """ select run_id, any_value(a) as "cycle_20::Capacities", any_value(b) as "cycle_160::Capacities", max(cycle_life) filter (where threshold = 0.9::double)::double as "capacity_0.9::Trajectory",
           max(cycle_life) filter (where threshold = 0.8::double)::double as "capacity_0.8::Trajectory" from caps join lives using (run_id) group by run_id""",
    "clean_matrix": _life(
        "m as (select run_id * 1000 + cycle_index as run_id, 1.0::double / nullif(dc_internal_resistance, 0) as g, time_temperature_integrated as t, charge_duration as c from life)",
        "k as (select * from m where (g is not null)::int + (t is not null)::int + (c is not null)::int >= 1.8)",
        "f as (select median(g) as g, median(t) as t, median(c) as c from k)",
    )
    + " select k.run_id, coalesce(k.g, f.g) as g, coalesce(k.t, f.t) as time_temperature_integrated, coalesce(k.c, f.c) as charge_duration from k, f",
    "grouped_folds": _life("h as (select distinct run_id, md5('3:' || run_id) as h from life)", "r as (select run_id, (row_number() over (partition by substr(h, 1, 2) order by h) + ('0x' || substr(h, 1, 2))::int) % 5 as fold from h)")
    + " select life.run_id, cycle_index, cast(fold as int) as fold from life join r using (run_id)",
}

_RES = """
res as (
  select run_id, p, w, {columns}
  from (select run_id, p, w, max(v) filter (where s = 0 and k = 11) as vd, max(v) filter (where s = 2 and k = 11) as vc,
               max(v) filter (where s = 1 and k = 0) as d0, max(v) filter (where s = 1 and k = 1) as d3, max(v) filter (where s = 1 and k = 11) as de,
               max(v) filter (where s = 3 and k = 0) as c0, max(v) filter (where s = 3 and k = 1) as c3, max(v) filter (where s = 3 and k = 11) as ce from hp group by all))""".format(
    columns=", ".join(f"({side}{t} - v{side}) / {current}::double as r_{side}_{name}" for side, current in (("c", 1.5), ("d", -2.0)) for t, name in (("0", "0s"), ("3", "3s"), ("e", "end")))
)
_G1 = "skewness(d) * (count(d) - 2) / sqrt(count(d) * (count(d) - 1))"


def _hppc(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in (HPPC_SQL, *parts))


def _res_change(c: str, w: int) -> str:
    a, b = (f"max({c}) filter (where p = {p} and w = {w})" for p in (0, 1))
    return f'({b} - {a}) / nullif({a}, 0) as "{c}_{w}0"'


_NAMES = [f"r_{side}_{t}" for side in ("c", "d") for t in ("0s", "3s", "end")]

ORACLES |= {
    "pulse_resistances": _hppc(_RES) + " select run_id, p as position, w as \"window\", " + ", ".join(_NAMES) + " from res",
    "pulse_features": _hppc(
        _RES,
        "chg as (select run_id, " + ", ".join(_res_change(c, w) for c in _NAMES for w in range(3)) + " from res group by run_id)",
        "ocv as (select run_id, w, max(v) filter (where p = 0) - max(v) filter (where p = 1) as d from hp where s = 0 and k = 2 group by all)",
        f"st as (select run_id, round(var_pop(d), 6) as var_ocv, round(min(d), 6) as min_ocv, round(avg(d), 6) as mean_ocv, round({_G1}, 6) as skew_ocv, round(kurtosis(d) + 3, 6) as kurtosis_ocv, round(sum(abs(d)), 6) as sum_ocv, round(sum(d * d), 6) as sum_square_ocv from ocv group by run_id)",
    )
    + " select * from chg join st using (run_id)",
    "diffusion_slopes": _hppc()
    + " select run_id, p as position, w as \"window\", round(regr_slope(v - v0, sqrt(t + 22) - sqrt(t)), 6) as slope from (select *, k * 2.0::double as t, min(v) over (partition by run_id, p, w) as v0 from hp where s = 2) where w > 0 and k >= 8 group by all",
    "drive_power": _with(
        "tr as (select run_id as wave_id, test_time as t, abs(current) * 8 * (1600.0::double / 3600.0::double) as v from raw)",
        "gr as (select *, t - lag(t) over w as h0, lead(t) over w - t as h1, v - lag(v) over w as b0, lead(v) over w - v as b1 from tr window w as (partition by wave_id order by t))",
        "gg as (select *, coalesce((b0 / h0 * h1 + b1 / h1 * h0) / (h0 + h1), b0 / h0, b1 / h1) as g from gr)",
    )
    + " select wave_id, t as time, round(-(1500.0::double * g + 0.01::double * 1500.0::double * 9.8::double + 0.5::double * 1.225::double * 0.34::double * 1.75::double * v * v) * v, 4) as power from gg",
    "tester_waveform": _with(
        "tr as (select run_id as wave_id, data_point as t, case when step_index <> 1 then floor(current) else 0 end as pw from raw)",
        "sc as (select *, pw / max(abs(pw)) over (partition by wave_id) as x from tr)",
        "nw as (select *, coalesce((x <> lag(x) over (partition by wave_id order by t))::int, 0) as new from sc)",
        "st as (select *, cast(sum(new) over (partition by wave_id order by t rows unbounded preceding) as bigint) as step from nw)",
        "gp as (select wave_id, step, count(*) as duration, min_by(x, t) as x from st group by all)",
    )
    + """ select wave_id, step, case when x <= 0 then 'D' else 'C' end as state, case when x = 0 then 'I' else 'P' end as control_mode, round(abs(x), 5) as value,
           case when x <= 0 then 2.7::double else 4.2::double end as limit_value, duration, case when x <= 0 then '<=' else '>=' end as operation from gp""",
    "spliced_runs": _with(
        "a as (select run_id, data_point, cycle_index, test_time from raw where cycle_index < 3)",
        "b as (select run_id, row_number() over (partition by run_id order by data_point) as data_point, cycle_index - 3 as cycle_index, test_time from raw where cycle_index >= 3)",
        "ae as (select run_id, max_by(data_point, data_point) as d, max_by(cycle_index, data_point) as c, max_by(test_time, data_point) as t from a group by run_id)",
        "bs as (select run_id, min_by(data_point, data_point) as d, min_by(cycle_index, data_point) as c, min_by(test_time, data_point) as t from b group by run_id)",
    )
    + """ select *, 1 as part from a union all
          select b.run_id, b.data_point + case when bs.d < ae.d then ae.d else 0 end, b.cycle_index + case when bs.c < ae.c then ae.c else 0 end, b.test_time + case when bs.t < ae.t then ae.t else 0 end, 2
          from b left join ae using (run_id) left join bs using (run_id)""",
    "test_sessions": _with(
        "g as (select run_id, date_time, case when epoch_us(date_time) - epoch_us(lag(date_time) over w) >= 21600000000 then 1 else 0 end as new from raw window w as (partition by run_id order by date_time))",
        "s as (select *, sum(new) over (partition by run_id order by date_time rows unbounded preceding) as sid from g)",
    )
    + " select run_id, strftime(min(date_time), '%Y-%m-%d %H:%M:%S.%f') as started, strftime(max(date_time), '%Y-%m-%d %H:%M:%S.%f') as ended, count(*) as samples from s group by run_id, sid",
    "live_cycles": _with()
    + " select run_id, cycle_index, strftime(date_trunc('day', date_time), '%Y-%m-%d') as window_start, max(charge_capacity) as charge_capacity, max(discharge_capacity) as discharge_capacity, max(temperature) as temperature_maximum, count(*) as samples from raw group by all",
}

ORACLES["protocol_steps"] = """
with p as (select p_partkey as seq_num, p_size / 16.0::double as c1, p_size / 32.0::double as c2, 3.5::double + p_size / 64.0::double as v, p_size / 8.0::double as d1, (10800 + 720 * (p_partkey % 96)) % 86400 as s from part),
st as (select seq_num, 1 as step, 'Charge' as kind, 'Current' as mode, round_even(c1 * 4.5::double, 3) as value, 'StepTime' as end_type from p
       union all select seq_num, 2, 'Charge', 'Current', round_even(c2 * 4.5::double, 3), 'Voltage' from p
       union all select seq_num, 3, 'Charge', 'Voltage', v, 'StepTime' from p
       union all select seq_num, 4, 'Rest', '', null, 'StepTime' from p
       union all select seq_num, 5, 'Dischrge', 'Current', round_even(d1 * 4.5::double, 3), 'Voltage' from p
       union all select seq_num, 6, 'Rest', '', null, 'StepTime' from p)
select st.*, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) as rest from st join p using (seq_num)
"""

ORACLES["smoothed_voltage"] = _with("v as (select run_id, data_point, voltage from raw)") + (
    " select a.run_id, a.data_point, round(sum(b.voltage * pow(0.4::double, a.data_point - b.data_point)) / sum(pow(0.4::double, a.data_point - b.data_point)), 9) as smooth"
    " from v a join v b on a.run_id = b.run_id and b.data_point between a.data_point - 43 and a.data_point group by all"
)


def _end(ha: str, sa: str, hb: str, sb: str) -> str:
    d = f"((2 * {ha} + {hb}) * {sa} - {ha} * {sb}) / ({ha} + {hb})"
    return f"case when {sb} is null then {sa} when sign({d}) <> sign({sa}) then 0 when sign({sa}) <> sign({sb}) and abs({d}) > 3 * abs({sa}) then 3 * {sa} else {d} end"


ORACLES["smooth_capacity"] = _life(
    "kn as (select run_id, cycle_index::double as x, discharge_capacity as y from life)",
    "k1 as (select *, lead(x) over w - x as h, (lead(y) over w - y) / (lead(x) over w - x) as s from kn window w as (partition by run_id order by x))",
    "k2 as (select *, lag(h) over w as h0, lag(s) over w as s0, lead(h) over w as h2, lead(s) over w as s2, lag(h, 2) over w as h00, lag(s, 2) over w as s00 from k1 window w as (partition by run_id order by x))",
    f"k3 as (select run_id, x, y, case when h0 is null then {_end('h', 's', 'h2', 's2')} when h is null then {_end('h0', 's0', 'h00', 's00')} when s0 * s <= 0 then 0 else (3 * h + 3 * h0) / ((2 * h + h0) / s0 + (h + 2 * h0) / s) end as d from k2)",
    "k4 as (select *, lead(x) over w as x1, lead(y) over w as y1, lead(d) over w as d1 from k3 window w as (partition by run_id order by x))",
    "b as (select run_id, min(x) as lo, max(x) as hi from kn group by run_id)",
    "g as (select distinct run_id, case when i = 64 then hi else lo + i * ((hi - lo) / 64) end as c from b, generate_series(0, 64) t(i))",
    "j as (select g.run_id, c, k4.*, (c - x) / (x1 - x) as t from g asof join k4 on g.run_id = k4.run_id and g.c >= k4.x)",
) + """ select run_id, round(c, 6) as cycle, round(case when c = x then y else (1 + 2 * t) * (1 - t) * (1 - t) * y + t * (1 - t) * (1 - t) * (x1 - x) * d + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * (x1 - x) * d1 end, 8) as discharge_capacity from j"""

ORACLES["rpt_roles"] = (
    _with(DIAGNOSTIC, "rates as (select run_id, cycle_index, step_index, round_even(median(current) / 2.0, 2) as m from raw semi join (select * from diag where cycle_type = 'reset') d using (run_id, cycle_index) group by all)")
    + " select run_id, cycle_index, step_index, case when m > 0 then 'reset_charge' when m < 0 then 'reset_discharge' end as role from rates"
)

ORACLES["excluded_cycles"] = _with("diag as (select distinct run_id, cycle_index from raw where cycle_index in (0, 2, 3))", SUMMARY) + f" select * exclude (date_time), {_TIME} from summary"

ORACLES["stray_finals"] = (
    _with(OCCURRENCES, "thin as (select * replace (case when event_id % 3 > 0 then test_time end as test_time) from occ)")
    + """, kept as (select * from thin where test_time is null or test_time <= 1000000 or cycle_index >= 4)
    select run_id, data_point, cycle_index, step_index, step_index_counter, test_time from kept
    qualify count(test_time) over (partition by run_id, cycle_index, step_index, step_index_counter) > 0"""
)

ORACLES["waveform_flags"] = _with() + " select run_id, cycle_index, step_index, count(*) filter (where event_id % 50 = 0) > 0 as is_waveform from raw group by all"

ORACLES["protocol_of_runs"] = """
select run_id, p_size / 16.0::double as charge_constant_current_1, 3.5::double + p_size / 64.0::double as charge_cutoff_voltage
from (select distinct user_id as run_id from events) r left join (select * from part where p_size % 4 <> 0) p on run_id = p_partkey
"""

ORACLES["structuring_ranges"] = """
with p as (select * from part where p_size % 4 <> 0),
spans as (select p_partkey % 5 as project, min(2.5::double + p_size / 128.0::double) as lo, max(3.5::double + p_size / 64.0::double) as hi from p group by 1)
select 'P' || u % 5 || '_' || u || '_x.csv' as run_id, coalesce(p_size / 16.0::double, 1.1::double) as nominal_capacity, case when p_size is not null then lo end as v_min, case when p_size is not null then hi end as v_max
from (select distinct user_id as u from events) r left join p on u = p_partkey left join spans on u % 5 = project
"""

ORACLES["diagnostic_patterns"] = (
    _with(
        "sets as (select run_id, cycle_index, list_sort(list_distinct(list(step_index))) as s from raw where (step_index + run_id) % 4 <> cycle_index % 3 group by all)",
        "sized as (select a.*, [len(a.s), coalesce(len(b.s), 0)] as n, max(a.cycle_index) over (partition by a.run_id) as last from sets a left join sets b on a.run_id = b.run_id and b.cycle_index = a.cycle_index + 1)",
        "known as (select run_id, s, n from sized where cycle_index in (1, 4))",
        "starts as (select distinct a.run_id, a.cycle_index from sized a join known k using (run_id) where a.s = k.s or (a.cycle_index >= last - 3 and a.n = k.n))",
        "marked as (select run_id, cycle_index + i as cycle_index, cycle_index as start, case i when 0 then 'reset' else 'hppc' end as cycle_type from starts, generate_series(0, 1) t(i))",
    )
    + " select run_id, cycle_index, max_by(cycle_type, start) as cycle_type from marked semi join sets using (run_id, cycle_index) group by run_id, cycle_index"
)

ORACLES["diagnostic_channels"] = (
    _with(
        OCCURRENCES,
        DIAGNOSTIC,
        """rows as (select occ.*, cycle_type, dense_rank() over (partition by run_id, cycle_index order by step_type) - 1 as step,
                 least(charge_capacity, max(charge_capacity) over p - discharge_capacity) as q, test_time - min(test_time) over p as t
          from occ join diag using (run_id, cycle_index) window p as (partition by run_id, cycle_index, step_index))""",
        """both_kinds as (select run_id, 'diag_cycle_0_' || cycle_type || '_capacity_step_' || step as channel, step_index_counter as k, test_time, q as value from rows
           union all select run_id, 'diag_cycle_0_' || cycle_type || '_test_time_step_' || step, step_index_counter, test_time, t from rows)""",
    )
    + " select run_id, channel, cast(row_number() over (partition by run_id, channel order by k, test_time, value) - 1 as integer) as place, value from both_kinds"
)

ORACLES["hppc_features"] = (
    _hppc(
        _RES,
        "chg as (select run_id, " + ", ".join(_res_change(c, w) for c in _NAMES for w in range(9)) + " from res group by run_id)",
        "ocv as (select run_id, w, max(v) filter (where p = 0) - max(v) filter (where p = 1) as d from hp where s = 0 and k = 2 group by all)",
        f"st as (select run_id, round(var_pop(d), 6) as var_ocv, round(min(d), 6) as min_ocv, round(avg(d), 6) as mean_ocv, round({_G1}, 6) as skew_ocv, round(kurtosis(d) + 3, 6) as kurtosis_ocv, round(sum(abs(d)), 6) as sum_ocv, round(sum(d * d), 6) as sum_square_ocv from ocv group by run_id)",
        "slopes as (select run_id, p, w, regr_slope(v - v0, sqrt(t + 22) - sqrt(t)) as slope from (select *, k * 2.0::double as t, min(v) over (partition by run_id, p, w) as v0 from hp where s = 2) where w > 0 and k >= 8 group by all)",
        "dif as (select run_id, " + ", ".join(f"round(max(slope) filter (where p = 1 and w = {w}) / max(slope) filter (where p = 0 and w = {w}) - 1, 6) + 0.0::double as D_{w}" for w in range(1, 9)) + " from slopes group by run_id)",
    )
    + " select * from chg join st using (run_id) join dif using (run_id)"
)

ORACLES["voltage_differences"] = (
    "with "
    + SOC_SQL.strip()
    + f""" select run_id, w as "window", round(var_pop(d), 6) as var_v_diff, round(min(d), 6) as min_v_diff, round(avg(d), 6) as mean_v_diff, round({_G1}, 6) as skew_v_diff, round(kurtosis(d) + 3, 6) as kurtosis_v_diff,
           round(sum(abs(d)), 6) as sum_v_diff, round(sum(d * d), 6) as sum_square_v_diff from sp where q > w and q < w + 1 group by run_id, w"""
)

ORACLES["curve_vectors"] = _life() + " select run_id, cycle_index, " + ", ".join(f"max(discharge_capacity) filter (where voltage = {2.5 + i / 16}::double) as v{i}" for i in range(21)) + " from lcurves where cycle_index in (10, 55, 100) group by all"


def _electrodes() -> str:
    ends = {"upper": 4.2, "lower": 2.7}
    near = ", ".join(f"min_by(struct_pack(soc, pe, ne), (abs(pe - ne - {v}::double), soc)) filter (where pe - ne is not null) as {e}" for e, v in ends.items())
    spans = ", ".join(f"{f}(soc) filter (where {x} is not null) as {n}_{f}" for f in ("min", "max") for n, x in (("pe", "pe"), ("ne", "ne"), ("li", "pe - ne")))
    out = [f"round({e}.{x}, 9) as {x}_{e}_voltage, round(({e}.soc - {x}_min) / ({x}_max - {x}_min) * 100, 9) as {x}_{e}_soc" for x in ("pe", "ne") for e in ends]
    out += [f"{x}_max - {x}_min as {x}_mass" for x in ("pe", "ne", "li")] + [f"{e}.soc as soc_{e}" for e in ends]
    return f"with {ELECTRODE_SQL.strip()}, found as (select run_id, {near}, {spans} from ec group by run_id) select run_id, {', '.join(out)} from found"


ORACLES["electrode_voltages"] = _electrodes()


def _blocks() -> str:
    """block, step, kind, mode, value, limit, type and value of the first end, by the parameters of the query."""
    amps = lambda k, places=3: f"round_even(4.5::double * (p_size / {k}.0::double), {places})"
    time = lambda seconds: f"printf('%02d:%02d:%02d', ({seconds}) // 3600, ({seconds}) % 3600 // 60, ({seconds}) % 60)"
    text = lambda x: f"cast({x} as varchar)"
    cut, low, high = text(amps(128)), "2.75::double", "4.25::double"
    rows = [
        ("reset", 0, "Charge", "Current", amps(16, 4), high, "Current", text(amps(64, 4))),
        ("reset", 1, "Dischrge", "Current", amps(16, 4), "null", "Voltage", "'2.75'"),
        ("hppc", 0, "Charge", "Current", amps(32), high, "Current", cut),
        ("hppc", 2, "Rest", "", "null", "null", "StepTime", time("60 * p_size")),
        ("hppc", 3, "Dischrge", "Current", amps(8), "null", "StepTime", time("2 * p_size")),
        ("hppc", 4, "Rest", "", "null", "null", "StepTime", time("3 * p_size")),
        ("hppc", 5, "Charge", "Current", amps(4), "null", "StepTime", time("4 * p_size")),
        ("hppc", 6, "Dischrge", "Current", amps(32), "null", "StepTime", time("cast(round_even(360 / (p_size / 32.0::double) - 1, 0) as bigint)")),
        ("hppc", 8, "Dischrge", "Voltage", low, amps(32), "Current", cut),
    ]
    for i, k in enumerate((64, 32, 8)):
        rows += [("rpt", 3 * i, "Charge", "Current", amps(16), high, "Current", cut), ("rpt", 3 * i + 1, "Dischrge", "Current", amps(k), "null", "Voltage", "'2.75'")]
    return " union all ".join(f"select p_partkey as seq_num, '{b}' as block, {n} as step, '{kind}' as kind, '{mode}' as mode, {v} as value, {limit} as \"limit\", '{t}' as end_type, {e} as end_value from part" for b, n, kind, mode, v, limit, t, e in rows)


ORACLES["diagnostic_protocols"] = _blocks()

ORACLES["early_constant_voltage"] = (
    _with(
        _cv("raw", "current > 0"),
        "span as (select run_id, cycle_index, min(test_time) as t0, max(test_time) as t1 from raw group by all)",
        "onset as (select run_id, cycle_index, (from_time - t0) / nullif(t1 - t0, 0) as x from span join start using (run_id, cycle_index))",
    )
    + " select run_id, not (run_id % 3 > 1 and bool_or(coalesce(x < 0.3, false))) as \"is_not_early_CV\" from onset group by run_id"
)


def _degraded() -> str:
    def curve(e: str) -> str:
        return f"""{e}_p as (select run_id, s_{e} as s, {e} as v, lead(s_{e}) over w as s2, lead({e}) over w as v2 from sh where {e} is not null window w as (partition by run_id order by s_{e})),
{e}_g as (select g.run_id, g.i, g.x, case when p.s = g.x then p.v when p.s2 is not null then p.v + (p.v2 - p.v) * ((g.x - p.s) / (p.s2 - p.s)) end as v from g asof left join {e}_p p on p.run_id = g.run_id and g.x >= p.s)"""

    return f"""with {ELECTRODE_SQL.strip()},
ends as (select run_id, min_by(soc, (abs(pe - ne - 4.2::double), soc)) filter (where pe - ne is not null) as top, min_by(soc, (pe - ne, soc)) filter (where pe - ne is not null) as bottom from ec group by run_id),
loss as (select run_id, top, bottom, (run_id % 5) / 2.0::double as lli, cast(run_id % 7 as double) as lam_pe, (run_id % 9) * 1.5::double as lam_ne from ends where top is not null),
sh as (select run_id, pe, ne, soc * (1 - lam_pe / 100) + lam_pe * top / 100 as s_pe, soc * (1 - lam_ne / 100) + lam_ne * bottom / 100 + lli as s_ne from ec join loss using (run_id)),
g0 as (select run_id, least(min(s_pe), min(s_ne)) as lo, greatest(max(s_pe), max(s_ne)) as hi from sh group by run_id),
g as (select run_id, i, case when i = 1000 then hi else lo + i * ((hi - lo) / 1000) end as x from g0, generate_series(0, 1000) t(i)),
{curve("pe")}, {curve("ne")}
select run_id, round(pe_g.x, 6) as soc, round(pe_g.v, 6) as pe, round(ne_g.v, 6) as ne from pe_g join ne_g using (run_id, i)"""


ORACLES["imposed_degradation"] = _degraded()


def _gram() -> str:
    names = ["1.0::double", "discharge_capacity", "charge_duration", "temperature_maximum", "time_temperature_integrated"]
    cells = " union all ".join(f"select fold, {i - 1} as i, {j - 1} as j, sum({a} * {b}) as total from whole group by fold" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)
    return _life() + f", whole as (select *, cast(run_id % 5 as integer) as fold from life where time_temperature_integrated is not null) {cells}"


ORACLES["gram_matrices"] = _gram()

ORACLES["cycles_across_files"] = (
    _with(
        "f0 as (select run_id, cast(least(data_point // 20, 2) as integer) as technique, data_point, step_index as s, cycle_index as l from raw)",
        "f1 as (select *, lag(s) over w as s0, lag(l) over w as l0 from f0 window w as (partition by run_id, technique order by data_point))",
        "f2 as (select *, case when l0 is null then 0 when l0 <> l then 2 - technique when s0 <> s then (s0 + 2 * s + technique) % 3 else 0 end as step from f1)",
    )
    # Starts count once a file that the run has: of the three only the second's is 1.
    + """ select run_id, technique, data_point, cast(1 + sum(step) over (partition by run_id order by technique, data_point rows unbounded preceding)
             + case when technique >= 1 and bool_or(technique = 1) over (partition by run_id) then 1 else 0 end as bigint) as cycle_index from f2"""
)

ORACLES["rules_of_step_tables"] = """
with s0 as (select p_partkey as protocol, t.i as technique, s.i as step, case when s.i = 3 then 'o' when s.i = 8 then 'c' when (p_size * s.i) % (2 + t.i) = 0 then 'a' else 'm' end as kind
            from part, generate_series(1, 2) t(i), generate_series(1, 10) s(i)),
m as (select * from s0 where kind = 'm'), a as (select * from s0 where kind = 'a'),
-- Straight ways: from a measured step to the next one, by the advances between them.
line as (select protocol, technique, step as source, lead(step) over (partition by protocol, technique order by step) as target from m),
ways as (select l.protocol, l.technique, source, target, count(*) as advance, 0 as i from line l join a on a.protocol = l.protocol and a.technique = l.technique and a.step between source and target group by all),
-- Back from the loop's last measured step to its first.
loops as (select protocol, technique, min(step) as target, max(step) as source from m where step between 4 and 7 group by all having min(step) < max(step)),
backs as (select l.protocol, l.technique, source, target, count(*) as advance, 1 as i from loops l join a on a.protocol = l.protocol and a.technique = l.technique and (a.step between source and 8 or a.step between 3 and target) group by all),
one as (select protocol, technique, source, target, max_by(advance, i) as advance from (select * from ways union all select * from backs) group by all),
listed as (select protocol, technique, string_agg(source || '>' || target || ':' || advance, ' ' order by source, target) as transitions from one group by all),
ends as (select k.protocol, k.technique, (select count(*) from a where a.protocol = k.protocol and a.technique = k.technique and a.step < k.low) as lead, (select count(*) from a where a.protocol = k.protocol and a.technique = k.technique and a.step > k.high) as rest
         from (select protocol, technique, min(step) filter (where kind = 'm') as low, coalesce(max(step) filter (where kind = 'm'), 0) as high from s0 group by all) k)
select protocol, technique, coalesce(lag(rest) over (partition by protocol order by technique), 0) + lead as on_start, rest as on_loop, coalesce(transitions, '') as transitions
from ends left join listed using (protocol, technique)"""
