"""Checked queries: drift within a table, and two versions of a table."""

from pyspark.sql import functions as F

from tablescope.operators import drift, ordering
from tablescope.plans.fixtures import view
from tablescope.plans.oracle import d, ks_ctes, ks_p, rnd, severity, shift, union, with_views
from tablescope.plans.queries import query, table

_HALF = "(select floor(count(*) / 2.0) from events)"


@query("split_halves", f"""
    select half, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from (
        select event_id, case when row_number() over (order by event_id) <= {_HALF} then 1 else 2 end as half
        from events) group by half""")
def _(spark, sf):
    halves = drift.split_halves(table(spark, sf, "events"), ["event_id"])
    return halves.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"),
                                      F.max("event_id").alias("last_id"))


_LI_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("split_halves_composite_key", f"""
    select half, l_returnflag, count(*) as n, cast(sum(l_partkey) as bigint) as parts from (
        select *, case when row_number() over (order by {_LI_KEYS}) <= (select floor(count(*) / 2.0) from lineitem)
                  then 1 else 2 end as half from lineitem) group by half, l_returnflag""")
def _(spark, sf):
    halves = drift.split_halves(table(spark, sf, "lineitem"), _LI_KEYS.split(", "))
    return halves.groupBy("half", "l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                                      F.sum("l_partkey").alias("parts"))


_DRIFT = with_views("fx_drift", extra=[ks_ctes(
    "fx_drift", ["event_id", "user_id", "value"], f"event_id >= {_HALF}")])
_REPORT = f"""select ordinal, feature, {rnd('ks', 4)} as ks_stat, {rnd(ks_p(), 4)} as p_value,
    {ks_p()} < 0.05 as drifted, {severity()} as severity, {rnd('m1', 4)} as mean_first,
    {rnd('m2', 4)} as mean_second, {shift('m1', 'm2')} as mean_shift, {shift('s1', 's2')} as std_shift
    from cmp where n1 >= 10 and n2 >= 10"""


@query("drift_report", _DRIFT + f"select * exclude (ordinal) from ({_REPORT})")
def _(spark, sf):
    return drift.drift_report(view(spark, sf, "fx_drift"), "trend", ["event_id"])


@query("drift_report_stable", "with " + ks_ctes(
    "li", ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"], "second").replace("long as", f"""
li as (select *, row_number() over (order by {_LI_KEYS}) > (select floor(count(*) / 2.0) from lineitem) as second
       from lineitem), long as""", 1) + f"select * exclude (ordinal) from ({_REPORT})")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    halves = drift.split_halves(li, _LI_KEYS.split(", "))
    names = ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
    # Keys that drift by construction stay out of the comparison.
    return drift.halves_report(halves, names)


@query("drift_summary", _DRIFT + f"""
    select n_drifted, n_tested, drift_pct, case when drift_pct > 40 then 'HIGH' when drift_pct > 20 then 'MEDIUM'
           else 'LOW' end as risk, top_drifted
    from (select count(*) filter (where drifted) as n_drifted, count(*) as n_tested,
                 {rnd('count(*) filter (where drifted) / 3.0::double * 100', 1)} as drift_pct,
                 coalesce(string_agg(feature, ',' order by ordinal) filter (where drifted), '') as top_drifted
          from ({_REPORT}))""")
def _(spark, sf):
    return drift.drift_summary(view(spark, sf, "fx_drift"), "trend", ["event_id"])


@query("target_drift", with_views("fx_drift", extra=[ks_ctes("fx_drift", ["value"], f"event_id >= {_HALF}")]) + f"""
    select {rnd('ks', 4)} as ks_stat, {rnd(ks_p(), 4)} as p_value, {ks_p()} < 0.05 as drifted,
           {rnd('m1', 4)} as mean_first, {rnd('m2', 4)} as mean_second from cmp where n1 > 5 and n2 > 5""")
def _(spark, sf):
    return drift.target_drift(view(spark, sf, "fx_drift"), "value", ["event_id"])


_FLAG_KS = ks_ctes("lineitem", ["l_extendedprice", "l_quantity"], "l_returnflag = 'R'")


@query("ks_statistic", f"with {_FLAG_KS} select feature, cast(n1 as bigint) as n_first, cast(n2 as bigint) as n_second, "
       f"{rnd('ks', 8)} as ks from cmp")
def _(spark, sf):
    ks = drift.ks_statistic(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"],
                            F.col("l_returnflag") == "R")
    return ks.select("feature", "n_first", "n_second", (F.round("ks", 8) + F.lit(0.0)).alias("ks"))


@query("ks_statistic_ranges", f"with {_FLAG_KS} select feature, cast(n1 as bigint) as n_first, cast(n2 as bigint) as n_second, "
       f"{rnd('ks', 8)} as ks from cmp")
def _(spark, sf):
    # Few cells at first, so that the search takes several rounds.
    ks = drift.ks_statistic(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"],
                            F.col("l_returnflag") == "R", first_cells=3)
    return ks.select("feature", "n_first", "n_second", (F.round("ks", 8) + F.lit(0.0)).alias("ks"))


@query("ks_pvalue", f"with {_FLAG_KS} select feature, {rnd(ks_p(), 6)} as p_value from cmp")
def _(spark, sf):
    from tablescope.functions.stats import ks_p_value
    ks = drift.ks_statistic(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"],
                            F.col("l_returnflag") == "R")
    return ks.select("feature", (F.round(ks_p_value(F.col("ks"), F.col("n_first"), F.col("n_second")), 6)
                                 + F.lit(0.0)).alias("p_value"))


@query("global_position", "select event_id, row_number() over (order by ts) - 1 as pos from events")
def _(spark, sf):
    events = table(spark, sf, "events")
    placed = ordering.global_position(events, ["ts"], small_rows=max(1, events.count() // 10))
    return placed.select("event_id", F.col("_pos").alias("pos"))


# --- two versions ----------------------------------------------------------------------------

_SCHEMA = [("o_orderkey", "common", "bigint", "bigint"), ("o_custkey", "common", "bigint", "bigint"),
           ("o_orderstatus", "common", "string", "string"), ("o_totalprice", "common", "double", "double"),
           ("o_orderdate", "removed", "timestamp_ntz", None),
           ("o_orderpriority", "common", "string", "string"), ("o_extra", "added", None, "int")]


def _text(v):
    return "null::varchar" if v is None else f"'{v}'"


@query("schema_diff", union([f"select '{c}' as \"column\", '{s}' as status, {_text(a)} as old_type, "
                             f"{_text(b)} as new_type" for c, s, a, b in _SCHEMA]))
def _(spark, sf):
    return drift.schema_diff(table(spark, sf, "orders"), view(spark, sf, "fx_new"))


@query("row_delta", with_views("fx_new") + f"""
    select o as rows_old, n as rows_new, n - o as delta,
           {rnd('(n - o) * 1.0::double / greatest(o, 1) * 100', 1)} as delta_pct
    from (select (select count(*) from orders) as o, (select count(*) from fx_new) as n)""")
def _(spark, sf):
    return drift.row_delta(table(spark, sf, "orders"), view(spark, sf, "fx_new"))


_COMMON = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("missing_delta", with_views("fx_new") + f"""
    select "column", {rnd('o', 2)} as old_pct, {rnd('n', 2)} as new_pct, {rnd('n - o', 2)} as delta,
           case when n > o then 'Increased' else 'Decreased' end as direction from (""" + union([
    f"select '{c}' as \"column\", (select (count(*) - count({c})) * 100.0::double / count(*) from orders) as o, "
    f"(select (count(*) - count({c})) * 100.0::double / count(*) from fx_new) as n" for c in _COMMON])
    + ") where abs(n - o) > 1")
def _(spark, sf):
    return drift.missing_delta(table(spark, sf, "orders"), view(spark, sf, "fx_new"))


@query("duplicate_delta", with_views("fx_dups") + """
    select (select count(*) from (select l_returnflag, l_linestatus from lineitem))
           - (select count(*) from (select distinct l_returnflag, l_linestatus from lineitem)) as duplicates_old,
           (select count(*) from fx_dups) - (select count(*) from (select distinct * from fx_dups)) as duplicates_new""")
def _(spark, sf):
    return drift.duplicate_delta(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"),
                                 view(spark, sf, "fx_dups"))


_BOTH = """both_v as (select o_orderkey, o_custkey, o_totalprice, false as is_new from orders
    union all select o_orderkey, o_custkey, o_totalprice, true as is_new from fx_new)"""
_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]
_SHIFTS = with_views("fx_new", extra=[_BOTH, ks_ctes("both_v", _NUMERIC, "is_new")])
_SHIFT = f"""select feature as "column", {rnd('ks', 4)} as ks_stat, {rnd(ks_p(), 4)} as p_value,
    {ks_p()} < 0.05 as shifted, {rnd('m1', 4)} as mean_old, {rnd('m2', 4)} as mean_new,
    {shift('m1', 'm2')} as mean_shift, {severity()} as severity from cmp"""


@query("distribution_shift", _SHIFTS + _SHIFT + " where n1 >= 5 and n2 >= 5")
def _(spark, sf):
    return drift.distribution_shift(table(spark, sf, "orders"), view(spark, sf, "fx_new"))


@query("target_shift", _SHIFTS + f"select * exclude (mean_shift) from ({_SHIFT}) where \"column\" = 'o_totalprice'")
def _(spark, sf):
    return drift.target_shift(table(spark, sf, "orders"), view(spark, sf, "fx_new"), "o_totalprice")


@query("comparison_verdict", _SHIFTS + f"""
    select true as schema_changed, n_shifted, n_shifted > 0.9 as features_shifted, target_shifted,
           cast(1 + (n_shifted > 0.9)::int + target_shifted::int as int) as n_issues,
           case when 1 + (n_shifted > 0.9)::int + target_shifted::int = 1 then 'MEDIUM' else 'HIGH' end as risk
    from (select count(*) filter (where shifted) as n_shifted,
                 coalesce(bool_or(shifted) filter (where "column" = 'o_totalprice'), false) as target_shifted
          from ({_SHIFT}))""")
def _(spark, sf):
    return drift.comparison_verdict(table(spark, sf, "orders"), view(spark, sf, "fx_new"), "o_totalprice")
