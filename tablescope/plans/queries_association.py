"""Checked queries: correlation, redundancy, leakage, mutual information, gaps, types, size."""

from tablescope.functions.stats import correlation_label, vif_label
from tablescope.operators import adequacy, association, inference, missingness
from tablescope.plans.fixtures import view
from tablescope.plans.oracle import LINEITEM, corr, d, per_column, rnd, union, with_views
from tablescope.plans.queries import query, table
from tablescope.plans.queries_profile import NULLS

from pyspark.sql import functions as F

LEAK = ["l_orderkey", "l_quantity", "l_discount", "l_tax", "l_revenue", "l_price_copy", "l_mix", "l_big"]
LEAK_ALL = ["l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_revenue",
            "l_price_copy", "l_mix", "l_big"]
_LISTWISE = "fx_lw as (select * from fx_nulls where l_quantity is not null and l_discount is not null)"
_NULLS_CORR = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
               "l_extendedprice", "const_col"]


@query("correlation_matrix", with_views("fx_nulls", extra=[_LISTWISE]) + union([
    f"select '{a}' as feature_1, '{b}' as feature_2, {rnd(corr(a, b), 4)} as corr from fx_lw"
    for a in _NULLS_CORR for b in _NULLS_CORR]))
def _(spark, sf):
    return association.correlation_matrix(view(spark, sf, "fx_nulls"), "l_tax")


def _pairs(source: str, names, value: str) -> str:
    return union([f"select {i} as i, {j} as j, '{names[i]}' as feature_1, '{names[j]}' as feature_2, "
                  f"{value.format(corr(names[i], names[j]))} as correlation from {source}"
                  for i in range(len(names)) for j in range(i + 1, len(names))])


_RED = _pairs("fx_leak", LEAK_ALL, "abs(round({0}, 4))")
_LEVEL = "case when correlation >= 0.95 then 'HIGH' else 'MODERATE' end"


@query("redundant_pairs", with_views("fx_leak") + f"""
    select feature_1, feature_2, correlation, {_LEVEL} as severity from ({_RED})
    where correlation >= 0.85 order by correlation desc, i, j limit 20""")
def _(spark, sf):
    return association.redundant_pairs(view(spark, sf, "fx_leak"))


@query("drop_suggestions", with_views("fx_leak") +
       f"select distinct feature_2 as feature from ({_RED}) where correlation >= 0.95")
def _(spark, sf):
    return association.drop_suggestions(view(spark, sf, "fx_leak"))


@query("corr_pairs_gt", with_views("fx_leak") + f"""
    select feature_2 as feature_1, feature_1 as feature_2, {rnd('abs(correlation)', 4)} as abs_corr
    from ({_pairs('fx_leak', LEAK_ALL, '{0}')}) where abs(correlation) > 0.9""")
def _(spark, sf):
    return association.corr_pairs_gt(view(spark, sf, "fx_leak"))


def _vif3(j: int, names) -> str:
    """Closed form of 1 - R^2 for one of three features."""
    a, b = [n for k, n in enumerate(names) if k != j]
    y = names[j]
    return f"""select '{y}' as feature, 1 / (1 - (ra * ra + rb * rb - 2 * ra * rb * rab) / (1 - rab * rab)
        + 0.00000001::double) as vif
        from (select {corr(y, a)} as ra, {corr(y, b)} as rb, {corr(a, b)} as rab from fx_leak)"""


_VIF = ["l_quantity", "l_discount", "l_revenue"]


@query("vif", with_views("fx_leak") + f"""
    select feature, {rnd('vif', 2)} as vif, case when round(vif, 2) > 10 then 'HIGH'
           when round(vif, 2) > 5 then 'MODERATE' else 'OK' end as level
    from ({union([_vif3(j, ['l_quantity', 'l_mix', 'l_discount']) for j in range(3)])})""")
def _(spark, sf):
    return association.vif(view(spark, sf, "fx_leak").select("l_quantity", "l_mix", "l_discount"))


@query("vif_all_features")
def _(spark, sf):
    return association.vif(table(spark, sf, "lineitem"), "l_extendedprice")


@query("redundancy_summary", with_views("fx_leak") + f"""
    select (select count(*) from ({_pairs('fx_leak', _VIF, 'abs(round({0}, 4))')})
            where correlation >= 0.85) as n_pairs,
           (select count(distinct feature_2) from ({_pairs('fx_leak', _VIF, 'abs(round({0}, 4))')})
            where correlation >= 0.95) as n_drop,
           (select count(*) from ({union([_vif3(j, _VIF) for j in range(3)])}) where round(vif, 2) > 5)
               as n_vif_above_5""")
def _(spark, sf):
    return association.redundancy_summary(view(spark, sf, "fx_leak").select(_VIF))


_LEAKS = per_column("fx_leak", LEAK, lambda c: f"abs({corr(c, 'l_extendedprice')}) as c")
_LEAK_LEVEL = "case when c > 0.95 then 'candidate' when c > 0.85 then 'warning' else 'ok' end"
_LEAK_LABEL = "case when round(c, 4) > 0.95 then 'HIGH RISK' when round(c, 4) > 0.85 then 'WATCH' else 'OK' end"


@query("leakage_by_correlation", with_views("fx_leak") + f"""
    select feature, {rnd('c', 4)} as abs_corr, {_LEAK_LEVEL} as level, {_LEAK_LABEL} as label
    from ({_LEAKS}) where c is not null""")
def _(spark, sf):
    return association.leakage_by_correlation(view(spark, sf, "fx_leak"), "l_extendedprice")


@query("leakage_candidates", with_views("fx_leak") +
       f"select feature, {rnd('c', 4)} as abs_corr from ({_LEAKS}) where c > 0.95")
def _(spark, sf):
    return association.leakage_candidates(view(spark, sf, "fx_leak"), "l_extendedprice")


@query("threshold_labels", with_views("fx_leak") + f"""
    select feature, case when c > 10 then 'HIGH' when c > 5 then 'MODERATE' else 'OK' end as vif_label,
           case when c > 0.95 then 'HIGH RISK' when c > 0.85 then 'WATCH' else 'OK' end as corr_label
    from ({per_column('fx_leak', LEAK, lambda c: f"max({d(c)}) / 10000 as c")})""")
def _(spark, sf):
    from tablescope.functions.schema import num
    from tablescope.functions.wide import per_column as rows
    top = rows(view(spark, sf, "fx_leak"), LEAK, lambda c: {"c": F.max(num(c)) / 10000})
    return top.select("feature", vif_label(F.col("c")).alias("vif_label"),
                      correlation_label(F.col("c")).alias("corr_label"))


def _mi_ctes(source: str, names, target: str) -> str:
    """CTEs ending in `mi(feature, mi, top)` over ten equal-frequency bins."""
    med = ", ".join(f"median({d(c)}) as m{i}" for i, c in enumerate(names))
    filled = ", ".join(f"coalesce({d(c)}, m{i}) as x{i}" for i, c in enumerate(names))
    cuts = "[" + ", ".join(f"0.{k}" for k in range(1, 10)) + "]"
    edges = ", ".join(f"list_distinct(quantile_cont(x{i}, {cuts})) as e{i}" for i in range(len(names)))

    def bin_of(x: str, e: str) -> str:
        return f"len(list_filter({e}, lambda q: q < {x}))"
    cells = union([f"select '{c}' as feature, {bin_of(f'x{i}', f'e{i}')} as x, {bin_of('y', 'ey')} as y, count(*) as c "
                   "from filled, edges group by all" for i, c in enumerate(names)])
    return f"""
med as (select {med} from {source}),
filled as (select {filled}, {d(target)} as y from {source}, med where {target} is not null),
edges as (select {edges}, list_distinct(quantile_cont(y, {cuts})) as ey from filled),
cells as ({cells}),
joint as (select feature, c * 1.0::double as c, sum(c) over (partition by feature) * 1.0::double as n,
                 sum(c) over (partition by feature, x) * 1.0::double as cx,
                 sum(c) over (partition by feature, y) * 1.0::double as cy from cells),
mi0 as (select feature, greatest(sum(c / n * ln(c * n / (cx * cy))), 0.0) as mi from joint group by feature),
mi as (select feature, mi, max(mi) over () as top from mi0)"""


_MI = ["l_quantity", "l_discount", "l_tax", "l_revenue", "l_big"]
_MI_VIEW = with_views("fx_leak", extra=[_mi_ctes("fx_leak", _MI, "l_extendedprice")])


@query("mutual_information", _MI_VIEW + f"""
    select feature, {rnd('mi', 5)} as mi, {rnd('mi / (top + 0.00000001::double)', 4)} as mi_norm from mi""")
def _(spark, sf):
    return association.mutual_information(
        view(spark, sf, "fx_leak").select("l_extendedprice", *_MI), "l_extendedprice")


_NULL_MI = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query("mutual_information_with_gaps",
       with_views("fx_nulls", extra=[_mi_ctes("fx_nulls", _NULL_MI, "l_extendedprice")]) + f"""
    select feature, {rnd('mi', 5)} as mi, {rnd('mi / (top + 0.00000001::double)', 4)} as mi_norm from mi""")
def _(spark, sf):
    return association.mutual_information(
        view(spark, sf, "fx_nulls").select("l_extendedprice", *_NULL_MI), "l_extendedprice")


_PROB = _MI_VIEW + f""", cor as ({per_column('fx_leak', _MI, lambda c: f"coalesce(abs({corr(c, 'l_extendedprice')}), 0.0) as c")}),
prob as (select mi.feature, mi, mi / (top + 0.00000001::double) as mi_norm, c,
                {rnd('0.5 * (mi / (top + 0.00000001::double)) + 0.5 * c', 4)} as leak_prob
         from mi join cor on mi.feature = cor.feature),
risk as (select *, case when leak_prob > 0.85 then 'CRITICAL' when leak_prob > 0.7 then 'HIGH'
                when leak_prob > 0.5 then 'MODERATE' when leak_prob > 0.3 then 'LOW' else 'SAFE' end as level
         from prob)
"""


@query("leakage_probability", _PROB + f"""
    select feature, {rnd('mi', 5)} as mi_score, {rnd('mi_norm', 4)} as mi_normalized,
           {rnd('c', 4)} as correlation, leak_prob as leakage_prob, level as risk_level from risk""")
def _(spark, sf):
    return association.leakage_probability(
        view(spark, sf, "fx_leak").select("l_extendedprice", *_MI), "l_extendedprice")


@query("leakage_summary", _PROB + """
    select count(*) filter (where level = 'CRITICAL') as n_critical,
           count(*) filter (where level = 'HIGH') as n_high,
           coalesce(string_agg(feature, ',' order by feature) filter (where level = 'CRITICAL'), '')
               as critical_features,
           coalesce(string_agg(feature, ',' order by feature) filter (where level = 'HIGH'), '')
               as high_features,
           case when count(*) filter (where level = 'CRITICAL') > 0 then 'CRITICAL'
                when count(*) filter (where level = 'HIGH') > 0 then 'HIGH RISK' else 'SAFE' end as verdict
    from risk""")
def _(spark, sf):
    return association.leakage_summary(
        view(spark, sf, "fx_leak").select("l_extendedprice", *_MI), "l_extendedprice")


@query("mutual_information_knn_sample")
def _(spark, sf):
    return association.mutual_information_knn(table(spark, sf, "events").select("event_id", "user_id", "value"),
                                              "value", "event_id")


# --- missing values --------------------------------------------------------------------------

@query("missing_severity", with_views("fx_nulls") + f"""
    select "column", n_missing, pct, case when pct > 30 then 'Critical' when pct > 10 then 'Moderate'
           else 'Minor' end as severity
    from (select "column", n_missing, {rnd('n_missing * 1.0::double / n * 100', 2)} as pct from (""" + union(
        [f"select '{c}' as \"column\", count(*) - count({c}) as n_missing, count(*) as n from fx_nulls"
         for c in NULLS]) + ") where n_missing > 0)")
def _(spark, sf):
    return missingness.missing_severity(view(spark, sf, "fx_nulls"))


def _signals_sql(source: str, gaps, numeric) -> str:
    rows = [f"select {i} as o, '{g}' as \"column\", '{c}' as related_to, "
            f"{corr(f'(case when {g} is null then 1.0 else 0.0 end)', c)} as c from {source}"
            for g in gaps for i, c in enumerate([x for x in numeric if x != g])]
    return f"""select "column", related_to, {rnd('abs(c)', 2)} as corr from (
        select *, row_number() over (partition by "column" order by o) as r
        from ({union(rows)}) where abs(c) > 0.2) where r = 1"""


MAR = _signals_sql("fx_mar", ["v_mar"], ["event_id", "user_id", "value", "v_mar"])
_NULL_SIGNALS = _signals_sql("fx_nulls", ["l_quantity", "l_discount", "l_returnflag", "all_null"],
                             [c for c in NULLS if c != "l_returnflag"])


@query("mar_signals", with_views("fx_mar") + MAR)
def _(spark, sf):
    return missingness.mar_signals(view(spark, sf, "fx_mar"))


@query("mar_signals_many_columns", with_views("fx_nulls") + _NULL_SIGNALS)
def _(spark, sf):
    return missingness.mar_signals(view(spark, sf, "fx_nulls"))


def pattern_sql(source: str, names, signals: str) -> str:
    n = " + ".join(f"(count(*) - count({c}))" for c in names)
    inc = " + ".join(f"(case when count({c}) < count(*) then 1 else 0 end)" for c in names)
    return f"""select case when inc = 0 then 'NONE' when sig > 0 then 'MAR' when pct < 5 then 'MCAR'
        else 'MNAR' end as pattern, cast(inc as bigint) as n_incomplete, sig as n_signals,
        {rnd('pct', 2)} as total_missing_pct
        from (select {inc} as inc, ({n}) * 1.0::double / (count(*) * {len(names)}) * 100 as pct,
              (select count(*) from ({signals})) as sig from {source})"""


@query("missing_pattern", with_views("fx_mar") + pattern_sql(
    "fx_mar", ["event_id", "user_id", "value", "v_mar"], MAR))
def _(spark, sf):
    return missingness.missing_pattern(view(spark, sf, "fx_mar"))


@query("missing_pattern_unexplained", with_views("fx_nulls") + pattern_sql("fx_nulls", NULLS, _NULL_SIGNALS))
def _(spark, sf):
    return missingness.missing_pattern(view(spark, sf, "fx_nulls"))


# --- types and time --------------------------------------------------------------------------

_FORMATS = ("['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%m/%d/%Y', "
            "'%Y/%m/%d', '%d-%b-%Y', '%b %-d, %Y']")


def _type_row(source: str, i: int, c: str, dtype: str) -> str:
    if dtype == "string":
        verdict = f"""case when bool_and(try_strptime({c}, {_FORMATS}) is not null) filter (where {c} is not null)
            then 'date' when avg(case when {c} like '%@%' then 1.0 when {c} is not null then 0.0 end) > 0.5 then 'email'
            when avg(case when {c} like 'http%' then 1.0 when {c} is not null then 0.0 end) > 0.5 then 'url'
            when avg(case when regexp_matches({c}, '^[0-9]{{5}}$') then 1.0 when {c} is not null then 0.0 end) > 0.5
            then 'zip' else 'none' end"""
    elif dtype == "timestamp_ntz":
        verdict = "'none'"
    else:
        named = c in ("id", "index", "row_id", "uid", "uuid", "customer_id", "user_id", "order_id")
        rsi = c.upper().endswith("RSI")
        verdict = f"""case when bool_and({c} in (0, 1)) and count(distinct {c}) = 2 then 'binary'
            when {str(named).lower()} and count(distinct {c}) = count({c}) then 'id'
            when min({c}) >= 0 and max({c}) <= 1 and count(distinct {c}) > 10 then 'share'
            when avg({c}) > 1000 and skewness({d(c)}) > 1 then 'money'
            when {str(rsi).lower()} and (min({c}) < 0 or max({c}) > 100) then 'rsi' else 'none' end"""
    return f"select {i} as ordinal, '{c}' as \"column\", '{dtype}' as dtype, {verdict} as v from {source} having count({c}) > 0"


_MEANING = """(values
    ('binary', 'Binary Flag (0/1)', 'Categorical stored as numeric', 'Treat as categorical', false),
    ('id', 'ID Column', 'Should be dropped', 'Drop: unique per row', true),
    ('share', 'Percentage (0-1)', 'Numeric: OK', 'Multiply by 100 for readability', false),
    ('money', 'Possible Currency / Revenue', 'Consider log transform', 'Apply log1p', false),
    ('rsi', 'RSI: Corrupted Range', 'Data quality issue', 'Check data source', true),
    ('date', 'Date / Datetime', 'Parse as datetime', 'Extract date parts', false),
    ('email', 'Email Address', 'Drop or extract domain', 'Extract domain or drop', true),
    ('url', 'URL', 'Drop', 'Drop this column', true),
    ('zip', 'ZIP Code', 'Treat as categorical', 'Group into regions', false),
    ('none', null, 'OK', 'No action needed', false)) as m(v, inferred, flag, recommendation, warning)"""


def _types_sql(source: str, columns: dict[str, str]) -> str:
    rows = union([_type_row(source, i, c, t) for i, (c, t) in enumerate(columns.items())])
    return f"""select ordinal, "column", dtype, coalesce(inferred, dtype) as inferred, flag, recommendation, warning
        from ({rows}) r join {_MEANING} on r.v = m.v"""


_TYPES = {"customer_id": "bigint", "email": "string", "url": "string", "zip": "string", "flag01": "int",
          "x_rsi": "double", "pct01": "double", "c_mktsegment": "string"}


@query("infer_types", with_views("fx_types") + _types_sql("fx_types", _TYPES))
def _(spark, sf):
    return inference.infer_types(view(spark, sf, "fx_types"))


@query("infer_types_dates", with_views("fx_dates") + _types_sql(
    "fx_dates", {"o_orderkey": "bigint", "order_day": "string", "o_totalprice": "double"}))
def _(spark, sf):
    return inference.infer_types(view(spark, sf, "fx_dates"))


@query("infer_types_nulls", with_views("fx_nulls") + _types_sql("fx_nulls", {
    "l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "l_suppkey": "bigint",
    "l_quantity": "double", "l_discount": "double", "l_extendedprice": "double", "l_tax": "double",
    "l_returnflag": "string", "all_null": "double", "const_col": "int"}))
def _(spark, sf):
    return inference.infer_types(view(spark, sf, "fx_nulls"))


@query("infer_types_pages", _types_sql("pages", {"page_id": "bigint", "url": "string", "html": "string"}))
def _(spark, sf):
    return inference.infer_types(table(spark, sf, "pages"))


@query("type_warnings", with_views("fx_types") + f"""
    select "column", inferred from ({_types_sql('fx_types', _TYPES)}) where warning""")
def _(spark, sf):
    return inference.type_warnings(view(spark, sf, "fx_types"))


def _gaps_sql(source: str, ts: str) -> str:
    return f"""select floor(median(g) / 86400000000) as days from (
        select epoch_us({ts}) - lag(epoch_us({ts})) over (order by {ts}) as g from {source}
        where {ts} is not null) where g is not null"""


_FREQ = """case when days = 1 then 'Daily' when days = 7 then 'Weekly' when days between 28 and 31 then 'Monthly'
    when days = 0 then 'Sub-daily' else concat('~', cast(cast(days as bigint) as varchar), '-day intervals') end"""


@query("detect_timeseries", with_views("fx_dates") + f"""
    select true as is_timeseries, 'order_day' as datetime_column, {_FREQ} as frequency_guess
    from ({_gaps_sql('fx_dates', 'cast(order_day as timestamp)')})""")
def _(spark, sf):
    return inference.detect_timeseries(view(spark, sf, "fx_dates"))


@query("detect_timeseries_typed", f"""
    select true as is_timeseries, 'ts' as datetime_column, {_FREQ} as frequency_guess
    from ({_gaps_sql('events', 'ts')})""")
def _(spark, sf):
    return inference.detect_timeseries(table(spark, sf, "events"))


@query("frequency_guess", f"""
    select 'd' as datetime_column, cast(days as bigint) as median_days, {_FREQ} as frequency_guess
    from ({_gaps_sql('(select distinct cast(o_orderdate as timestamp) as d from orders)', 'd')})""")
def _(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").alias("d")).distinct()
    return inference.frequency_guess(days, "d")


# --- sample size -----------------------------------------------------------------------------

def _size_sql(source: str, target: str, columns: int, classes: bool) -> str:
    need = (columns - 1) * 10
    rows = [f"select 'rows per feature' as rule, cast({need} as bigint) as needed, count(*) as have, "
            f"count(*) >= {need} as pass from {source}",
            "select 'absolute minimum' as rule, cast(100 as bigint) as needed, count(*) as have, "
            f"count(*) >= 100 as pass from {source}"]
    if classes:
        rows.append(f"""select 'rows per class' as rule, cast(50 as bigint) as needed, min(n) as have,
            min(n) >= 50 as pass from (select count(*) as n from {source} where {target} is not null
            group by {target})""")
    return union(rows)


def _adequate_sql(source: str, target: str, columns: int, classes: bool) -> str:
    need = (columns - 1) * 10
    return f"""select n as n_rows, {columns - 1} as n_features, bad as n_issues, bad = 0 as adequate,
        {rnd(f'least(1.0::double, n * 1.0::double / greatest({need}, 1))', 4)} as ratio,
        case when n < 500 then 'High' when n < 2000 then 'Moderate' else 'Low' end as projected_gain
        from (select count(*) as n from {source}),
             (select count(*) filter (where not pass) as bad from ({_size_sql(source, target, columns, classes)}))"""


@query("sample_size_checks", with_views("fx_imb") + _size_sql("fx_imb", "toxic", 4, True))
def _(spark, sf):
    return adequacy.sample_size_checks(view(spark, sf, "fx_imb"), "toxic")


@query("sample_size_checks_regression", _size_sql("lineitem", "l_extendedprice", 11, False))
def _(spark, sf):
    return adequacy.sample_size_checks(table(spark, sf, "lineitem"), "l_extendedprice")


@query("sample_adequacy", with_views("fx_imb") + _adequate_sql("fx_imb", "quality", 4, True))
def _(spark, sf):
    return adequacy.sample_adequacy(view(spark, sf, "fx_imb"), "quality")
