"""Checked queries: input, profile, distribution, charts."""

from pyspark.sql import functions as F

from tablescope.functions.schema import resolve_target, split_columns
from tablescope.operators import charts, distribution, profile
from tablescope.operators.quantiles import quantiles
from tablescope.plans.fixtures import view
from tablescope.plans.oracle import (LINEITEM, corr, d, jb_p, moments, per_column, rnd, union, with_views)
from tablescope.plans.queries import query, table
from tablescope.sources import sampling, tables

ALL_LINEITEM = [*LINEITEM, "l_returnflag", "l_linestatus", "l_shipdate"]
NULLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
         "l_extendedprice", "l_tax", "l_returnflag", "all_null", "const_col"]
NULLS_NUMERIC = [c for c in NULLS if c != "l_returnflag"]
_TYPES = {**{c: "double" for c in LINEITEM}, "l_orderkey": "bigint", "l_partkey": "bigint",
          "l_suppkey": "bigint", "l_linenumber": "int", "l_returnflag": "string",
          "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


# --- input and output ------------------------------------------------------------------------

@query("read_table", "select * from orders")
def _(spark, sf):
    return tables.read_table(spark, f"{sf}/orders.parquet")


@query("csv_round_trip", "select * from orders")
def _(spark, sf):
    source = table(spark, sf, "orders")
    path = tables.write_cleaned(source, tables.shared_path(spark, "csv"))
    return tables.read_table(spark, path, "csv", schema=", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema))


_ODD_PRICE = "case when o_orderkey % 10 = 0 then 'n/a' else cast(o_totalprice as {}) end"


def _orders_with_bad_records(spark, sf):
    """Orders as CSV, of which each tenth has a text for a price."""
    odd = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.expr(_ODD_PRICE.format("string")).alias("o_totalprice"))
    path = tables.write_cleaned(odd, tables.shared_path(spark, "odd-csv"))
    return tables.read_checked(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("bad_records", """
    select count(*) as n_rows, count(*) filter (where o_orderkey % 10 = 0) as bad_rows,
           min(case when o_orderkey % 10 = 0 then concat(o_orderkey, ',', o_orderstatus, ',n/a') end) as sample,
           true as reported from orders""")
def _(spark, sf):
    _, status = _orders_with_bad_records(spark, sf)
    return status.agg(F.sum("rows").alias("n_rows"), F.sum("bad_rows").alias("bad_rows"), F.min("sample").alias("sample"),
                      (F.count_if(F.col("status") == "bad records") > 0).alias("reported"))


@query("good_records", "select o_orderkey, o_orderstatus, cast(o_totalprice as double) as o_totalprice from orders where o_orderkey % 10 <> 0")
def _(spark, sf):
    return _orders_with_bad_records(spark, sf)[0]


@query("ingest_check", "select count(*) >= 10 as enough_rows, true as enough_columns from lineitem")
def _(spark, sf):
    return tables.ingest_check(tables.ingest_guard(table(spark, sf, "lineitem")))


@query("deterministic_sample", """
    select event_id, user_id, event_type, value from events
    order by md5(concat(cast(event_id as varchar), '|42')), event_id limit 1000""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return sampling.deterministic_sample(events, 1000, "event_id")


@query("preview", "select * from orders order by o_orderkey limit 8")
def _(spark, sf):
    return tables.preview(table(spark, sf, "orders"), ["o_orderkey"])


@query("load_labelled", with_views("fx_imb") + "select doc_id, n_chars, toxic, quality as target from fx_imb")
def _(spark, sf):
    return tables.load_labelled(view(spark, sf, "fx_imb"), "quality")


@query("split_columns", union([
    f"select {i} as ordinal, '{c}' as \"column\", '{_TYPES[c]}' as dtype, "
    f"'{'target' if c == 'l_extendedprice' else 'numeric' if c in LINEITEM else 'categorical'}' as kind"
    for i, c in enumerate(ALL_LINEITEM)]))
def _(spark, sf):
    return split_columns(table(spark, sf, "lineitem"), "l_extendedprice")


@query("resolve_target", "select o_orderpriority as target, count(*) as n from orders group by 1")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.col(resolve_target(orders)).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("listwise_rows", with_views("fx_nulls") + """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_extendedprice
    from fx_nulls where l_quantity is not null and l_discount is not null""")
def _(spark, sf):
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
             "l_extendedprice"]
    return view(spark, sf, "fx_nulls").dropna(subset=["l_quantity", "l_discount"]).select(names)


# --- profile ---------------------------------------------------------------------------------

@query("shape", """
    select count(*) as rows, 11 as columns, 7 as numeric_features, 3 as categorical_features from lineitem""")
def _(spark, sf):
    return profile.shape(table(spark, sf, "lineitem"), "l_extendedprice")


@query("missing_by_column", with_views("fx_nulls") + "select * from (" + union(
    [f"select '{c}' as \"column\", count(*) - count({c}) as n_missing from fx_nulls" for c in NULLS])
    + ") where n_missing > 0")
def _(spark, sf):
    return profile.missing_by_column(view(spark, sf, "fx_nulls"))


_MISSING = " + ".join(f"(count(*) - count({c}))" for c in NULLS)


@query("missing_total", with_views("fx_nulls") + f"""
    select cast({_MISSING} as bigint) as missing_total,
           {rnd(f"({_MISSING}) * 1.0::double / (count(*) * {len(NULLS)}) * 100", 2)} as missing_pct
    from fx_nulls""")
def _(spark, sf):
    return profile.missing_total(view(spark, sf, "fx_nulls"))


@query("duplicate_rows", with_views("fx_dups") + """
    select (select count(*) from fx_dups) - (select count(*) from (select distinct * from fx_dups))
           as duplicate_rows""")
def _(spark, sf):
    return profile.duplicate_rows(view(spark, sf, "fx_dups"))


@query("duplicate_rows_documents", """
    select cast(coalesce(sum(n - 1), 0) as bigint) as duplicate_rows
    from (select count(*) as n from documents group by text, lang, source, n_chars)""")
def _(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents").drop("doc_id"))


@query("distinct_count", union([f"select '{c}' as feature, count(distinct {c}) as n_distinct from lineitem"
                                for c in ALL_LINEITEM]))
def _(spark, sf):
    return profile.distinct_count(table(spark, sf, "lineitem"))


@query("constant_features", with_views("fx_nulls") + "select feature from (" + union(
    [f"select '{c}' as feature, count(distinct {c}) as n from fx_nulls" for c in NULLS]) + ") where n <= 1")
def _(spark, sf):
    return profile.constant_features(view(spark, sf, "fx_nulls"), "l_extendedprice")


@query("high_cardinality", "select feature from (" + union(
    [f"select '{c}' as feature, count(distinct {c}) as n from customer" for c in ("c_name", "c_mktsegment")])
    + ") where n > 50")
def _(spark, sf):
    return profile.high_cardinality(table(spark, sf, "customer"), "c_acctbal")


def _iqr_sql(source: str, names) -> str:
    return "select feature, q1, q3, lower, upper, n_outliers from (" + union([f"""
        select '{c}' as feature, {rnd('q1', 4)} as q1, {rnd('q3', 4)} as q3,
               {rnd('q1 - 1.5 * (q3 - q1)', 4)} as lower, {rnd('q3 + 1.5 * (q3 - q1)', 4)} as upper,
               (select count(*) from {source} where {c} < q1 - 1.5 * (q3 - q1)
                or {c} > q3 + 1.5 * (q3 - q1)) as n_outliers
        from (select quantile_cont({d(c)}, 0.25) as q1, quantile_cont({d(c)}, 0.75) as q3 from {source})"""
                                                                                    for c in names]) + ") where n_outliers > 0"


@query("iqr_outliers", _iqr_sql("documents", ["doc_id", "n_chars"]))
def _(spark, sf):
    return profile.iqr_outliers(table(spark, sf, "documents"))


@query("iqr_outliers_events", _iqr_sql("events", ["event_id", "user_id", "value"]))
def _(spark, sf):
    return profile.iqr_outliers(table(spark, sf, "events"))


@query("target_correlations", with_views("fx_leak") + "select feature, correlation from (" + per_column(
    "fx_leak", ["l_orderkey", "l_quantity", "l_discount", "l_tax", "l_revenue", "l_price_copy", "l_mix", "l_big"],
    lambda c: f"{rnd(corr(c, 'l_extendedprice'), 4)} as correlation")
    + ") where correlation is not null order by abs(correlation) desc, ordinal limit 5")
def _(spark, sf):
    return profile.target_correlations(view(spark, sf, "fx_leak"), "l_extendedprice", k=5)


def _task_sql(source: str, c: str, text: bool) -> str:
    kind = ("case when " + ("true" if text else "false") + " or n_unique <= 2 or (n_unique <= 20 and "
            "n_unique * 1.0::double / greatest(n_rows, 1) < 0.05) then 'classification' else 'regression' end")
    why = ("case when " + ("true" if text else "false") + " then 'text' when n_unique <= 2 then 'binary' "
           "when n_unique <= 20 and n_unique * 1.0::double / greatest(n_rows, 1) < 0.05 "
           "then 'low cardinality' else 'continuous' end")
    lo, hi = ("null::double", "null::double") if text else (f"min({d(c)})", f"max({d(c)})")
    return f"""select '{c}' as target, n_unique, n_rows,
        {rnd('n_unique * 1.0::double / greatest(n_rows, 1)', 6)} as unique_ratio, target_min, target_max,
        {kind} as task_type, {why} as reason
        from (select count(distinct {c}) as n_unique, count(*) as n_rows, {lo} as target_min,
              {hi} as target_max from {source})"""


@query("task_type", union([_task_sql("lineitem", c, t) for c, t in
                           (("l_extendedprice", False), ("l_linenumber", False), ("l_returnflag", True))]))
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return (profile.task_type(li, "l_extendedprice").unionByName(profile.task_type(li, "l_linenumber"))
            .unionByName(profile.task_type(li, "l_returnflag")))


_CLASSES = """select cast(l_returnflag as varchar) as class, count(*) as n,
    round(count(*) * 1.0::double / (select count(l_returnflag) from fx_nulls), 4) + 0.0 as share
    from fx_nulls where l_returnflag is not null group by 1"""


@query("class_distribution", with_views("fx_nulls") + _CLASSES)
def _(spark, sf):
    return profile.class_distribution(view(spark, sf, "fx_nulls"), "l_returnflag")


@query("imbalance_ratio", with_views("fx_imb") + f"""
    select count(*) as n_classes, min(n) as min_class, max(n) as max_class,
           case when count(*) >= 2 then {rnd('max(n) * 1.0::double / min(n)', 2)} end as imbalance_ratio,
           count(*) = 2 and min(n) * 1.0::double / max(n) < 0.5 as imbalanced
    from (select quality, count(*) as n from fx_imb where quality is not null group by 1)""")
def _(spark, sf):
    return profile.imbalance_ratio(view(spark, sf, "fx_imb"), "quality")


@query("describe", with_views("fx_nulls") + union([f"""
    select '{c}' as feature, '{ {'l_orderkey': 'bigint', 'l_quantity': 'double', 'l_discount': 'double',
                                 'l_tax': 'double'}[c] }' as dtype, count({c}) as count,
           {rnd(f'avg({c})', 4)} as mean, {rnd(f'stddev_samp({c})', 4)} as std, {rnd(f'min({d(c)})', 4)} as min,
           {rnd(f'quantile_cont({d(c)}, 0.25)', 4)} as q25, {rnd(f'quantile_cont({d(c)}, 0.5)', 4)} as q50,
           {rnd(f'quantile_cont({d(c)}, 0.75)', 4)} as q75, {rnd(f'max({d(c)})', 4)} as max
    from fx_nulls""" for c in ("l_orderkey", "l_quantity", "l_discount", "l_tax")]))
def _(spark, sf):
    return profile.describe(view(spark, sf, "fx_nulls").select(
        "l_orderkey", "l_quantity", "l_discount", "l_tax"))


_RANGES = per_column("lineitem", [c for c in LINEITEM if c != "l_extendedprice"],
                     lambda c: f"max({d(c)}) - min({d(c)}) as value_range")


@query("feature_ranges", f"select feature, {rnd('value_range', 4)} as value_range from ({_RANGES}) "
       "order by lineitem.value_range desc, ordinal limit 4".replace("lineitem.value_range", "2"))
def _(spark, sf):
    return profile.feature_ranges(table(spark, sf, "lineitem"), "l_extendedprice", k=4)


@query("data_quality_summary", with_views("fx_imb") + """
    select (select count(*) from fx_imb) as num_samples, 3 as num_features,
           cast(0 as bigint) as missing_total,
           (select string_agg(c, ',' order by c) from (select concat(cast(quality as varchar), ':',
               cast(count(*) as varchar)) as c from fx_imb where quality is not null group by quality))
               as class_balance,
           'doc_id,n_chars,toxic' as widest_features""")
def _(spark, sf):
    return profile.data_quality_summary(view(spark, sf, "fx_imb"), "quality")


@query("value_frequency", union([
    f"select '{c}' as feature, cast({c} as varchar) as value, count(*) as n from lineitem group by {c}"
    for c in ("l_returnflag", "l_linestatus", "l_linenumber")]))
def _(spark, sf):
    return profile.value_frequency(table(spark, sf, "lineitem"),
                                   ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("exact_quantiles", union([
    f"select '{c}' as feature, {p} + 0.0::double as p, {rnd(f'quantile_cont({d(c)}, {p})', 6)} as q from lineitem"
    for c in ("l_extendedprice", "l_quantity", "l_partkey") for p in (0.01, 0.25, 0.5, 0.99)]))
def _(spark, sf):
    probs = [0.01, 0.25, 0.5, 0.99]
    # small_rows=0: always the way that large tables take.
    found = quantiles(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_partkey"], probs,
                      small_rows=0)
    rows = [(c, p, q) for c, qs in found.items() for p, q in zip(probs, qs)]
    return spark.createDataFrame(rows, "feature string, p double, q double").withColumn(
        "q", F.round("q", 6) + F.lit(0.0))


def _profile_sql(target: str) -> str:
    rows = []
    for c in ALL_LINEITEM:
        base = f"'{c}' as feature, '{_TYPES[c]}' as dtype, count(*) as n_rows, count(*) - count({c}) as n_missing"
        if c in LINEITEM:
            fence = "null::bigint" if c == target else (
                f"(select count(*) from lineitem, b_{c} where {c} < q1 - 1.5 * (q3 - q1) "
                f"or {c} > q3 + 1.5 * (q3 - q1))")
            v = d(c)
            stats = (f"{rnd(f'avg({v})', 4)} as mean, {rnd(f'stddev_samp({v})', 4)} as std, "
                     f"{rnd(f'min({v})', 4)} as min, {rnd(f'max({v})', 4)} as max, "
                     f"{rnd(f'skewness({v})', 3)} as skewness, {rnd(f'kurtosis({v})', 3)} as kurtosis, "
                     f"{fence} as n_outliers")
        else:
            stats = ", ".join(f"null::double as {s}" for s in
                              ("mean", "std", "min", "max", "skewness", "kurtosis")) + ", null::bigint as n_outliers"
        rows.append(f"select {base}, {stats}, count(distinct {c}) as n_distinct, "
                    f"count(distinct {c}) <= 1 as is_constant from lineitem")
    fences = [f"b_{c} as (select quantile_cont({d(c)}, 0.25) as q1, quantile_cont({d(c)}, 0.75) as q3 "
              "from lineitem)" for c in LINEITEM]
    return "with " + ",\n".join(fences) + "\n" + union(rows)


@query("profile_columns", _profile_sql("l_extendedprice"))
def _(spark, sf):
    return profile.profile_columns(table(spark, sf, "lineitem"), "l_extendedprice")


# --- distribution ----------------------------------------------------------------------------

def _dist_rows(source: str, names) -> str:
    return union([f"select {i} as ordinal, '{c}' as feature, {moments(c)} from {source}"
                  for i, c in enumerate(names)])


def _dist_sql(source: str, names) -> str:
    shape = """case when abs(sk) < 0.5 then 'Normal / Symmetric' when sk > 1.5 then 'Highly Right-Skewed'
        when sk > 0.5 then 'Mildly Right-Skewed' when sk < -1.5 then 'Highly Left-Skewed'
        else 'Mildly Left-Skewed' end"""
    hint = """case when abs(sk) > 1.5 and lo > 0 then 'log1p' when abs(sk) > 0.5 then 'sqrt or Box-Cox'
        else 'none' end"""
    return f"""select ordinal, feature, n, {rnd('mean', 4)} as mean, {rnd('std', 4)} as std, {rnd('lo', 4)} as min,
        {rnd('hi', 4)} as max, {rnd('sk', 3)} as skewness, {rnd('ku', 3)} as kurtosis,
        {rnd(jb_p(), 4)} as p_normal, {jb_p()} > 0.05 as is_normal, {shape} as shape, {hint} as transform
        from ({_dist_rows(source, names)}) where n >= 8"""


_DIST = with_views("fx_nulls") + "select * exclude (ordinal) from (" + _dist_sql(
    "fx_nulls", [c for c in NULLS_NUMERIC if c != "l_extendedprice"]) + ")"
_DIST_DOCS = _dist_sql("documents", ["doc_id", "n_chars"])


@query("distributions", _DIST)
def _(spark, sf):
    return distribution.distributions(view(spark, sf, "fx_nulls"), "l_extendedprice")


@query("distributions_documents", f"select * exclude (ordinal) from ({_DIST_DOCS})")
def _(spark, sf):
    return distribution.distributions(table(spark, sf, "documents"))


@query("normality_jb", f"select feature, p_normal, is_normal from ({_dist_sql('events', ['event_id', 'user_id', 'value'])})")
def _(spark, sf):
    return distribution.distributions(table(spark, sf, "events")).select("feature", "p_normal", "is_normal")


@query("skewed_features", f"select feature, skewness from ({_DIST_DOCS}) where abs(skewness) > 1.0")
def _(spark, sf):
    return distribution.skewed_features(table(spark, sf, "documents"), threshold=1.0)


@query("skewed_positive", f"select feature, skewness from ({_DIST_DOCS}) where abs(skewness) > 1.5 and min > 0")
def _(spark, sf):
    return distribution.skewed_features(table(spark, sf, "documents"), threshold=1.5, positive_only=True, k=5)


@query("distribution_summary", f"""
    select count(*) as features_analysed, count(*) filter (where abs(skewness) > 1) as n_skewed,
           count(*) filter (where not is_normal) as n_not_normal
    from ({_dist_sql('lineitem', [c for c in LINEITEM if c != 'l_tax'])})""")
def _(spark, sf):
    return distribution.distribution_summary(table(spark, sf, "lineitem"), "l_tax")


@query("normality_sample")
def _(spark, sf):
    return distribution.normality_sample(table(spark, sf, "events"), "event_id")


# --- chart data ------------------------------------------------------------------------------

@query("histogram", f"""
    with l as (select min(value) as lo, max(value) as hi from events),
    b as (select cast(least(floor(coalesce((value - lo) / nullif(hi - lo, 0), 0) * 40), 39) as int) as bin, lo, hi
          from events, l where value is not null)
    select bin, {rnd('lo + bin * (hi - lo) / 40', 6)} as bin_from,
           {rnd('lo + (bin + 1) * (hi - lo) / 40', 6)} as bin_to, count(*) as n from b group by bin, lo, hi""")
def _(spark, sf):
    return charts.histogram(table(spark, sf, "events"), "value")


@query("class_share", """
    select o_orderpriority as class, count(*) as n,
           round(count(*) * 1.0::double / (select count(*) from orders), 4) + 0.0 as share
    from orders group by 1""")
def _(spark, sf):
    return profile.class_distribution(table(spark, sf, "orders"), "o_orderpriority")


@query("top_k", f"select feature, skewness from ({_dist_sql('lineitem', LINEITEM)}) "
                "order by abs(skewness) desc, feature limit 3")
def _(spark, sf):
    dist = distribution.distributions(table(spark, sf, "lineitem")).select("feature", "skewness")
    return charts.top_k(dist, 3, "skewness", ("feature",), absolute=True)
