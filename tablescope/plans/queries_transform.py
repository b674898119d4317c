"""Checked queries: feature transforms, splits, baseline models."""

from pyspark.sql import functions as F

from tablescope.operators import features, modeling
from tablescope.plans.fixtures import view
from tablescope.plans.oracle import rnd, union, with_views
from tablescope.plans.queries import query, table
from tablescope.sources import sampling

# --- transforms ------------------------------------------------------------------------------


def _r(c: str, digits: int = 8):
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


@query("log1p_transform", f"select doc_id, n_chars, {rnd('ln(1 + n_chars)', 8)} as n_chars_log from documents")
def _(spark, sf):
    made = features.log1p_transform(table(spark, sf, "documents").select("doc_id", "n_chars"))
    return made.select("doc_id", "n_chars", _r("n_chars_log"))


@query("one_hot", with_views("fx_nulls") + """
    select l_orderkey, l_partkey, l_suppkey, coalesce(l_returnflag = 'N', false) as "l_returnflag_N",
           coalesce(l_returnflag = 'R', false) as "l_returnflag_R" from fx_nulls""")
def _(spark, sf):
    return features.one_hot(view(spark, sf, "fx_nulls").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"), ["l_returnflag"])


@query("target_encode", f"""
    select event_id, user_id, {rnd('avg(value) over (partition by user_id)', 6)} as user_id_encoded from events""")
def _(spark, sf):
    made = features.target_encode(table(spark, sf, "events"), "user_id", "value")
    return made.select("event_id", "user_id", _r("user_id_encoded", 6))


@query("target_encode_gaps", with_views("fx_nulls") + f"""
    select l_orderkey, l_partkey, l_returnflag, case when l_returnflag is not null then
           {rnd('avg(l_extendedprice) over (partition by l_returnflag)', 4)} end as l_returnflag_encoded
    from fx_nulls""")
def _(spark, sf):
    made = features.target_encode(view(spark, sf, "fx_nulls"), "l_returnflag", "l_extendedprice")
    return made.select("l_orderkey", "l_partkey", "l_returnflag", _r("l_returnflag_encoded", 4))


@query("interaction", f"""select l_orderkey, l_partkey, {rnd('l_quantity * l_discount', 8)} as l_quantity_x_l_discount
    from lineitem""")
def _(spark, sf):
    made = features.interaction(table(spark, sf, "lineitem"), "l_quantity", "l_discount")
    return made.select("l_orderkey", "l_partkey", _r("l_quantity_x_l_discount"))


@query("top_interaction", with_views("fx_leak") + """
    select l_orderkey, l_price_copy * l_revenue as l_price_copy_x_l_revenue from fx_leak""")
def _(spark, sf):
    made = features.top_interaction(view(spark, sf, "fx_leak"), "l_extendedprice")
    return made.select("l_orderkey", "l_price_copy_x_l_revenue")


@query("datetime_parts", """
    select o_orderkey, cast(year(o_orderdate) as int) as o_orderdate_year,
           cast(month(o_orderdate) as int) as o_orderdate_month,
           cast(isodow(o_orderdate) - 1 as int) as o_orderdate_dayofweek,
           cast(quarter(o_orderdate) as int) as o_orderdate_quarter from orders""")
def _(spark, sf):
    made = features.datetime_parts(table(spark, sf, "orders"), "o_orderdate")
    return made.select("o_orderkey", *[f"o_orderdate_{p}" for p in ("year", "month", "dayofweek", "quarter")])


@query("datetime_parts_text", with_views("fx_dates") + """
    select o_orderkey, order_day, cast(year(cast(order_day as date)) as int) as order_day_year,
           cast(month(cast(order_day as date)) as int) as order_day_month,
           cast(isodow(cast(order_day as date)) - 1 as int) as order_day_dayofweek,
           cast(quarter(cast(order_day as date)) as int) as order_day_quarter from fx_dates""")
def _(spark, sf):
    return features.datetime_parts(view(spark, sf, "fx_dates").drop("o_totalprice"), "order_day")


@query("quantile_bin", with_views("fx_nulls") + """
    select l_orderkey, l_partkey, l_quantity, case when l_quantity is not null then cast(
        (l_quantity > (select quantile_cont(l_quantity, 0.2) from fx_nulls))::int
        + (l_quantity > (select quantile_cont(l_quantity, 0.4) from fx_nulls))::int
        + (l_quantity > (select quantile_cont(l_quantity, 0.6) from fx_nulls))::int
        + (l_quantity > (select quantile_cont(l_quantity, 0.8) from fx_nulls))::int as int) end as l_quantity_bin
    from fx_nulls""")
def _(spark, sf):
    made = features.quantile_bin(view(spark, sf, "fx_nulls"), "l_quantity")
    return made.select("l_orderkey", "l_partkey", "l_quantity", "l_quantity_bin")


@query("polynomial", f"""
    select l_quantity, l_tax, {rnd('l_quantity * l_quantity', 6)} as l_quantity_x_l_quantity,
           {rnd('l_quantity * l_tax', 6)} as l_quantity_x_l_tax, {rnd('l_tax * l_tax', 6)} as l_tax_x_l_tax
    from lineitem""")
def _(spark, sf):
    made = features.polynomial(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])
    return made.select("l_quantity", "l_tax", *[_r(c, 6) for c in (
        "l_quantity_x_l_quantity", "l_quantity_x_l_tax", "l_tax_x_l_tax")])


_LAGS = ", ".join(f"lag(value, {k}) over (order by event_id) as value_lag_{k}" for k in (1, 3, 7, 14))
_LAGS_USER = ", ".join(f"lag(value, {k}) over (partition by user_id order by event_id) as value_lag_{k}"
                       for k in (1, 3))


@query("lag_features", f"select * from (select event_id, value, {_LAGS} from events) where value_lag_14 is not null")
def _(spark, sf):
    return features.lag_features(table(spark, sf, "events").select("event_id", "value"), "value", ["event_id"])


@query("lag_features_by_user", f"""
    select * from (select event_id, user_id, value, {_LAGS_USER} from events) where value_lag_3 is not null""")
def _(spark, sf):
    return features.lag_features(table(spark, sf, "events").select("event_id", "user_id", "value"), "value",
                                 ["event_id"], ["user_id"], lags=(1, 3))


@query("lag_features_blocks", f"""
    select * from (select event_id, user_id, value, {_LAGS_USER} from events) where value_lag_3 is not null""")
def _(spark, sf):
    # Small blocks: always the way that large tables take.
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    return features.lag_features(events, "value", ["event_id"], ["user_id"], lags=(1, 3),
                                 small_rows=max(10, events.count() // 10))


@query("recommendations", """
    select 1 as phase, 'drop redundant' as action, 'l_price_copy' as columns, '5 min' as effort
    union all select 2, 'interaction', 'l_price_copy,l_revenue', '15 min'
    union all select 2, 'quantile bins', 'l_price_copy', '15 min'
    union all select 3, 'polynomial', 'l_orderkey,l_quantity,l_discount,l_tax,l_revenue', '1 hour'
    union all select 3, 'lag features', 'l_extendedprice', '2 hours'
    union all select 3, 'external data', '', '1-2 days'""")
def _(spark, sf):
    return features.recommendations(view(spark, sf, "fx_leak"), "l_extendedprice")


# --- splits and models -----------------------------------------------------------------------

@query("stratified_split", """
    select event_id, event_type, case when r <= floor(0.2 * n + 0.5) then 'validation' else 'train' end as split
    from (select event_id, event_type, count(*) over (partition by event_type) as n,
                 row_number() over (partition by event_type
                     order by md5(concat(cast(event_id as varchar), '|42')), event_id) as r from events)""")
def _(spark, sf):
    return sampling.stratified_split(table(spark, sf, "events").select("event_id", "event_type"),
                                     "event_type", "event_id")


@query("stratified_split_prefixes", """
    select event_id, event_type, case when r <= floor(0.2 * n + 0.5) then 'validation' else 'train' end as split
    from (select event_id, event_type, count(*) over (partition by event_type) as n,
                 row_number() over (partition by event_type
                     order by md5(concat(cast(event_id as varchar), '|42')), event_id) as r from events)""")
def _(spark, sf):
    # Short digits, so that several passes are needed.
    return sampling.stratified_split(table(spark, sf, "events").select("event_id", "event_type"),
                                     "event_type", "event_id", digit_bits=2)


@query("chronological_split", """
    select o_orderkey, case when row_number() over (order by o_orderdate, o_orderkey)
           <= (select floor(count(*) * 0.8) from orders) then 'train' else 'validation' end as split from orders""")
def _(spark, sf):
    return modeling.chronological_split(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "split")


@query("fit_diagnosis", """
    select l_discount, l_tax, case when 0.9 + l_discount > 0.95 and (0.9 + l_discount) - (0.9 + l_tax) > 0.05
               then 'Overfitting' when 0.9 + l_discount < 0.75 and 0.9 + l_tax < 0.75 then 'Underfitting'
           else 'Healthy' end as diagnosis
    from (select distinct l_discount, l_tax from lineitem)""")
def _(spark, sf):
    # Every pair of rates in the table stands for a pair of accuracies.
    pairs = table(spark, sf, "lineitem").select("l_discount", "l_tax").distinct()
    return pairs.withColumn("diagnosis", modeling.fit_diagnosis(0.9 + F.col("l_discount"), 0.9 + F.col("l_tax")))


_COEF = union([f"select '{c}' as feature, {s} * avg(cast({c} as double)) as coefficient from lineitem"
               for c, s in (("l_quantity", 1), ("l_tax", -1), ("l_partkey", 1), ("l_discount", 1),
                            ("l_linenumber", -1), ("l_suppkey", 1), ("l_linenumber", 1))])


@query("dominance_check", f"""
    select arg_max(feature, abs(coefficient)) as dominant_feature, {rnd('max(abs(coefficient))', 4)} as strength,
           {rnd('avg(abs(coefficient))', 4)} as mean_strength,
           max(abs(coefficient)) > 5 * avg(abs(coefficient)) as suspicious from ({_COEF})""")
def _(spark, sf):
    means = [F.struct(F.lit(c).alias("feature"), (s * F.avg(c)).alias("coefficient"))
             for c, s in (("l_quantity", 1), ("l_tax", -1), ("l_partkey", 1), ("l_discount", 1),
                          ("l_linenumber", -1), ("l_suppkey", 1), ("l_linenumber", 1))]
    table_ = table(spark, sf, "lineitem").agg(F.array(*means).alias("r")).select(F.inline_outer("r"))
    return modeling.dominance_check(table_)


@query("root_causes", """
    with s as (select l_returnflag, l_linestatus, l_linenumber, count(*) as n, avg(l_quantity) as q,
                      count(*) filter (where l_tax = 0) as zero_tax from lineitem group by 1, 2, 3),
    f as (select l_returnflag, l_linestatus, l_linenumber, zero_tax % 3 as missing_total, n % 2 = 0 as imbalanced,
                 case n % 3 when 0 then 'Overfitting' when 1 then 'Underfitting' else 'Healthy' end as diagnosis,
                 n % 5 = 0 as suspicious, n % 4 as n_correlated_pairs from s),
    r as (select f.*, c.* from f, (values (1, 'missing values', 'impute'),
            (2, 'class imbalance', 'class weights or resampling'), (3, 'overfitting', 'regularise or simplify'),
            (4, 'underfitting', 'richer model or features'), (5, 'feature dominance', 'check for leakage'),
            (6, 'correlated features', 'select features')) as c(k, root_cause, recommendation)
          where (k = 1 and missing_total > 0) or (k = 2 and imbalanced) or (k = 3 and diagnosis = 'Overfitting')
             or (k = 4 and diagnosis = 'Underfitting') or (k = 5 and suspicious) or (k = 6 and n_correlated_pairs > 0))
    select l_returnflag, l_linestatus, l_linenumber, root_cause, recommendation from r
    union all
    select l_returnflag, l_linestatus, l_linenumber, 'none', 'healthy' from f
    where missing_total = 0 and not imbalanced and diagnosis = 'Healthy' and not suspicious
          and n_correlated_pairs = 0""")
def _(spark, sf):
    # One row of signals per segment, the signals taken from counts so that every rule occurs.
    by = ["l_returnflag", "l_linestatus", "l_linenumber"]
    n = F.col("n")
    of = table(spark, sf, "lineitem").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_tax") == 0).alias("z")).select(
        *by, (F.col("z") % 3).alias("missing_total"), (n % 2 == 0).alias("imbalanced"),
        F.when(n % 3 == 0, "Overfitting").when(n % 3 == 1, "Underfitting").otherwise("Healthy").alias("diagnosis"),
        (n % 5 == 0).alias("suspicious"), (n % 4).alias("n_correlated_pairs"))
    return modeling.root_causes(of, by)


@query("baseline_report")
def _(spark, sf):
    split = sampling.stratified_split(view(spark, sf, "fx_imb"), "quality", "doc_id")
    return modeling.baseline_report(split, ["n_chars", "toxic"], "quality")


@query("coefficient_importance")
def _(spark, sf):
    rows = modeling.assembled(view(spark, sf, "fx_imb"), ["n_chars", "toxic"], "quality")
    return modeling.coefficient_importance(modeling.baseline_classifier(rows), ["n_chars", "toxic"], spark)


@query("learning_curve")
def _(spark, sf):
    return modeling.learning_curve(view(spark, sf, "fx_imb"), ["n_chars", "toxic"], "quality", "doc_id")


@query("accuracy", """
    select cast(round(avg(case when (quality > 0) = (toxic = 0) then 1.0 else 0.0 end), 4) as double) as accuracy from labels
    where quality is not null and toxic is not null""")
def _(spark, sf):
    rows = table(spark, sf, "labels").dropna(subset=["quality", "toxic"])
    return modeling.accuracy(rows.select(F.col("toxic").cast("double").alias("label"),
                                         (F.col("quality") < 0.5).cast("double").alias("prediction")))


@query("expanding_folds", """
    with r as (select o_orderstatus as label, row_number() over (order by o_orderdate, o_orderkey) as i, count(*) over () as n from orders),
    b as (select label, (select count(*) from range(1, 6) t(k) where i > floor(n * (k / 6.0))) as block from r),
    c as (select fold, label, count(*) filter (where block < fold) as t, count(*) filter (where block = fold) as v
          from b, range(1, 6) f(fold) where block <= fold group by 1, 2),
    w as (select *, sum(t) over (partition by fold) as train_rows, sum(v) over (partition by fold) as validation_rows,
                 row_number() over (partition by fold order by t desc, label) as place from c)
    select cast(fold as integer) as fold, cast(train_rows as bigint) as train_rows, cast(validation_rows as bigint) as validation_rows,
           label as majority, round(v / validation_rows, 4) as majority_accuracy from w where place = 1""")
def _(spark, sf):
    return modeling.expanding_folds(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query("cross_validate")
def _(spark, sf):
    return modeling.cross_validate(view(spark, sf, "fx_imb"), ["n_chars", "toxic"], "quality", ["doc_id"])
