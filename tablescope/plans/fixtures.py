"""Derived tables with gaps, leaks, drift and odd types, in SQL that both engines run.

The given tables are complete and their columns nearly independent, so the cases
the operators look for are made from them, over all rows. `{lineitem}` and the
like stand for a table.
"""

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_nulls": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey,
               case when l_partkey % 13 = 0 then null else l_quantity end as l_quantity,
               case when l_extendedprice > 95000 then null else l_discount end as l_discount,
               l_extendedprice, l_tax,
               case when l_suppkey % 17 = 0 then null else l_returnflag end as l_returnflag,
               cast(null as double) as all_null, 1 as const_col
        from {lineitem}""",
    "fx_leak": """
        select l_orderkey, l_quantity, l_discount, l_tax, l_extendedprice,
               l_extendedprice * (1 - l_discount) as l_revenue,
               l_extendedprice * 2 + 1 as l_price_copy,
               l_extendedprice + l_quantity * 900 as l_mix,
               cast(case when l_quantity > 25 then 1 else 0 end as int) as l_big
        from {lineitem}""",
    "fx_mar": """
        select event_id, user_id, value, case when user_id < 60 then null else value end as v_mar
        from {events}""",
    "fx_drift": """
        select event_id, user_id,
               case when event_id >= (select floor(count(*) / 2.0) from {events})
                    then value * 1.5 + 20 else value end as value,
               cast(event_id as double) as trend
        from {events}""",
    "fx_new": """
        select o_orderkey, o_orderstatus, o_totalprice * 1.3 as o_totalprice,
               case when o_custkey % 20 = 0 then null else o_custkey end as o_custkey,
               o_orderpriority, cast(o_orderkey % 7 as int) as o_extra
        from {orders} where o_orderkey % 10 <> 0""",
    "fx_dups": "select l_returnflag, l_linestatus, l_linenumber, l_discount from {lineitem}",
    "fx_types": """
        select c_custkey as customer_id,
               concat('user', cast(c_custkey as varchar(20)), '@mail.example') as email,
               concat('http://shop.example/', cast(c_custkey as varchar(20))) as url,
               cast(10000 + c_custkey as varchar(20)) as zip,
               case when c_nationkey > 12 then 1 else 0 end as flag01,
               c_acctbal / 100.0 as x_rsi,
               cast(c_custkey as double) / (select max(c_custkey) from {customer}) as pct01,
               c_mktsegment
        from {customer}""",
    "fx_dates": """
        select o_orderkey, substr(cast(cast(o_orderdate as date) as varchar(20)), 1, 10) as order_day,
               o_totalprice
        from {orders}""",
    "fx_imb": """
        select d.doc_id, d.n_chars, l.quality, l.toxic
        from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "fx_seg": """
        select l_returnflag, l_quantity, l_tax, l_extendedprice, 1 as const_col,
               case when l_returnflag = 'A' and l_extendedprice > 95000 then null
                    when l_returnflag = 'R' and l_partkey % 50 = 0 then null
                    else l_discount end as l_discount,
               case when l_returnflag = 'R' then l_extendedprice * 2 + 1 else l_quantity * 3 end as l_copy
        from {lineitem}""",
    "fx_dirty": """
        select c_custkey as customer_id, c_nationkey, c_mktsegment,
               case when c_custkey % 11 = 0 then null else c_acctbal end as c_acctbal,
               case when c_custkey % 7 = 0 then null else c_mktsegment end as segment2,
               c_acctbal * 3 as c_triple, c_acctbal * 3 + 5 as c_triple2,
               'x' as same,
               case when c_custkey % 40 = 0 then c_acctbal * 100 else c_acctbal end as c_spiky
        from {customer}
        union all
        select c_custkey as customer_id, c_nationkey, c_mktsegment,
               case when c_custkey % 11 = 0 then null else c_acctbal end as c_acctbal,
               case when c_custkey % 7 = 0 then null else c_mktsegment end as segment2,
               c_acctbal * 3 as c_triple, c_acctbal * 3 + 5 as c_triple2,
               'x' as same,
               case when c_custkey % 40 = 0 then c_acctbal * 100 else c_acctbal end as c_spiky
        from {customer} where c_custkey % 10 = 3""",
}

_TABLES = ("lineitem", "events", "orders", "customer", "documents", "labels")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in _TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def view_sql(name: str) -> str:
    """The view as a named SQL subquery: `<name> as (...)`."""
    text = VIEWS[name]
    for t in _TABLES:
        text = text.replace("{" + t + "}", t)
    return f"{name} as ({text})"
