"""SQL text for the checks: the same answers written for a relational engine."""

from collections.abc import Sequence

from tablescope.plans.fixtures import VIEWS, view_sql

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]


def with_views(*names: str, extra: Sequence[str] = ()) -> str:
    parts = [view_sql(n) for n in names if n in VIEWS] + list(extra)
    return "with " + ",\n".join(parts) + "\n" if parts else ""


def rnd(x: str, digits: int) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def d(x: str) -> str:
    return f"cast({x} as double)"


def corr(a: str, b: str) -> str:
    return (f"(covar_pop({d(a)}, {d(b)}) / nullif(stddev_pop(case when {b} is not null then {d(a)} end)"
            f" * stddev_pop(case when {a} is not null then {d(b)} end), 0))")


def union(rows: Sequence[str]) -> str:
    return "\nunion all\n".join(rows)


def per_column(source: str, names: Sequence[str], body, key: str = "feature", where: str = "") -> str:
    return union([f"select {i} as ordinal, '{c}' as {key}, {body(c)} from {source} {where}"
                  for i, c in enumerate(names)])


def grade(x: str) -> str:
    return (f"case when {x} >= 90 then 'A' when {x} >= 75 then 'B' when {x} >= 60 then 'C' "
            f"when {x} >= 40 then 'D' else 'F' end")


def moments(x: str) -> str:
    """n, adjusted skew and kurtosis, Jarque-Bera p of a column."""
    v = d(x)
    return (f"count({x}) as n, avg({v}) as mean, stddev_samp({v}) as std, min({v}) as lo, max({v}) as hi, "
            f"coalesce(skewness({v}), 0.0) as sk, coalesce(kurtosis({v}), 0.0) as ku")


def jb_p(n: str = "n", sk: str = "sk", ku: str = "ku") -> str:
    """From the columns of `moments`."""
    g1 = f"({sk} * ({n} - 2) / sqrt({d(n)} * ({n} - 1)))"
    g2 = f"(case when lo = hi then 0 else (({ku} * ({d(n)} - 2) * ({n} - 3) / ({n} - 1) - 6) / ({n} + 1)) end)"
    return f"exp(-({d(n)} / 6 * ({g1} * {g1} + {g2} * {g2} / 4)) / 2)"


def ks_p(ks: str = "ks", n1: str = "n1", n2: str = "n2") -> str:
    m = f"({d(n1)} * {n2} / ({n1} + {n2}))"
    x0 = f"(sqrt({m}) * {ks})"
    x = f"({x0} + 1 / (6 * sqrt({m})) + ({x0} - 1) / (4 * {m}))"
    series = (f"list_sum(list_transform(range(1, 21), lambda k: "
              f"(case when k % 2 = 1 then 1.0 else -1.0 end) * exp(-2.0 * k * k * {x} * {x})))")
    return (f"(case when {x} < 0.2 then 1.0 else greatest(0.0, least(1.0, 2 * {series})) end)")


def ks_ctes(source: str, names: Sequence[str], second: str) -> str:
    """Common table expressions ending in `cmp(ordinal, feature, n1, n2, ks, m1, m2, s1, s2)`."""
    long = per_column(source, names, lambda c: f"{d(c)} as v, ({second}) as second")
    return f"""
long as (select * from ({long}) where v is not null),
vf as (select ordinal, feature, v, sum(case when second then 0 else 1 end) as a,
              sum(case when second then 1 else 0 end) as b from long group by all),
cum as (select ordinal, feature,
               sum(a) over (partition by feature order by v) as ca,
               sum(b) over (partition by feature order by v) as cb,
               sum(a) over (partition by feature) as n1, sum(b) over (partition by feature) as n2 from vf),
ks as (select ordinal, feature, max(n1) as n1, max(n2) as n2,
              max(abs(ca * 1.0::double / nullif(n1, 0) - cb * 1.0::double / nullif(n2, 0))) as ks
       from cum group by all),
mom as (select feature as f, avg(case when not second then v end) as m1, avg(case when second then v end) as m2,
               stddev_samp(case when not second then v end) as s1,
               stddev_samp(case when second then v end) as s2 from long group by all),
cmp as (select * from ks join mom on ks.feature = mom.f)"""


def shift(a: str, b: str) -> str:
    return rnd(f"abs({b} - {a}) / (abs({a}) + 0.00000001::double) * 100", 1)


def severity(ks: str = "ks") -> str:
    return f"case when {ks} > 0.3 then 'HIGH' when {ks} > 0.15 then 'MEDIUM' else 'LOW' end"
