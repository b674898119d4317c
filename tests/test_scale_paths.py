"""The ways large tables take give the same answers as the plain ones, at forced small limits."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.operators import association, comoments, drift, duplicates, features, inference, ks, missingness, ordering, scoring
from tablescope.operators.quantiles import quantiles, value_at_rank
from tablescope.sources import sampling, tables

RNG = np.random.default_rng(5)


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e12, 1e12)), min_size=1, max_size=60))
def test_refined_quantiles_equal_numpy(spark, values):
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = quantiles(frame(spark, x=values), ["x"], probs, small_rows=0)["x"]
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-9, atol=1e-9)


def test_refined_quantiles_with_hot_value_and_outliers(spark):
    x = np.concatenate([np.full(5000, 7.0), RNG.lognormal(0, 4, 9000), [1e300, -1e300]])
    got = quantiles(frame(spark, x=x), ["x"], [0.01, 0.3, 0.5, 0.9, 0.999], small_rows=0)["x"]
    assert np.allclose(got, np.quantile(x, [0.01, 0.3, 0.5, 0.9, 0.999]), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert quantiles(df, ["x"], [0.5]) == {"x": [None]}
    assert quantiles(df, ["x"], [0.5], small_rows=0) == {"x": [None]}


def test_value_at_rank_with_weights(spark):
    df = frame(spark, x=[3.0, 1.0, 2.0], w=[5, 1, 4])
    assert [value_at_rank(df, F.col("x"), r, F.col("w")) for r in (0, 1, 4, 5, 9)] == [1, 2, 2, 3, 3]


def test_quantile_passes_hand_on_buckets_not_rows(spark):
    x = np.concatenate([RNG.normal(size=30_000), np.full(9_000, 0.25), [np.inf, -np.inf, -0.0, np.nan]])
    wide = frame(spark, q0=x, w=RNG.integers(1, 4, len(x))).repartition(3)
    plan = []
    original = type(wide).mapInArrow
    type(wide).mapInArrow = lambda df, *a, **k: plan.append(1) or original(df, *a, **k)
    try:
        from tablescope.operators.quantiles import _bracket_counts
        got = _bracket_counts(wide, [(0, (-1.0, -0.5)), (0, (0.25, 0.25)), (0, (0.3, float("inf")))])
    finally:
        type(wide).mapInArrow = original
    rows = wide.toPandas().dropna()
    for (_, (lo, hi)), (below, buckets) in got.items():
        assert below == rows.w[rows.q0 < lo].sum()
        inside = rows[(rows.q0 >= lo) & (rows.q0 <= hi)]
        assert sum(c for c, _, _ in buckets) == inside.w.sum()
        for c, a, z in buckets:
            assert c == inside.w[(inside.q0 >= a) & (inside.q0 <= z)].sum()
    assert plan


def brute_ks(a, b):
    grid = np.unique(np.concatenate([a, b]))
    one, two = np.searchsorted(np.sort(a), grid, "right"), np.searchsorted(np.sort(b), grid, "right")
    return np.abs(one / len(a) - two / len(b)).max()


def sides(spark, a, b):
    return frame(spark, v=np.concatenate([a, b]), side=[False] * len(a) + [True] * len(b)).repartition(4)


@pytest.mark.parametrize("first_cells", [1, 7, 256])
def test_ks_by_branch_and_bound(spark, first_cells):
    ties = np.round(RNG.normal(0, 1, 400), 1), np.concatenate([np.round(RNG.normal(0.4, 1, 300), 1), np.full(200, 0.5)])
    wide = RNG.lognormal(0, 40, 700) * RNG.choice([-1, 1], 700), np.concatenate([RNG.lognormal(0, 39, 500), [0.0, 1e300, -1e300]])
    for a, b in (ties, wide, (RNG.normal(size=900), RNG.normal(size=700)), (np.zeros(5), np.ones(3)), (np.array([2.0]), np.array([2.0]))):
        row = ks.ks_statistic(sides(spark, a, b), ["v"], F.col("side"), first_cells=first_cells).first()
        assert row.ks == brute_ks(a, b) and (row.n_first, row.n_second) == (len(a), len(b))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e12, 1e12)), min_size=1, max_size=40),
       b=st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e12, 1e12)), min_size=1, max_size=40))
def test_ks_of_any_values(spark, a, b):
    a, b = np.array(a) + 0.0, np.array(b) + 0.0
    assert ks.ks_statistic(sides(spark, a, b), ["v"], F.col("side"), first_cells=2).first().ks == brute_ks(a, b)


def test_ks_of_equal_samples_is_zero_after_one_round(spark, monkeypatch):
    x = RNG.normal(size=5000)
    rounds, count = [], ks._count
    monkeypatch.setattr(ks, "_count", lambda *a: rounds.append(1) or count(*a))
    for times in (1, 3):                                    # also where one side is a multiple of the other
        assert ks.ks_statistic(sides(spark, x, np.tile(x, times)), ["v"], F.col("side")).first().ks == 0
    assert len(rounds) == 2


def test_ks_counts_few_cells_of_many_values(spark, monkeypatch):
    live, count = [], ks._count
    monkeypatch.setattr(ks, "_count", lambda wide, cells: live.append(sum(len(e) for e, _ in cells.values())) or count(wide, cells))
    a, b = RNG.normal(size=40_000), RNG.normal(0.2, 1, 40_000)
    assert ks.ks_statistic(sides(spark, a, b), ["v"], F.col("side")).first().ks == brute_ks(a, b)
    assert sum(live) < 20_000 and len(live) < 6


def test_ks_of_nearly_equal_samples_sends_few_counts_to_the_driver(spark, monkeypatch):
    live, count = [], ks._count
    monkeypatch.setattr(ks, "_count", lambda wide, cells: live.append(sum(len(e) for e, _ in cells.values())) or count(wide, cells))
    a = np.arange(300_000) * 1.0
    b = a[np.arange(len(a)) % 10 != 0]
    for x, y in ((a, b), (b, a)):
        assert ks.ks_statistic(sides(spark, x, y), ["v"], F.col("side"), first_cells=3).first().ks == brute_ks(x, y)
    assert len(live) <= 4 and sum(live) < 30_000


@pytest.mark.parametrize("product", [1 << 61, 1])
def test_ks_settles_open_cells_of_any_size(spark, monkeypatch, product):
    for name in ("PASSES", "MAX_PASSES"):
        monkeypatch.setattr(ks, name, 1)
    if product == 1:                                        # as for counts whose product passes 64 bits
        init = ks._Search.__init__
        monkeypatch.setattr(ks._Search, "__init__", lambda s, *n: (init(s, *n), setattr(s, "whole", object), s.open.__setitem__(0, s.open[0].astype(object)))[0])
    a, b = np.round(RNG.normal(0, 3, 3000), 1), np.concatenate([np.round(RNG.normal(0.1, 3, 2000), 1), np.full(300, 0.5)])
    for x, y in ((a, b), (RNG.normal(size=900), RNG.normal(size=700))):
        assert ks.ks_statistic(sides(spark, x, y), ["v"], F.col("side"), first_cells=2).first().ks == brute_ks(x + 0.0, y + 0.0)


def test_ks_without_values_on_a_side(spark):
    df = spark.createDataFrame([(1.0, None, None), (2.0, None, None), (None, 3.0, None)], "a double, b double, c double")
    got = {r.feature: r for r in ks.ks_statistic(df, ["a", "b", "c"], F.col("a").isNull()).collect()}
    assert set(got) == {"a", "b"} and got["a"].ks is None and (got["b"].n_first, got["b"].n_second) == (0, 1)


def test_split_at_fraction_by_composite_key(spark):
    # Half the table shares the first key, so the second one decides.
    a = np.concatenate([np.full(60, 5), np.arange(61) % 9])
    df = frame(spark, a=a, b=RNG.permutation(121))
    got = ordering.split_at_fraction(df, ["a", "b"], 0.5).toPandas()
    got = got.sort_values(["a", "b"])
    assert list(got["second"]) == [False] * 60 + [True] * 61


def test_split_rejects_ambiguous_and_missing_keys(spark):
    with pytest.raises(ValueError, match="unique"):
        ordering.split_at_fraction(frame(spark, a=[1, 2, 2, 3]), ["a"], 0.5)
    with pytest.raises(ValueError, match="no value"):
        ordering.split_at_fraction(spark.createDataFrame([(1,), (None,)], "a int"), ["a"])


def test_split_by_text_key(spark):
    names = [f"k{i:03d}" for i in RNG.permutation(90)] + ["", "k", "k0", "ü", "üb", "漢字", "z" * 300, "z" * 300 + "a", "k\0", "A", "z"]
    for fraction in (0.02, 0.3, 0.93, 0.97):
        got = ordering.split_at_fraction(frame(spark, k=names), ["k"], fraction).toPandas()
        assert sorted(got.k[~got.second], key=str.encode) == sorted(names, key=str.encode)[:int(101 * fraction)]
    both = frame(spark, a=["x"] * 60 + ["y"] * 41, b=names)
    got = ordering.split_at_fraction(both, ["a", "b"], 0.5).toPandas()
    assert sorted(zip(got.a[~got.second], got.b[~got.second])) == sorted(zip(["x"] * 60, names[:60]), key=lambda r: (r[0], r[1].encode()))[:50]


def test_split_by_long_decimals(spark):
    from decimal import Decimal, localcontext
    with localcontext(prec=50):
        values = [Decimal(10) ** 27 * (i % 3) + Decimal(i).scaleb(-8) for i in range(-30, 31)]
    df = spark.createDataFrame([(v,) for v in values], "d decimal(37,8)")
    got = [r.d for r in ordering.split_at_fraction(df, ["d"], 0.4).filter("not second").collect()]
    assert sorted(got) == sorted(values)[:24]


@pytest.mark.parametrize("small_rows", [16, 10**6])
def test_lags_across_blocks(spark, small_rows):
    # One user holds most rows.
    pdf = pd.DataFrame({"u": np.where(RNG.random(200) < 0.7, 1, RNG.integers(2, 6, 200)),
                        "t": RNG.permutation(200), "v": RNG.normal(size=200)})
    got = ordering.lagged(spark.createDataFrame(pdf), "v", [1, 5], ["t"], ["u"], small_rows).toPandas()
    want = pdf.sort_values(["u", "t"])
    for k in (1, 5):
        want[f"v_lag_{k}"] = want.groupby("u").v.shift(k)
    got = got.sort_values(["u", "t"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want.reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("per_bucket", [5, 10**6])
def test_adjacent_gaps(spark, per_bucket):
    v = np.concatenate([RNG.integers(0, 10**6, 80), np.full(40, 123), RNG.integers(0, 10**6, 80)])
    gaps = ordering.adjacent_gaps(frame(spark, v=v), per_bucket)
    want = np.median(np.diff(np.sort(v)))
    assert ordering.weighted_median(gaps) == want
    assert ordering.weighted_median(gaps, small_rows=0) == want


@pytest.mark.parametrize("digit_bits, hash_bits, groups", [(2, 60, 10_000), (10, 60, 10_000), (4, 8, 10_000), (10, 60, 0)])
def test_sample_and_split_by_hash(spark, monkeypatch, digit_bits, hash_bits, groups):
    monkeypatch.setattr(sampling, "HASH_BITS", hash_bits)       # 8 bits leave ties, which the whole hash settles
    monkeypatch.setattr(sampling.bounded_broadcast, "__defaults__", (groups,))
    df = frame(spark, k=np.arange(300), c=np.where(np.arange(300) % 3 == 0, "a", np.where(np.arange(300) == 7, None, "b")))
    order = [r.k for r in df.orderBy(sampling.hash_key("k")).collect()]
    if groups:
        assert {r.k for r in sampling.deterministic_sample(df, 77, "k", digit_bits=digit_bits).collect()} == set(order[:77])
    split = sampling.stratified_split(df, "c", "k", digit_bits=digit_bits).toPandas()
    kind = {k: c for k, c in zip(range(300), df.toPandas().c)}
    want = set([k for k in order if kind[k] == "a"][:20] + [k for k in order if kind[k] == "b"][:40])
    assert set(split.k[split.split == "validation"]) == want and len(split) == 300


def test_sample_of_nothing(spark):
    none = spark.createDataFrame([], "k int, c string")
    assert sampling.deterministic_sample(none, 5, "k").count() == 0 and sampling.stratified_split(none, "c", "k").count() == 0
    assert sampling.deterministic_sample(frame(spark, k=[1, 2]), 0, "k").count() == 0


def test_sample_larger_than_table(spark):
    assert sampling.deterministic_sample(frame(spark, k=[1, 2, 3]), 10, "k").count() == 3


def test_correlation_of_a_wide_table_with_gaps(spark):
    m = RNG.normal(size=(300, 14)) * 10 + 1e4
    m[:, 3], m[:, 5] = m[:, 2] * 2 + 1, 7.0
    m[RNG.random(m.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(m, columns=[f"c{i}" for i in range(14)])
    want = pdf.corr().to_numpy()
    for r in association.correlation_pairs(spark.createDataFrame(pdf), list(pdf), listwise=False).collect():
        if np.isnan(want[r.i, r.j]):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(want[r.i, r.j], abs=1e-10)


def test_target_encode_with_hot_categories(spark, monkeypatch):
    many = [f"k{i}" for i in range(3000)]
    df = frame(spark, c=["a"] * 4000 + many + [None] * 900, y=np.arange(7900.0), z=[1] * 4000 + [2] * 3900)    # rows of the hot key alike
    plain = sorted(map(repr, features.target_encode(df, "c", "y").collect()))
    monkeypatch.setattr(features, "_MAX_BROADCAST_BYTES", 0)
    got = features.target_encode(df, "c", "y")
    assert sorted(map(repr, got.collect())) == plain
    # neither the hot category nor the gaps are among the rows that are shuffled
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "broadcast" in plan.lower()
    monkeypatch.setattr(features, "HOT_SHARE", 1)
    assert sorted(map(repr, features.target_encode(df, "c", "y").collect())) == plain
    assert features.target_encode(spark.createDataFrame([], "c string, y double"), "c", "y").count() == 0


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        x = np.random.default_rng(1).normal(size=500)
        df = frame(spark, i=np.arange(500), x=x, y=x * 2 + 1).repartition(int(partitions))
        report = drift.drift_report(df, "y", ["i"]).orderBy("feature").toPandas()
        half = x[:250], x[250:]
        grid = np.sort(x)
        brute = max(abs((half[0] <= g).mean() - (half[1] <= g).mean()) for g in grid)
        assert report.ks_stat[1] == pytest.approx(brute, abs=5e-5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_date_formats(spark):
    texts = ["2024-02-29", "2024-01-02 03:04:05", "2024-01-02T03:04:05", "02/29/2024", "2024/02/29",
             "05-Jan-2024", "Jan 5, 2024", "2024-13-01", "12345", "5", "x", "2024-02-29 extra"]
    got = [r.p is not None for r in frame(spark, t=texts).select(
        inference.parse_date(F.col("t")).alias("p")).collect()]
    assert got == [True] * 7 + [False] * 5


def test_cut_before_equal_keys(spark):
    """Equal keys are unclear only where the cut divides them, whatever the size of the table."""
    df = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k long")
    parts = ordering.split_at_fraction(df, ["k"]).collect()
    assert sorted((r.k, r.second) for r in parts) == [(1, False), (2, False), (3, True), (3, True)]
    with pytest.raises(ValueError):
        ordering.split_at_fraction(df, ["k"], 0.75).collect()


def test_cut_inside_equal_text(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "k string")
    with pytest.raises(ValueError):
        ordering.split_at_fraction(df, ["k"]).collect()


def test_lag_longer_than_block(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(20)], "k long, v double")
    for small in (100, 4):
        rows = ordering.lagged(df, "v", [1, 7], ["k"], small_rows=small).collect()
        assert sorted((r.k, r.v_lag_7) for r in rows) == [(i, float((i - 7) ** 2) if i >= 7 else None) for i in range(20)]


def test_fractions_of_seconds_survive(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2024-01-02 01:00:00.123456' as t")
    tables.write_cleaned(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).filter("value like '%00.123456%'").count() == 1


def test_split_by_ids_beyond_doubles(spark):
    for kind in ("bigint", "decimal(18,0)", "decimal(30,0)"):
        ids = spark.range(2**53, 2**53 + 6).selectExpr(f"cast(id as {kind}) as id")
        for half in (1, 2, 3, 4, 5):
            got = ordering.split_at_fraction(ids, ["id"], half / 6 + 0.01).filter("second").count()
            assert got == 6 - half
    signs = spark.createDataFrame([(-(2**62),), (-1,), (0,), (2**62,)], "id bigint")
    got = ordering.split_at_fraction(signs, ["id"]).filter("second").collect()
    assert sorted(r.id for r in got) == [0, 2**62]


def test_times_without_zone_over_a_clock_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select cast(s as timestamp_ntz) as t from values ('2024-03-10 01:30:00'), "
                       "('2024-03-10 02:30:00.25'), ('2024-03-10 03:30:00.25'), ('2024-03-10 04:30:00') as v(s)")
        assert ordering.split_at_fraction(df, ["t"]).filter("second").count() == 2
        us = [r[0] for r in df.select(ordering.instant(df, "t")).collect()]
        assert np.diff(us).tolist() == [3_600_250_000, 3_600_000_000, 3_599_750_000]
        assert us[0] == 1_710_034_200_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# --- moments of all columns in one pass ------------------------------------------------------

def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") \
        + df._jdf.queryExecution().optimizedPlan().toString().count("Relation")


def test_comoments_by_segment(spark):
    m = RNG.normal(size=(900, 5)) * [1, 10, 1e-3, 5, 1] + [0, 1e6, 1, -5, 3]
    m[RNG.random(m.shape) < 0.2] = np.nan
    m[:, 4] = 0.1
    seg = [None if i % 7 == 0 else "hot" if i % 7 < 5 else f"s{i % 40}" for i in range(900)]
    pdf = pd.DataFrame(m, columns=list("abcde")).assign(seg=seg)
    names = list("abcde")
    df = spark.createDataFrame(pdf).repartition(6)
    got = comoments.comoments(df, {c: F.col(c) for c in names}, [names], names, ["seg"]).collect()
    assert len(got) == pdf.seg.nunique(dropna=False)
    for r in got:
        part = pdf[pdf.seg.isna() if r.seg is None else pdf.seg == r.seg][names]
        for k, c in enumerate(names):
            x, s = part[c].dropna(), r.singles[k]
            assert s.n == len(x)
            if len(x):
                assert (s.low, s.high) == (x.min(), x.max()) and s["mean"] == pytest.approx(x.mean(), rel=1e-12)
                assert s.m2 == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-8, abs=1e-20)
                assert s.m3 == pytest.approx(((x - x.mean()) ** 3).sum(), rel=1e-6, abs=1e-6 * (1 + x.std(ddof=0) ** 3))
        for p in r.pairs:
            both = part[[names[p.i], names[p.j]]].dropna().to_numpy()
            both = both[:, [0, -1]]
            assert p.n == len(both)
            if len(both):
                d = both - both.mean(axis=0)
                assert p.cm == pytest.approx((d[:, 0] * d[:, 1]).sum(), rel=1e-7, abs=1e-9)
                assert (p.m2_i == 0) == (p.i == 4 or len(both) == 1) and p.m2_j == pytest.approx((d[:, 1] ** 2).sum(), rel=1e-7, abs=1e-20)


def test_comoments_of_nothing(spark):
    df = spark.createDataFrame([], "a double, g string")
    assert comoments.comoments(df, {"a": F.col("a")}, [["a"]], ["a"]).count() == 0
    none = spark.createDataFrame([(None, "x"), (float("nan"), "x")], "a double, g string")
    row = comoments.comoments(none, {"a": F.col("a")}, [["a"]], ["a"], ["g"]).first()
    assert (row.g, row.singles[0].n, row.singles[0].low, row.pairs[0].n, row.pairs[0].m2_i) == ("x", 0, None, 0, 0)


def test_scans_do_not_grow_with_columns_or_segments(spark, tmp_path):
    def of(n, segments):
        pdf = pd.DataFrame(RNG.normal(size=(80, n)), columns=[f"c{i}" for i in range(n)]).assign(
            g=[i % segments for i in range(80)], t=[f"u{i}@x" for i in range(80)])
        pdf[pdf.columns[:-2]] = pdf[pdf.columns[:-2]].mask(RNG.random((80, n)) < 0.1)
        path = f"{tmp_path}/{n}-{segments}"
        spark.createDataFrame(pdf).write.parquet(path)
        df = spark.read.parquet(path)
        return [scans(f) for f in (scoring.signals(df, "c0", ["g"]), scoring.signals(df, "c0"), missingness.mar_signals(df),
                                   association.correlation_matrix(df), association.correlation_matrix(df, listwise=False))]
    few = of(6, 2)
    assert of(40, 12) == few and few[2:] == [1, 1, 1] and few[0] <= 3


def test_signals_of_many_columns_equal_pandas(spark):
    m = RNG.normal(size=(300, 12))
    m[:, 1], m[:, 2], m[:, 3] = m[:, 0] * 2 + 1, m[:, 0] + 0.01 * m[:, 2], 5.0
    pdf = pd.DataFrame(m, columns=[f"c{i}" for i in range(12)]).assign(user_id=np.arange(300), email=[f"u{i}@x" for i in range(300)])
    pdf.loc[pdf.c5 > 0.8, "c6"] = np.nan
    row = scoring.signals(spark.createDataFrame(pdf), "c0").first()
    assert (row.rows, row.n_constant, row.n_leak, row.n_redundant, row.n_type_warnings, row.pattern) == (300, 1, 2, 1, 2, "MAR")
    again = pdf.assign(user_id=[0, *range(299)], seg=["x"] * 150 + ["y"] * 150)     # the id repeats in one segment
    by = {r.seg: r.n_type_warnings for r in scoring.signals(spark.createDataFrame(again), "c0", ["seg"]).collect()}
    assert by == {"x": 1, "y": 2}


def test_signals_of_an_empty_table(spark):
    row = scoring.signals(spark.createDataFrame([], "a double, b string, y double"), "y").first()
    assert (row.rows, row.missing_pct, row.n_leak, row.n_redundant, row.pattern, row.adequate) == (0, 0, 0, 0, "NONE", False)


# --- equal rows by digests --------------------------------------------------------------------

def odd_rows(spark):
    rows = [(1, "a", None, 0.0, [1]), (1, "a", None, -0.0, [1]), (1, None, "a", 0.0, [1]), (1, "ab", "c", float("nan"), None),
            (1, "ab", "c", None, None), (1, "a", "bc", None, None), (None, None, None, None, None), (None, None, None, None, None),
            (2, "", None, 1.0, []), (2, None, "", 1.0, []), (1, "a", None, 0.0, [1])]
    return spark.createDataFrame(rows, "k int, a string, b string, x double, l array<int>")


@pytest.mark.parametrize("broadcast", [True, False])
def test_duplicates_by_digest(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(duplicates, "MAX_BROADCAST", 0)
    df = odd_rows(spark)
    assert duplicates.duplicate_rows(df).first()[0] == 4
    kept = [(r.k, r.a, r.b, None if r.x is None else r.x + 0.0, r.l) for r in duplicates.drop_duplicate_rows(df).collect()]
    assert len(kept) == 7 and len({repr(r) for r in kept}) == 7
    by = {r.k: r.duplicate_rows for r in duplicates.copies_by(df, ["k"]).collect()}
    assert by == {1: 3, None: 1, 2: 0}
    mapped = df.withColumn("m", F.when(F.col("k") == 1, F.create_map(F.lit("q"), F.col("a"))))
    assert duplicates.duplicate_rows(mapped).first()[0] == 4 and duplicates.drop_duplicate_rows(mapped).count() == 7


def test_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "a string, b double")
    assert duplicates.duplicate_rows(none).first()[0] == 0 and duplicates.drop_duplicate_rows(none).count() == 0
    assert duplicates.copies_by(none, []).first()[0] == 0


def test_rows_that_share_a_digest_are_compared(spark, monkeypatch):
    df = frame(spark, a=["x", "y", "y", "z"])
    same = lambda d: d.select("*", F.lit(1).cast("long").alias("_d1"), F.lit(1).cast("long").alias("_d2"), F.lit(1).cast("long").alias("_size"))
    monkeypatch.setattr(duplicates, "with_digest", same)
    assert duplicates.duplicate_rows(df).first()[0] == 1
    assert sorted(r.a for r in duplicates.drop_duplicate_rows(df).collect()) == ["x", "y", "z"]


def test_counting_duplicates_shuffles_no_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").drop("doc_id")
    plan = duplicates.duplicate_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_d1" in plan and "_sha" in plan
    shuffled = duplicates.with_digest(df).groupBy("_d1", "_d2", "_size").count()._jdf.queryExecution().executedPlan().toString()
    exchange = shuffled[shuffled.index("Exchange"):].split("\n")[1]
    assert "text" not in exchange.split("Scan")[0]


def test_clean_writes_nothing_where_nothing_repeats(spark, monkeypatch):
    written = []
    from tablescope.operators import cleaning as c
    monkeypatch.setattr(c, "materialise", lambda df, name: written.append(name) or df)
    c.clean(frame(spark, a=[1.0, 2.0, 3.0], y=[1.0, 5.0, 2.0]), "y")
    assert written == []
    fixed, _ = c.clean(frame(spark, a=[1.0, 1.0, 3.0], y=[1.0, 1.0, 2.0]), "y")
    assert written == ["deduplicated"] and fixed.count() == 2


def test_sample_counts_few_digits_whatever_the_rows(spark, monkeypatch):
    seen, write = [], sampling.materialise
    monkeypatch.setattr(sampling, "materialise", lambda df, name: seen.append(df.count()) or write(df, name))
    df = spark.range(20_000).withColumn("g", F.col("id") % 7)
    split = sampling.stratified_split(df, "g", "id", 0.3)
    assert split.filter("split = 'validation'").count() == sum(int(0.3 * n + 0.5) for n in [2858] + [2857] * 6)
    assert len(seen) <= 4 and max(seen) == 7
