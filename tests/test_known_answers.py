"""Cases whose answers follow by hand."""

import datetime as dt
import json
import math
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from brassloom.functions import instruments as I
from brassloom.functions.normal import cdf, quantile
from brassloom.operators import backtest as B
from brassloom.operators import folds, ledger, metrics, prediction, quality, resample, runner, signals, stats
from brassloom.operators.asof import asof_join
from brassloom.plans.panel import HoldoutViolation, Splits, densify, guard, monthly_rf, weight_faults
from brassloom.sources import cache, parsers
from brassloom.streaming import bars as streaming

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def panel(spark, closes, opens=None):
    rows = [(day(k), a, float((opens or closes)[a][k]), float(c)) for a, cs in closes.items() for k, c in enumerate(cs) if c is not None]
    return densify(spark.createDataFrame(rows, "date date, asset string, open double, close double"))


def weighted(p, weights):
    w = p.sparkSession.createDataFrame([(day(k), a, float(x)) for a, ws in weights.items() for k, x in enumerate(ws)], "date date, asset string, weight double")
    return p.join(w, ["date", "asset"], "left").withColumn("variant", F.lit("v"))


FREE = B.Costs(half_spread_bps=0, slippage_bps=0, sec_per_million=0, taf_per_share=0, borrow_bps=0, margin_rate=0, cash_haircut=0)


OPEN = B.Rules(allow_short=True, opened=True)


def net(rows, mode, costs=FREE):
    return [r.net for r in B.periods(B.simulate(rows, mode, costs, rules=OPEN)).orderBy("date").collect()]


def test_open_to_close_path(spark):
    p = panel(spark, {"a": [100, 110, 121]}, {"a": [100, 105, 110]})
    rows = weighted(p, {"a": [1, 1, 1]})
    assert net(rows, "next_open") == pytest.approx([0, 110 / 105 - 1, 121 / 110 - 1])
    assert net(rows, "next_close") == pytest.approx([0, 0, 0.1])
    assert net(rows, "same_close") == pytest.approx([0, 0.1, 0.1])


def test_costs_are_charged_on_both_sides_and_double(spark):
    p = panel(spark, {"a": [100] * 5})
    rows = weighted(p, {"a": [0, 1, 1, 0, 0]})
    costs = B.Costs(half_spread_bps=5, slippage_bps=5, sec_per_million=0, taf_per_share=0, cash_haircut=0)
    one = net(rows, "same_close", costs)
    assert one == pytest.approx([0, -0.001, 0, -0.001, 0])
    assert net(rows, "same_close", costs.scaled(2)) == pytest.approx([2 * x for x in one])


def test_drift_causes_turnover(spark):
    p = panel(spark, {"a": [100, 100, 200], "b": [100, 100, 100]})
    rows = weighted(p, {"a": [0.5] * 3, "b": [0.5] * 3})
    t = [r.turnover for r in B.periods(B.simulate(rows, "same_close", FREE, rules=OPEN)).orderBy("date").collect()]
    assert t == pytest.approx([1, 0, 1 / 3])


def test_shorts_pay_borrow(spark):
    p = panel(spark, {"a": [100.0] * 3})
    costs = B.Costs(half_spread_bps=0, slippage_bps=0, sec_per_million=0, taf_per_share=0, cash_haircut=0, borrow_bps=365)
    assert net(weighted(p, {"a": [-1, -1, -1]}), "same_close", costs) == pytest.approx([0, -1e-4, -1e-4])


def test_episode_profits_add_up_to_returns(spark):
    rng = np.random.default_rng(1)
    p = panel(spark, {"a": np.cumprod(1 + rng.normal(0, 0.01, 60)) * 100, "b": np.cumprod(1 + rng.normal(0, 0.01, 60)) * 50})
    rows = weighted(p, {"a": ([0.5] * 10 + [-0.2] * 10 + [0] * 10) * 2, "b": [0] * 20 + [0.3] * 40})
    sim = B.simulate(rows, "next_close", FREE, rules=OPEN)
    pnl = B.episodes(sim).agg(F.sum("pnl")).first()[0]
    assert pnl == pytest.approx(B.periods(sim).agg(F.sum("net")).first()[0])
    held = B.episodes(sim).where("asset = 'b'").collect()
    assert len(held) == 1 and held[0].still_open and held[0].side == "long" and held[0].periods == 39


def test_weights_and_holdout_are_guarded(spark):
    p = panel(spark, {"a": [1, 2, 3]})
    w = spark.createDataFrame([(day(0), "a", 1.5), (day(1), "x", -0.5), (day(9), "a", 0.1)], "date date, asset string, weight double")
    assert weight_faults(w, p).first().asDict() == {"n_short": 1, "n_nonfinite": 0, "n_over": 1, "n_assets": 1, "n_dates": 1}
    with pytest.raises(HoldoutViolation):
        guard(p, Splits("2019-01-01", "2020-01-02"))
    assert guard(p, Splits("2019-01-01", "2020-01-02"), opened=True) is p
    with pytest.raises(ValueError, match="unknown split"):
        Splits().bounds("LATER")
    with pytest.raises(ValueError, match="mode"):
        B.simulate(p, "tomorrow")


def test_simulation_refuses_what_breaks_its_rules(spark):
    p = panel(spark, {"a": [1, 2, 3], "b": [4, 5, 6]})
    early = Splits("2019-01-01", "2030-01-01")
    run = lambda rows, mode="next_close", **how: B.simulate(rows, mode, FREE, rules=B.Rules(**{"splits": early, **how})).count() and B.periods(B.simulate(rows, mode, FREE, rules=B.Rules(**{"splits": early, **how}))).collect()
    good = weighted(p, {"a": [0.5] * 3, "b": [0.5] * 3})
    assert len(run(good)) == 3 and len(run(good, splits=Splits("2019-01-01", "2020-01-02"), opened=True)) == 3
    for rows, how, message in [
        (weighted(p, {"a": [0.8] * 3, "b": [0.8] * 3}), {}, "gross exposure"),
        (weighted(p, {"a": [-0.1] * 3}), {}, "short"),
        (weighted(p, {"a": [float("nan")] * 3}), {}, "finite"),
        (good, {"splits": Splits("2019-01-01", "2020-01-02")}, "holdout"),
        (good.withColumn("open", F.lit(None).cast("double")), {"mode": "next_open"}, "open is missing"),
    ]:
        with pytest.raises(Exception, match=message):
            run(rows, **how)
    assert len(run(weighted(p, {"a": [0.8] * 3, "b": [0.8] * 3}), max_gross=2.0)) == 3


def test_a_month_without_a_rate_raises(spark):
    p = panel(spark, {"a": [1.0] * 40})
    rates = spark.createDataFrame([(DAY, 1.0)], "month date, percent double")
    with pytest.raises(Exception, match="no rate for 2020-02-01"):
        monthly_rf(p, rates).collect()
    got = [r.rf for r in monthly_rf(p.where("date < '2020-02-01'"), rates).collect()]
    assert np.prod([1 + x for x in got]) == pytest.approx(1.01)


def test_look_ahead_is_found(spark):
    p = panel(spark, {"a": list(range(1, 81)), "b": list(range(80, 0, -1))})
    cuts = spark.createDataFrame([(day(40),), (day(60),)], "date date")
    cheat = lambda q: q.withColumn("weight", F.lead("adj_close").over(B.Window.partitionBy("asset").orderBy("date")))
    assert B.look_ahead(lambda q: signals.price_above_sma(q, 10), p, cuts).count() == 0
    assert B.look_ahead(cheat, p, cuts).count() == 4


def series(spark, values, key="k"):
    return spark.createDataFrame([(key, day(i), float(x), 0.0) for i, x in enumerate(values)], "k string, date date, r double, rf double")


def test_drawdown_counts_a_first_loss(spark):
    s = metrics.summarize(series(spark, [-0.1, 0.05, 0.2, -0.05, -0.05, 0.2]), ["k"], 252).first()
    assert s.max_dd == pytest.approx(-0.1) and s.max_dd_len == 2 and s.cvar is None
    assert s.total_return == pytest.approx(0.9 * 1.05 * 1.2 * 0.95 * 0.95 * 1.2 - 1)


def test_constant_returns_bootstrap_exactly(spark):
    won = resample.resample_trades(series(spark, [0.01] * 50), ["k"], "r", ["date"], n_sims=200).first()
    assert won.final_p05 == pytest.approx(1.01**50) and won.prob_loss == 0 and won.dd_p05 == 0
    lost = resample.block_bootstrap(series(spark, [-0.02] * 60), ["k"], n_sims=100).first()
    assert lost.final_p95 == pytest.approx(0.98**60) and lost.prob_dd_25 == 1
    none = resample.block_bootstrap(series(spark, [0.1] * 30), ["k"], n_sims=10).first()
    assert none.n_sims == 0 and none.final_p50 is None


def test_normal_distribution(spark):
    xs = [-9.0, -3.3, -1.0, 0.0, 0.5, 2.0, 8.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").withColumn("p", cdf("x")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=3e-16)
    assert quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_contract_fees(spark):
    rows = spark.createDataFrame([(100, 0.5, False), (1, 0.5, False), (100, 0.05, False), (100, 0.5, True), (100, 0.99, False)], "n int, p double, maker boolean")
    got = [r.f for r in rows.select(I.contract_fee(F.col("n"), F.col("p"), F.col("maker")).alias("f")).collect()]
    assert got == pytest.approx([1.75, 0.02, 0.34, 0.44, 0.07])


def test_tax_carries_losses_forward(spark):
    y = spark.createDataFrame([("k", 2020, 1.1, 0.25), ("k", 2021, 0.8, 0.25), ("k", 2022, 1.3, 0.25)], "k string, year int, growth double, rate double")
    tax = [r["out"].tax for r in folds.after_tax(y, ["k"], "rate").orderBy("year").collect()]
    assert tax == pytest.approx([0.025, 0, 0.25 * 0.043])


def test_asof_takes_the_last_in_time(spark):
    left = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 5.0)], "k string, t double")
    right = spark.createDataFrame([("a", 10.0, 1), ("a", 10.0, 2), ("a", 12.0, 3), ("b", 6.0, 4)], "k string, at double, v int")
    got = {(r.k, r.t): r.v for r in asof_join(left, right, "t", "at", ["k"], ["v"], 8.0, tie="v").collect()}
    assert got == {("a", 10.0): 2, ("a", 20.0): 3, ("b", 5.0): None}
    assert asof_join(left, right, "t", "at", ["k"], ["v"], 7.9).where("t = 20").first().v is None


def test_bucket_probabilities_sum_to_one(spark):
    rows = [("less", None, 60.0)] + [("between", float(f), float(f + 1)) for f in range(60, 70, 2)] + [("greater", 69.0, None)]
    df = spark.createDataFrame([(t, f, c, 64.0, 0.3, None) for t, f, c in rows], "strike_type string, floor_strike double, cap_strike double, txn double, bias double, xnd double")
    p = prediction.with_probability(df, 1.5, 0.5, clip=False)
    assert p.agg(F.sum("p")).first()[0] == pytest.approx(1.0)


def test_faulty_bars_are_reported(spark):
    rows = [("k", day(i), 10.0, 11.0, 9.0, 10.0 + (i % 2), 5.0) for i in range(40) if not 20 <= i < 30]
    rows[3] = ("k", day(3), 10.0, 8.0, 9.0, 10.0, 5.0)
    rows[5] = ("k", day(5), 10.0, 40.0, 9.0, 33.0, 5.0)
    rows[7] = ("k", day(7), 10.0, 11.0, -2.0, -1.0, 5.0)
    rows.append(("k", day(9), 10.0, 11.0, 9.0, 10.0, 5.0))
    found = quality.check_bars(spark.createDataFrame(rows, "k string, date date, open double, high double, low double, close double, volume double"), ["k"])
    names = {r["check"]: r.n for r in found.collect()}
    assert {"duplicate_dates", "high_below_ohlc", "nonpositive_close", "extreme_returns", "calendar_gaps"} <= set(names) and names["duplicate_dates"] == 1
    with pytest.raises(ValueError, match="duplicate_dates"):
        quality.assert_clean(found)


def test_ledgers(spark, tmp_path):
    path = f"{tmp_path}/trials"
    tid = ledger.trial_id("f", "v", {"b": 1, "a": 2}, "u")

    def row(tid, split="DEV+VAL", cost=1.0, sr=0.1, status="tested", at="2020"):
        return (tid, at, "f", "v", "{}", "u", "s", "r", split, cost, 10, 5, 0.1, 1.0, sr, 0.0, 3.0, -0.1, 0.5, "data-mining", status, "")

    new = spark.createDataFrame([row(tid), row(tid, at="2021", sr=9.0), row("needs", status="needs_data"), row(tid, "DEVELOPMENT", sr=7.0)], ledger.TRIALS)
    assert (ledger.log_trials(new, path), ledger.log_trials(new, path)) == (3, 0)
    held = lambda: ledger.load(spark, path, ledger.TRIALS)
    assert ledger.n_trials(held()).first().n == 1 and ledger.sr_variance(held()).first().variance is None
    assert [r.sr_period for r in ledger.trial_srs(held()).collect()] == [0.1]
    more = [row("b", sr=0.2), row("b", cost=2.0, sr=5.0, at="2022"), row("c", cost=2.0, sr=0.3), row("d", "VALIDATION", sr=8.0)]
    assert ledger.log_trials(spark.createDataFrame(more, ledger.TRIALS), path) == 4
    # the selection split alone, each trial's first row, whatever its cost for the variance, at plain costs for the ratios
    assert ledger.sr_variance(held()).first().variance == pytest.approx(0.01)
    assert sorted(r.sr_period for r in ledger.trial_srs(held()).collect()) == [0.1, 0.2]
    assert ledger.trial_id("f", "v", {"a": 2, "b": 1}, "u") == tid
    looks = f"{tmp_path}/looks"
    p = panel(spark, {"a": [1, 2, 3]})
    splits = Splits("2019-01-01", "2020-01-01", "short")
    ledger.open_holdout(p, looks, "s", {}, "d", "why", "2020", splits)
    with pytest.raises(HoldoutViolation, match="look"):
        ledger.open_holdout(p, looks, "s", {}, "d", "again", "2021", splits)
    with pytest.raises(HoldoutViolation, match="no rows"):
        ledger.open_holdout(p, looks, "t", {}, "d", "none", "2021", Splits("2019-01-01", "2021-01-01"))
    (look,) = ledger.load(spark, looks, ledger.LOOKS).collect()
    assert (look.splits, look.holdout_first, look.holdout_last) == ("short", "2020-01-02", "2020-01-03")


def test_parsers_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n2020-01-03,1,2,0.5,.,\n")
    rows = parsers.read_daily_csv(spark, f"{tmp_path}/a.csv").orderBy("date").collect()
    assert rows[0].adj_close == 1.5 and rows[1].close is None
    (tmp_path / "b.csv").write_text("No data\n")
    with pytest.raises(ValueError, match="no daily bars"):
        parsers.read_daily_csv(spark, f"{tmp_path}/b.csv")
    with zipfile.ZipFile(tmp_path / "k.zip", "w") as z:
        z.writestr("k.csv", "1577836800000,1,2,0.5,1.5,10,0,0,0,0,0,0\n1577836800000000,1,2,0.5,2.5,10,0,0,0,0,0,0\n")
    got = parsers.read_zipped_klines(spark, f"{tmp_path}/k.zip").orderBy("close").collect()
    assert [r.ts for r in got] == [dt.datetime(2020, 1, 1)] * 2
    text = json.dumps({"timestamp": [0, 86400], "gmtoffset": 3600, "open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [1, None], "volume": [1, 2]})
    chart = parsers.parse_chart(spark.createDataFrame([("k", text)], "k string, t string"), ["k"], "t").collect()
    assert [(r.date, r.adj_close) for r in chart] == [(dt.date(1970, 1, 1), 1.0)]


def test_streaming_bars(spark, tmp_path):
    events = spark.range(2000).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 300)).alias("ts"), F.lit("x").alias("event_type"), (F.col("id") % 17).cast("double").alias("value"))
    events.write.parquet(f"{tmp_path}/in")
    out = streaming.run_once(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = {r.start: r for r in streaming.bars(events).collect()}
    rows = out.collect()
    assert len(rows) >= len(batch) - 2 and all(r.close == batch[r.start].close and r.volume == batch[r.start].volume for r in rows)


def test_long_series_fold_in_linear_time(spark):
    n = 100_000
    z = F.sin(F.col("id") / 7.0) * 2
    df = spark.range(n).select(F.lit("k").alias("k"), "id", F.when(F.col("id") % 11 != 0, z).alias("z"), (F.col("id") % 13 == 3).alias("go"), (F.col("id") % 5 == 3).alias("stop"))
    began = time.perf_counter()
    mean, held, three = (x.orderBy("id").toPandas() for x in (folds.ema(df, ["k"], "id", "z", 0.2), folds.hysteresis(df, ["k"], "id", "go", "stop"), folds.three_state(df, ["k"], "id", "z", 1.0, 0.5)))
    assert time.perf_counter() - began < 60
    s = state = pair = None
    state, pair = 0, 0
    zs = [None if i % 11 == 0 else math.sin(i / 7.0) * 2 for i in range(n)]
    for i, v in enumerate(zs):
        s = s if v is None else v if s is None else 0.2 * v + 0.8 * s
        go, stop = i % 13 == 3, i % 5 == 3
        state = int(go) if not state else int(not stop)
        if v is not None:
            if pair == 0:
                pair = -1 if v > 1 else 1 if v < -1 else 0
            elif (pair < 0 and v < 0.5) or (pair > 0 and v > -0.5):
                pair = 0
        if i % 997 == 0 or i < 300:
            assert held.out[i] == state and three.out[i] == (0 if v is None else pair)
            assert (s is None and math.isnan(mean.out[i])) or mean.out[i] == pytest.approx(s, abs=1e-9)


@pytest.mark.parametrize("span", [1.0, 7.0, 1000.0])
def test_asof_with_spans_equals_asof_without(spark, span):
    rng = np.random.default_rng(4)
    # one key holds most rows, and long stretches have no right row
    left = spark.createDataFrame([(str(k), i, float(t)) for i, (k, t) in enumerate(zip(rng.choice(3, 400, p=[0.8, 0.1, 0.1]), rng.integers(0, 300, 400)))] + [("0", 999, None)], "k string, i long, t double")
    right = spark.createDataFrame([(str(k), float(t), j) for j, (k, t) in enumerate(zip(rng.choice(3, 60, p=[0.8, 0.1, 0.1]), rng.choice([*range(20, 60), *range(200, 220)], 60)))], "k string, at double, v long")
    how = dict(left_on="t", right_on="at", by=["k"], take=["v", "at"], tie="v")
    for tolerance in (None, 9.0):
        got, want = (sorted(map(tuple, asof_join(left, right, tolerance=tolerance, span=s, **how).collect()), key=str) for s in (span, None))
        assert got == want
    days = left.withColumn("t", F.date_add(F.lit(DAY), F.col("t").cast("int")))
    on = right.withColumn("at", F.date_add(F.lit(DAY), F.col("at").cast("int")))
    got, want = (sorted(map(tuple, asof_join(days, on, tolerance=30, span=s, **how).collect()), key=str) for s in (span, None))
    assert got == want


def test_spread_of_most_likelihood_is_found(spark):
    rng = np.random.default_rng(6)
    xnd = rng.choice([1.0, 2.0, 4.0], 20_000)
    err = np.round(rng.normal(0, np.sqrt(1.2**2 + (0.7 * xnd) ** 2)))
    rows = spark.createDataFrame([(DAY, 60.0 + float(e), 60.0, 0.0, float(x)) for e, x in zip(err, xnd)], "D date, actual double, txn double, bias double, xnd double")
    found = prediction.fit_sigma(rows, "2021-01-01")
    assert found["n"] == 20_000 and found["a"] == pytest.approx(1.2, abs=0.15) and found["c"] == pytest.approx(0.7, abs=0.05)
    assert stats.nelder_mead(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 4, [0.0, 0.0]) == pytest.approx([3, -1], abs=0.05)


def test_bootstraps_have_the_spread_that_follows(spark):
    rng = np.random.default_rng(8)
    r = rng.normal(0.001, 0.01, 500)
    own = series(spark, r)
    log = np.log1p(r)
    draws = resample.resample_trades(own, ["k"], "r", ["date"], n_sims=4000).first()
    mean, sd = 500 * log.mean(), math.sqrt(500) * log.std()
    assert math.log(draws.final_p50) == pytest.approx(mean, abs=0.06 * sd + 0.01)
    assert math.log(draws.final_p95) - math.log(draws.final_p05) == pytest.approx(2 * 1.645 * sd, rel=0.1)
    blocks = resample.block_bootstrap(own, ["k"], n_sims=4000).first()
    assert math.log(blocks.final_p50) == pytest.approx(mean, abs=0.1 * sd + 0.01)
    # blocks keep the order inside them: a series of two long halves stays wider than its shuffled draws
    halves = series(spark, [0.01] * 100 + [-0.01] * 100)
    wide = lambda x: x.final_p95 / x.final_p05
    assert wide(resample.block_bootstrap(halves, ["k"], n_sims=2000).first()) > 2 * wide(resample.resample_trades(halves, ["k"], "r", ["date"], n_sims=2000).first())


def test_levels_and_buying_power(spark):
    kinds = [("debit_spread", -210.0, 0.0, 400.0), ("iron_condor", 150.0, 0.0, 350.0), ("cash_secured_put", 120.0, 5000.0, 4880.0), ("naked_call", 99.0, 0.0, None)]
    df = spark.createDataFrame(kinds, "kind string, cash double, secured double, loss double")
    got = {r.kind: (r.level, r.need) for r in df.select("kind", I.level(F.col("kind")).alias("level"), I.buying_power(F.col("kind"), F.col("cash"), F.col("secured"), F.col("loss")).alias("need")).collect()}
    assert got == {"debit_spread": (3, 210.0), "iron_condor": (3, 350.0), "cash_secured_put": (1, 4880.0), "naked_call": (None, None)}


def test_panel_is_made_in_one_scan(spark):
    from brassloom.sources.tables import order_panel

    plan = order_panel(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()


def test_trades_are_kept_by_variant(spark, tmp_path):
    path = f"{tmp_path}/trades"
    rows = lambda k: spark.createDataFrame([(v, float(i), k) for v in ("a", "b") for i in range(3)], "variant string, pnl double, run int")
    cache.write_trades(rows(1), path)
    cache.write_trades(rows(2).where("variant = 'b'"), path)
    got = {(r.variant, r.run) for r in cache.read_trades(spark, path).collect()}
    assert got == {("a", 1), ("b", 2)} and cache.read_trades(spark, path, "a").count() == 3


def test_fetch_plans_resume(spark):
    listed = spark.createDataFrame([("a", 5.0), ("b", 50.0), ("c", 70.0), ("d", 60.0)], "t string, v double")
    plan = cache.fetch_plan(listed, spark.createDataFrame([("d",)], "t string"), "t", "v", 10.0, 1)
    assert [r.t for r in plan.collect()] == ["c"]
    months = spark.createDataFrame([("k", 1), ("k", 2)], "key string, month int")
    assert [r.month for r in cache.months_missing(months, months.where("month = 1")).collect()] == [2]


def test_runner_scores_on_a_common_window_and_logs(spark, tmp_path):
    rng = np.random.default_rng(2)
    p = panel(spark, {a: np.cumprod(1 + rng.normal(0.001, 0.01, 120)) * 100 for a in "xy"})
    half = lambda n: lambda q: signals.scaled(signals.price_above_sma(q, n), 0.5)
    trials = [runner.Trial("trend", f"sma{n}", half(n), {"n": n}, n) for n in (5, 30)]
    splits = Splits("2020-03-15", "2020-04-29", "t")
    scores = runner.score(p, trials, splits, 252, FREE, "next_close", B.Rules(splits=splits, opened=True))
    rows = runner.trial_rows(scores, trials, "u", "s", "2020")
    found = {(r.variant, r.split): r for r in rows.collect()}
    assert len(found) == 6 and {r.data_range[:10] for (_, s), r in found.items() if s != "VALIDATION"} == {str(day(30))}
    path = f"{tmp_path}/trials"
    assert (ledger.log_trials(rows, path), ledger.log_trials(rows, path)) == (6, 0)
    assert ledger.n_trials(ledger.load(spark, path, ledger.TRIALS)).first().n == 2


def test_chosen_checks_of_bars(spark):
    """A low of 0 is an issue of the operator, and of no query whose SQL doesn't look at lows."""
    from brassloom.plans import data_queries

    day = [(dt.date(2024, 1, 1 + i), "a", 1.0, 2.0, 0.0, 1.0, 1.0) for i in range(3)]
    bars = spark.createDataFrame(day, "date date, asset string, open double, high double, low double, close double, volume double")
    assert {r.check for r in quality.check_bars(bars, ["asset"]).collect()} >= {"nonpositive_low"}
    assert quality.check_bars(bars, ["asset"], checks=data_queries._MADE).collect() == []
    with pytest.raises(ValueError, match="unknown"):
        quality.check_bars(bars, ["asset"], checks=("lows",))


def test_a_mean_at_a_border_stays_there(spark):
    """The mean of these is 60, but the sum of the doubles depends on their order."""
    from brassloom.plans.market_queries import _exact_mean

    values = [0.1, 0.2, 0.3, 119.9, 119.8, 119.7, 54.77, 65.23, 60.07, 59.93] * 30
    orders = [values, values[::-1], sorted(values), sorted(values, key=lambda x: -x), sorted(values, key=lambda x: abs(x - 60))]
    assert any(sum_in_order(o) != 60.0 * len(o) for o in orders)
    df = spark.createDataFrame([(k, x) for k, o in enumerate(orders) for x in o], "k int, value double").coalesce(1)
    assert {r.m for r in df.groupBy("k").agg(_exact_mean("value").alias("m")).collect()} == {60.0}
    odd = spark.createDataFrame([(0, None), (1, float("inf")), (1, 2.0), (2, 1e300), (2, 1e300)], "k int, value double")
    assert {r.k: r.m for r in odd.groupBy("k").agg(_exact_mean("value").alias("m")).collect()} == {0: None, 1: float("inf"), 2: 1e300}


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total


def test_positions_take_more_tasks_when_the_table_grows(spark, monkeypatch):
    from brassloom.plans import market_queries

    sf = "/root/testdata/sf0.001"
    before = sorted(tuple(r) for r in market_queries.o_required(spark, sf).collect())
    monkeypatch.setattr(market_queries, "TASK_ROWS", 300)
    assert market_queries._by_position(spark, sf).rdd.getNumPartitions() >= 20
    assert market_queries._pnl(spark, sf).rdd.getNumPartitions() >= 20
    assert [r[0] for r in sorted(tuple(r) for r in market_queries.o_required(spark, sf).collect())] == [r[0] for r in before]


def test_forecast_parts_are_bounded(spark, tmp_path, monkeypatch):
    """Many short parts and few long ones give the same forecasts."""
    from brassloom.plans import data_queries, registry

    e = spark.range(400).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 300)).alias("ts"), (F.col("id") % 2).alias("user_id"), (F.col("id") % 90 + 0.25).alias("value"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    texts, parse = [], data_queries.forecasts.parse_forecasts
    monkeypatch.setattr(data_queries.forecasts, "parse_forecasts", lambda parts, *a: (texts.append(parts.agg(F.max(F.length("text"))).first()[0]), parse(parts, *a))[1])
    rows = []
    for ids in (100_000, 50):
        monkeypatch.setattr(data_queries, "PART_IDS", ids)
        rows.append(sorted(map(str, registry.QUERIES["s_forecast_parts"](spark, str(tmp_path)).collect())))
    assert rows[0] == rows[1] and rows[0] and texts[1] < texts[0]


def test_forecast_parts_are_bounded_where_ids_repeat(spark, tmp_path, monkeypatch):
    """Events that all have one id make short parts as well, and every line is kept."""
    from brassloom.plans import data_queries, registry

    e = spark.range(400).select(F.lit(7).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200)).alias("ts"), F.lit(1).cast("long").alias("user_id"), (F.col("id") % 90 + 0.25).alias("value"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    lines, parse = [], data_queries.forecasts.parse_forecasts
    monkeypatch.setattr(data_queries.forecasts, "parse_forecasts", lambda parts, *a: (lines.append(parts.agg(F.max(F.size(F.split("text", "\n")))).first()[0]), parse(parts, *a))[1])
    rows = []
    for most in (100_000, 50):
        monkeypatch.setattr(data_queries, "PART_IDS", most)
        rows.append(sorted(map(str, registry.QUERIES["s_forecast_parts"](spark, str(tmp_path)).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == e.where("value > 20").count()
    assert lines[0] == 401 and lines[1] < 70
