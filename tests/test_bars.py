"""Bars, features, motion stream, audits, model."""

import datetime as dt
import inspect
import math
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError
from chronoweave.functions.medians import exact_medians
from chronoweave.functions.ordered import by_group, dense_index, in_blocks
from chronoweave.functions.times import as_of
from chronoweave.operators import compare, features, model, motion, rollup
from chronoweave.sources import bars as source
from chronoweave.sources import quotes

START = dt.date(2025, 1, 1)


def walk(n, seed=7, entity="X"):
    random.seed(seed)
    out, close = [], 100.0
    for i in range(n):
        opened = close * (1 + random.uniform(-0.01, 0.01))
        close = opened * (1 + random.uniform(-0.03, 0.03))
        out.append((entity, START + dt.timedelta(days=i), opened, max(opened, close) * 1.01, min(opened, close) * 0.99, close, float(random.randint(1, 10_000))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.struct(schemas.DAILY_BARS))


def pandas_features(pdf):
    """The formulas of the feature table in pandas, one entity."""
    close, volume = pdf["close"], pdf["volume"].replace(0, float("nan"))
    out = pd.DataFrame({"date": pdf["date"]})
    for n in (1, 3, 5, 10, 20):
        out[f"ret_{n}"] = close / close.shift(n) - 1
    for n in (5, 10, 20, 60):
        out[f"ma_{n}_gap"] = close / close.rolling(n).mean() - 1
    for n in (10, 20):
        out[f"volatility_{n}"] = out["ret_1"].rolling(n).std()
    for n in (5, 20):
        out[f"volume_change_{n}"] = volume / volume.rolling(n).mean() - 1
    change = close.diff()
    gain, loss = change.clip(lower=0).rolling(14).mean(), (-change.clip(upper=0)).rolling(14).mean()
    out["rsi_14"] = 100 - 100 / (1 + gain / loss.replace(0, float("nan")))
    fast, slow = close.ewm(span=12, adjust=False).mean(), close.ewm(span=26, adjust=False).mean()
    out["macd"] = fast - slow
    out["macd_signal"] = out["macd"].ewm(span=9, adjust=False).mean()
    mean, std = close.rolling(20).mean(), close.rolling(20).std()
    out["bb_position_20"] = (close - (mean - 2 * std)) / (4 * std)
    return out


def same(spark_df, expected, names, key="date"):
    got = spark_df.select(key, *names).toPandas().sort_values(key).reset_index(drop=True)
    expected = expected.sort_values(key).reset_index(drop=True)
    assert len(got) == len(expected)
    for name in names:
        for a, b in zip(got[name], expected[name]):
            if b is None or math.isnan(b):
                assert a is None or math.isnan(a), name
            else:
                assert a == pytest.approx(b, rel=1e-8, abs=1e-9), name


def test_features_match_pandas_in_one_window_and_in_blocks(spark):
    data = walk(2600)
    bars = frame(spark, data)
    expected = pandas_features(pd.DataFrame(data, columns=["entity", "date", "open", "high", "low", "close", "volume"]))
    plain = features.bar_features(bars, entity="entity", time="date", horizon=1)
    blocked = features.bar_features(bars, entity="entity", time="date", horizon=1, bucket=F.date_trunc("quarter", "date"), block_rows=200)
    same(plain, expected, features.FEATURES)
    same(blocked, expected, features.FEATURES)
    ahead = {r["date"]: r["future_return"] for r in blocked.select("date", "future_return").collect()}
    closes = {row[1]: row[5] for row in data}
    for day, value in ahead.items():
        later = closes.get(day + dt.timedelta(days=1))
        assert value is None if later is None else value == pytest.approx(later / closes[day] - 1)


def test_zero_volume_is_missing_and_flat_prices_have_no_rsi(spark):
    rows = [("X", START + dt.timedelta(days=i), 10.0, 10.0, 10.0, 10.0, 0.0 if i == 3 else 5.0) for i in range(25)]
    out = features.bar_features(frame(spark, rows), entity="entity", time="date", horizon=1).orderBy("date").collect()
    assert out[3]["volume_change_5"] is None and out[7]["volume_change_5"] is None and out[8]["volume_change_5"] == pytest.approx(0.0)
    assert out[24]["rsi_14"] is None and out[24]["bb_position_20"] is None and out[24]["target"] is None and out[23]["target"] == 0


def test_dense_index_equals_row_number(spark):
    rows = [("A" if i % 3 else "B", i // 5, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    got = dense_index(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 7)).collect()
    for key in "AB":
        ordered = sorted((r for r in got if r["k"] == key), key=lambda r: (r["t"], r["id"]))
        assert [r["_i"] for r in ordered] == list(range(len(ordered)))


def test_blocks_give_the_same_neighbours_as_one_window(spark):
    df = spark.createDataFrame([("hot", i, i * i) for i in range(1000)] + [("cold", i, -i) for i in range(7)], "k string, t int, v int")
    plain, block = by_group(df, ["k"], [F.col("t")]), in_blocks(df, ["k"], [F.col("t")], bucket=F.floor(F.col("t") / 90), before=2, after=1, block_rows=16)

    def run(s):
        cols = {"a": F.lag("v", 2).over(s.window), "b": F.lead("v").over(s.window), "c": F.sum("v").over(s.rows(3))}
        return {(r["k"], r["t"]): (r["a"], r["b"], r["c"]) for r in s.with_df(s.df.withColumns(cols)).finish().collect()}

    assert run(plain) == run(block)


def test_exact_medians(spark):
    random.seed(1)
    rows = [(random.choice("ab"), random.choice([1.0, 2.0, 2.0, 2.0, random.random() * 9])) for _ in range(3001)] + [("c", 4.0), ("c", 7.0), ("d", None)]
    out = {r["k"]: r["m"] for r in exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], {"m": F.col("v")}).collect()}
    expected = pd.DataFrame(rows, columns=["k", "v"]).dropna().groupby("k")["v"].median()
    assert out == {k: pytest.approx(v) for k, v in expected.items()}


def test_vendor_rows_localised_units_duplicates_and_order(spark):
    raw = spark.createDataFrame(
        [("2026-01-02", "10", "11", "9", "10.5", "1.2万", 1), ("2026-01-01", "9", "10", "8", "9.5", "1,000", 2),
         ("2026-01-02", "10", "12", "9", "11", "2万", 3), ("bad", "1", "1", "1", "1", "1", 4), ("20260103", "10", "12", "9", "11", "--", 5)],
        "`日期` string, `开盘价` string, `最高价` string, `最低价` string, `收盘价` string, `成交量(手)` string, ingest_seq int")
    parsed = source.parse_vendor_rows(raw, keep=("ingest_seq",)).withColumn("entity", F.lit("X"))
    clean, audit = source.clean_bars(parsed)
    assert [(str(r["date"]), r["close"], r["volume"]) for r in clean.orderBy("date").collect()] == [("2026-01-01", 9.5, 1000.0), ("2026-01-02", 11.0, 20000.0)]
    row = audit.first()
    assert (row["input_rows"], row["output_rows"], row["dropped_rows"], row["unparsed_rows"], row["duplicate_dates"]) == (5, 2, 3, 2, 1)


def test_strict_clean_up_and_gates(spark):
    raw = spark.createDataFrame([("2026-01-01", "10", "9", "8", "9.5", "1")], "date string, open string, high string, low string, close string, vol string")
    with pytest.raises(ContractError, match="contradict"):
        source.convert_bars(raw, source.Provenance("s", "X"))
    bars, audit = source.convert_bars(raw, source.Provenance("s", "X"), strict=False)
    row = audit.first()
    assert bars.isEmpty() and row["broken_rows"] == 1 and row["findings"] == [("broken_rows", 1)]
    assert row["provenance"]["symbol"] == "X" and ("volume", "vol") in row["headers"]
    for bad in ({"frequency": "5m"}, {"source": " "}, {"symbol": ""}):
        with pytest.raises(ContractError):
            source.Provenance(**({"source": "s", "symbol": "X"} | bad))


def test_header_resolution():
    assert source.resolve_headers(["交易日期", "Open Price", "HIGH", "low", "last", "VOL"])["close"] == "last"
    with pytest.raises(ContractError, match="no header"):
        source.resolve_headers(["date", "open"])
    with pytest.raises(ContractError, match="several fields"):
        source.resolve_headers(["date", "open", "high", "low", "close", "volume"], {"open": "close"})
    with pytest.raises(ContractError, match="unknown mapping"):
        source.resolve_headers(["date"], {"price": "date"})


def test_load_bars_and_exports(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Volume\n2026-01-01,1,2,1,1.5,10\n2026-01-01,1,2,1,1.6,10\n2026-01-02,x,2,1,1.5,10\n")
    bars = source.load_bars(spark, str(tmp_path), entity_from_path=True).collect()
    assert [(r["entity"], r["close"]) for r in bars] == [("AAA", 1.6)]
    out = tmp_path / "exports"
    out.mkdir()
    (out / "E1.csv").write_text("exported by terminal\n\n日期,开盘,最高,最低,收盘,成交量\n2026-01-01,1,2,1,1.5,2万\n2026-01-02,1,2,1,1.7,--\n", encoding="utf-8")
    (out / "E2.csv").write_text("date,close,open,high,low,vol\n2026-01-03,1.5,1,2,1,3\n")
    got = {(r["entity"], str(r["date"])): (r["close"], r["volume"]) for r in source.read_exports(spark, str(out)).collect()}
    assert got == {("E1", "2026-01-01"): (1.5, 20000.0), ("E2", "2026-01-03"): (1.5, 3.0)}
    for text, lacks in (("no header here\n1,2,3\n", "header"), ("date,close\n2026-01-01,1\n", "volume")):
        (out / "E3.csv").write_text(text)
        with pytest.raises(ContractError, match=lacks):
            source.read_exports(spark, str(out))


@pytest.mark.parametrize("long", ["a", "b"])
def test_later_file_wins_whatever_its_size(spark, tmp_path, long):
    head = "date,open,high,low,close,volume\n"
    for name, price in (("a", 1.5), ("b", 1.7)):
        more = "".join(f"2025-01-{d:02d},1,2,1,1.5,10\n" for d in range(1, 29)) * (50 if name == long else 0)
        (tmp_path / f"{name}.csv").write_text(head + more + f"2026-01-01,1,2,1,{price},10\n")
    bars = {str(r["date"]): r["close"] for r in source.load_bars(spark, str(tmp_path), entity="X").collect()}
    assert bars["2026-01-01"] == 1.7


def test_quotes(spark):
    raw = spark.createDataFrame([("600000", "浦发", "10.5", "-")], "`代码` string, `名称` string, `最新价` string, `量比` string")
    row = quotes.normalise_snapshot(raw, fetched_at="2026-01-01T00:00:00").first()
    assert (row["symbol"], row["price"], row["volume_ratio"]) == ("600000.SH", 10.5, None)
    shaped = quotes.shape_realtime(spark.createDataFrame([("1", "2.5", "7")], "ThsCode string, Latest string, trade_volume string")).first()
    assert (shaped["symbol"], shaped["price"], shaped["volume"]) == ("1", 2.5, 7.0)
    with pytest.raises(ContractError):
        quotes.shape_realtime(spark.createDataFrame([("1",)], "x string"))


def test_motion_round_trip_ids_and_future_perturbation(spark):
    data = walk(90)
    stream = motion.market_stream(frame(spark, data), provenance={"source": F.lit("feed"), "market": F.lit("m"), "adjustment": F.lit("none"), "volume_unit": F.lit("lot")})
    changed = data[:-1] + [data[-1][:2] + tuple(v * 5 for v in data[-1][2:])]
    again = motion.market_stream(frame(spark, changed), provenance={"source": F.lit("feed"), "market": F.lit("m"), "adjustment": F.lit("none"), "volume_unit": F.lit("lot")})
    cut = str(data[-2][1])
    assert {tuple(r) for r in as_of(stream, cut).collect()} == {tuple(r) for r in as_of(again, cut).collect()}
    back = {r["event_time"]: r for r in motion.stream_to_bars(stream).collect()}
    assert all(back[str(row[1])]["close"] == row[5] and back[str(row[1])]["volume"] == row[6] for row in data)
    assert stream.select("quality_status").distinct().first()[0] == "usable_with_declared_provenance"
    blocked = motion.market_stream(frame(spark, data), provenance={"source": F.lit("feed"), "market": F.lit("m"), "adjustment": F.lit("none"), "volume_unit": F.lit("lot")}, bucket=F.date_trunc("month", "date"))
    assert {r["event_id"]: round(r["value"], 9) for r in blocked.collect()} == {r["event_id"]: round(r["value"], 9) for r in stream.collect()}
    with pytest.raises(ContractError, match="unique"):
        motion.merge_streams(spark, stream, stream)
    with pytest.raises(ContractError):
        source.require_sound_bars(frame(spark, [data[0][:2] + (-1.0,) + data[0][3:]]))


def test_sources_compared(spark):
    data = walk(40)
    left, right = frame(spark, data), frame(spark, [r[:6] + (r[6] * 100,) for r in data[:-1]] + [data[-1][:5] + (data[-1][5] + 1, data[-1][6] * 100)])
    row = compare.compare_sources(left, right, entity="entity", day="date").first()
    assert (row["overlap_rows"], row["price_match_rows"], str(row["last_mismatch"])) == (40, 39, str(data[-1][1]))
    assert row["volume_ratio_median"] == pytest.approx(100) and row["scaled_volume_diff_max"] == pytest.approx(0) and row["close_max_diff"] == pytest.approx(1)
    with pytest.raises(ContractError):
        source.require_comparable_bars(left.unionByName(left))
    audit = rollup.rollup_audit(left, right, ["entity", "date"], ["entity"]).first()
    assert (audit["close_exact_days"], audit["ohlcv_exact_days"]) == (39, 0)


def test_model_split_folds_and_curve(spark):
    data = walk(400)
    rows = features.model_rows(features.bar_features(frame(spark, data), entity="entity", time="date")).cache()
    n = rows.count()
    split = model.holdout_split(rows, entity="entity", time="date")
    assert split.filter("is_test").count() == n - int(n * 0.8)
    assert split.filter("is_test").agg(F.min("date")).first()[0] > split.filter("not is_test").agg(F.max("date")).first()[0]
    bounds = [spark.range(1).select(*model.fold_bounds(F.lit(100), k)).first() for k in range(1, 6)]
    assert [(b[0], b[1]) for b in bounds] == [(20, 36), (36, 52), (52, 68), (68, 84), (84, 100)]
    fitted, scored, scores, accuracies = model.train_direction_model(rows, entity="entity", time="date", rounds=2, folds=2)
    assert len(accuracies) == 2 and 0 <= scores.accuracy <= 1 and 0 <= scores.roc_auc <= 1
    assert scores.by_class.agg(F.sum("support")).first()[0] == n - int(n * 0.8)
    assert model.score_latest(fitted, features.bar_features(frame(spark, data), entity="entity", time="date", horizon=None), entity="entity", time="date").count() == 1
    with pytest.raises(Exception, match="fewer than"):
        model.holdout_split(rows.limit(50), entity="entity", time="date").collect()
    series = [0.1, -0.5, None, -1.0, 0.2]
    df = spark.createDataFrame([("X", i, r) for i, r in enumerate(series)], "e string, t int, r double")
    curve = [r["g"] for r in model.growth_curve(df, "r", entity="e", time="t", name="g").orderBy("t").collect()]
    assert curve == [pytest.approx(1.1), pytest.approx(0.55), pytest.approx(0.55), 0.0, 0.0]
    flips = spark.createDataFrame([("X", i, r) for i, r in enumerate([-3.0, 0.5, -2.0])], "e string, t int, r double")
    assert [r["g"] for r in model.growth_curve(flips, "r", entity="e", time="t", name="g").orderBy("t").collect()] == [pytest.approx(-2), pytest.approx(-3), pytest.approx(3)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables not present")
def test_gbt_eval_trains_the_whole_model(spark, monkeypatch):
    from oracle_check import compare, duck

    from chronoweave.plans import ORACLES, QUERIES

    folder, train, asked = "/root/testdata/sf0.01", model.train_direction_model, []

    def short(*args, **given):
        bound = inspect.signature(train).bind(*args, **given)
        bound.apply_defaults()
        asked.append((bound.arguments["rounds"], bound.arguments["folds"]))
        return train(*args, **given | {"rounds": 1})

    monkeypatch.setattr(model, "train_direction_model", short)
    rows = QUERIES["gbt_eval"](spark, folder).collect()
    assert asked == [(200, 5)]
    parts = QUERIES["gbt_folds"](spark, folder).groupBy("fold").agg(F.sum("valid_rows").alias("n"), F.sum("valid_up").alias("up"), F.sum("train_rows").alias("t")).collect()
    parts = {r["fold"]: r for r in parts}
    assert {(r["fold"], r["class"]): r["support"] for r in rows} == {
        (0, 0): parts[0]["n"] - parts[0]["up"], (0, 1): parts[0]["up"], **{(k, None): parts[k]["n"] for k in range(1, 6)}}
    assert all(0 <= r["accuracy"] <= 1 and r["train_rows"] == parts[r["fold"]]["t"] for r in rows)
    assert compare(spark, duck(folder), folder, QUERIES["gbt_folds"], ORACLES["gbt_folds"]) is None
