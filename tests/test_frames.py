"""DataFrame operators on small tables, readers and writers on small files, the stream against the batch."""

import datetime
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import kernels as kn
from pulseloom.functions import scalars as sc
from pulseloom.operators import framing as fr
from pulseloom.operators import metrics as me
from pulseloom.operators import models as mo
from pulseloom.operators import prep
from pulseloom.operators import relational as rel
from pulseloom.operators import stats as st
from pulseloom.operators import waveforms as wf
from pulseloom.operators.neighbours import nearest
from pulseloom.sources import readers, writers
from pulseloom.streaming.sections import stream_fold, windowed_counts
from tests.test_kernels import ecg


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def samples(spark, x, record="a"):
    return spark.createDataFrame([(record, i, float(v)) for i, v in enumerate(x)], "record_id string, idx long, v double")


@pytest.mark.parametrize("n,want", [(260, [(0, 100), (80, 180), (160, 260)]), (261, [(0, 100), (80, 180), (160, 260), (240, 261)]), (60, [(0, 60)])])
def test_segment(spark, n, want):
    got = fr.segment(spark.createDataFrame([("a", n)], "record_id string, n long"), 10.0, 10.0, 0.2, 2.0)
    assert [(r.start_point, r.end_point) for r in got.orderBy("wave_section").collect()] == want


def test_segment_stretched(spark):
    got = fr.segment(spark.createDataFrame([("a", 250)], "record_id string, n long"), 10.0, 10.0, 0.2, -1)
    assert [(r.start_point, r.end_point) for r in got.orderBy("wave_section").collect()] == [(0, 100), (80, 250)]


def test_segment_in_sql(spark):
    from pulseloom.functions.tables import register

    register(spark)
    for n, least in ((260, 2.0), (261, 2.0), (60, 5.0), (250, -1.0)):
        got = spark.sql(f"SELECT start_point, end_point FROM segment({n}, 10.0, 10.0, 0.2, {least})")
        want = fr.segment(spark.createDataFrame([("a", n)], "record_id string, n long"), 10.0, 10.0, 0.2, least)
        assert rows(got) == rows(want.select("start_point", "end_point"))


def test_rolling_median(spark):
    x = np.random.default_rng(0).normal(size=120)
    got = {r.idx: r.rolling_med for r in fr.rolling_median(samples(spark, x)).collect()}
    for i in range(120):
        want = np.median(x[0:41] if i < 20 else x[79:119] if i + 21 >= 120 else x[i - 20 : i + 21])
        assert got[i] == pytest.approx(want), i


def test_lookback_case(spark):
    p = spark.createDataFrame([("a", r, int(r != 6000)) for r in range(1000, 10000, 1000)], "record_id string, r_idx long, valid int")
    assert [r.r_idx for r in fr.valid_lookback(p, 1999, "record_id").orderBy("r_idx").collect()] == [7000, 8000, 9000]
    assert fr.valid_lookback(p, 10**6, "record_id").isEmpty()


def test_qtc_and_qtvi(spark):
    q = spark.createDataFrame([(400, 1000), (300, 500), (400, 0), (None, 5)], "qt int, rr int").select(sc.qtc(F.col("qt"), F.col("rr")).alias("q"))
    assert sorted(r.q for r in q.collect()) == [0, 0, 400, 424]
    v = spark.createDataFrame([("a", 400.0, 1000.0), ("a", 405.0, 950.0), ("a", 395.0, 1050.0), ("a", 410.0, 900.0), ("b", 400.0, 1000.0), ("b", None, 1000.0), ("b", math.nan, 1000.0)], "k string, qt double, rr double")
    got = {r.k: r.qtvi for r in st.qtvi(v, "k").collect()}
    assert got["b"] is None and not math.isnan(got["a"])


def test_safe_mean_skips_nan(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,), (2.0,)], "x double")
    assert df.agg(st.safe_mean(F.col("x"), 1).alias("m")).first().m == 1.5


def test_stitch_and_pad(spark):
    blocks = spark.createDataFrame([("e", 1, [3.0]), ("e", 0, [1.0, 2.0]), ("f", 0, [9.0])], "channel string, block int, samples array<double>")
    assert rows(rel.stitch_blocks(blocks)) == [("e", 0, 1.0), ("e", 1, 2.0), ("e", 2, 3.0), ("f", 0, 9.0)]
    padded = writers.pad_channels(rel.stitch_blocks(blocks).withColumn("record_id", F.lit("r")))
    assert padded.count() == 6


def test_running_sum_and_spearman(spark):
    x = np.random.default_rng(0).integers(0, 9, size=(200, 2))
    df = spark.createDataFrame([(int(a), int(a + b)) for a, b in x], "a int, b int")
    rank = lambda v: np.array([np.mean(np.flatnonzero(np.sort(v) == q)) for q in v])
    want = np.corrcoef(rank(x[:, 0]), rank(x.sum(1)))[0, 1]
    assert st.spearman(df, ["a", "b"]).first().rho == pytest.approx(want)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.2), (1, 0, 0.4), (0, 0, 0.4)], "label int, prediction int, score double")
    got = me.summary(df).first()
    assert got.accuracy == 0.75 and got.balanced_accuracy == 0.75 and got.mcc == pytest.approx(1 / math.sqrt(3))
    assert me.roc_auc(df).first().auc == pytest.approx(0.875)
    assert me.roc_points(df).count() == 3


def test_prep(spark):
    df = spark.createDataFrame([(i, float(i % 7), "s" + str(i % 3)) for i in range(60)], "i int, x double, s string")
    assert prep.outliers(df, ["x"], 0.1).count() < 60
    assert abs(prep.scaled(df, ["x"], "standard").agg(F.avg("x")).first()[0]) < 1e-12
    assert prep.transformed(df.withColumn("x", F.exp("x")), "x", "boxcox").count() == 60
    assert abs(prep.power_lambda(df.withColumn("x", F.exp("x")), "x", "boxcox")) < 0.3
    assert prep.vif(df.withColumn("y", F.col("x") * 2), ["x", "y"])[0][1] == math.inf
    folds = df.select("s", prep.group_fold(F.col("s"), 3).alias("f")).distinct()
    assert folds.count() == 3


def test_models(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(i % 2), float(rng.normal(3 * (i % 2))), float(rng.normal()), i % 3) for i in range(120)]
    df = spark.createDataFrame(data, "id int, label double, a double, b double, fold int").cache()
    assert mo.out_of_fold(df, ["a", "b"], "forest", numTrees=5).where("prediction = label").count() > 90
    model = mo.pipeline(["a", "b"], "logistic").fit(df)
    assert mo.importances(model, ["a", "b"])[0][0] == "a"
    votes = mo.soft_vote([mo.probabilities(model, df, "id"), mo.probabilities(mo.pipeline(["a", "b"], "forest").fit(df), df, "id")], "id")
    assert votes.count() == 120
    odd = mo.isolation_forest(df.select("id", "a", "b").union(spark.createDataFrame([(999, 50.0, 50.0)], "id int, a double, b double")), ["a", "b"], trees=20)
    assert odd.orderBy(F.desc("anomaly")).first().id == 999
    best, score, every = mo.grid_search(df, ["a", "b"], "forest", {"numTrees": [3, 5]})
    assert len(every) == 2 and score > 0.7
    wide, names = mo.fourier_features(df, ["a", "b"], 0.5, 16)
    assert mo.pipeline(names, "svm", "s", maxIter=5).fit(wide).transform(wide).where("prediction = label").count() > 80


def sections(spark):
    x, _ = ecg(60.0, noise=0.005)
    s = samples(spark, x)
    both = fr.section_join(fr.rolling_median(s), 250.0, 10.0).select("record_id", "wave_section", "idx", "v", "rolling_med")
    return wf.section_arrays(both), wf.section_arrays(both, "rolling_med")


def test_engine_and_stream_agree(spark, tmp_path):
    waves, meds = sections(spark)
    payload = wf.quality_rows(waves, meds, 250.0).cache()
    folded = wf.history_fold(payload, 250.0).cache()
    assert folded.where("valid = 1").count() >= 3
    beats = wf.extract_beats(waves, meds, folded, 250.0)
    assert beats.where("valid_qrs").count() > 15
    assert beats.where("QT between 200 and 600").count() > 15
    payload.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_fold(spark.readStream.schema(payload.schema).parquet(str(tmp_path / "in")), 250.0)
    run = stream.writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    pick = lambda df: rows(df.select("record_id", "wave_section", "valid", "reason"))
    assert pick(spark.table("folded")) == pick(folded)


def test_windows_run_on_streams(spark, tmp_path):
    events = spark.createDataFrame([(datetime.datetime(2024, 1, 1, h, 5), "view", float(h)) for h in range(5)], "ts timestamp, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert rows(spark.table("windows")) == rows(windowed_counts(events))


def test_wfdb_files(spark, tmp_path):
    values = np.array([[0, 5], [100, -7], [-200, 2047], [50, -2048]])
    (tmp_path / "a.hea").write_text("a 2 360 4\na.dat 16 200(10)/mV 12 10 0 0 0 MLII\na.dat 16 100/mV 12 0 0 0 0 V5\n")
    (tmp_path / "a.dat").write_bytes(values.astype("<i2").tobytes())
    packed = bytearray()
    for x, y in values:
        x, y = int(x) & 0xFFF, int(y) & 0xFFF
        packed += bytes([x & 0xFF, (x >> 8) | (y >> 8) << 4, y & 0xFF])
    (tmp_path / "b.hea").write_text("b 2 360 4\nb.dat 212 200(10)/mV 12 10 0 0 0 MLII\nb.dat 212 100/mV 12 0 0 0 0 V5\n")
    (tmp_path / "b.dat").write_bytes(bytes(packed))
    got = readers.read_wfdb(spark, str(tmp_path), None)
    for record in "ab":
        first = [r.v for r in got.where(f"record_id = '{record}' and channel = 'MLII'").orderBy("idx").collect()]
        assert first == [(v - 10) / 200 for v in (0, 100, -200, 50)]
        assert [r.v for r in got.where(f"record_id = '{record}' and channel = 'V5'").orderBy("idx").collect()] == [5 / 100, -7 / 100, 20.47, -20.48]
    assert readers.read_wfdb(spark, str(tmp_path)).select("channel").distinct().count() == 1


@pytest.mark.parametrize("order", "<>")
def test_embla_files(spark, tmp_path, order):
    record = lambda number, body: struct.pack(order + "Ll", number, len(body)) + body
    data = np.array([1, -2, 300], order + "i2").tobytes()
    when = struct.pack(order + "h", 2024) + bytes([2, 3, 4, 5, 6, 7])
    raw = b"Embla data file\x1a" + (b"\xff" if order == ">" else b"\x00") + record(readers.TIME, when) + record(readers.FREQUENCY, struct.pack(order + "L", 1000)) + record(readers.GAIN, struct.pack(order + "l", 1_000_000)) + record(readers.NAME, b"ECG\x00") + record(readers.DATA, data) + record(readers.TIME, when) + record(readers.DATA, data[:4])
    (tmp_path / "x.ebm").write_bytes(raw)
    got = readers.read_embla(spark, str(tmp_path)).orderBy("block", "idx").collect()
    assert [(r.block, r.idx, round(r.v, 6)) for r in got] == [(0, 0, 0.001), (0, 1, -0.002), (0, 2, 0.3), (1, 0, 0.001), (1, 1, -0.002)]
    heads = readers.read_embla_headers(spark, str(tmp_path)).orderBy("block").collect()
    assert heads[0].stoptime - heads[0].starttime == datetime.timedelta(seconds=3) and heads[1].length == 2
    with pytest.raises(ValueError):
        readers.parse_embla(b"something else")


@pytest.mark.parametrize("date", ["2024-02-03", "03/02/2024"])
def test_rr_files(spark, tmp_path, date):
    (tmp_path / "n.rri").write_text(f"RR\nfile\ndate={date}\ntime=04:05:06\nfreq=200\nmore=1\n-----\n100\tN\n310\tV\n")
    got = readers.read_rr(spark, str(tmp_path / "n.rri")).orderBy("rposition").collect()
    assert [(r.rposition, r.marker, r.freq) for r in got] == [(100, "N", 200), (310, "V", 200)] and got[0].start == datetime.datetime(2024, 2, 3, 4, 5, 6)


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1, ""), ("b", 0, 0, "no_sig")], "record_id string, wave_section int, valid int, fail_reason string")
    writers.save_results(df, str(tmp_path / "r"), "2024-01-01")
    writers.save_results(df.where("valid = 1"), str(tmp_path / "r"), "2024-01-02")
    assert readers.newest_run(spark, str(tmp_path / "r")).count() == 1
    assert rows(writers.run_summary(df)) == [("fail_reason", "", 1), ("fail_reason", "no_sig", 1), ("valid", "0", 1), ("valid", "1", 1)]
    assert readers.listing(spark, str(tmp_path)) == ["r"]
    (tmp_path / "c.json").write_text(json.dumps({"batch": True}))
    assert readers.load_config(spark, str(tmp_path / "c.json")) == {"batch": True}
    (tmp_path / "old.csv").write_text("0,0,100,1,ok,70.5,1.25,0,0,3.5,1,2\n1,80,180,0,bad,,,,,,,\n")
    old = readers.read_legacy_sections(spark, str(tmp_path / "old.csv")).orderBy("wave_section").collect()
    assert old[0].Avg_HR == 70.5 and old[1].SDNN == 0 and old[0].Avg_ST == 0
    assert "<td>no_sig</td>" in writers.report("t", {"x": df})
    rr = spark.createDataFrame([("a", 10, "N"), ("a", 5, None)], "record_id string, rposition long, marker string")
    writers.save_rr(rr, str(tmp_path / "rr"))
    assert sorted(x for f in (tmp_path / "rr" / "record_id=a").glob("part*") for x in f.read_text().splitlines()) == ["10\tN", "5\t"]
    assert writers.warp_clock(samples(spark, range(10)), 0.1).where("abs(v - idx / 0.9D) > 1e-9").isEmpty()


def test_empty_tables(spark):
    none = samples(spark, [])
    assert fr.section_join(none, 10.0, 10.0).isEmpty() and st.hjorth(none, "record_id").isEmpty() and fr.rolling_median(none).isEmpty()
    assert wf.find_peaks(wf.section_arrays(none.withColumn("wave_section", F.lit(0))), 10.0).isEmpty()


def test_queries_beyond_one_part_are_answered(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, r.normal(size=4).tolist(), i % 3) for i in range(90)], "vec_id long, embedding array<double>, label int")
    asked = df.where("vec_id % 2 = 0")
    got = [sorted(map(tuple, nearest(asked, df, 3, most_queries=n).collect())) for n in (200_000, 10, 1)]
    assert len(got[0]) == 45 * 3 and got[0] == got[1] == got[2]
    assert nearest(asked.limit(0), df, 3).collect() == []


@pytest.mark.parametrize("n,block", [(41, 64), (127, 64), (128, 64), (150, 64), (148, 64), (300, 64), (300, 1000)])
def test_rolling_median_in_blocks(spark, n, block):
    """Ends that lie in another block than the rows they rule, and frames across borders."""
    x = np.random.default_rng(n).normal(size=n)
    both = samples(spark, x).union(samples(spark, x[:100] + 1, "b"))
    got = {(r.record_id, r.idx): r.rolling_med for r in fr.rolling_median(both, block=block).collect()}
    for name, y in (("a", x), ("b", x[:100] + 1)):
        m = len(y)
        for i in range(m):
            want = np.median(y[0:41] if i < 20 else y[m - 41 : m - 1] if i + 21 >= m else y[i - 20 : i + 21])
            assert got[name, i] == pytest.approx(want), (name, i)


@pytest.mark.parametrize("n,block", [(41, 64), (128, 64), (150, 64), (300, 64), (300, 1000)])
def test_rolling_medians_of_dense_signals(spark, n, block):
    both = samples(spark, np.random.default_rng(n).normal(size=n)).union(samples(spark, np.random.default_rng(1).normal(size=90), "b"))
    got = {(r.record_id, r.idx): r.rolling_med for r in wf.rolling_medians(both, block=block).collect()}
    want = {(r.record_id, r.idx): r.rolling_med for r in fr.rolling_median(both, block=block).collect()}
    assert got == pytest.approx(want)


def test_numbers_over_blocks(spark):
    """Positions and lengths are those of one window by key, in many partitions, with a key that holds most rows and null keys."""
    df = spark.range(20_000, numPartitions=7).select(F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 7 == 0, "rare").otherwise("hot").alias("k"), (F.xxhash64("id") % 1000).alias("t"), "id")
    got = fr.numbered(df, "k", "t", "id")
    from pyspark.sql import Window

    w = Window.partitionBy("k")
    want = df.withColumns({"idx": F.row_number().over(w.orderBy("t", "id")) - 1, "n": F.count("*").over(w)})
    assert rows(got.select("k", "id", "idx", "n")) == rows(want.select("k", "id", "idx", "n"))
    assert fr.numbered(df.limit(0), "k", "t", "id").collect() == []


def test_running_sum_over_many_keys(spark):
    df = spark.range(200_000, numPartitions=9).select((F.xxhash64("id") % 1_000_003).alias("x")).distinct().withColumn("n", F.abs(F.col("x") % 5))
    got = st.running_sum(df, "x", "n", "upto").toPandas().sort_values("x")
    assert (got.n.cumsum() == got.upto).all()


def test_quantiles(spark):
    x = np.round(np.random.default_rng(2).normal(size=501), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    q = (0.0, 0.2, 0.25, 0.5, 0.977, 1.0)
    assert list(prep.quantiles(df, "x", q).first()) == pytest.approx(np.quantile(x, q).tolist())
    assert list(prep.quantiles(df.where("x is null"), "x", (0.5,)).first()) == [None]
    assert rows(prep.impute(df, ["x"], "median").where("x is null")) == []


def test_folds_hold_as_many_of_each_class(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], i // 10) for i in range(200)], "id long, y string, g long")
    dealt = prep.folded(df, "stratified", 4, "id", "y").groupBy("y", "fold").count().collect()
    for y in "ab":
        sizes = [r["count"] for r in dealt if r.y == y]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    assert prep.folded(df, "leave_one_group_out", 0, "id", group="g").select("fold").distinct().count() == 20
    split = prep.shuffled(df, "group_shuffle", 3, 0.3, "id", group="g").groupBy("split", "g").agg(F.count_distinct("test").alias("n"))
    assert split.where("n > 1").isEmpty()
    tests = prep.shuffled(df, "stratified_shuffle", 3, 0.25, "id", "y").where("test").groupBy("split", "y").count()
    assert {r["count"] for r in tests.where("y = 'a'").collect()} == {33} and {r["count"] for r in tests.where("y = 'b'").collect()} == {17}


def test_json_results_and_search_log(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"record_id": "a", "section_idx": 1, "hr": 60, "discord_score": 2.5}]\n{"record_id": "b", "m": 9}\n')
    got = rows(readers.read_json_results(spark, str(tmp_path / "r.json")).select("record_id", "section_idx", "discord_score", "m"))
    assert got == [("a", 1, 2.5, None), ("b", None, None, 9)]
    data = [(i, float(i % 2), float(i % 2) + (i % 7) / 10, i % 3) for i in range(90)]
    df = spark.createDataFrame(data, "id int, label double, a double, fold int")
    model, best, scored = mo.search_metrics(df, ["a"], "forest", [{"numTrees": 2}, {"numTrees": 3}])
    assert len(scored) == 2 and {"accuracy", "mcc", "f1_macro"} <= set(scored[0]) and best in ({"numTrees": 2}, {"numTrees": 3}) and model.stages
    writers.save_search_log(spark, scored, str(tmp_path / "log"), "run1")
    writers.save_search_log(spark, scored, str(tmp_path / "log"), "run2")
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_pressure_table_gates_noise(spark):
    """Noise is marked invalid and not measured; the means of clean sections are those of the pulse they are made of."""
    fs, t = 250.0, np.arange(5000) / 250.0
    ph = t % 0.8
    clean = 75 + 40 * np.where(ph < 0.12, np.sin(np.pi / 2 * ph / 0.12) ** 2, np.exp(-(ph - 0.12) * 3)) + 5 * np.exp(-(((ph - 0.4) / 0.04) ** 2))
    noise = 80 + 20 * np.random.default_rng(0).normal(size=5000)
    lad, car = np.full(5000, 0.5), 2 + np.sin(2 * np.pi * t / 0.8)
    df = spark.createDataFrame([("a", 0, 0, clean.tolist(), lad.tolist(), car.tolist()), ("a", 1, 4000, noise.tolist(), lad.tolist(), car.tolist())], "record_id string, wave_section int, start long, wave array<double>, lad array<double>, carotid array<double>")
    got = {r.wave_section: r.asDict() for r in wf.pressure_table(df, fs).collect()}
    assert got[1]["invalid"] == 1 and got[1]["HR"] is None and got[1]["SBP"] is None
    ok = got[0]
    assert ok["invalid"] == 0 and ok["HR"] == 75 and ok["beats"] >= 20
    assert ok["SBP"] == pytest.approx(clean.max(), abs=0.5) and ok["DBP"] == pytest.approx(clean.min(), abs=6)
    assert ok["ap_MAP"] == pytest.approx(ok["DBP"] + (ok["SBP"] - ok["DBP"]) / 3) and ok["shock_gap"] == pytest.approx(ok["true_MAP"] - ok["ap_MAP"])
    assert ok["true_MAP"] == pytest.approx(clean.mean(), abs=2) and ok["lad_mean"] == pytest.approx(0.5) and ok["cvr"] == pytest.approx(ok["true_MAP"] / 0.5)
    assert ok["flow_div"] == pytest.approx(4, abs=0.2) and ok["lad_dia_neg"] == 0 and ok["lad_pi"] == pytest.approx(0) and ok["ri"] is not None
    assert ok["p1_p2"] == pytest.approx(ok["p1"] / ok["p2"], rel=0.05) and 0 < ok["dni"] < 1 and ok["sys_sl"] > 0 > ok["dia_sl"]


def test_engine_on_the_events_has_every_kind_of_section(spark):
    """The registered binding accepts, rejects and goes stale."""
    from pulseloom.plans.waveform_queries import ecg_folded

    got = ecg_folded(spark, "/root/testdata/sf0.01")[2].groupBy("valid", "stale").count().collect()
    kinds = {(r.valid, r.stale) for r in got}
    assert {(1, False), (1, True), (0, False), (0, None)} <= kinds


def test_numbers_when_each_plan_reads_for_itself(spark):
    df = spark.range(0, 400_000, 1, 8).select((F.col("id") % 3).cast("string").alias("k"), (F.xxhash64("id") % 50_000).alias("t"), "id", F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("payload"))
    got = fr.numbered(df, "k", "t", "id").groupBy("k").agg(F.count("*").alias("rows"), F.countDistinct("idx").alias("own"), F.max("idx").alias("last"), F.max("n").alias("n"), F.max("payload").alias("longest"))
    assert [tuple(r)[:5] for r in got.orderBy("k").collect()] == [("0", 133_334, 133_334, 133_333, 133_334), ("1", 133_333, 133_333, 133_332, 133_333), ("2", 133_333, 133_333, 133_332, 133_333)]


def test_blocks_are_in_order(spark):
    df = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") > 9, F.col("id") % 700).alias("t"), "id")
    got = [(r.t is not None, r.t, r.id, r._b) for r in fr.placed(df, "t", "id", bits=4).collect()]
    got.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    assert [r[3] for r in got] == sorted(r[3] for r in got) and {r[3] for r in got} == set(range(16))


def test_ecg_sections_are_made_of_few_rows(spark):
    from pulseloom.plans import waveform_queries as wq

    sf = "/root/testdata/sf0.001"
    rows = fr.section_join(wf.rolling_medians(wq.ecg(spark, sf)), wq.ECG_FS, wq.SECONDS, wq.OVERLAP).groupBy(*fr.KEYS).agg(F.array_sort(F.collect_list(F.struct("idx", "v", "rolling_med"))).alias("r"))
    want = {(r.record_id, r.wave_section): ([x.idx for x in r.r][0], [x.v for x in r.r], [x.rolling_med for x in r.r]) for r in rows.collect()}
    waves, meds = wq.ecg_sections(spark, sf)
    assert want == {(r.record_id, r.wave_section): (r.start, r.wave, r.med) for r in waves.collect()}
    assert {k: v[2] for k, v in want.items()} == {(r.record_id, r.wave_section): r.wave for r in meds.collect()}
    plan = wf.extract_beats(*wq.ecg_folded(spark, sf), wq.ECG_FS)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan  # no sample is shuffled alone
    assert "BroadcastHashJoin" not in plan.split("MapInArrow")[0]


def test_one_profile_whichever_way():
    rng = np.random.default_rng(5)
    for x, m in ((rng.normal(size=300), 20), (np.sin(np.arange(400) * np.pi / 25), 25), (rng.integers(0, 4, 300) + np.arange(300) % 7 * 0.1, 12), (rng.normal(size=30), 28)):
        x = np.asarray(x, float)
        mean, sd = kn._moving(x, m)
        dist, near = kn.matrix_profile(x, m)
        for i in range(len(mean)):
            d = kn._distances(np.array([np.dot(x[i : i + m], x[j : j + m]) for j in range(len(mean))]), m, mean, sd, mean[i], sd[i])
            d[max(0, i - -(-m // 4)) : i + -(-m // 4) + 1] = np.inf
            assert abs(dist[i] - d.min()) < 1e-5 if np.isfinite(d.min()) else dist[i] == np.inf and near[i] == -1
