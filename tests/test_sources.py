import json
import math

from pyspark.sql import functions as F

from windprint.sources import dumps, text
from windprint.streaming import incremental as inc

CASE = "Description = demo, 2 x 2\n#--GRID\ndx = 24.5 # spacing\ndt=0.02\nNx = 186 # 186 x 24 m\ninPath = ./\ninFile = RST.7\n"
REPORT = "header\n  footprint-weighted land-cover share (x):\n    water          0.03%   (domain area share  0.64%)\n    solar array    7.32%   (domain area share  0.71%)\n  next\n    water   9.00%   (domain area share  9.00%)\n"


def lines(spark, path, content):
    path.write_text(content)
    return text.numbered_lines(text.read_lines(spark, str(path)))


def test_case_file(spark, tmp_path):
    p = text.parse_case(lines(spark, tmp_path / "a.in", CASE), ["path"])
    kv = {r.key: (r.value, r.comment) for r in p.collect()}
    assert kv["dx"] == ("24.5", "spacing") and kv["dt"] == ("0.02", None) and kv["Nx"] == ("186", "186 x 24 m") and len(kv) == 6
    have = spark.createDataFrame([("./RST.1",)], "name string")
    assert [r.name for r in text.missing_restarts(p, have, "path").collect()] == ["./RST.7"]
    assert text.missing_restarts(p, have.union(spark.createDataFrame([("./RST.7",)], "name string")), "path").count() == 0


def test_cover_report_stops_at_the_first_other_line(spark, tmp_path):
    got = {r.cover: (r.share_pct, r.area_pct) for r in text.cover_report(lines(spark, tmp_path / "r.txt", REPORT)).collect()}
    assert got == {"water": (0.03, 0.64), "array": (7.32, 0.71)}


def test_log_tokens(spark, tmp_path):
    (tmp_path / "ok.log").write_text("inFile = x\nstep 1\nsimulation is complete\n")
    (tmp_path / "nan.log").write_text("u = nan \nsimulation is complete\n")
    (tmp_path / "cut.log").write_text("step 1\n")
    s = text.score_log(text.log_lines(spark, str(tmp_path)), ["path"])
    got = {r.path.rsplit("/", 1)[1]: r.verdict for r in s.collect()}
    assert got == {"ok.log": "OK", "nan.log": "REJECTED", "cut.log": "REJECTED"}


def test_result_files_of_both_generations(spark, tmp_path):
    new = {"stats": {"L": "INF", "h": 900.0}, "les": {"centroid_e": 1.0, "area80_ha": 2.0}, "cover_share": {"water": 0.5}, "cover_share_nowrap": {"water": 0.1}}
    body = json.dumps(new).replace('"INF"', "Infinity")
    (tmp_path / "new.json").write_text(body)
    (tmp_path / "old.json").write_text(json.dumps({"les": {"centroid_x": 3.0, "x80_near": 30.0}, "cover_share": {"water": 0.3}, "cover_share_nowrap": {}}))
    df = dumps.result_files(spark, str(tmp_path))
    r = {x.tag: x for x in df.collect()}
    assert math.isinf(r["new"].stats.L) and r["new"].les.centroid_x is None and r["old"].les.centroid_x == 3.0
    assert {(x.tag, x.share) for x in dumps.cover_shares(df).collect()} == {("new", 0.1), ("old", 0.3)}


def test_dump_series_and_newest_file(spark, tmp_path):
    base = spark.createDataFrame([(1.0, 2.0)], "u double, w double")
    for step, df in ((8, base.withColumn("ht", F.lit(0.1))), (120, base)):
        (tmp_path / "s").mkdir(exist_ok=True)
        df.toPandas().to_parquet(tmp_path / "s" / f"WIN.{step}.parquet")
    got = dumps.dump_series(spark, str(tmp_path / "s"), ["u", "ht"], dt=0.5).orderBy("step").collect()
    assert [(r.step, r.t, r.ht) for r in got] == [(8, 4.0, 0.1), (120, 60.0, None)]
    assert dumps.newest_file(spark, str(tmp_path / "s")).first().path.endswith("WIN.120.parquet")


def test_resume_lists(spark):
    tags = spark.createDataFrame([("wN",), ("wE",), ("wS",)], "tag string")
    done = spark.createDataFrame([("wE",)], "tag string")
    assert sorted(r.tag for r in dumps.pending(tags, done).collect()) == ["wN", "wS"]
    assert [r.tag for r in dumps.pending(tags, done, ["wS", "wE"]).collect()] == ["wS"]
    assert [r.tag for r in dumps.with_results(tags, done).collect()] == ["wE"]


def test_sinks_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 1, 2.0), ("b", 1, 1, 3.0)], "run_id string, j long, i long, f double")
    dumps.write_footprint(cells, cells.groupBy("run_id").agg(F.sum("f").alias("s")), str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o" / "cells")).select(cells.columns)
    assert back.exceptAll(cells).count() == 0 and spark.read.json(str(tmp_path / "o" / "summary")).count() == 2


def test_micro_batches_equal_one_batch(spark, tmp_path):
    rows = [("r", s, k, j, i, float((s * 7 + k * 5 + j * 3 + i) % 11)) for s in range(4) for k in range(2) for j in range(3) for i in range(3)]
    df = spark.createDataFrame(rows, "run_id string, step long, k long, j long, i long, w double")
    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):  # every dump arrives in three pieces
        df.where(F.pmod(F.col("i"), F.lit(3)) == n).coalesce(1).toPandas().to_parquet(src / f"part{n}.parquet")
    stream = inc.stream_parquet(spark, str(src), df.schema, files_per_trigger=1)
    table = inc.run_updates(inc.dump_gate(stream), str(tmp_path / "out"), inc.gate_alerts)
    got = {r.step: (round(r.ratio, 9), r.status, r.n_cells) for r in inc.latest(spark, table, ["run_id", "step"]).collect()}
    want = {r.step: (round(r.ratio, 9), r.status, r.n_cells) for r in inc.gate_alerts(inc.dump_gate(df)).collect()}
    assert got == want and len(got) == 4
    assert spark.read.option("basePath", table).parquet(table).select("batch").distinct().count() == 3
