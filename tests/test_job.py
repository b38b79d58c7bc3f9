"""Whole runs, adapters against a local server, retries and appended batches."""

import csv
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from docmill import __main__ as cli
from docmill import job
from docmill.functions import reply as R
from docmill.operators import analyze, classify, extract, health, provider, sinks
from docmill.session import clear, materialise
from docmill.spec import RunSpec


def write_csv(path, rows, names=("key", "pdf_url", "body", "replay")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(names)
        w.writerows(rows)


def stage_one(n=50):
    return [(i * 3, f"https://a.example/{i}", f"page one {i}\fpage two", json.dumps({"is_annual_report": i % 2 == 0, "reason": f"r{i}"}) if i % 7 else "") for i in range(n)]


def test_a_killed_run_goes_on(spark, tmp_path):
    write_csv(tmp_path / "in.csv", stage_one())
    spec = RunSpec(str(tmp_path / "in.csv"), "out", batch_size=4, start_row=5, end_row=-3)
    args = cli.parser().parse_args(["classify", "--input", "x", "--output", "y", "--replay", "replay", "--text_column", "body"])
    stage = cli.stage_of(args)
    first = job.run(spark, spec, stage, "key", wave=3, waves=1)
    assert not first.finished and job.written(spark, spec).count() == 12
    calls = spark.sparkContext.accumulator(0)

    def counted(df):
        calls.add(df.count())
        return stage(df)

    second = job.run(spark, spec, counted, "key", wave=3)
    assert (second.rows, second.skipped, second.batches, second.finished) == (30, 12, 11, True) and calls.value == 30
    rows = sorted(job.written(spark, spec).collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(5, 47)) and [r.batch_num for r in rows] == [i // 4 + 1 for i in range(42)]
    assert all(r.confidence == ("unknown" if r.pos % 7 else "failed") and (r.classification_reason == f"r{r.pos}" or not r.pos % 7) for r in rows)
    third = job.run(spark, spec, counted, "key", wave=3)
    assert third.rows == 0 and calls.value == 30 and job.written(spark, spec).count() == 42
    assert sinks.latest_runs(spark.read.parquet(job.ledger_of(spec))).count() == 2


def test_command_line(spark, tmp_path, capsys):
    write_csv(tmp_path / "in.csv", stage_one())
    stores = [tmp_path / "a", tmp_path / "b"]
    for s in stores:
        s.mkdir()
    code = cli.main(
        ["classify", "--input", str(tmp_path / "in.csv"), "--output", "out", "--replay", "replay", "--no_extract", "--annual_reports_only", "--end_row", "20"], spark
    )
    assert code == 0 and json.loads(capsys.readouterr().out)["rows"] == 20
    got = [r for f in (tmp_path / "out").glob("part*.csv") for r in csv.DictReader(f.open())]
    assert sorted(int(r["key"]) for r in got) == [i * 3 for i in range(20) if i % 2 == 0 and i % 7]
    answers = {llm: {f"Y{k}": json.dumps({f"Y{k}": v}) for k, v in ((1, "issue"), (2, 5), (3, ["q"]), (4, 3))} for llm in analyze.PROVIDERS}
    write_csv(tmp_path / "two.csv", [(1, "u", "text", json.dumps(answers)), (2, "v", "", json.dumps(answers))])
    assert cli.main(["analyse", "--input", str(tmp_path / "two.csv"), "--output", "two", "--replay", "replay", "--text_column", "body", "--skip_null_text"], spark) == 0
    rows = job.written(spark, RunSpec(str(tmp_path / "two.csv"), "two")).collect()
    assert sorted((r.key, r.llm, r.status, r.y2) for r in rows) == sorted(
        [("1", p, "ok", 5) for p in analyze.PROVIDERS] + [("2", p, "y1_no_text", None) for p in analyze.PROVIDERS]
    )
    with pytest.raises(ValueError):
        job.run(spark, RunSpec(str(tmp_path / "two.csv"), "x", url_column="none"), lambda df: df)


def test_empty_slice_writes_no_rows(spark, tmp_path):
    write_csv(tmp_path / "in.csv", stage_one(4))
    spec = RunSpec(str(tmp_path / "in.csv"), "out", start_row=3, end_row=2)
    done = job.run(spark, spec, lambda df: df, "key")
    assert done.batches == 0 and done.rows == 0 and not (tmp_path / "out").exists()


def test_upload_names_and_outcomes(spark, tmp_path):
    import datetime as dt

    (tmp_path / "in.csv").write_text("a\n1\n")
    at = dt.datetime(2024, 7, 1, 12, tzinfo=dt.UTC)
    assert sinks.object_name("input", at) == "input_2024-07-01 07:00:00 CDT.csv"
    assert sinks.object_name("output", at.replace(month=1)) == "output_2024-01-01 06:00:00 CST.csv"
    got = sinks.copy_to(spark, str(tmp_path / "in.csv"), str(tmp_path / "copy.csv"))
    assert got["ok"] and (tmp_path / "copy.csv").read_text() == "a\n1\n"
    bad = sinks.upload_run(spark, str(tmp_path / "none.csv"), str(tmp_path / "none"), str(tmp_path / "x"), str(tmp_path / "y"))
    assert [b["ok"] for b in bad] == [False, False] and all(b["error"] for b in bad)
    df = spark.createDataFrame([(at,)], "t timestamp")
    assert df.select(sinks.object_key("input", F.col("t"))).first()[0] == "input_2024-07-01 07:00:00 CDT.csv"
    assert df.select(sinks.object_key("input", F.col("t"), "Asia/Tokyo")).first()[0].endswith("21:00:00 UTC+9.csv")


class Once:
    """Bad JSON at first, then a good reply; counts its calls."""

    def __init__(self, acc, bad="{oops", good='{"is_annual_report": true}'):
        self.acc, self.bad, self.good, self.seen = acc, bad, good, {}

    def complete(self, prompt, question, row):
        self.acc.add(1)
        self.seen[prompt] = self.seen.get(prompt, 0) + 1
        return self.bad if self.seen[prompt] == 1 else self.good


def test_unreadable_replies_are_asked_again(spark):
    acc = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, f"u{i}") for i in range(6)], "k int, pdf_url string").coalesce(1)
    again = provider.CallPolicy(tries=3, sleep=lambda s: None)
    out = materialise(classify.classify(df, Once(acc), text=None, policy=again))
    assert {r.status for r in out.collect()} == {"ok"} and acc.value == 12
    out = classify.classify(df, Once(acc), text=None)
    assert {r.status for r in out.collect()} == {"bad_json"}
    out = classify.classify(df, Once(acc, bad="[1]"), text=None, policy=again)
    assert {r.status for r in out.collect()} == {"not_object"}


def test_charset_fences_in_stage_two():
    assert R.decode('`json{"Y2": 1}`', charset=True) == ("ok", {"Y2": 1}) and R.decode('`json{"Y2": 1}`')[0] == "bad_json"
    assert R.decode("null", charset=True)[0] == "bad_json"


class Slow:
    running, most = 0, 0

    def complete(self, prompt, question, row):
        import time

        Slow.running += 1
        Slow.most = max(Slow.most, Slow.running)
        time.sleep(0.02)
        Slow.running -= 1
        return json.dumps({"reason": f"{row['k']} {Slow.most}"})


def test_threads_keep_order_and_the_cap(spark):
    df = spark.createDataFrame([(i, f"u{i}") for i in range(60)], "k int, pdf_url string").repartition(5)
    policy = provider.CallPolicy(threads=4, at_once=4)
    out = classify.classify(df, Slow(), text=None, policy=policy, hints=("k",))
    assert out.rdd.getNumPartitions() == 1  # one task of four threads
    seen = [r.classification_reason.split() for r in materialise(out).collect()]
    assert sorted(int(k) for k, _ in seen) == list(range(60)) and 2 <= max(int(m) for _, m in seen) <= 4


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        if "missing" in self.path:
            self.send_error(404)
            return
        self._send(b"page one\fpage two " + b"x" * 60)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if "generateContent" in self.path:
            assert body["generationConfig"]["thinkingConfig"] == {"thinkingLevel": "high"} and self.headers["x-goog-api-key"] == "k"
            parts = [{"text": "a thought", "thought": True}, {"text": "answer to "}, {"text": body["contents"][0]["parts"][0]["text"]}]
            self._send(json.dumps({"candidates": [{"content": {"parts": parts}}]}).encode())
        else:
            assert body["temperature"] == 0 and self.headers["Authorization"] == "Bearer k"
            self._send(json.dumps({"choices": [{"message": {"content": "answer to " + body["messages"][0]["content"]}}]}).encode())

    def _send(self, body):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_adapters_against_a_server(spark, server, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "k")
    chat, generate = provider.HttpProvider(server, "m", "SOME_KEY"), provider.GenerateProvider(server, "m", "SOME_KEY")
    assert chat.complete("x", "q", {}) == generate.complete("x", "q", {}) == "answer to x"
    rows = health.provider_health(spark, {"a": health.probe(chat), "b": health.probe(provider.HttpProvider("http://127.0.0.1:9", "m", "SOME_KEY"))}).collect()
    assert {tuple(r) for r in rows} == {("a", True), ("b", False)}
    df = spark.createDataFrame([(1, server + "/doc"), (2, server + "/missing")], "k int, pdf_url string")
    got = {r.k: r for r in extract.extract(df, extract.HttpFetcher(), extract.TextReader()).collect()}
    assert got[1].extract_status == "ok" and got[1].pdf_text.startswith("page onepage two") and got[1].extract_seconds >= 0
    assert got[2].extract_status == "fetch_failed"


def test_many_batches_share_folders(spark, tmp_path):
    path = str(tmp_path / "batches")
    df = spark.range(1000).withColumn("batch_num", (F.col("id") / 3 + 1).cast("int")).withColumn("v", F.lit("old"))
    sinks.append_batches(df, path, group=100)
    sinks.append_batches(df.filter("batch_num in (5, 150)").withColumn("v", F.lit("new")), path, group=100)
    sinks.append_batches(df.limit(0), path, group=100)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 1000 and {r.batch_num for r in rows if r.v == "new"} == {5, 150} and len(list((tmp_path / "batches").glob("part=*"))) == 4
    sinks.append_batches(df.limit(2).withColumn("batch_num", F.lit(None).cast("int")), path, group=100)
    sinks.append_batches(df.limit(2).withColumn("batch_num", F.lit(None).cast("int")), path, group=100)
    assert spark.read.parquet(path).count() == 1002


def test_clear_removes_what_was_written(spark):
    import os

    df = materialise(spark.range(3))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    clear(spark)
    assert not os.path.exists(folder)
