"""Spark operators on small fixtures with nulls, ties, empty tables and clashing names."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.functions import reply as R
from docmill.functions import text as X
from docmill.operators import analyze, classify, extract, health, provider, select, sinks
from docmill.session import materialise
from docmill.sources.csvsource import read_csv

SPACES = [" a ", "　a\n", "\x1c\x1fa\x85", "​a﻿", "  ", "", "a b", None]


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


@pytest.mark.parametrize("value", SPACES)
def test_strip_is_pythons(spark, value):
    assert one(spark, value, X.strip(F.col("v"))) == (None if value is None else value.strip())


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("`json {}\n a", max_size=12), min_size=1, max_size=30))
def test_fences(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(R.fence_strip_prefix(F.col("v")), R.fence_strip_charset(F.col("v"))).collect()
    for v, (a, b) in zip(values, got):
        assert a == R.unfence(v)
        assert b == v.strip().strip("```json").strip("```").strip()


def test_page_columns_agree_with_policies(spark):
    cases = [[None, ""], ["x" * 49], ["x" * 50], [" " * 60], [""] * 60, ["a"] * 16, []]
    df = spark.createDataFrame([(c,) for c in cases], "p array<string>")
    rows = df.select("p", X.ocr_gate_strict(F.col("p")), X.ocr_gate_lenient(F.col("p")), extract.CLASSIFY.column(F.col("p"))).collect()
    for p, strict, lenient, text in rows:
        assert strict == extract.CLASSIFY.wants_ocr(p)
        assert lenient == extract.ANALYSE.wants_ocr(p)
        assert text == extract.CLASSIFY.text(p)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(-(10**12), 10**12), max_size=40), st.integers(-50, 50), st.integers(-50, 50))
def test_slice_over_sparse_keys(spark, keys, start, end):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r.k for r in select.slice_rows(df, "k", start, end).orderBy("k").collect()]
    assert got == sorted(keys)[start:end]


def test_position_crosses_blocks_and_overwrites(spark):
    df = spark.range(0, 50, 3).withColumn("pos", F.lit("old"))
    rows = select.with_batch(select.with_position(df, "id", block=7), 4).orderBy("id").collect()
    assert [r.pos for r in rows] == list(range(17)) and [r.batch_num for r in rows] == [i // 4 + 1 for i in range(17)]
    assert select.batch_count(df.filter("id < 0"), 4).first().n_batches == 0
    with pytest.raises(ValueError):
        select.with_batch(df, 0)


class Counting:
    """Counts calls in an accumulator."""

    def __init__(self, acc, reply):
        self.acc, self.reply = acc, reply

    def complete(self, prompt, question, row):
        self.acc.add(1)
        return self.reply(question)


def test_classify_calls_once_per_row_and_keeps_rows(spark):
    acc = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(1, None, "t", "mine"), (2, "u", None, None), (2, "u", "", "x")], "k int, pdf_url string, pdf_text string, status string")
    reply = lambda q: '{"is_annual_report": true}'
    out = materialise(classify.classify(df, Counting(acc, reply)))
    assert acc.value == 3 and out.count() == 3 and acc.value == 3
    assert out.columns == ["k", "pdf_url", "status", "is_annual_report", "confidence", "classification_reason"]
    assert classify.annual_only(out).count() == 3
    assert classify.classify(df.limit(0), Counting(acc, reply)).count() == 0


@pytest.mark.parametrize("broken", [None, "Y1", "Y2", "Y3", "Y4"])
def test_chain_is_all_or_nothing(spark, broken):
    acc = spark.sparkContext.accumulator(0)
    good = {"Y1": '{"Y1": "issue"}', "Y2": '{"Y2": 0}', "Y3": '{"Y3": ["q"]}', "Y4": '{"Other": 1}'}
    replies = {k: (None if k == broken else v) for k, v in good.items()}

    def reply(question):
        if replies[question] is None:
            raise TimeoutError
        return replies[question]

    one_provider = Counting(acc, reply)
    df = spark.createDataFrame([(1, "u", None), (2, None, "t")], "k int, pdf_url string, pdf_text string")
    rows = materialise(analyze.analyse(df, {p: one_provider for p in analyze.PROVIDERS}, "run", "k")).collect()
    assert len(rows) == 6 and len({r.id for r in rows}) == 2
    assert acc.value == (2 if broken == "Y1" else 2 * 10)
    if broken:
        assert {(r.y1, r.y2, r.y3, r.y4) for r in rows} == {(None, None, None, None)}
        assert {r.status for r in rows} == {f"{broken.lower()}_call_failed"}
    else:
        assert {(r.y1, r.y2, tuple(r.y3), r.y4, r.status) for r in rows} == {("issue", 0, ("q",), None, "ok")}
    text = {(r.y1, r.y2, r.y3, r.y4) for r in analyze.to_legacy_text(spark.createDataFrame(rows, "k int, pdf_url string, id string, y1 string, provider_ord int, llm string, y2 int, y3 array<string>, y4 int, calls int, status string")).collect()}
    assert text == ({("API failed",) * 4} if broken else {("issue", "0", '["q"]', " ")})


class Web:
    def fetch(self, url):
        if "down" in url:
            raise TimeoutError("slow")
        return url.encode()


class Reader:
    def pages(self, body):
        if b"corrupt" in body:
            raise ValueError("no document")
        return [body.decode(), None, " tail"]


class NoOcr:
    def read(self, body):
        raise RuntimeError("ocr")


def test_extract_errors_become_columns(spark):
    urls = [None, "down", "corrupt", "short", "x" * 60, "x" * 60]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "i int, pdf_url string, pdf_text string")
    rows = extract.extract(df, Web(), Reader(), ocr=NoOcr()).orderBy("i").collect()
    assert [r.extract_status for r in rows] == ["no_url", "fetch_failed", "read_failed", "ocr_failed", "ok", "ok"]
    assert [r.pdf_text for r in rows] == [None] * 4 + ["x" * 60 + " tail"] * 2
    assert rows[1].extract_error == "TimeoutError: slow"
    assert extract.extract(df.limit(1).filter("i > 5"), Web(), Reader()).count() == 0


def test_csv_edges(spark, tmp_path):
    path = tmp_path / "edge.csv"
    path.write_text('﻿,a,a,"q ""x"""\n0,007,2024-01-02,"line\nbreak"\n1,NA,null," lead"\n\n2,n/a,,\n3,short\n', encoding="utf-8")
    rows = read_csv(spark, str(path)).orderBy("row_ordinal").collect()
    assert rows[0].asDict() == {"row_ordinal": 0, "a": "007", "a.1": "2024-01-02", 'q "x"': "line\nbreak"}
    assert [r["a"] for r in rows] == ["007", None, None, "short"] and rows[1]['q "x"'] == " lead" and rows[3]["a.1"] is None
    long = tmp_path / "long.csv"
    long.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="longer than the header"):
        read_csv(spark, str(long)).collect()
    assert read_csv(spark, str(long), on_long="drop").count() == 1 and read_csv(spark, str(long), on_long="only").first().a == "3"


def test_csv_roundtrip(spark, tmp_path):
    rows = [(1, ' lead "q"\nnext', True, ["x", 'y"']), (2, "", False, None), (3, None, None, [])]
    df = spark.createDataFrame(rows, "i int, t string, b boolean, l array<string>")
    sinks.export_csv(df, str(tmp_path / "out"), index="i")
    got = read_csv(spark, str(tmp_path / "out"), drop_index=False, ordinal=None).orderBy("`Unnamed: 0`").collect()
    assert [tuple(r) for r in got] == [("1", ' lead "q"\nnext', "True", '["x","y\\""]'), ("2", None, "False", None), ("3", None, None, "[]")]


def test_append_is_idempotent_and_resumes(spark, tmp_path):
    path = str(tmp_path / "batches")
    df = spark.range(10).withColumn("batch_num", (F.col("id") / 4).cast("int"))
    sinks.append_batches(df.filter("batch_num < 2"), path)
    sinks.append_batches(df.filter("batch_num = 1"), path)
    rest = sinks.pending(df, spark.read.parquet(path))
    assert sorted(r.id for r in rest.collect()) == [8, 9]
    sinks.append_batches(rest, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10))


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "log")
    run = sinks.log_run(spark, path, 2, 5, 1.5)
    sinks.log_run(spark, path, 4, 7, 0.5, run_id=run)
    ledger = spark.read.parquet(path)
    assert sinks.latest_runs(ledger).first()[1:] == (2, 7, 1.5)
    open_run = ledger.withColumn("time_elapsed", F.lit(None).cast("double"))
    df = spark.range(9)
    assert [r.id for r in sinks.pending_rows(df, ledger, "id", block=3).orderBy("id").collect()] == [0, 1, 7, 8]
    assert sinks.pending_rows(df, open_run, "id").count() == 9 and sinks.pending_rows(df, ledger.limit(0), "id").count() == 9


def test_upload_reports(spark, tmp_path):
    assert sinks.upload(spark.range(1), str(tmp_path / "a"))["ok"]
    assert not sinks.upload(spark.range(1), str(tmp_path / "a"))["ok"]


def test_health(spark):
    def broken():
        raise OSError

    assert {tuple(r) for r in health.provider_health(spark, {"a": lambda: 1, "b": broken}).collect()} == {("a", True), ("b", False)}
    assert [r.wait_s for r in health.retry_schedule(spark).collect()] == [2, 4, 8, 16, 32, 64, 128]


def test_replay_map(spark):
    df = spark.createDataFrame([("u", "t", {"Y1": '{"Y1": "x"}'})], "pdf_url string, pdf_text string, replay map<string,string>")
    assert analyze.shared_first_answer(df, provider.ReplayProvider(), hints=("replay",)).first().y1 == "x"
