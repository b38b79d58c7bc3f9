"""Named queries over the test tables, each beside its SQL where SQL can say it.

Model replies are replayed from the tables: stage 1 from `filter_output`, stage 2
from the latest answers in `report_analysis`. Pages are the parts of a text between
form feeds. Every query covers its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill import job
from docmill.functions import reply as R
from docmill.functions import template as P
from docmill.functions import text as X
from docmill.operators import analyze, classify, extract, health, provider, select, sinks
from docmill.session import place
from docmill.sources.csvsource import read_csv
from docmill.spec import RunSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- positions and batches -------------------------------------------------

_POS = "(SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)"


@query(f"SELECT doc_id, pos, n_chars FROM {_POS} WHERE pos >= 100 AND pos < 400")
def slice_rows(spark, sf_dir):
    return select.slice_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 100, 400)


@query(f"SELECT doc_id, pos, n_chars FROM {_POS} WHERE pos >= n - 150 AND pos < n - 10")
def slice_negative(spark, sf_dir):
    return select.slice_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", -150, -10)


@query(f"SELECT doc_id, pos, n_chars FROM {_POS} WHERE pos >= 120")
def slice_clip(spark, sf_dir):
    return select.slice_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 120, 10**12)


@query("SELECT row_ordinal, (row_number() OVER (ORDER BY row_ordinal) - 1) // 64 + 1 AS batch FROM filter_output")
def batch_assign(spark, sf_dir):
    df = select.with_position(table(spark, sf_dir, "filter_output").select("row_ordinal"), "row_ordinal")
    return select.with_batch(df, 64, out="batch").select("row_ordinal", "batch")


@query("SELECT count(*) AS n_rows, CAST((count(*) + 31) // 32 AS BIGINT) AS n_batches FROM report_analysis_text")
def batch_count(spark, sf_dir):
    return select.batch_count(table(spark, sf_dir, "report_analysis_text"), 32)


# --- pages and text --------------------------------------------------------

#: Literal page lists on which the two gates differ, or that hold empty and null pages.
_EDGE_PAGES = ((-1, [" " * 60]), (-2, ["", "", "ab"]), (-3, [None, "x" * 49]), (-4, ["x" * 50]), (-5, [""] * 60), (-6, [" " * 55, "y"]), (-7, ["z"] * 16))


def _sql_edge() -> str:
    rows = []
    for key, pages in _EDGE_PAGES:
        items = ", ".join("NULL" if p is None else "'" + p + "'" for p in pages)
        rows.append(f"SELECT CAST({key} AS BIGINT) AS text_id, CAST([{items}] AS VARCHAR[]) AS pages")
    return " UNION ALL ".join(rows)


_PAGES = f"(SELECT text_id, string_split(pdf_text, chr(12)) AS pages FROM report_analysis_text WHERE pdf_text IS NOT NULL UNION ALL {_sql_edge()})"
_STRIP = r"regexp_replace({0}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}\x{{0b}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}\x{{0b}}]+$', '', 'g')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "report_analysis_text").filter(F.col("pdf_text").isNotNull())
    edge = spark.createDataFrame([(k, list(p)) for k, p in _EDGE_PAGES], "text_id long, pages array<string>")
    return texts.select("text_id", X.pages_of(F.col("pdf_text")).alias("pages")).unionByName(edge)


@query(f"SELECT text_id, length({_STRIP.format("array_to_string(list_transform(pages[1:15], lambda p: coalesce(p, '')), '')")}) < 50 AS needs_ocr FROM {_PAGES}")
def ocr_gate_strict(spark, sf_dir):
    return _pages(spark, sf_dir).select("text_id", X.ocr_gate_strict(F.col("pages")).alias("needs_ocr"))


@query(f"SELECT text_id, length(array_to_string(list_transform(pages[1:15], lambda p: CASE WHEN coalesce(p, '') = '' THEN ' ' ELSE p END), '')) < 50 AS needs_ocr FROM {_PAGES}")
def ocr_gate_lenient(spark, sf_dir):
    return _pages(spark, sf_dir).select("text_id", X.ocr_gate_lenient(F.col("pages")).alias("needs_ocr"))


@query(f"SELECT text_id, CAST(len(pages) AS BIGINT) AS n_pages, md5(array_to_string(list_transform(pages[1:2], lambda p: coalesce(p, '')), '')) AS text_md5 FROM {_PAGES}")
def page_concat_cap(spark, sf_dir):
    pages = F.col("pages")
    return _pages(spark, sf_dir).select("text_id", F.size(pages).cast("long").alias("n_pages"), F.md5(X.page_concat(pages, 2)).alias("text_md5"))


@query("SELECT doc_id, md5(left(text, 1000)) AS text_md5, CAST(length(left(text, 1000)) AS BIGINT) AS n FROM documents")
def text_truncate(spark, sf_dir):
    cut = X.truncate(F.col("text"), 1000)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cut).alias("text_md5"), F.char_length(cut).cast("long").alias("n"))


@query(
    "SELECT text_id, "
    + ", ".join(f"md5(array_to_string(list_transform(pages[1:{n}], lambda p: coalesce(p, '')), '')) AS {c}_md5" for c, n in (("classify", 15), ("analyse", 2000)))
    + f" FROM {_PAGES}"
)
def page_concat_full(spark, sf_dir):
    """Both stages' caps of pages, as in production."""
    pages = F.col("pages")
    return _pages(spark, sf_dir).select("text_id", F.md5(X.page_concat(pages, 15)).alias("classify_md5"), F.md5(X.page_concat(pages, 2000)).alias("analyse_md5"))


@query("SELECT doc_id, md5(left(text, 200000)) AS text_md5, CAST(length(left(text, 200000)) AS BIGINT) AS n FROM documents")
def text_truncate_full(spark, sf_dir):
    """The cap of characters, as in production."""
    cut = X.truncate(F.col("text"), 200_000)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cut).alias("text_md5"), F.char_length(cut).cast("long").alias("n"))


@query("SELECT text_id, CAST(length(pdf_text) AS BIGINT) AS text_chars FROM report_filter")
def text_stats(spark, sf_dir):
    return extract.text_stats(table(spark, sf_dir, "report_filter")).select("text_id", "text_chars")


# --- fetch and extract, replayed -------------------------------------------

_FETCHED = "(SELECT f.row_ordinal, f.c3, r.text_id, r.pdf_text, r.text_id IS NOT NULL AS fetched FROM filter_output f LEFT JOIN (SELECT DISTINCT * FROM report_filter) r ON f.row_ordinal = r.row_ordinal)"
_STATUS = "CASE WHEN c3 IS NULL THEN 'no_url' WHEN NOT fetched THEN 'fetch_failed' WHEN coalesce(pdf_text, '') = '' THEN 'read_failed' ELSE 'ok' END"


def _texts_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage-1 text once, already where the join on its row needs it: rows delivered twice are equal in every column."""
    texts = table(spark, sf_dir, "report_filter").select("row_ordinal", "text_id", "pdf_text")
    return texts.repartition("row_ordinal").dropDuplicates(["row_ordinal", "text_id"])


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "filter_output").select("row_ordinal", "c3")
    return rows.join(_texts_of_rows(spark, sf_dir), "row_ordinal", "left").withColumn("fetched", F.col("text_id").isNotNull())


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1's extraction by the operator itself; a document is the stored text, one that cannot be read is empty."""
    df = _fetched(spark, sf_dir).withColumn("document", F.when(F.col("fetched"), F.coalesce("pdf_text", F.lit("")))).drop("pdf_text")
    return extract.extract(df, extract.ColumnFetcher("document"), extract.TextReader(), extract.CLASSIFY, "c3")


@query(f"SELECT row_ordinal, left(c3, 100) AS url_prefix, text_id, {_STATUS} NOT IN ('no_url', 'fetch_failed') AS fetched FROM {_FETCHED}")
def fetch_outcome(spark, sf_dir):
    got = ~F.col("extract_status").isin("no_url", "fetch_failed")
    return _extracted(spark, sf_dir).select("row_ordinal", X.url_prefix(F.col("c3")).alias("url_prefix"), "text_id", got.alias("fetched"))


@query(f"SELECT {_STATUS} AS status, count(*) AS n FROM {_FETCHED} GROUP BY 1")
def extract_status(spark, sf_dir):
    return _extracted(spark, sf_dir).groupBy(F.col("extract_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT row_ordinal, text_id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'ok' THEN md5(left(array_to_string(string_split(pdf_text, chr(12))[1:15], ''), 200000)) END AS text_md5 FROM {_FETCHED}")
def extract_pipeline(spark, sf_dir):
    return _extracted(spark, sf_dir).select("row_ordinal", "text_id", F.col("extract_status").alias("status"), F.md5("pdf_text").alias("text_md5"))


@query("SELECT text_id, CASE WHEN pdf_url IS NULL THEN 'no_url' WHEN pdf_text IS NULL THEN 'fetch_failed' WHEN pdf_text = '' THEN 'read_failed' ELSE 'ok' END AS status, CASE WHEN pdf_url IS NOT NULL AND pdf_text != '' THEN md5(array_to_string(string_split(pdf_text, chr(12))[1:2000], '')) END AS text_md5 FROM report_analysis_text")
def extract_analyse(spark, sf_dir):
    """Stage 2's extraction: 2,000 pages, no cap of characters."""
    texts = table(spark, sf_dir, "report_analysis_text").select("text_id", "pdf_url", F.col("pdf_text").alias("document"))
    df = extract.extract(texts, extract.ColumnFetcher("document"), extract.TextReader(), extract.ANALYSE)
    return df.select("text_id", F.col("extract_status").alias("status"), F.md5("pdf_text").alias("text_md5"))


# --- prompts ---------------------------------------------------------------


@query(
    f"SELECT row_ordinal, text_id, md5(p) AS prompt_md5, CAST(length(p) AS BIGINT) AS n FROM (SELECT row_ordinal, text_id, CASE WHEN coalesce(pdf_text, '') != '' THEN {P.CLASSIFY_TEXT.sql(url='c3', text='pdf_text')} ELSE {P.CLASSIFY_URL.sql(url='c3')} END AS p FROM {_FETCHED})"
)
def prompt_classify(spark, sf_dir):
    p = P.classify_prompt(F.col("c3"), F.col("pdf_text"))
    return _fetched(spark, sf_dir).select("row_ordinal", "text_id", F.md5(p).alias("prompt_md5"), F.char_length(p).cast("long").alias("n"))


def _chain_sql(where: str) -> str:
    v = {"url": "pdf_url", "text": "pdf_text", "y1": "c1", "y2": "batch_num"}
    use = {"y1": ("url", "text"), "y2": ("url", "text", "y1"), "y3": ("url", "text", "y1", "y2"), "y4": ("url", "text")}
    cols = ", ".join(f"md5({t.sql(**{k: v[k] for k in use[n]})}) AS {n}_md5" for n, t in (("y1", P.Y1), ("y2", P.Y2), ("y3", P.Y3), ("y4", P.Y4)))
    return f"SELECT text_id, {cols} FROM report_analysis_text{where}"


def _chain_prompts(df: DataFrame) -> DataFrame:
    u, t, a, b = F.col("pdf_url"), F.col("pdf_text"), F.col("c1"), F.col("batch_num")
    return df.select(
        "text_id",
        F.md5(P.Y1.column(url=u, text=t)).alias("y1_md5"),
        F.md5(P.Y2.column(url=u, text=t, y1=a)).alias("y2_md5"),
        F.md5(P.Y3.column(url=u, text=t, y1=a, y2=b)).alias("y3_md5"),
        F.md5(P.Y4.column(url=u, text=t)).alias("y4_md5"),
    )


@query(_chain_sql(""))
def prompt_chain(spark, sf_dir):
    return _chain_prompts(table(spark, sf_dir, "report_analysis_text"))


@query(_chain_sql(" WHERE pdf_text IS NULL"))
def prompt_null_text(spark, sf_dir):
    return _chain_prompts(table(spark, sf_dir, "report_analysis_text").filter(F.col("pdf_text").isNull()))


# --- replies ---------------------------------------------------------------

_REPLY_KEYS = ("is_annual_report", "confidence", "reason")


def _quoted(c: Column) -> Column:
    escaped = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def _reply(label: Column, sure: Column, why: Column) -> Column:
    return F.concat(
        F.lit('{"is_annual_report": '), F.coalesce(label.cast("string"), F.lit("null")),
        F.lit(', "confidence": '), _quoted(sure), F.lit(', "reason": '), _quoted(why), F.lit("}"),
    )


def _sql_quoted(c: str) -> str:
    return f"""coalesce('"' || replace(replace({c}, '\\', '\\\\'), '"', '\\"') || '"', 'null')"""


_SQL_JSON = f"""'{{"is_annual_report": ' || coalesce(CAST(is_annual_report AS VARCHAR), 'null') || ', "confidence": ' || {_sql_quoted("confidence")} || ', "reason": ' || {_sql_quoted("classification_reason")} || '}}'"""
_SQL_REPLIES = f"(SELECT *, CASE WHEN confidence = 'failed' THEN NULL ELSE {_SQL_JSON} END AS reply FROM filter_output)"
_SQL_FENCED = f"(SELECT row_ordinal, CASE row_ordinal % 4 WHEN 0 THEN reply WHEN 1 THEN '```json' || chr(10) || reply || chr(10) || '```' WHEN 2 THEN ' ```' || reply || '``` ' ELSE reply || '```' END AS reply FROM {_SQL_REPLIES})"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage-1 rows with the raw reply that leads to their verdict; null where the call failed."""
    df = table(spark, sf_dir, "filter_output")
    made = _reply(F.col("is_annual_report"), F.col("confidence"), F.col("classification_reason"))
    return df.withColumn("reply", F.when(F.coalesce(F.col("confidence"), F.lit("")) != "failed", made))


def _fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, k = F.col("reply"), F.col("row_ordinal") % 4
    styled = (
        F.when(k == 0, r)
        .when(k == 1, F.concat(F.lit("```json\n"), r, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit(" ```"), r, F.lit("``` ")))
        .otherwise(F.concat(r, F.lit("```")))
    )
    return _replies(spark, sf_dir).select("row_ordinal", styled.alias("reply"))


@query(f"SELECT row_ordinal, trim(regexp_extract(trim(reply), '^(?:```json)?(?:```)?(.*?)(?:```)?$', 1, 's'), ' ' || chr(10)) AS body FROM {_SQL_FENCED}")
def fence_strip_prefix(spark, sf_dir):
    return _fenced(spark, sf_dir).select("row_ordinal", R.fence_strip_prefix(F.col("reply")).alias("body"))


@query(f"SELECT row_ordinal, trim(trim(trim(trim(reply), '`json'), '`'), ' ' || chr(10)) AS body FROM {_SQL_FENCED}")
def fence_strip_charset(spark, sf_dir):
    return _fenced(spark, sf_dir).select("row_ordinal", R.fence_strip_charset(F.col("reply")).alias("body"))


@query(f"SELECT row_ordinal, reply AS content FROM {_SQL_REPLIES}")
def reply_envelope(spark, sf_dir):
    envelope = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("reply").alias("content")).alias("message"))).alias("choices")))
    return _replies(spark, sf_dir).select("row_ordinal", R.reply_content(envelope).alias("content"))


#: Replies with every kind of fault, by the row's number.
_FAULTS = ((1, "{r} and so on", "bad_json"), (2, "[{r}]", "not_object"), (3, "{{}}", "empty_object"), (4, "7", "not_object"), (5, "{{'confidence': 'high'}}", "bad_json"))
_FAULT_CASE = lambda out: "".join(f" WHEN row_ordinal % 13 = {k} THEN {out(t, s)}" for k, t, s in _FAULTS)
_SQL_FAULTY = (
    "(SELECT row_ordinal, CASE WHEN reply IS NULL THEN 'call_failed'" + _FAULT_CASE(lambda t, s: f"'{s}'") + " ELSE 'ok' END AS status, is_annual_report, confidence, classification_reason FROM " + _SQL_REPLIES + ")"
)


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, made = F.col("reply"), F.col("reply")
    for k, text, _ in _FAULTS:
        before, there, behind = text.partition("{r}")
        parts = [F.lit(x.replace("{{", "{").replace("}}", "}")) for x in (before, behind)]
        made = F.when(F.col("row_ordinal") % 13 == k, F.concat(parts[0], r, parts[1]) if there else F.when(r.isNotNull(), parts[0])).otherwise(made)
    return _replies(spark, sf_dir).select("row_ordinal", made.alias("reply"))


_PARSED = T.StructType([T.StructField(n, t) for n, t in (("status", T.StringType()), ("is_annual_report", T.BooleanType()), ("confidence", T.StringType()), ("reason", T.StringType()))])


@query("SELECT row_ordinal, status, CASE WHEN status = 'ok' THEN is_annual_report END AS is_annual_report, CASE WHEN status = 'ok' THEN confidence END AS confidence, CASE WHEN status = 'ok' THEN classification_reason END AS reason FROM " + _SQL_FAULTY)
def parse_reply(spark, sf_dir):
    """The strict decoding of replies, faulty ones among them."""

    def parsed(row):
        status, got = R.decode(row["reply"])
        return {"status": status} | (got or {})

    return provider.row_stage(_faulty(spark, sf_dir), _PARSED, parsed, ("reply",), drop=("reply",))


@query("SELECT row_ordinal, CASE WHEN status IN ('ok', 'bad_json') THEN 'ok' ELSE status END AS status, CASE WHEN status IN ('ok', 'bad_json') THEN is_annual_report END AS is_annual_report FROM " + _SQL_FAULTY)
def retry_unreadable(spark, sf_dir):
    """Replies that are no JSON at the first try and good at the second; other faults are not asked for again."""
    good = _replies(spark, sf_dir).select("row_ordinal", F.col("reply").alias("second"))
    df = _faulty(spark, sf_dir).withColumnRenamed("reply", "first").join(good, "row_ordinal").withColumn("pdf_url", F.lit("u"))
    policy = provider.CallPolicy(tries=2, base=0.0)
    out = classify.classify(df, provider.TriesProvider(("first", "second")), text=None, policy=policy, hints=("row_ordinal", "first", "second"), keep=("row_ordinal",))
    return out.select("row_ordinal", "status", "is_annual_report")


_SQL_PARTIAL = """(SELECT row_ordinal, CASE WHEN c2 IS NULL THEN '{"other": 1}' WHEN c5 IS NULL THEN '{"confidence": null}' ELSE '{"confidence": "' || c2 || '"}' END AS reply FROM filter_output)"""


@query(f"SELECT row_ordinal, CASE WHEN json_exists(reply, '$.confidence') THEN json_extract_string(reply, '$.confidence') ELSE 'unknown' END AS confidence FROM {_SQL_PARTIAL}")
def reply_defaults(spark, sf_dir):
    made = (
        F.when(F.col("c2").isNull(), '{"other": 1}')
        .when(F.col("c5").isNull(), '{"confidence": null}')
        .otherwise(F.concat(F.lit('{"confidence": "'), F.col("c2"), F.lit('"}')))
    )
    df = table(spark, sf_dir, "filter_output").select("row_ordinal", made.alias("reply"))
    return df.select("row_ordinal", R.get_or_default(F.col("reply"), "confidence", "unknown").alias("confidence"))


# --- stage 1 ---------------------------------------------------------------


def _classified(spark: SparkSession, sf_dir: str, text: bool) -> DataFrame:
    replies = _replies(spark, sf_dir).select("row_ordinal", F.col("c3").alias("pdf_url"), F.col("reply").alias("replay"))
    if text:
        replies = replies.join(_texts_of_rows(spark, sf_dir), "row_ordinal", "left")
    return classify.classify(replies, provider.ReplayProvider(), text="pdf_text" if text else None, hints=("replay",))


_SQL_VERDICT = "is_annual_report, CASE WHEN confidence = 'failed' THEN 'call_failed' ELSE 'ok' END AS status, confidence, classification_reason"


@query("SELECT f.row_ordinal, r.text_id, " + _SQL_VERDICT + " FROM filter_output f LEFT JOIN (SELECT DISTINCT row_ordinal, text_id, pdf_text FROM report_filter) r ON f.row_ordinal = r.row_ordinal")
def classify_documents(spark, sf_dir):
    return _classified(spark, sf_dir, True).select("row_ordinal", "text_id", "is_annual_report", "status", "confidence", "classification_reason")


@query(f"SELECT row_ordinal, {_SQL_VERDICT} FROM filter_output")
def classify_url_only(spark, sf_dir):
    return _classified(spark, sf_dir, False).select("row_ordinal", "is_annual_report", "status", "confidence", "classification_reason")


@query("SELECT CASE WHEN confidence = 'failed' THEN 'call_failed' ELSE 'ok' END AS status, count(*) AS n FROM filter_output GROUP BY 1")
def classify_status(spark, sf_dir):
    return _classified(spark, sf_dir, False).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_ordinal, c3 FROM filter_output WHERE is_annual_report")
def annual_only(spark, sf_dir):
    return classify.annual_only(table(spark, sf_dir, "filter_output")).select("row_ordinal", "c3")


@query(f"SELECT row_ordinal, c1, c2, {_SQL_VERDICT} FROM filter_output")
def overwrite_column(spark, sf_dir):
    """A second run over stage 1's own output: its old verdict columns are overwritten in place."""
    old = table(spark, sf_dir, "filter_output").select("row_ordinal", "c1", "c2", F.col("c3").alias("pdf_url"), (~F.col("is_annual_report")).alias("is_annual_report"), F.lit("old").alias("confidence"), F.lit(1).alias("classification_reason"))
    df = old.join(_replies(spark, sf_dir).select("row_ordinal", F.col("reply").alias("replay")), "row_ordinal")
    out = classify.classify(df, provider.ReplayProvider(), text=None, hints=("replay",))
    return out.select("row_ordinal", "c1", "c2", "is_annual_report", "status", "confidence", "classification_reason")


# --- stage 2 ---------------------------------------------------------------

_LLMS = ", ".join(f"('{p}', {i})" for i, p in enumerate(analyze.PROVIDERS))
_SQL_FAN = f"report_analysis_text CROSS JOIN (VALUES {_LLMS}) v(llm, provider_ord)"
_RUN = "run-1"


@query(f"SELECT text_id, llm, provider_ord FROM {_SQL_FAN}")
def fanout_providers(spark, sf_dir):
    return analyze.fan_out(table(spark, sf_dir, "report_analysis_text").select("text_id")).select("text_id", "llm", "provider_ord")


@query(f"SELECT text_id, llm, sha256('{_RUN}:' || CAST(text_id AS VARCHAR)) AS group_id FROM {_SQL_FAN}")
def group_key(spark, sf_dir):
    df = table(spark, sf_dir, "report_analysis_text").select("text_id")
    return analyze.fan_out(df.withColumn("group_id", analyze.group_key(_RUN, F.col("text_id")))).select("text_id", "llm", "group_id")


#: The latest answer per text and model; among equal times the largest answers win.
_SQL_LATEST = (
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, llm ORDER BY answered_at DESC NULLS LAST, y1 DESC NULLS LAST, y2 DESC NULLS LAST, y4 DESC NULLS LAST) AS rn "
    "FROM report_analysis WHERE llm IN ('DeepSeek', 'GPT', 'Gemini')) WHERE rn = 1)"
)
_SQL_INT = "CASE WHEN regexp_full_match({0}, '-?[0-9]{{1,9}}') THEN CAST({0} AS INTEGER) END"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct("y1", "y2", "y3", "y4"), F.struct("answered_at", "y1", "y2", "y4"))
    df = table(spark, sf_dir, "report_analysis").filter(F.col("llm").isin(*analyze.PROVIDERS))
    return df.groupBy("id", "llm").agg(best.alias("a")).select("id", "llm", "a.*")


def _integer(c: str) -> Column:
    return F.when(F.col(c).rlike(r"\A-?[0-9]{1,9}\z"), F.col(c).cast("int"))


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the map of raw replies of each model; a missing answer is a failed call."""
    failed = lambda k: F.coalesce(F.col(k), F.lit("")) == analyze.FAILED
    one = lambda k, v: F.when(~failed(k), F.concat(F.lit(f'{{"{k.upper()}": '), v, F.lit("}")))
    null = F.lit("null")
    replies = F.create_map(
        F.lit("Y1"), one("y1", _quoted(F.col("y1"))),
        F.lit("Y2"), one("y2", F.coalesce(_integer("y2").cast("string"), null)),
        F.lit("Y3"), F.when(~failed("y2"), F.concat(F.lit('{"Y3": '), F.coalesce(F.to_json("y3"), null), F.lit("}"))),
        F.lit("Y4"), one("y4", F.coalesce(_integer("y4").cast("string"), null)),
    )
    by_text = _latest(spark, sf_dir).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("llm", replies.alias("r")))).alias("models"))
    return table(spark, sf_dir, "report_analysis_text").select("text_id", "id", "pdf_url", "pdf_text").join(by_text, "id", "left")


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _replayed(spark, sf_dir).withColumn("replay", F.try_element_at("models", F.lit(analyze.LEADER)))
    return analyze.shared_first_answer(df, provider.ReplayProvider(), hints=("replay",)).drop("replay")


@query(f"SELECT t.text_id, CASE WHEN a.id IS NULL OR a.y1 = 'API failed' THEN 'call_failed' ELSE 'ok' END AS y1_status, CASE WHEN a.y1 = 'API failed' THEN NULL ELSE a.y1 END AS y1 FROM report_analysis_text t LEFT JOIN (SELECT * FROM {_SQL_LATEST} WHERE llm = 'GPT') a ON t.id = a.id")
def shared_y1(spark, sf_dir):
    return _first(spark, sf_dir).select("text_id", "y1_status", "y1")


def _chained(spark: SparkSession, sf_dir: str, skip_null_text: bool = False) -> DataFrame:
    df = _replayed(spark, sf_dir)
    first = analyze.shared_first_answer(df, provider.ReplayProvider("models", analyze.LEADER), hints=("models",), skip_null_text=skip_null_text)
    return analyze.chain_all(first, {p: provider.ReplayProvider("models", p) for p in analyze.PROVIDERS}, hints=("models",))


def _sql_chained() -> str:
    fail = lambda c: f"(a.id IS NULL OR coalesce({c}, '') = 'API failed')"
    bad = f"(l.id IS NULL OR coalesce(l.y1, '') = 'API failed' OR {fail('a.y2')} OR {fail('a.y4')})"
    return (
        f"SELECT t.text_id, v.llm, {bad} AS bad, l.y1, {_SQL_INT.format('a.y2')} AS y2, a.y3, {_SQL_INT.format('a.y4')} AS y4 "
        f"FROM report_analysis_text t CROSS JOIN (VALUES {_LLMS}) v(llm, provider_ord) "
        f"LEFT JOIN (SELECT * FROM {_SQL_LATEST} WHERE llm = 'GPT') l ON t.id = l.id "
        f"LEFT JOIN {_SQL_LATEST} a ON t.id = a.id AND v.llm = a.llm"
    )


@query(
    "SELECT text_id, llm, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS outcome, CASE WHEN NOT bad THEN y1 END AS y1, CASE WHEN NOT bad THEN y2 END AS y2, "
    f"CASE WHEN NOT bad THEN array_to_string(y3, '|') END AS y3, CASE WHEN NOT bad THEN y4 END AS y4 FROM ({_sql_chained()})"
)
def analysis_chain(spark, sf_dir):
    done = analyze.gate(_chained(spark, sf_dir))
    outcome = F.when(F.col("status") == R.OK, "ok").otherwise("failed")
    return done.select("text_id", "llm", outcome.alias("outcome"), "y1", "y2", F.array_join("y3", "|").alias("y3"), "y4")


@query(
    "SELECT text_id, llm, CASE WHEN bad THEN 'API failed' ELSE coalesce(y1, ' ') END AS y1, CASE WHEN bad THEN 'API failed' ELSE coalesce(CAST(y2 AS VARCHAR), ' ') END AS y2, "
    f"CASE WHEN bad THEN 'API failed' ELSE coalesce(CAST(y4 AS VARCHAR), ' ') END AS y4 FROM ({_sql_chained()})"
)
def analysis_gate(spark, sf_dir):
    return analyze.to_legacy_text(analyze.gate(_chained(spark, sf_dir))).select("text_id", "llm", "y1", "y2", "y4")


@query(
    "SELECT text_id, llm, CASE WHEN pdf_text IS NULL THEN 'y1_no_text' WHEN bad THEN 'failed' ELSE 'ok' END AS outcome, CASE WHEN NOT bad AND pdf_text IS NOT NULL THEN y2 END AS y2 "
    f"FROM ({_sql_chained()}) JOIN (SELECT text_id, pdf_text FROM report_analysis_text) USING (text_id)"
)
def analysis_skip_null(spark, sf_dir):
    """Documents without text are not asked about."""
    done = analyze.gate(_chained(spark, sf_dir, skip_null_text=True))
    outcome = F.when(F.col("status").isin(R.OK, "y1_no_text"), F.col("status")).otherwise("failed")
    return done.select("text_id", "llm", outcome.alias("outcome"), "y2")


# --- sinks and logs --------------------------------------------------------


@query("SELECT row_ordinal, CAST(batch_num AS BIGINT) AS batch_num, c3 FROM filter_output")
def append_batches(spark, sf_dir):
    """Batches as they are numbered; the first ten are written wrong at first and then again."""
    df, path = table(spark, sf_dir, "filter_output").select("row_ordinal", "batch_num", "c3"), place(spark, "batches")
    early = F.col("batch_num") <= 10
    sinks.append_batches(df.filter(early).withColumn("c3", F.lit("wrong")), path)
    sinks.append_batches(df.filter(~early), path)
    sinks.append_batches(df.filter(early), path)
    return spark.read.parquet(path).select("row_ordinal", F.col("batch_num").cast("long").alias("batch_num"), "c3")


@query("SELECT CAST(row_ordinal AS VARCHAR) AS row_ordinal, nullif(nullif(c1, ''), 'None') AS c1, nullif(c3, '') AS c3, CASE is_annual_report WHEN true THEN 'True' WHEN false THEN 'False' END AS is_annual_report, nullif(classification_reason, '') AS classification_reason FROM filter_output")
def csv_roundtrip(spark, sf_dir):
    path = place(spark, "csv")
    sinks.export_csv(table(spark, sf_dir, "filter_output").select("row_ordinal", "c1", "c3", "is_annual_report", "classification_reason"), path)
    return read_csv(spark, path, ordinal=None)


@query("SELECT id, min(start_row) AS start_row, max(end_row) AS end_row, max(time_elapsed) AS time_elapsed FROM (SELECT * FROM run_log UNION ALL SELECT 'another', 5, 9, 1.5, NULL) GROUP BY id")
def run_log(spark, sf_dir):
    """Runs logged by the sink, twice, and one more; each comes once."""
    path = place(spark, "ledger")
    runs = table(spark, sf_dir, "run_log")
    sinks.log_runs(runs, path)
    sinks.log_runs(runs, path)
    sinks.log_run(spark, path, 5, 9, 1.5, run_id="another")
    return sinks.latest_runs(spark.read.parquet(path))


_UNENDED = "(SELECT *, end_row < max(end_row) OVER () AS ended FROM run_log)"


@query(f"SELECT row_ordinal FROM filter_output f WHERE NOT EXISTS (SELECT 1 FROM {_UNENDED} r WHERE r.ended AND r.time_elapsed IS NOT NULL AND r.start_row <= f.row_ordinal AND f.row_ordinal < r.end_row)")
def resume_pending(spark, sf_dir):
    """What is left to do while the runs with the last end have not ended yet."""
    ledger = table(spark, sf_dir, "run_log")
    return sinks.pending_rows(table(spark, sf_dir, "filter_output").select("row_ordinal"), _ended(ledger), "row_ordinal")


def _ended(ledger: DataFrame) -> DataFrame:
    last = ledger.agg(F.max("end_row")).first()[0]
    return ledger.filter(F.col("end_row") < F.lit(last))


_SQL_LOCAL = "timezone('America/Chicago', CAST(written_at AS TIMESTAMPTZ))"
_SQL_LETTERS = f"CASE WHEN date_diff('hour', CAST(written_at AS TIMESTAMP), {_SQL_LOCAL}) = -5 THEN 'CDT' ELSE 'CST' END"


@query(f"SELECT row_ordinal, kind || '_' || strftime({_SQL_LOCAL}, '%Y-%m-%d %H:%M:%S') || ' ' || {_SQL_LETTERS} || '.csv' AS object_key FROM filter_output CROSS JOIN (VALUES ('input'), ('output')) v(kind)")
def object_key(spark, sf_dir):
    df, at = table(spark, sf_dir, "filter_output"), F.col("written_at")
    return df.select("row_ordinal", F.explode(F.array(sinks.object_key("input", at), sinks.object_key("output", at))).alias("object_key"))


#: A slice that leaves rows out at both ends, in batches of the usual size.
_JOB_START, _JOB_END, _JOB_BATCH = 7, -5, 64
_SQL_JOB = (
    f"SELECT row_ordinal, pos, (pos - {_JOB_START}) // {_JOB_BATCH} + 1 AS batch_num, {_SQL_VERDICT} FROM "
    f"(SELECT *, row_number() OVER (ORDER BY row_ordinal) - 1 AS pos, count(*) OVER () AS n FROM filter_output) WHERE pos >= {_JOB_START} AND pos < n + {_JOB_END}"
)


@query(_SQL_JOB)
def job_classify(spark, sf_dir):
    """A whole run of stage 1 from CSV files: cut short after its first wave, run again, and its rows as they were written."""
    folder = place(spark, "job")
    df = _replies(spark, sf_dir).select("row_ordinal", F.col("c3").alias("pdf_url"), F.col("reply").alias("replay"))
    sinks.export_csv(df, folder + "/in")
    spec = RunSpec(folder + "/in", "out", _JOB_BATCH, _JOB_START, _JOB_END)
    stage = lambda part: classify.classify(part, provider.ReplayProvider(), text=None, hints=("replay",))
    job.run(spark, spec, stage, "row_ordinal", wave=16, waves=1)
    job.run(spark, spec, stage, "row_ordinal", wave=2048)
    return job.written(spark, spec).select(
        F.col("row_ordinal").cast("long").alias("row_ordinal"), "pos", "batch_num", "is_annual_report", "status", "confidence", "classification_reason"
    )


@query(
    "SELECT text_id, llm, pos, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS outcome, CASE WHEN NOT bad THEN y2 END AS y2, CASE WHEN NOT bad THEN y4 END AS y4 "
    f"FROM ({_sql_chained()}) JOIN (SELECT text_id, row_number() OVER (ORDER BY text_id) - 1 AS pos FROM report_analysis_text) USING (text_id)"
)
def job_analyse(spark, sf_dir):
    """A whole run of stage 2 from CSV files, with recorded replies of all models."""
    folder = place(spark, "job")
    df = _replayed(spark, sf_dir).select("text_id", "pdf_url", F.col("pdf_text").alias("body"), F.to_json("models").alias("models"))
    sinks.export_csv(df, folder + "/in")
    spec = RunSpec(folder + "/in", "out", 32)

    def stage(part: DataFrame) -> DataFrame:
        part = part.withColumn("models", F.from_json("models", "map<string,map<string,string>>"))
        texts = extract.extract(part, extract.ColumnFetcher("body"), extract.TextReader(), extract.ANALYSE)
        return analyze.analyse(texts, {p: provider.ReplayProvider("models", p) for p in analyze.PROVIDERS}, _RUN, "pos", hints=("models",))

    job.run(spark, spec, stage, "text_id")
    outcome = F.when(F.col("status") == R.OK, "ok").otherwise("failed")
    return job.written(spark, spec).select(F.col("text_id").cast("long").alias("text_id"), "llm", "pos", outcome.alias("outcome"), "y2", "y4")


@query("SELECT CAST(k AS INTEGER) AS attempt, CAST(pow(2, k) AS BIGINT) AS wait_s, CAST(pow(2, k + 1) - 2 AS BIGINT) AS total_s FROM range(1, 8) t(k)")
def retry_schedule(spark, sf_dir):
    return health.retry_schedule(spark)


@query("SELECT * FROM (VALUES ('DeepSeek', CAST(0.028 AS DOUBLE), CAST(0.42 AS DOUBLE)), ('GPT', 3.0, 0.75), ('Gemini', 1.25, 12.0)) t(provider, usd_in, usd_out)")
def provider_prices(spark, sf_dir):
    return health.provider_prices(spark)


_NAMES = ", ".join(f"('{p}')" for p in (*analyze.PROVIDERS, "Retired"))


@query(f"SELECT v.provider, count(a.llm) > 0 AS online FROM (VALUES {_NAMES}) v(provider) LEFT JOIN report_analysis a ON a.llm = v.provider AND a.y1 != 'API failed' GROUP BY v.provider")
def provider_health(spark, sf_dir):
    """Each model is asked by its probe; a recorded good answer is its reply, a model without one does not answer."""
    good = F.max(F.when(F.col("y1") != analyze.FAILED, F.col("y1")))
    replies = {r.llm: r.reply for r in table(spark, sf_dir, "report_analysis").groupBy("llm").agg(good.alias("reply")).filter(F.col("llm").isin(*analyze.PROVIDERS)).collect()}
    probes = {p: health.probe(provider.ReplayProvider(), {"replay": replies.get(p)}) for p in (*analyze.PROVIDERS, "Retired")}
    return health.provider_health(spark, probes)


@query(f"SELECT row_ordinal, {_SQL_VERDICT} FROM filter_output")
def stream_classify(spark, sf_dir):
    from docmill.streaming.pipeline import stream_stage

    src, out = place(spark, "stream-in"), place(spark, "stream-out")
    _replies(spark, sf_dir).select("row_ordinal", F.col("c3").alias("pdf_url"), F.col("reply").alias("replay")).write.parquet(src)
    stage = lambda df: classify.classify(df, provider.ReplayProvider(), text=None, hints=("replay",))
    stream_stage(spark, src, spark.read.parquet(src).schema, stage, out, place(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("row_ordinal", "is_annual_report", "status", "confidence", "classification_reason")
