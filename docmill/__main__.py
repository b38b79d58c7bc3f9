"""Command line: `python -m docmill classify|analyse --input in.csv --output out --endpoint URL --model NAME --key SETTING`."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import job
from docmill.operators import analyze, classify, extract, provider, sinks
from docmill.spec import RunSpec


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docmill")
    p.add_argument("stage", choices=("classify", "analyse"))
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--batch_size", type=int, default=64)
    p.add_argument("--start_row", type=int)
    p.add_argument("--end_row", type=int)
    p.add_argument("--column", default="pdf_url", help="column of the addresses")
    p.add_argument("--order", help="column of whole numbers that orders the rows; else file order")
    p.add_argument("--no_extract", action="store_true", help="judge by the address alone")
    p.add_argument("--annual_reports_only", action="store_true")
    p.add_argument("--skip_null_text", action="store_true", help="ask nothing about documents without text")
    p.add_argument("--text_column", help="column that holds the documents' text; else they are fetched")
    p.add_argument("--replay", help="column of recorded replies; else models are called")
    p.add_argument("--endpoint", help="chat-completions address")
    p.add_argument("--model", default="deepseek-chat")
    p.add_argument("--key", default="DeepSeek_key", help="setting that holds the key")
    p.add_argument("--gpt_endpoint")
    p.add_argument("--gemini_endpoint")
    p.add_argument("--tries", type=int, default=8)
    p.add_argument("--pause", type=float, default=0.5)
    p.add_argument("--threads", type=int, default=4)
    p.add_argument("--at_once", type=int, default=32, help="calls of all tasks together")
    p.add_argument("--input_store", help="where the input is copied to after the run")
    p.add_argument("--output_store", help="where the output is copied to after the run")
    return p


def providers(a: argparse.Namespace) -> dict[str, provider.ModelProvider]:
    """One per answerer, by the order in which rows come out."""
    if a.replay:
        one = a.stage == "classify"
        return {llm: provider.ReplayProvider(a.replay, None if one else llm) for llm in analyze.PROVIDERS}
    if not a.endpoint:
        raise SystemExit("an --endpoint or recorded replies are needed")
    tokens = 2000 if a.stage == "classify" else 3000
    out: dict[str, provider.ModelProvider] = {"DeepSeek": provider.HttpProvider(a.endpoint, a.model, a.key, tokens)}
    if a.stage == "analyse":
        if not (a.gpt_endpoint and a.gemini_endpoint):
            raise SystemExit("--gpt_endpoint and --gemini_endpoint are needed")
        out["GPT"] = provider.HttpProvider(a.gpt_endpoint, "gpt-4.1", "GPT_key", tokens)
        out["Gemini"] = provider.GenerateProvider(a.gemini_endpoint, "gemini-3-flash-preview", "Gemini_key", tokens)
    return out


def stage_of(a: argparse.Namespace, run_id: str = "run") -> job.Stage:
    """The stage's DataFrame function."""
    models = providers(a)
    policy = provider.CallPolicy(tries=1 if a.replay else a.tries, pause=0 if a.replay else a.pause, threads=a.threads, at_once=None if a.replay else a.at_once)
    hints = (a.replay,) if a.replay else ()

    def text(df: DataFrame, how: extract.ExtractPolicy) -> DataFrame:
        if a.text_column:
            return extract.extract(df, extract.ColumnFetcher(a.text_column), extract.TextReader(), how, a.column)
        return extract.extract(df, extract.HttpFetcher(), extract.PdfReader(), how, a.column, extract.CommandOcr(), a.threads)

    def classified(df: DataFrame) -> DataFrame:
        if not a.no_extract:
            df = text(df, extract.CLASSIFY)
        return classify.classify(df, models["DeepSeek"], a.column, None if a.no_extract else "pdf_text", policy, hints)

    def analysed(df: DataFrame) -> DataFrame:
        if a.replay:
            df = df.withColumn(a.replay, F.from_json(a.replay, "map<string,map<string,string>>"))
        df = text(df, extract.ANALYSE)
        return analyze.analyse(df, models, run_id, "pos", a.column, "pdf_text", policy, hints, a.skip_null_text)

    return classified if a.stage == "classify" else analysed


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spec = RunSpec(a.input, a.output, a.batch_size, a.start_row, a.end_row, a.column, not a.no_extract, a.annual_reports_only)
    spark = spark or SparkSession.builder.appName("docmill").getOrCreate()
    done = job.run(spark, spec, stage_of(a), a.order)
    said = asdict(done)
    if a.input_store and a.output_store:
        said["uploads"] = sinks.upload_run(spark, spec.input_path, spec.output_path, a.input_store, a.output_store)
    print(json.dumps(said))
    return 0 if all(u["ok"] for u in said.get("uploads", [])) else 1


if __name__ == "__main__":
    sys.exit(main())
