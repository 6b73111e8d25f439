"""``spark-submit``-able entry point: one sub-command per job.

    python -m lorekeep load --warehouse /lake --feeds /feeds
    python -m lorekeep refresh --warehouse /lake --quarantine /lake/quarantine
    python -m lorekeep index --warehouse /lake
    python -m lorekeep stream --warehouse /lake --input /landing/events --run-for-seconds 60
    python -m lorekeep analytics --warehouse /lake
    python -m lorekeep search --warehouse /lake --questions q.jsonl --out /tmp/answers
    python -m lorekeep evaluate --warehouse /lake --benchmark cases.json --out /tmp/evaluation
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lorekeep.operators.seed_gate import DeliveryRejected
from lorekeep.plans import jobs
from lorekeep.session import build_session, drop_staged
from lorekeep.sources import files, streams
from lorekeep.streaming.events import run_for


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lorekeep", description="Governed-knowledge jobs on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        sub.add_argument("--warehouse", required=True)
        for flag, settings in options:
            sub.add_argument(flag, **settings)

    need = {"required": True}
    command("load", ("--feeds", need), ("--rules", {}), ("--single-line", {"action": "store_true"}))
    command("refresh", ("--quarantine", need), ("--run-id", {}))
    command("index", ("--full", {"action": "store_true"}))
    command("stream", ("--input", {}), ("--kafka-servers", {}), ("--kafka-topic", {}),
            ("--run-for-seconds", {"type": float}), ("--available-now", {"action": "store_true"}))
    command("compact")
    command("analytics", ("--recompute", {"action": "store_true"}))
    command("search", ("--questions", need), ("--out", need), ("--topic", {}), ("--top-n", {"type": int, "default": 5}),
            ("--fetch-n", {"type": int}), ("--semantic-weight", {"type": float, "default": 0.6}), ("--lexical-weight", {"type": float, "default": 0.4}))
    command("report", ("--name", {**need, "choices": jobs.REPORTS}), ("--out", need), ("--topic", {}), ("--ids", {}))
    command("evaluate", ("--benchmark", need), ("--out", need), ("--single-line", {"action": "store_true"}))
    return top


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "load":
        try:
            for warning in jobs.load_raw(spark, args.feeds, args.warehouse, not args.single_line, args.rules):
                print(f"WARNING: {warning}")
        except DeliveryRejected as error:
            print(f"ERROR: {error}")
            return 1
    elif args.command == "refresh":
        print(jobs.refresh(spark, args.warehouse, args.quarantine, args.run_id))
    elif args.command == "index":
        try:
            jobs.index(spark, args.warehouse, full=args.full)
        except ValueError as error:
            print(f"ERROR: {error}")
            return 1
    elif args.command == "stream":
        if args.input:
            messages = streams.text_messages(spark, args.input)
        else:
            messages = streams.kafka_messages(spark, args.kafka_servers, args.kafka_topic)
        query = jobs.stream(messages, args.warehouse, args.available_now)
        if args.run_for_seconds:
            run_for(query, args.run_for_seconds)
        else:
            query.awaitTermination()
    elif args.command == "analytics":
        jobs.refresh_analytics(spark, args.warehouse, args.recompute)
    elif args.command == "compact":
        print(json.dumps(jobs.compact(spark, args.warehouse)))
    elif args.command == "search":
        questions = spark.read.schema("query_id string, question string").json(args.questions)
        answers = jobs.search(
            spark, args.warehouse, questions, args.top_n, args.topic, semantic_weight=args.semantic_weight,
            lexical_weight=args.lexical_weight, fetch_n=args.fetch_n)
        answers.write.mode("overwrite").json(args.out)
    elif args.command == "report":
        ids = spark.read.schema("source_id string").json(args.ids) if args.ids else None
        for name, frame in jobs.report(spark, args.warehouse, args.name, args.topic, ids).items():
            frame.write.mode("overwrite").json(f"{args.out}/{name}")
    else:
        cases = files.read_benchmark(spark, args.benchmark, not args.single_line)
        for name, frame in jobs.evaluate(spark, args.warehouse, cases).items():
            frame.write.mode("overwrite").json(f"{args.out}/{name}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args, spark = parser().parse_args(argv), build_session()
    try:
        return run(args, spark)
    finally:
        drop_staged(spark)


if __name__ == "__main__":
    sys.exit(main())
