"""python -m claimworks: prepare pools, score rows that are pending, report and compare, check one claim."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("claimworks").getOrCreate()


def prepare(args) -> None:
    from claimworks.operators import checks, sampling
    from claimworks.sources import scans, sinks

    spark = _session()
    rows = sampling.with_pool(scans.benchmark(spark, args.data))
    if not checks.shared(rows, "group", "pool").isEmpty():
        raise SystemExit("a document is in both pools")
    sinks.write_once(sampling.stratified(rows, ["pool", "dataset", "label"], args.size).drop("place"), args.out)


def _rows(spark: SparkSession, path: str):
    from claimworks.sources import scans

    return scans.user_rows(spark.read.json(path) if path.endswith((".json", ".jsonl")) else scans.table(spark, path))


def score(args) -> None:
    """Scores with the stand-in model, window by window; a service or a local model takes its place as another make().

    A run that died is gone on with first; then what the cache does not have, failed rows too, is a round of its own.
    """
    from claimworks.operators import joins, sampling, scoring
    from claimworks.operators.lineage import exists
    from claimworks.streaming import resume, windows

    spark = _session()
    place = resume.run_location(args.out, {"questions": args.questions, "data": args.data})
    done = lambda rows: scoring.scored(rows, scoring.hash_scorer(args.questions), args.questions, rate=args.rate)
    number = 0
    while True:
        pending, cache = f"{place}/rounds/{number}/pending", f"{place}/cache"
        fresh = not exists(spark, f"{pending}/_SUCCESS")
        if fresh:
            rows = sampling.interleaved(_rows(spark, args.data), ["dataset", "label"], ["id"], args.limit)
            rows = joins.pending(rows, spark.read.parquet(cache)) if exists(spark, cache) else rows
            rows.select("id", "doc", "claim").write.mode("overwrite").parquet(pending)
        windows.score_windows(spark, pending, f"{place}/rounds/{number}", done, args.window, cache=f"{cache}/round={number}", errors=f"{place}/errors/round={number}", most=args.errors)
        if fresh:
            break
        number += 1
    print(place)


def report(args) -> None:
    from claimworks.operators.leaderboard import markdown
    from claimworks.plans import checkers

    spark = _session()
    rows = _rows(spark, args.data)
    reports = [checkers.report(rows, spark.read.parquet(f"{c}/cache"), checkers.Checker(c.rstrip("/").rsplit("/", 1)[-1], threshold=args.threshold), whole=not args.partial) for c in args.runs]
    print(markdown(checkers.comparison(*reports), ["scope"]) if len(reports) > 1 else markdown(reports[0], ["scope"]))


def check(args) -> None:
    from claimworks.plans import checkers

    value, verdict = checkers.check_claim(_session(), args.document, args.claim, json.loads(args.answers), checkers.Checker("check", threshold=args.threshold))
    print(json.dumps({"score": value, "verdict": verdict}))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="claimworks", description=__doc__)
    commands = parser.add_subparsers(required=True)
    p = commands.add_parser("prepare")
    p.add_argument("data")
    p.add_argument("out")
    p.add_argument("--size", type=int, default=110)
    p.set_defaults(run=prepare)
    p = commands.add_parser("score")
    p.add_argument("data")
    p.add_argument("out")
    p.add_argument("--questions", nargs="+", default=["support", "unsupported", "contradicted"])
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--rate", type=float)
    p.add_argument("--window", type=int, default=10000, help="rows that are kept at a time")
    p.add_argument("--errors", type=int, default=10, help="failed rows after which a run stops")
    p.set_defaults(run=score)
    p = commands.add_parser("report")
    p.add_argument("data")
    p.add_argument("runs", nargs="+")
    p.add_argument("--threshold", type=float, default=0.30)
    p.add_argument("--partial", action="store_true", help="report the rows that have answers; else a row without one is an error")
    p.set_defaults(run=report)
    p = commands.add_parser("check")
    p.add_argument("document")
    p.add_argument("claim")
    p.add_argument("answers", help="probabilities by question, as JSON")
    p.add_argument("--threshold", type=float, default=0.30)
    p.set_defaults(run=check)
    args = parser.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
