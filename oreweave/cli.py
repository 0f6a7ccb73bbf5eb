"""Command line: ``python -m oreweave.cli <command>``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from oreweave.operators.research import WEB_RESULT, harvested_web_search, run_research, stored_web_search
from oreweave.plans import crawl as C
from oreweave.plans import harvest as H
from oreweave.plans import pipeline as P
from oreweave.session import get_spark
from oreweave.sinks.ledger import Ledger
from oreweave.sources.providers import profile_queries


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="oreweave")
    parser.add_argument("--ledger", required=True, help="folder of the ledger tables")
    parser.add_argument("--master", default=None, help="Spark master; the cluster's own when left out")
    commands = parser.add_subparsers(dest="command", required=True)

    ingest = commands.add_parser("ingest", help="scan, parse and chunk a folder")
    ingest.add_argument("path")
    ingest.add_argument("--run-name")
    ingest.add_argument("--ocr", choices=["auto", "always", "off"], default="auto")

    refresh = commands.add_parser("refresh", help="bring a run up to date with its folder")
    refresh.add_argument("path")
    refresh.add_argument("--run-id", default="latest")
    refresh.add_argument("--ocr", choices=["auto", "always", "off"], default="auto")
    refresh.add_argument("--max-attempts", type=int, default=1, help="times a file is tried whose parser fails")

    vacuum = commands.add_parser("vacuum", help="remove old versions of the ledger tables")
    vacuum.add_argument("--keep", type=int, default=2)

    records = commands.add_parser("records", help="ingest provider records from JSON lines")
    records.add_argument("source_type", choices=["openalex", "oqmd", "materials_project"])
    records.add_argument("path")
    records.add_argument("--run-name", default="records")

    harvest = commands.add_parser("harvest", help="export works of a provider by queries; goes on with an unfinished export")
    harvest.add_argument("out")
    harvest.add_argument("--query", action="append", default=[])
    harvest.add_argument("--profile", help="queries of a profile, when none are given")
    harvest.add_argument("--limit-per-query", type=int, default=0)
    harvest.add_argument("--limit-total", type=int, default=0)
    harvest.add_argument("--max-pages", type=int, default=0)
    harvest.add_argument("--max-stale-pages", type=int, default=0)
    harvest.add_argument("--page-size", type=int, default=200)
    harvest.add_argument("--resume-from", action="append", default=[])
    harvest.add_argument("--fetch", default="oreweave.sources.providers:fetch_openalex", help="module:function for one page")
    harvest.add_argument("--lookup", help="module:function for one DOI")
    harvest.add_argument("--option", action="append", default=[], help="name=value handed to the functions")
    harvest.add_argument("--no-ledger", action="store_true")

    crawl = commands.add_parser("crawl", help="file links of linked pages; goes on with an unfinished crawl")
    crawl.add_argument("out")
    crawl.add_argument("--seed", action="append", required=True)
    crawl.add_argument("--fetch", required=True, help="module:function (options, url) for the markup of one page")
    crawl.add_argument("--option", action="append", default=[], help="name=value handed to the function")
    crawl.add_argument("--max-pages", type=int, default=0)
    crawl.add_argument("--max-links", type=int, default=0)
    crawl.add_argument("--retries", type=int, default=1)
    crawl.add_argument("--known", help="text file of links that are passed over")

    for name in ("build", "build-all"):
        build = commands.add_parser(name, help="build graph tables")
        build.add_argument("--run-id", default="latest")
        build.add_argument("--stages", default="")
        build.add_argument("--dry-run", action="store_true")

    status = commands.add_parser("status", help="row counts of a run")
    status.add_argument("--run-id", default="latest")

    search = commands.add_parser("search", help="lexical and graph search")
    search.add_argument("query")
    search.add_argument("--run-id", default="latest")
    search.add_argument("--top-k", type=int, default=8)

    research = commands.add_parser("research", help="answer a question with citations")
    research.add_argument("--question", required=True)
    research.add_argument("--run-id", default="latest")
    research.add_argument("--mode", default="auto")
    research.add_argument("--top-k", type=int, default=8)
    research.add_argument("--max-subqueries", type=int, default=3)
    research.add_argument("--max-context", type=int, default=12)
    research.add_argument("--web-results", help="JSON lines of stored search results")
    research.add_argument("--works", help="folder of a harvest whose works are searched as well")
    research.add_argument("--web-max", type=int, default=6)
    research.add_argument("--json", action="store_true")

    hypotheses = commands.add_parser("hypotheses", help="generate and rank candidate changes")
    hypotheses.add_argument("--target-kpi", required=True)
    hypotheses.add_argument("--run-id", default="latest")
    hypotheses.add_argument("--mode", default="tfidf")
    hypotheses.add_argument("--output")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = get_spark(master=args.master)
    ledger = Ledger(spark, args.ledger)
    if args.command == "ingest":
        run_id = P.ingest_folder(spark, ledger, args.path, args.run_name, args.ocr)
        print(json.dumps(ledger.run_status(run_id), ensure_ascii=False, default=str))
    elif args.command == "refresh":
        print(json.dumps(P.drain_folder(spark, ledger, args.path, ledger.resolve_run(args.run_id), ocr=args.ocr, max_attempts=args.max_attempts)))
    elif args.command == "vacuum":
        print(json.dumps({"removed": ledger.vacuum(args.keep)}))
    elif args.command == "records":
        payloads = spark.read.text(args.path).select(F.col("value").alias("payload")).where(F.try_parse_json("payload").isNotNull())
        run_id = P.ingest_records(spark, ledger, payloads, args.source_type, args.run_name)
        print(json.dumps(ledger.run_status(run_id), ensure_ascii=False, default=str))
    elif args.command == "harvest":
        options = {"fetch": args.fetch, **dict(o.split("=", 1) for o in args.option)}
        limits = H.Limits(args.limit_per_query, args.limit_total, args.max_pages, args.max_stale_pages, args.page_size)
        manifest = H.export_literature(
            spark, args.out, args.query or profile_queries(args.profile or "full"), H.fetched_pages(options), limits, args.resume_from,
            args.lookup, options, None if args.no_ledger else ledger,
        )
        print(json.dumps(manifest, ensure_ascii=False))
        return 2 if manifest["failed_queries"] else 0
    elif args.command == "crawl":
        limits = C.Limits(args.max_pages, args.max_links, args.retries)
        known = spark.read.text(args.known).select(F.col("value").alias("link")) if args.known else None
        manifest = C.harvest_links(spark, args.out, args.seed, C.fetched(args.fetch, dict(o.split("=", 1) for o in args.option)), limits, known)
        print(json.dumps(manifest, ensure_ascii=False))
        return 2 if manifest["failed"] else 0
    elif args.command == "build":
        run_id = ledger.resolve_run(args.run_id)
        print(json.dumps({"run_id": run_id, **P.build_graph(ledger, run_id, P.parse_stages(args.stages))}))
    elif args.command == "build-all":
        built = P.build_all(ledger, P.parse_stages(args.stages), args.dry_run)
        print(json.dumps(built))
        return 2 if any(isinstance(v, str) and v.startswith("failed") for v in built.values()) else 0
    elif args.command == "status":
        print(json.dumps(ledger.run_status(ledger.resolve_run(args.run_id)), ensure_ascii=False, default=str))
    elif args.command == "search":
        evidence, hits = P.search_graph(ledger, args.query, args.run_id, args.top_k)
        for i, row in enumerate(evidence.collect(), 1):
            print(f"[{i}] relevance={row['relevance']:.3f} source={row['source_id']} section={row['section']}")
        for i, row in enumerate(hits.collect(), 1):
            print(f"[g{i}] {row['subject_name']} --{row['predicate']}--> {row['object_name'] or row['object_value']}")
    elif args.command == "research":
        search = P.retriever(ledger, args.run_id, args.mode)
        web = stored_web_search(ledger.spark.read.schema(WEB_RESULT).json(args.web_results)) if args.web_results else None
        if args.works:
            web = harvested_web_search(H.Harvest(spark, f"{args.works.rstrip('/')}/harvest", []).works())
        result = run_research(
            args.question, lambda q: search.retrieve(q, args.top_k), web=web, web_max=args.web_max,
            max_subqueries=args.max_subqueries, max_context=args.max_context,
        )
        print(json.dumps(result.to_dict(), ensure_ascii=False) if args.json else "\n".join([result.answer, *result.warnings]))
    elif args.command == "hypotheses":
        settings = P.PipelineInput(args.target_kpi, args.run_id, args.mode)
        result = P.run_pipeline(ledger, settings)
        for i, row in enumerate(result["ranked"].limit(10).collect(), 1):
            print(f"{i}. {row['title']} score={row['final_score']:.3f}")
        if args.output:
            print(json.dumps(P.export_all(result, settings, args.output)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
