"""Command line: validate, build, search, suggest, synth."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="shelfmark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    validate = commands.add_parser("validate", help="check a declaration")
    validate.add_argument("config")
    make = commands.add_parser("build", help="build an index")
    make.add_argument("config")
    make.add_argument("root")
    make.add_argument("index")
    find = commands.add_parser("search", help="search an index")
    find.add_argument("config")
    find.add_argument("index")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=20)
    find.add_argument("--offset", type=int, default=0)
    find.add_argument("--facet", action="append", default=[])
    offer = commands.add_parser("suggest", help="suggest words")
    offer.add_argument("config")
    offer.add_argument("index")
    offer.add_argument("text")
    offer.add_argument("--kind", choices=("completion", "correction"), default="completion")
    synth = commands.add_parser("synth", help="write a synthetic corpus")
    synth.add_argument("count", type=int)
    synth.add_argument("path")
    synth.add_argument("--seed", type=int, default=7)
    args = parser.parse_args(argv)

    from shelfmark.config import load
    from shelfmark.errors import CodedError

    try:
        config = load(json.loads(Path(args.config).read_text())) if hasattr(args, "config") else None
        if args.command == "validate":
            print(json.dumps({"ok": True, "fingerprint": config.fingerprint}))
            return 0
        from pyspark.sql import SparkSession

        from shelfmark.operators.compile import compile_site
        from shelfmark.operators.index import open_index
        from shelfmark.operators.search import Request, Searcher
        from shelfmark.operators.suggest import suggest
        from shelfmark.operators.verify import check_index, human_seconds
        from shelfmark.sources.synthetic import synthetic_corpus

        spark = SparkSession.builder.appName("shelfmark").getOrCreate()
        if args.command == "synth":
            synthetic_corpus(spark, args.count, args.seed).write.mode("overwrite").parquet(args.path)
        elif args.command == "build":
            start = time.perf_counter()
            metrics: dict = {}
            index = compile_site(spark, args.root, config, args.index, metrics)
            print(json.dumps(check_index(index, config.fields) | {"took": human_seconds(time.perf_counter() - start), "metrics": metrics}, default=str))
        else:
            searcher = Searcher(open_index(spark, args.index), config.fields, config.boosts)
            if args.command == "suggest":
                print(json.dumps([r.asDict() for r in suggest(searcher, args.text, args.kind).collect()], ensure_ascii=False))
            else:
                request = Request(args.query, limit=args.limit, offset=args.offset, facets=args.facet, columns=list(config.result_fields) or None)
                hits = [r.asDict() for r in searcher.hits(request).collect()]
                counts = [r.asDict() for r in searcher.facets(request).collect()] if args.facet else []
                print(json.dumps({"total": searcher.total(request).first().total, "hits": hits, "facets": counts}, ensure_ascii=False, default=str))
    except CodedError as error:
        print(json.dumps({"ok": False, "code": error.code, "message": error.message}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
