"""Command line: python -m loomspark.cli [--vault DIR | --config FILE] VERB ...

Exit codes: 0 done, 1 not available or a golden run below its bar, 2 usage or configuration.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict
from pathlib import Path

from loomspark.operators.fusion import Fusion
from loomspark.policy import Policy
from loomspark.sources import files
from loomspark.sources.vault import VaultAccessError

VAULT_ENV = "LOOMSPARK_VAULT"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspark", description=__doc__)
    place = p.add_mutually_exclusive_group()
    place.add_argument("--vault")
    place.add_argument("--config", type=Path)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: tuple) -> None:
        v = verbs.add_parser(name)
        for flag, kind, default in args:
            if kind is bool:
                v.add_argument(flag, action="store_true")
            elif flag.startswith("-"):
                v.add_argument(flag, type=kind, default=default)
            else:
                v.add_argument(flag, type=kind)

    fusion = ("--fusion", Fusion, Fusion.RRF)
    verb("search", ("query", str, None), ("-k", int, 8), fusion)
    verb("read", ("path", str, None))
    verb("neighbors", ("path", str, None), ("--depth", int, 1), ("--budget", int, 4000))
    verb("recent", ("--days", int, 7), ("--limit", int, 20))
    verb("golden", ("--file", Path, None), ("--min-recall", float, None), ("--baseline", Path, None), fusion)
    verb("index", ("--force", bool, False))
    verb("gaps", ("--threshold", float, 0.6))
    verb("similar", ("path", str, None), ("-k", int, 8))
    verb("dismiss", ("a", str, None), ("b", str, None))
    verb("status")
    return p


def run(args: argparse.Namespace, engine) -> int:
    if args.verb == "search":
        print(files.to_json(engine.search(args.query, args.k, args.fusion)))
    elif args.verb == "read":
        print(engine.read(args.path), end="")
    elif args.verb == "neighbors":
        print(files.to_json(engine.neighbors(args.path, args.depth, args.budget)))
    elif args.verb == "recent":
        print(files.to_json(engine.recent_activity(args.days, args.limit)))
    elif args.verb == "index":
        print(files.to_json(engine.index(args.force)))
    elif args.verb == "gaps":
        print(json.dumps([{"a": a, "b": b, "score": s} for a, b, s in engine.gaps(threshold=args.threshold)], indent=2))
    elif args.verb == "similar":
        print(json.dumps([{"note_path": p, "score": s} for p, s in engine.similar_notes(args.path, args.k)], indent=2))
    elif args.verb == "dismiss":
        engine.dismiss(args.a, args.b)
    elif args.verb == "status":
        print(json.dumps(engine.status(), indent=2))
    elif args.verb == "golden":
        queries = files.load_golden(args.file, engine.policy.vault_root)  # before any work on the index
        baseline = files.report_from_dict(json.loads(args.baseline.read_text())) if args.baseline else None
        engine.index()
        before = engine.store.current()["snapshot"]
        report = engine.golden(queries, args.fusion)
        out = asdict(report) | {"provenance": asdict(engine.provenance(args.file, queries, args.fusion))}
        if engine.store.current()["snapshot"] != before:
            print("warning: the index changed during the run", file=sys.stderr)
        if baseline:
            out["regressions"] = [d for d in engine.diff(baseline, report) if d["delta"] < 0]
        print(json.dumps(out, indent=2))
        return int(bool(out.get("regressions")) or (args.min_recall is not None and report.mean_recall < args.min_recall))
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.config:
            policy = Policy.from_toml(args.config)
        elif args.vault or os.environ.get(VAULT_ENV):
            policy = Policy.for_vault(args.vault or os.environ[VAULT_ENV])
        else:
            print(f"error: no vault (--vault, --config or ${VAULT_ENV})", file=sys.stderr)
            return 2
    except (ValueError, KeyError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from loomspark.engine import Engine

    spark = spark or SparkSession.builder.appName("loomspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(args, Engine(spark, policy))
    except (VaultAccessError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
