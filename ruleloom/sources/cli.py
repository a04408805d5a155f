"""Command line: python -m ruleloom.sources.cli evaluate TREE [--inputs FILE] [--as predicate|expression] [--max-nodes N].

Files hold JSON; - is standard input. Exit status: 0 for a definite value, 1 for an indeterminate one, 2 for a refusal.
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv=None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="ruleloom", description="Evaluate a tree on named inputs.")
    parser.add_argument("--version", action="version", version="ruleloom 0.1")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("evaluate")
    run.add_argument("tree")
    run.add_argument("--inputs")
    run.add_argument("--as", dest="of", choices=("predicate", "expression"))
    run.add_argument("--max-nodes", type=int)
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if args.tree == "-" and args.inputs == "-":
        print("standard input can be read once only", file=sys.stderr)
        return 2
    try:
        tree, inputs = (json.loads(sys.stdin.read() if p == "-" else open(p, encoding="utf-8").read()) if p else {} for p in (args.tree, args.inputs))
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from ruleloom.plans.lower import MAX_NODES
    from ruleloom.sources.document import evaluate_document

    spark = spark or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    out = evaluate_document(spark, tree, inputs, args.of, MAX_NODES if args.max_nodes is None else args.max_nodes)
    print(json.dumps(out))
    if out["outcome"] != "evaluated":
        return 2
    return 0 if out["status"] == "definite" else 1


if __name__ == "__main__":
    sys.exit(main())
