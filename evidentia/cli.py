"""python -m evidentia.cli generate|resolve ...: a thin wrapper over the DataFrame API."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from evidentia.operators.entities import Resolution
from evidentia.sources import cases
from evidentia.synth import generate
from evidentia.synth.enrich import enrich_cases


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="evidentia")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="write synthetic cases")
    g.add_argument("--domain", choices=list(generate.dims.WINDOWS))
    g.add_argument("--suspects", type=int)
    g.add_argument("--witnesses", type=int)
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--batch", type=int, default=1)
    g.add_argument("--start-index", type=int, default=1)
    g.add_argument("--output", help="where to write; without it, cases are printed")
    g.add_argument("--validate", action="store_true")
    g.add_argument("--enrich", metavar="MODULE:FUNCTION", help="rewrite texts by a function from a question to an answer, both JSON")
    r = sub.add_parser("resolve", help="resolve case documents")
    r.add_argument("--input", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--multi-line", action="store_true", help="a file holds one document over many lines")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "resolve":
        cases.write_results(Resolution(cases.read_cases(spark, a.input, a.multi_line)).documents(), a.output)
        return 0
    docs = generate.case_documents(spark, a.batch, seed=a.seed, start=a.start_index, domain=a.domain, suspects=a.suspects, witnesses=a.witnesses)
    if a.enrich:
        module, name = a.enrich.split(":")
        docs = enrich_cases(docs, getattr(importlib.import_module(module), name))
    if a.validate and (bad := generate.validated(docs).where("size(errors) > 0").select("case_id", "errors").take(5)):
        print("\n".join(f"{b.case_id}: {', '.join(b.errors)}" for b in bad))
        return 1
    if not a.output:
        cases.print_cases(docs, a.batch)
        return 0
    cases.write_cases(docs, f"{a.output}/cases")
    cases.write_observations_only(docs, f"{a.output}/observations")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
