"""python -m tidemark FEATURE --source NAME=PATH ... --start MS --end MS [--resolution MS] [feature options] [--format csv|json|yaml]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.plans.grid import DAY
from tidemark.plans.registry import SECONDARY, all_features, run


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description="Compute a feature from Parquet tables.")
    commands = out.add_subparsers(dest="feature", required=True)
    for name, entry in sorted(all_features().items()):
        one = commands.add_parser(name, help=(entry.function.__doc__ or "").split("\n")[0])
        one.add_argument("--source", action="append", required=True, metavar="NAME=PATH", help=f"inputs: {', '.join(entry.sources)}")
        one.add_argument("--start", type=int)
        one.add_argument("--end", type=int)
        if entry.kind == SECONDARY:
            one.add_argument("--resolution", type=int, default=DAY)
        one.add_argument("--id", action="append", help="participants; all without it")
        one.add_argument("--format", choices=("csv", "json", "yaml"), default="csv")
        one.add_argument("--output", help="folder to write to instead of printing")
        for option, p in entry.parameters.items():
            if p.kind is p.VAR_KEYWORD:
                continue
            kind = type(p.default) if p.default not in (None, p.empty) else str
            one.add_argument(f"--{option}", type=(lambda s: s.lower() in ("1", "true", "yes")) if kind is bool else kind, default=None, required=p.default is p.empty)
    return out


def main(arguments: list[str] | None = None) -> int:
    args = vars(parser().parse_args(arguments))
    spark = SparkSession.builder.getOrCreate()
    sources = {name: spark.read.parquet(path) for name, _, path in (s.partition("=") for s in args["source"])}
    entry = all_features()[args["feature"]]
    if lacking := [i for i in entry.sources if i not in sources]:
        sys.exit(f"{entry.name} needs --source for {', '.join(lacking)}")
    people = sources[entry.sources[0]].select("participant_id").distinct()
    if args["id"]:
        people = people.where(people["participant_id"].cast("string").isin(args["id"]))
    options = {k: args[k] for k in entry.parameters if args.get(k) is not None}
    found = run(sources, people, [entry.name], args["start"], args["end"], args.get("resolution") or DAY, {entry.name: options})
    if entry.name not in found:
        return 0
    out = found[entry.name]
    if args["output"]:
        (out.write.json if args["format"] == "json" else out.write.option("header", True).csv)(args["output"])
        return 0
    columns = out.columns
    if args["format"] == "csv":
        print(",".join(columns))
    for r in out.toLocalIterator():
        values = ["" if r[c] is None else str(r[c]) for c in columns]
        if args["format"] == "csv":
            print(",".join(values))
        elif args["format"] == "json":
            import json

            print(json.dumps(r.asDict(), default=str))
        else:
            print("- " + "\n  ".join(f"{c}: {v}" for c, v in zip(columns, values, strict=True)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
