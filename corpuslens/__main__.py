"""Command line: ``python -m corpuslens list | run | report | eta``.

The master, the data folder and the output may also come from the environment
(CORPUSLENS_MASTER, CORPUSLENS_DATA, CORPUSLENS_OUT); options win.
"""

from __future__ import annotations

import argparse
import os
import sys

from corpuslens import plans
from corpuslens.plans.presets import CONFIGURATIONS, estimated_seconds

FORMATS = ("json", "csv", "parquet", "markdown", "latex")


def parser() -> argparse.ArgumentParser:
    env = os.environ.get
    p = argparse.ArgumentParser(prog="corpuslens")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries and configurations")
    for name in ("run", "report"):
        s = sub.add_parser(name)
        if name == "run":
            s.add_argument("query", choices=sorted(plans.QUERIES), metavar="QUERY")
            s.add_argument("--format", choices=FORMATS, default="json")
            s.add_argument("--limit", type=int, help="rows to return, in the order of the first column")
        else:
            s.add_argument("--reports", default=None, help="numbers such as 1,3; all by default")
        s.add_argument("--data", default=env("CORPUSLENS_DATA"), required=env("CORPUSLENS_DATA") is None)
        s.add_argument("--out", default=env("CORPUSLENS_OUT"), required=name == "report" and env("CORPUSLENS_OUT") is None)
        s.add_argument("--master", default=env("CORPUSLENS_MASTER"))
    e = sub.add_parser("eta", help="estimated duration of a configuration")
    e.add_argument("configuration", choices=list(CONFIGURATIONS), metavar="CONFIGURATION")
    e.add_argument("--samples", type=int, required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join([*sorted(plans.QUERIES), *CONFIGURATIONS]))
        return 0
    if args.command == "eta":
        seconds = estimated_seconds(args.configuration, args.samples)
        print("no estimate" if seconds is None else f"{seconds} s ({seconds / 3600:.1f} h)")
        return 0
    from corpuslens.plans import reports
    from corpuslens.session import build_session
    from corpuslens.sources import render

    spark = build_session("corpuslens", args.master)
    if args.command == "report":
        print("\n".join(reports.write_all(spark, args.data, args.out, args.reports)))
        return 0
    df = plans.QUERIES[args.query](spark, args.data)
    df = df if args.limit is None else df.orderBy(df.columns[0]).limit(args.limit)
    if args.format in ("markdown", "latex"):
        text = render.markdown(df) if args.format == "markdown" else render.latex(df, args.query, f"tab:{args.query}")
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text + "\n")
        else:
            print(text)
    elif args.out:
        df.write.mode("overwrite").options(header=True).format(args.format).save(args.out)
    else:
        for line in df.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
