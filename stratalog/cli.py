"""Command line: query, explain and schema."""

from __future__ import annotations

import argparse
import sys

from .engine import Engine
from .errors import EngineError
from .session import session
from .sources import logs, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stratalog", description="Query logs, JSON lines and Parquet files on Spark.")
    commands = out.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="run a query and print its result")
    explain = commands.add_parser("explain", help="print Spark's plan of a query")
    for command in (query, explain):
        command.add_argument("text")
        command.add_argument("--table", action="append", default=[], metavar="NAME:FORMAT=PATH")
        command.add_argument("--mode", choices=("PERMISSIVE", "FAILFAST"), default="PERMISSIVE", help="what a field that doesn't parse is: null or an error")
        command.add_argument("--threads", type=int, default=0, help="local threads; 0 takes all")
    query.add_argument("--output", choices=sinks.MODES, default="table")
    schema = commands.add_parser("schema", help="print the fields of a log format")
    schema.add_argument("format", nargs="?")
    return out


def engine(args: argparse.Namespace) -> Engine:
    out = Engine(session(**{"spark.master": f"local[{args.threads or '*'}]", "spark.ui.showConsoleProgress": "false"}))
    for spec in args.table:
        out.source(spec, args.mode)
    return out


def main(argv: list[str] | None = None, out=None) -> int:
    """Exit code 0, or 1 after an error, which goes to stderr."""
    args, out = parser().parse_args(argv), out or sys.stdout
    try:
        if args.command == "schema":
            if args.format is None:
                print("\n".join(logs.FIELDS), file=out)
            else:
                print("\n".join(sinks.grid([list(x) for x in logs.describe(args.format)])), file=out)
        elif args.command == "explain":
            print(engine(args).explain(args.text), file=out)
        else:
            sinks.show(engine(args).sql(args.text), args.output, out)
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # Spark's own errors
        print(f"ExecutionError: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
