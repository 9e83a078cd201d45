"""Command line: inspect, migrate, verify."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import __version__, commands
from .contracts import TARGET
from .errors import Refusal


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--version", action="version", version=f"lodestone {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("inspect")
    i.add_argument("source")
    i.add_argument("--format", choices=["json", "text"], default="json", dest="form")
    i.add_argument("--report")
    m = sub.add_parser("migrate")
    m.add_argument("source")
    m.add_argument("--output", required=True)
    m.add_argument("--target", default=TARGET)
    for name in ("manifest", "report", "id-map", "unsupported-report"):
        m.add_argument(f"--{name}", dest={"unsupported-report": "unsupported"}.get(name, name.replace("-", "_")))
    m.add_argument("--checksums", choices=["sha256"], default="sha256")
    for flag in ("dry-run", "copy-only", "strict", "best-effort", "resume", "load-joblib"):
        m.add_argument(f"--{flag}", action="store_true", dest=flag.replace("-", "_"))
    m.add_argument("--verify", action="store_true", dest="verify_after")
    c = sub.add_parser("verify")
    c.add_argument("output")
    c.add_argument("--manifest", required=True)
    c.add_argument("--report")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; refusals go to stderr as JSON and give their exit code. 2 is a usage error."""
    try:
        args = vars(parser().parse_args(argv))
    except SystemExit as e:
        return int(e.code or 0)
    command = args.pop("command")
    args.pop("best_effort", None)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    try:
        return getattr(commands, command)(spark, **args)
    except Refusal as e:
        print(json.dumps({"error": {"code": e.name, "exit_code": e.code, "cause": e.cause, "message": str(e), "mitigation": e.mitigation}}), file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
