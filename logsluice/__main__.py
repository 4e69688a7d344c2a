"""The jobs from the command line: ``spark-submit`` or ``python -m logsluice <job> ...``."""

from __future__ import annotations

import argparse
from datetime import date

from logsluice.functions.paths import ACCOUNT_LAYOUT, HIVE_LAYOUT
from logsluice.plans import jobs
from logsluice.session import session

LAYOUTS = {"account": ACCOUNT_LAYOUT, "hive": HIVE_LAYOUT}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logsluice")
    commands = top.add_subparsers(dest="job", required=True)

    def command(name: str, *names: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for argument in ("root", *names):
            sub.add_argument(f"--{argument}", required=True)
        sub.add_argument("--layout", choices=LAYOUTS, default="account")
        return sub

    command("backfill", "dest")
    month = command("backfill-month", "dest")
    month.add_argument("--year", type=int, required=True)
    month.add_argument("--month", type=int, required=True)
    for name in ("incremental", "incremental-lookback"):
        sub = command(name, "dest")
        sub.add_argument("--as-of", type=date.fromisoformat, default=None)
    sub.add_argument("--days", type=int, default=7)
    command("register-partitions", "table")
    recent = command("register-recent", "table")
    recent.add_argument("--as-of", type=date.fromisoformat, default=None)
    for name in ("convert-table", "publish"):
        sub = commands.add_parser(name)
        sub.add_argument("--table", required=True)
        sub.add_argument("--dest", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    arguments = vars(parser().parse_args(argv))
    job = arguments.pop("job").replace("-", "_")
    if "as_of" in arguments and arguments["as_of"] is None:
        arguments["as_of"] = date.today()
    if "layout" in arguments:
        arguments["layout"] = LAYOUTS[arguments["layout"]]
    result = getattr(jobs, job)(session(f"logsluice {job}"), **arguments)
    if job.startswith("register"):
        result.show()
    elif result is not None:
        print(result)


if __name__ == "__main__":
    main()
