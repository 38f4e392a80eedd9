"""``python -m ruleframe.cli preview|run|steps [SCHEDULE] [--sheet NAME]``."""

from __future__ import annotations

import argparse
import sys

from ruleframe.errors import RuleError
from ruleframe.plans.pipeline import Event, Pipeline, known_steps
from ruleframe.session import get_or_create, ship
from ruleframe.sources.tables import read_table


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ruleframe")
    parser.add_argument("what", choices=("preview", "run", "steps"))
    parser.add_argument("schedule", nargs="?")
    parser.add_argument("--sheet")
    asked = parser.parse_args(args)
    if asked.what == "steps":
        print(*known_steps(), sep="\n")
        return 0
    spark = ship(get_or_create())
    try:
        pipeline = Pipeline(read_table(spark, asked.schedule, asked.sheet))
        for s in pipeline.preview():
            print(f"{s.order:g} {s.function} {s.params}")
        if asked.what == "run":
            pipeline.run(spark, lambda e: print(_line(e)))
    except RuleError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _line(e: Event) -> str:
    return f"[{e.index}/{e.total}] {e.step.function} {e.state}" + (f" in {e.seconds:.1f} s: {e.result}" if e.state == "completed" else "")


if __name__ == "__main__":
    sys.exit(main())
