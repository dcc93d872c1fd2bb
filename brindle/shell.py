"""Statements from standard input or a file: python -m brindle.shell FOLDER [FILE.sql].

Without a file: reads statements up to a semicolon, `exit` or the end of input ends it.  With one: runs each
statement $BRINDLE_RUNS times (once if unset).  $BRINDLE_TIMES=1 reports times, $BRINDLE_PROMPT=0 hides the prompt.
"""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame

from .api import connect
from .plans import statements
from .plans.sqlfront import Engine


def table_text(df: DataFrame, most: int = 10_000) -> str:
    """The rows as text (at most `most` of them, which is said)."""
    rows = [tuple("NULL" if v is None else str(v) for v in r) for r in df.limit(most + 1).collect()]
    widths = [max([len(c), *(len(r[k]) for r in rows[:most])]) for k, c in enumerate(df.columns)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)) + " |"
    out = [line(df.columns), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, rows[:most])]
    return "\n".join([*out, *([f"(the first {most} rows)"] if len(rows) > most else [])])


def typed(lines: TextIO, prompt: str) -> Iterator[str]:
    """Statements as they are typed."""
    held = ""
    while True:
        print(prompt if not held else "   >" if prompt else "", end="", flush=True)
        line = lines.readline()
        if not line or (not held.strip() and line.strip().rstrip(";") in ("exit", "quit")):
            break
        held += line
        if held.rstrip().endswith(";"):
            yield from statements.split(held)
            held = ""
    yield from statements.split(held)


def run(engine: Engine, text: str, runs: int = 1, times: bool = False, out: TextIO = sys.stdout) -> None:
    """One statement; a query's rows are printed once, however often it runs."""
    for k in range(runs):
        began = time.perf_counter()
        df = engine.sql(text)
        planned = time.perf_counter()
        shown = table_text(df) if df.columns != ["done"] else ""
        if times:
            print(f"planning: {1000 * (planned - began):.1f} ms, execution: {1000 * (time.perf_counter() - planned):.1f} ms", file=sys.stderr)
        if shown and not k:
            print(shown, file=out)
        if not shown:
            break  # a statement that changes tables runs once


def main(argv: list[str]) -> int:
    if not 1 <= len(argv) <= 2:
        print(__doc__, file=sys.stderr)
        return 1
    engine, times = connect(argv[0]).engine, os.environ.get("BRINDLE_TIMES", "0") != "0"
    if len(argv) == 2:
        with open(argv[1], encoding="utf-8") as f:
            for one in statements.split(f.read()):
                run(engine, one, int(os.environ.get("BRINDLE_RUNS", "1")), times)
        return 0
    for one in typed(sys.stdin, "sql>" if os.environ.get("BRINDLE_PROMPT", "1") != "0" else ""):
        try:
            run(engine, one, 1, times)
        except Exception as e:  # the session goes on
            print(f"error: {e}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
