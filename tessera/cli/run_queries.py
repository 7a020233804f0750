"""Run catalogue queries over a folder of tables, each to CSV, with its time.

``--skip`` wins over all else; a list in ``--queries`` overrides ``--from`` and ``--to``. A failing query is
reported and the next one runs.
"""

from __future__ import annotations

import argparse
import re
import sys
import time

from tessera.plans import queries
from tessera.session import get_session
from tessera.sources import write_csv


def parse_query_list(text: str) -> set[int]:
    """``"1, q2,Q3"`` to ``{1, 2, 3}``; what isn't a number is reported and ignored."""
    found = set()
    for token in filter(None, (t.strip() for t in text.split(","))):
        if m := re.match(r"[qQ]?([+-]?[0-9]+)", token):
            found.add(int(m[1]))
        else:
            print(f"ignored: {token}", file=sys.stderr)
    return found


def should_run(index: int, only: set[int], skip: set[int], first: int = -1, last: int = -1) -> bool:
    if index in skip:
        return False
    if only:
        return index in only
    return not (0 <= last < index or first >= 0 and index < first)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True, help="folder of <table>.parquet")
    p.add_argument("--output_dir", required=True)
    p.add_argument("--queries", default="")
    p.add_argument("--skip", default="")
    p.add_argument("--from", dest="first", type=int, default=-1)
    p.add_argument("--to", dest="last", type=int, default=-1)
    a = p.parse_args(argv)
    spark = get_session("run_queries")
    only, skip, failed = parse_query_list(a.queries), parse_query_list(a.skip), 0
    for name, fn in queries().items():
        if not re.fullmatch(r"q[0-9]+", name) or not should_run(index := int(name[1:]), only, skip, a.first, a.last):
            continue
        began = time.perf_counter()
        try:
            write_csv(fn(spark, a.input), f"{a.output_dir}/q{index}.csv", single_file=True)
            print(f"Q{index} completed in {(time.perf_counter() - began) * 1000:.0f} ms")
        except Exception as e:  # the rest should run
            failed += 1
            print(f"Q{index} failed: {e}", file=sys.stderr)
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
