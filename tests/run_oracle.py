"""Command line: python tests/run_oracle.py [sf] [name ...] compares registered queries."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import compare, duck  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from seasonpanel.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark = local_session()
    con, qs, sqls = duck(d), queries(), oracle_sql()
    names = [n for n in qs if not wanted or any(n == w or n.startswith(w) for w in wanted)]
    good = bad = loose = 0
    began = time.time()
    for name in names:
        start = time.time()
        if start - began > 780:
            print("out of time before", name)
            break
        try:
            df = qs[name](spark, d)
            if name in sqls:
                message = compare(df, con, sqls[name])
            else:
                rows = df.collect()
                message = "" if rows else "no rows"
                loose += not message
        except Exception as e:  # noqa: BLE001
            message = f"{type(e).__name__}: {str(e)[:1500]}"
        good += not message
        bad += bool(message)
        took = time.time() - start
        print(f"{'ok ' if not message else 'BAD'} {took:6.2f}s {name} {'' if name in sqls else '(rows only)'} {message}", flush=True)
    print(f"ok {good} (rows only {loose}), bad {bad}")


if __name__ == "__main__":
    main()
