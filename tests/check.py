"""Run catalogue queries against DuckDB: `python tests/check.py SF [name ...]`."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsquant.plans.catalog import ORACLES, QUERIES  # noqa: E402
from newsquant.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main(sf: str, names: list[str]) -> int:
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toArrow()
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name in ORACLES:
            start = time.time()
            try:
                want = con.execute(ORACLES[name]).to_arrow_table()
                problems = compare(got, want)
            except Exception as e:
                problems = [f"oracle {type(e).__name__} {str(e)[:800]}"]
            bad += bool(problems)
            verdict = "; ".join(problems) if problems else "equal"
        else:
            verdict = "no SQL"
        print(f"{name}: {got.num_rows} rows, {took:.1f}s spark, {time.time() - start:.1f}s check: {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 100))
