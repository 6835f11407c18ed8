"""Write docs/plans.md: physical plans of the headline queries after execution.

Usage: python tools/plans.py [sf_dir] > docs/plans.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINES = ["segment_parse", "dispatch_day_summary", "clustered_day_report", "energy_series", "bundle_topk", "timing_estimate"]

INTRO = """# Physical plans of the headline queries

Made by `tools/plans.py` on {sf}, `local[8]`, after execution
(`queryExecution().executedPlan()`); long expression lists are cut.

What to read in them:

* **Header attachment** — the plan starts from the landed lines: one `FileScan`
  that reads `value` (kind 1 to 3), and scans of kind 4 (one row a piece: the
  header open at its end) that never read the text. The join on `file, piece`
  gives a piece the header it starts with; Spark broadcasts these few rows by
  their size, no hint is given. There is no `InMemoryTableScan` and no range join.
* **Keep-first** — `SortAggregate` (partial) → `Exchange hashpartitioning(duid,
  time)` → `SortAggregate` (final): copies collapse before the shuffle.
* **Summary** — `HashAggregate` (partial) → `Exchange(duid, market_day)` →
  `HashAggregate` (final), exact DECIMAL mean inside.
* **Landed by unit-day** (`clustered_day_report`) — keep-first, summary, breakdown
  and head over a bucketed table: no `Exchange` at all.
* **Energy series** — one scan, one exchange, a window over the unit-day.
* **Top-k as-of** (`bundle_topk`) — joins on `(format, month)` and on rank numbers;
  no nested-loop or cartesian operator appears in any registered query
  (`tests/test_plans.py`).
* **Wait estimates** — one group limit below the shuffle, then a bounded
  `collect_list` (≤ 100 values) per source.
"""


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from wattline.plans.queries import QUERIES
    from wattline.session import get_spark

    spark = get_spark("local[8]", shuffle_partitions=16, extra={"spark.driver.memory": "8g"})
    print(INTRO.format(sf=os.path.basename(sf_dir)))
    for name in HEADLINES:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = []
        for line in plan.splitlines():
            line = re.sub(r"\[[^\[\]]{80,}\]", "[…]", line)
            lines.append(line if len(line) <= 150 else line[:150] + "…")
        print(f"## `{name}`\n\n```\n" + "\n".join(lines) + "\n```\n")


if __name__ == "__main__":
    main()
