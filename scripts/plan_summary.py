"""Summarise the final (post-AQE) physical plan of every registered query as PLANS.md.

usage: python scripts/plan_summary.py [sf_dir] [out.md]

Each query is executed once; the plans are those Spark recorded for all its
executions, after adaptive changes (runtime join conversions, coalescing and
skew splits are visible), also for tables it wrote before its final read.
Counts come from the plan text: shuffles that ran, join strategies, aggregates,
windows, file scans per table, local or checkpointed rows and Python nodes.
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slate.plans.catalog import QUERIES  # noqa: E402
from slate.session import build_session  # noqa: E402

PY_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def _executions(spark) -> list:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(i) for i in range(found.size())]


def last_execution(spark) -> int:
    """Id of the newest SQL execution of the session (-1 if there was none)."""
    return max((r.executionId() for r in _executions(spark)), default=-1)


def executed_plans(spark, after: int = -1) -> list[str]:
    """Final plan of every SQL execution with an id above ``after``, in order.

    Ids grow for ever while Spark remembers only the last executions
    (``spark.sql.ui.retainedExecutions``), so places in its list mean nothing.
    """
    out = []
    for text in (r.physicalPlanDescription() for r in sorted(_executions(spark), key=lambda r: r.executionId()) if r.executionId() > after):
        text = text.split("== Physical Plan ==", 1)[-1]
        if "== Final Plan ==" in text:
            text = text.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
        out.append(text)
    return out


def summarise(text: str) -> dict[str, str]:
    lines = text.splitlines()

    def count(pattern: str) -> int:
        return sum(1 for line in lines if re.search(pattern, line))

    files = collections.Counter(re.findall(r"/(\w+)\.parquet", text))
    return {
        "shuffles": str(count(r"ShuffleQueryStage \d+")),
        "broadcast joins": str(count(r"BroadcastHashJoin")),
        "sort-merge joins": str(count(r"SortMergeJoin")),
        "aggregates": str(count(r"(Hash|ObjectHash|Sort)Aggregate\(")),
        "windows": str(count(r"^\W*(\*\(\d+\) )?Window ")),
        "scans": ", ".join(f"{t}" + (f" x{n}" if n > 1 else "") for t, n in sorted(files.items())) or "-",
        "RDD scans": str(count(r"Scan ExistingRDD")),
        "python": str(sum(count(p) for p in PY_NODES)),
    }


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    out = argv[2] if len(argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                                     "PLANS.md")
    spark = build_session(master="local[8]", shuffle_partitions=8)
    cols = ["shuffles", "broadcast joins", "sort-merge joins", "aggregates", "windows", "scans",
            "RDD scans", "python"]
    rows = []
    spark.conf.set("spark.sql.ui.explainMode", "extended")
    for key, q in QUERIES.items():
        seen = last_execution(spark)
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        rows.append((key, summarise("\n".join(executed_plans(spark, seen)))))
        print(key, rows[-1][1], flush=True)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    with open(out, "w") as f:
        f.write("# PLANS\n\n")
        f.write(f"Final (post-AQE) physical plans of every registered reference query at sf{m.group(1) if m else '?'}, "
                "`local[8]`, 8 shuffle partitions, generated by `scripts/plan_summary.py`. *shuffles* counts the "
                "shuffle stages that ran. *scans* lists the driver tables read, with the count when a table is "
                "read more than once. *RDD scans* are reads of a few local rows, such as the fixed free-agent row. "
                "All executions of a query count, also the tables it writes before its final read; the reports' "
                "player and schedule tables are stored by the first report that needs them.\n\n")
        f.write("| query | " + " | ".join(cols) + " |\n")
        f.write("| --- | " + " | ".join("---" for _ in cols) + " |\n")
        for key, s in rows:
            f.write(f"| `{key}` | " + " | ".join(s[c] for c in cols) + " |\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
