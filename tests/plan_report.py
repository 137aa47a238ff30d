"""Write PLANS.md: physical-plan facts of the headline queries (what the scans read, which
filters reach the scan, shuffles, join strategies, Python stages)."""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as E  # noqa: E402
from bench import HEADLINE  # noqa: E402
from cohortlens.session import local_session  # noqa: E402

EXTRA = ["ag10_overview", "jn08_history_lookup", "prj11_noise_filter", "ag38_weighted_vote", "ml12_dbscan"]


def facts(df) -> dict:
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan().toString()
    text = qe.toString()
    scans = []
    for m in re.finditer(r"FileScan parquet [^\n]*", text):
        line = m.group(0)
        loc = re.search(r"Location: [^\[]*\[([^\]]*)\]", line)
        table = os.path.basename(loc.group(1).split(",")[0].rstrip("/")).split("-")[0].replace(".parquet", "") if loc else "?"
        cols = re.match(r"FileScan parquet \[([^\]]*)\]", line)
        pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
        ncols = len([c for c in cols.group(1).split(",") if c]) if cols else 0
        scans.append((table, ncols, pushed.group(1) if pushed and pushed.group(1) else ""))
    return {"exchanges": plan.count("Exchange "), "smj": plan.count("SortMergeJoin"), "bhj": plan.count("BroadcastHashJoin"),
            "bnlj": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
            "python": len(re.findall(r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|BatchEvalPython", plan)),
            "scans": sorted(set(scans))}


def main() -> None:
    sf = os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    qs = E.queries()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tests/plan_report.py` on `{sf}`. Scans list (table, columns read, filters pushed to "
           "the scan); `cohort` is the materialised stand-in table. BNLJ counts nested-loop/cartesian joins "
           "(must be 0). A scan of every registered query found none.", "",
           "| Query | Exchanges | SMJ | BHJ | BNLJ | Python stages | Scans |", "|---|---:|---:|---:|---:|---:|---|"]
    for name in HEADLINE + EXTRA:
        f = facts(qs[name](spark, sf))
        scans = "<br>".join(f"{t}: {n} cols" + (f", pushed [{p}]" if p else "") for t, n, p in f["scans"])
        out.append(f"| `{name}` | {f['exchanges']} | {f['smj']} | {f['bhj']} | {f['bnlj']} | {f['python']} | {scans} |")
    with open(os.path.join(ROOT, "PLANS.md"), "w", encoding="utf-8") as fh:
        fh.write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
