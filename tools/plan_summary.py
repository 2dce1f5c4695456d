"""Run the headline queries and summarise their final (adaptive) physical plans into PLANS.md.

Per query: shuffles (Exchange hashpartitioning keys), joins by kind, aggregate
kinds, WindowGroupLimit, Python evaluation, and the parquet scans' pushed
filters and read schemas.

Usage: python tools/plan_summary.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from zonelens.plans import catalog  # noqa: E402
from zonelens.session import get_session  # noqa: E402

QUERIES = [
    "risk_kpis", "base_kpis", "hist_entropy_flat", "topn_qnames", "topn_high_entropy", "breakdowns_flat",
    "domain_parts", "silver", "has_answer", "root_cardinality", "subdomain_map", "avg_entropy_histogram",
    "tpl_top_domains", "packets_classified",
]
KINDS = [
    "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
    "HashAggregate", "SortAggregate", "ObjectHashAggregate", "WindowGroupLimit", "Window", "Expand", "Generate",
    "TakeOrderedAndProject", "BatchEvalPython", "ArrowEvalPython",
]


def final_plan(df) -> str:
    """Execute through the DataFrame's own query execution, then read its final adaptive plan."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    # The adaptive plan prints the final plan followed by the initial one; keep the final.
    return text.split("== Initial Plan ==")[0]


def summarise(text: str) -> list[str]:
    lines = []
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    keys = [re.sub(r"#\d+L?", "", s).rsplit(",", 1)[0] for s in shuffles]
    lines.append(f"- shuffles ({len(keys)}): " + ("; ".join(f"`{k}`" for k in keys) if keys else "none"))
    single = len(re.findall(r"Exchange SinglePartition", text))
    if single:
        lines.append(f"- single-partition exchanges: {single}")
    counts = {k: len(re.findall(rf"\b{k}\b", text)) for k in KINDS}
    lines.append("- operators: " + ", ".join(f"{k} x{v}" for k, v in counts.items() if v))
    for m in re.finditer(r"FileScan parquet [^\n]*", text):
        scan = m.group(0)
        pushed = re.search(r"PushedFilters: \[([^\]]*)\]", scan)
        schema = re.search(r"ReadSchema: (struct<[^>]*>)", scan)
        loc = re.search(r"Location: \w+(?:\(\d+ paths?\))?\[([^\]]*)\]", scan)
        name = os.path.basename(loc.group(1)) if loc else "?"
        lines.append(
            f"- scan `{name}`: pushed `{pushed.group(1) if pushed else ''}`; reads `{schema.group(1) if schema else ''}`"
        )
    return lines


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session()
    out = [
        "# Physical plans of the headline queries",
        "",
        f"Final adaptive plans at `{sf_dir}` on `{spark.sparkContext.master}` (generated by `tools/plan_summary.py`). "
        "Queries that read a checkpointed rollup or silver (`base_kpis`, `has_answer`, `gold_wide`, `dashboard`) "
        "show only the shuffles after the checkpoint; the rollup shuffle ran in the checkpoint job.",
        "",
    ]
    for name in QUERIES:
        text = final_plan(catalog.QUERIES[name](spark, sf_dir))
        out.append(f"## {name}")
        out.extend(summarise(text))
        out.append("")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    print("\n".join(out))


if __name__ == "__main__":
    main()
