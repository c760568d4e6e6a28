"""Summarise the physical plans of the registered queries into PLANS.md.

For each query: number of shuffles (Exchange), broadcasts, sort-merge joins,
partial top-k (WindowGroupLimit), Python grouped-map stages, and the parquet
scans with their pruned read schema and pushed filters.  Plans are taken
after the reused inputs are materialised, so they show each query's own work;
the plans that build those inputs come after them.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summary(plan: str) -> dict:
    head = plan.split("\n\n(1)")[0]
    scans = re.findall(r"\(\d+\) Scan parquet.*?\nLocation: [^\[]*\[file:[^\]]*/([^/\]]+)\]"
                       r"(?:.*?\nPushedFilters: (\[[^\n]*\]))?.*?\nReadSchema: (struct<[^\n]*>)", plan, re.S)
    return {
        "exchanges": head.count("Exchange") - head.count("BroadcastExchange") - head.count("ReusedExchange"),
        "broadcasts": head.count("BroadcastExchange"),
        "smj": head.count("SortMergeJoin"),
        "window_group_limit": head.count("WindowGroupLimit"),
        "python": head.count("FlatMapGroupsInPandas"),
        "scans": scans,
    }


def builds(spark, sf) -> dict:
    """The plans of the materialised inputs, each over the inputs before it."""
    from cartlens.operators import cf_blocks, content, hybrid, interactions, similarity  # noqa: F401
    from cartlens.plans.context import CF_LIST, inputs
    from cartlens.plans.hybrid import _hybrid
    from cartlens.sources import tables
    i = inputs(spark, sf)
    chosen = [r["term"] for r in i.content.vocab.select("term").collect()]
    words = content.words_of(i.corpus)
    return {
        "products": tables.products(spark, sf, i.categories).drop("description"),
        "dedup": interactions.deduped_enriched(i.interactions, i.products),
        "clean": interactions.score_filtered(i.cleaned.deduped, 3, 3),
        "split": interactions.flag_train(i.clean),
        "item_pairs": similarity.item_pairs(i.train),
        "cf_lists": cf_blocks.cf_lists(i.train, i.cf_pairs, k_user=CF_LIST, k_item=CF_LIST, k_blend=10),
        "corpus": content.product_corpus(i.products_with_text, i.categories, i.tags),
        "terms": content.top_terms(words),
        "term_counts": content.counts_of_terms(words, chosen),
        "similar_lists": content.similar_products(i.content, 10),
        "content_lists": content.content_recs(i.train, i.content, 20),
        "hybrid": _hybrid(i),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out_path = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    from cartlens.session import local_session
    spark = local_session(8)
    lines = ["# Physical plans", "",
             f"Generated by `tools/plan_report.py` on `{sf}` (local[8], AQE on). Counts are taken from the",
             "initial physical plan; inputs shared between queries (clean/train tables, item pairs, CF lists,",
             "TF-IDF model) are Parquet tables; the plans that build them are listed below the queries.", "",
             "| query | shuffles | broadcasts | sort-merge joins | partial top-k | pandas groups | parquet scans (columns read) |",
             "|---|---|---|---|---|---|---|"]
    from cartlens import plans
    for name, fn in plans.queries().items():
        plan = formatted(fn(spark, sf))
        s = summary(plan)
        scans = "; ".join(f"{t.replace('.parquet', '').split('-')[0]}({len(re.findall(r':', schema))})" for t, _, schema in s["scans"])
        lines.append(f"| {name} | {s['exchanges']} | {s['broadcasts']} | {s['smj']} | {s['window_group_limit']} | "
                     f"{s['python']} | {scans} |")
    lines += ["", "## Builds of the shared inputs", "",
              "| input | shuffles | broadcasts | sort-merge joins | partial top-k | pandas groups | parquet scans (columns read) |",
              "|---|---|---|---|---|---|---|"]
    for name, df in builds(spark, sf).items():
        s = summary(formatted(df))
        scans = "; ".join(f"{t.replace('.parquet', '').split('-')[0]}({len(re.findall(r':', schema))})" for t, _, schema in s["scans"])
        lines.append(f"| {name} | {s['exchanges']} | {s['broadcasts']} | {s['smj']} | {s['window_group_limit']} | "
                     f"{s['python']} | {scans} |")
    with open(out_path, "w") as f:
        f.write("\n".join(lines) + "\n")
    print("wrote", out_path)


if __name__ == "__main__":
    main()
