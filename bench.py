"""Headline queries, timed. Prints one JSON line.

Each query is run once to warm up code generation and once for the clock, with its
result written to the no-op sink so that every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from caseledger.plans.catalog import REGISTRY  # noqa: E402
from caseledger.session import build_session  # noqa: E402

HEADLINE = (
    "listing_page", "f02_classification_match", "f13_boolean_search",
    "s01_folder_scan", "s06_paged_merge", "w01_merge_keep_first", "w01_keep_first_text",
    "w03_running_labels", "w04_top_per_group", "j01_outer_join_kinds", "j03_resolve_links",
    "j04_verify_species", "j07_existing_text", "j11_potential_duplicates",
    "j13_dictionary_hits", "a02_dedup_accounting", "a08_global_keywords",
    "p01_flatten_taxa", "p03_flatten_tariffs", "m01_insert_unique", "m02_update_by_id",
    "m05_add_links", "m06_remove_links", "m11_audit_updates", "k01_keyword_candidates",
    "k02_similarity_ranking", "k03_diverse_selection", "k04_frequency_ranking",
    "k05_cluster_invariants", "k06_query_builder", "k09_corpus_report", "h02_cleaning_stages",
    "r01_intake_status", "r04_persisted_tables", "t01_intake_stream",
)


def in_row_groups(spark, folder: str) -> str:
    """A folder with the same tables, texts in several files as a large table would be.

    The given ``documents`` file has one row group, which no reader can split. Done once,
    outside the clock.
    """
    out = Path(tempfile.mkdtemp(prefix="bench-"))
    for table in Path(folder).iterdir():
        if table.name != "documents.parquet":
            (out / table.name).symlink_to(table)
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    documents.repartitionByRange(32, "doc_id").write.parquet(f"{out}/documents.parquet")
    return str(out)


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    cores = int(cpus) if cpus.isdigit() else os.cpu_count()
    spark = build_session(
        "bench", f"local[{cpus}]", cores, **{"spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = in_row_groups(spark, folder)
    times = {}
    for name in HEADLINE:
        timed(spark, name, tables)
        times[name] = round(timed(spark, name, tables), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
