"""A cross-section of the registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, canonical

NAMES = ["document_audit", "file_inventory", "code_scan_findings", "file_triage", "validate_rejects", "dedup_same_line", "assign_ids", "near_duplicate_groups",
         "jaccard_groups", "family_members", "gate_tiers", "gate_blockers", "compliance_cube", "line_relocation", "import_edges", "blast_radius", "import_cycles",
         "cluster_chunks", "cluster_members", "integrity_violations", "report_semgrep", "env_findings", "duplicate_blocks", "stream_usage_windows",
         "similar_findings", "import_levels_with_circles", "unused_files", "snippet_check", "merge_near_duplicates", "loss_guard", "published_files", "json_documents", "phase_progress",
         "scanner_degraded", "layer_health", "reconcile", "artifact_completeness", "nominal_files"]


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, duck, name):
    frame = entry.queries()[name](spark, folder)
    result = duck.execute(entry.oracle_sql()[name])
    want = canonical([c[0] for c in result.description], result.fetchall())
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
