"""Queries against their SQL on the smallest tables."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"
NAMES = ["q02_snapshot_diff", "q04_failed_module_skip", "q12_lifecycle_diff", "q15_members_by_prefix", "q18_shared_lifecycle_division", "q22_xfer_table", "q24_impact_by_container", "q33_innermost_span", "q36_complete_records", "q43_nearest_store_asof", "q40_guarded_readers", "q76_native_changes", "q104_state_writers", "q105_argument_positions", "q106_written_state", "q107_found_first", "q108_nearest_ancestor", "q109_process_windows", "q110_literal_sets", "q111_interned_sets", "q46_outcome_transition", "q48_check_misses", "q53_cell_rollup", "q61_without_isolated_writers", "q65_target_edges", "q66_without_lazy_writes", "q80_entry_relaxed", "q84_canonical_paths", "q85_dictionary", "q90_stored_results", "q97_verdict", "q99_glob", "q100_bitmap"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    from tidemark.plans.catalog_paths import ORACLES, QUERIES

    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM read_parquet('{f}')")
    got, want = QUERIES[name](spark, DATA), db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_every_catalogue_query_has_sql():
    from tidemark.plans.catalog_paths import ORACLES, QUERIES

    assert len(QUERIES) == 111 and set(QUERIES) == set(ORACLES)
