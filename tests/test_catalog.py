"""Queries against their DuckDB formulations on the smallest tables."""

import pytest

from thicketry.plans import catalog

#: One of each family; the driver compares all of them.
SOME = ["content_digest", "annex_key_digest", "scan_exclude_rollup", "error_nodes_perturb_hash", "flatten_postorder", "row_format", "find_topmost", "find_labels_first_wins", "dupes_simplified", "set_merge_last_wins", "diff_render", "tree_info", "find_regex", "row_format_errors", "row_parse", "diff_links_and_errors", "assert_same_trees", "apply_deltas", "rm_subtree", "add_subtree", "wrap_dirs", "set_with_note", "set_sorted_lines", "dupes_scored", "dupes_explained"]


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.SQL.keys() and len(catalog.QUERIES) > 50


@pytest.mark.parametrize("name", SOME)
def test_query_equals_duckdb(spark, duck, name):
    found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    wanted = duck.sql(catalog.SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    rows = wanted.fetchall()
    assert rows and plain([tuple(r) for r in found.collect()], found.columns) == plain(rows, wanted.columns)
