"""Which corpus queries are registered."""

import re

import __spark_entry__ as entry_points


def test_one_query_for_each_operator_and_the_pipeline():
    names = [n for n in entry_points.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert {"op2_exact_topk", "op10_minhash_near_dedup", "op11_target_resampling", "op12_url_filters", "op13_spelling_variants"} == {n for n in names if n in entry_points.oracle_sql()}
