"""Queries against their SQL on the small tables, where those are there."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
FEW = ("eval_accuracy", "mcq_extract", "latex_grade", "boolean_extract", "text_extract", "boxed_extract", "log_replay", "case_stats", "stratified_sample", "terciles", "scaffold_parse", "json_repair", "coached_loop", "prompt_texts", "prompt_summaries", "enriched_file", "symbolic_grade", "rejected_lines", "restored_ids", "question_progress", "loader_round_trip", "length_strata", "domain_report", "bounded_calls", "strict_readings", "shared_model")


def key(rows):
    fix = lambda v: round(v, 9) if isinstance(v, float) else None if v is None or v != v else v  # noqa: E731, PLR0124
    return sorted(repr(tuple(fix(v) for v in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
@pytest.mark.parametrize("name", FEW)
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tessera.plans import calling, catalogue, coaching, durable, round_trips  # noqa: F401

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert key(tuple(r[c] for c in want.columns) for r in got.collect()) == key(want.fetchall())


def test_configs_cover_every_language(spark, tmp_path):
    from tessera.plans import catalogue

    rows = [(i, f"t{i}", x, 2) for i, x in enumerate(["de", "en", "es", "fr", "it", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES["union_configs"](spark, str(tmp_path)).collect()
    assert {(r["problem"], r["subtask"]) for r in got} == {(t, x) for _, t, x, _ in rows}


def test_entry_imports():
    import __spark_entry__

    assert "eval_accuracy" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
