import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)


def test_optional_modules():
    assert entry._optional("fidelis.plans.queries")
    assert entry._optional("corpus_pipeline") is entry.corpus_pipeline
    with pytest.raises(ModuleNotFoundError):
        entry._optional("fidelis.absent")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["style_density", "style_diagnosis", "sections", "mask_digests", "zh_numerals", "decimals_plain", "atoms_citations", "atoms_other", "sql_atoms", "gate_long_numbers", "citation_bindings", "verdict_bridge", "model_claims"])
def test_against_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got) == sorted(want)
    cols = sorted(got)
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))
