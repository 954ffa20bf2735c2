"""A few queries of each group on the smallest tables, held against DuckDB; the driver runs them all."""

import duckdb
import pytest

from corpusloom import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["flagship_mine", "sc5_loose_key", "fl1_strict_filter", "dd1_filter_then_first", "fl7_gate_chain", "wn2_best_take", "ea4_corpus_score", "wn7_downsample", "ts7_final_movement", "tx21_chunks", "st1_incremental_read", "jn8_onto_grid"]


def _plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(catalog.oracle_sql()[name])
    assert cols == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    a = sorted((tuple(_plain(r[c]) for c in cols) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert a == b


def test_every_query_with_sql_is_registered():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
