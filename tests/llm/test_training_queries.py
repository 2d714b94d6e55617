"""Every training-data query that has SQL against DuckDB, on the smallest data; the others give rows."""

import os

import duckdb
import pytest

from lenforge.llm.encoding import DEFAULT_TOKENIZERS
from lenforge.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents raw_samples token_lengths tokenized build_config mix_targets review_labels token_marks".split()


def plain(v):
    if v is None:
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF) or not os.path.isdir(DEFAULT_TOKENIZERS), reason="no test data or tokenizer files")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    if name not in ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
