import glob
import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
NAMES = [
    "normalize_strings", "lexical_shape", "dictionary_exact", "fuzzy_match", "classify_strings", "classify_v1",
    "score_weighted", "token_rank_bands", "frequency_stats", "tag_sequences", "string_flags", "unmatched_tokens",
    "ambiguous_acronyms", "extract_tagged_dom", "annotate_tagged", "validate_tagged", "nested_docs", "stratified_split",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    from namesieve.plans.catalogue import QUERIES
    from namesieve.plans.sql import SQL

    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(repr, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    want = Counter(tuple(map(repr, r)) for r in cursor.fetchall())
    assert got == want and got


def test_every_query_reads_the_tables():
    from namesieve.plans.catalogue import QUERIES
    from namesieve.plans.sql import SQL

    assert set(SQL) <= set(QUERIES)
