"""The registered queries of the subpackage against their SQL, and those without SQL against brute force on small tables."""

import hashlib
import math
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import bpe, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    import duckdb

    with duckdb.connect() as c:
        for f in DATA.glob("*.parquet"):
            c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        want = c.execute(queries.oracle_sql()[name])
        names = [d[0] for d in want.description]
        rows = [tuple(map(plain, r)) for r in want.fetchall()]
    got = queries.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr) == sorted(rows, key=repr)


def test_bpe_query_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op6_bpe(spark, str(DATA)).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_queries_give_a_row_for_each_document(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for query in (queries.op3_quality_rules, queries.op4_media_columns, queries.op10_license_scans):
        rows = query(spark, str(DATA)).collect()
        assert len(rows) == documents == len({r["doc_id"] for r in rows})
