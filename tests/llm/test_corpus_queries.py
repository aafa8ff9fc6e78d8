"""Corpus queries on the smallest tables: against their SQL, or their contract's invariants."""

from pathlib import Path

import duckdb
import pytest

from codetide.llm import queries as Q

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no test tables here")

COLUMNS = {
    "op1_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op2_toxicity": "doc_id held_out score predicted", "op3_simhash": "doc_id fingerprint component_id",
    "op4_mixing": "doc_id size source_size target taken", "op5_tokencount": "doc_id n_bytes n_tokens over_limit", "op6_vecdedup": "vec_id n_links component_id kept",
    "op7_licenses": "doc_id n_words n_base first_word last_word base_labels labels score", "op8_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op11_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op12_quality": "doc_id held_out score predicted", "op13_divergence": "lang source part item value rank",
}


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    frame, expected = Q.queries()[name](spark, str(SF)), con.sql(Q.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in expected.select(*columns).fetchall())


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in Q.oracle_sql()])
def test_columns_and_rows(spark, name):
    frame = Q.queries()[name](spark, str(SF)).cache()
    assert frame.columns == COLUMNS[name].split()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert frame.select("doc_id").distinct().count() == docs.count()
    assert name == "op1_packing" or frame.count() == docs.count()
    frame.unpersist()


def test_columns_of_the_others(spark):
    assert all(Q.queries()[n](spark, str(SF)).columns == COLUMNS[n].split() for n in Q.oracle_sql())
    assert Q.queries()["op9_warc"](spark, str(SF)).count() == 2 * spark.read.parquet(f"{SF}/pages.parquet").count()
