"""The registered queries themselves: columns, folds, whole tables."""

import zlib

import pytest

import corpus_pipeline
from hinoki.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_suffix_dedup": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    "op3_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op4_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op5_ann": "query_id:bigint rank:int vec_id:bigint score:double",
    "op6_jaccard": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op7_url_filter": "page_id:bigint host:string path:string rule:string verdict:string",
    "op9_lm_score": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op11_conversation_repair": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint cost:bigint audit:string repaired_sha256:string",
    "op12_pii": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op13_fill_in_middle": "doc_id:bigint n:bigint form:string prefix_chars:bigint middle_chars:bigint output_sha256:string restored_sha256:string",
}
FOLDS = {"op3_toxicity": (5, 0), "op9_lm_score": (7, 2)}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, name):
    df = QUERIES[name](spark, DIR)
    assert " ".join(f"{a}:{b}" for a, b in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    docs = [r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()]
    if "doc_id" in df.columns:
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if name in FOLDS:
        mod, at = FOLDS[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == at) for r in rows)
    if name == "op5_ann":
        assert {r.query_id % 100 for r in rows} == {0} and {r["rank"] for r in rows} == set(range(1, 11))
        assert all(r.query_id != r.vec_id for r in rows)
    if name == "op3_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "benchmark", "tokens"]


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
