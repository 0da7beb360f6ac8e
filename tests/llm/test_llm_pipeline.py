"""Queries with SQL twins, and the pipeline against plain versions of its stages."""

import duckdb
import pytest
from brute import exact, near, sha

import __spark_entry__ as entry
import corpus_pipeline
from skylattice.llm import queries as llm

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    answer = con.sql(llm.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in answer.fetchall())


def test_stages_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact", "near", "benchmark", "encode"]
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in llm.queries()}


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.toxicity(spark, docs, DATA)
    assert kept.columns == columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    texts = {i: texts[i] for i, v in exact(texts).items() if v[2]}
    texts = {i: texts[i] for i, v in near(texts, 5).items() if v[2]}
    bench = [r["text"].lower().split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def holds(text):
        words = (text or "").lower().split()
        grams = {tuple(words[i : i + 11]) for i in range(len(words) - 10)}
        return any(sum(tuple(b[i : i + 11]) in grams for i in range(len(b) - 10)) >= (len(b) - 10) * 0.9 for b in bench)

    texts = {i: t for i, t in texts.items() if not holds(t)}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{llm.TOKENIZERS}/byte_bpe_50k.json")
    want = {i: sha(",".join(map(str, library.encode(t or "", add_special_tokens=False).ids))) for i, t in texts.items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, DATA).collect()} == want
