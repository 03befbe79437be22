"""The pipeline against its plain version, and the registered queries against their SQL."""

import os

import duckdb
import plain
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tessellis.llm import bpe, queries, quality

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_the_plain_version(spark, corpus, tmp_path):
    documents = [(k, t) for k, t in corpus(110, 12) if k != 5]
    items = [(k, " ".join((documents[60 + k][1] or "x").split(" ")[2:20])) for k in range(4)]
    good = set(range(10, 50))
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in documents], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in good], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r[0] for r in plain.quality(documents, good, quality.BUCKETS, quality.PRIOR, quality.THRESHOLD) if r[-1]}
    rows = [(k, t) for k, _, _, t in plain.line_dedup([r for r in documents if r[0] in kept])]
    first = {k for k, _, c in plain.near(rows) if k == c}
    rows = [r for r in rows if r[0] in first]
    bad = {r[0] for r in plain.leaks(rows, items)}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(path, "rb").read()), special_tokens={})
    pack = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
    want = sorted((k, len(ids := library.encode_ordinary(t)), plain.sha(pack(ids)), plain.sha(t)) for k, t in rows if k not in bad)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert want and got == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "item_containment", "byte_bpe"]


@pytest.mark.parametrize("name", ["op1_slot_table", "op2_perspectives", "op8_warc_archives"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{table}')")
    theirs = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    mine = queries.QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(str, map(tuple, mine.collect()))) == sorted(map(str, theirs.fetchall()))
