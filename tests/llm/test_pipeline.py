import pytest

import corpus_pipeline
from lumenfold.llm import queries

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert out.columns == COLUMNS
        rows = out.collect()
        assert 0 < len(rows) <= n and all(r.n_chars == len(r.text) for r in rows)
        if name in ("suffix_array_dedup", "decontamination"):
            assert len(rows) == n
        if name == "decontamination":
            text = "\n".join(r.text for r in rows).lower()
            assert not any(t.lower() in text for t in items.values())
        docs, n = out, len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == n


def test_run_equals_the_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    whole = {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {(key(r)[0], key(r)[4]) for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in queries.queries()[name](spark, sf_dir).collect()]
    order = lambda rows: sorted(tuple(sorted(r.items())) for r in rows)
    assert order(got) == order(want)


def test_stages_with_nulls_repeats_clashes_and_empty_tables(spark, sf_dir):
    long = " ".join(f"w{k}" for k in range(300))
    other = " ".join(f"v{k}" for k in range(300))
    rows = [(1, long), (2, long), (3, long + " tail"), (4, None), (5, ""), (6, other), (6, other), (None, other + " end of its own"), (7, "x" * 60000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, predicted string, class_id string, kept_text string"
    docs = spark.createDataFrame([(i, t, None, "s", None, "a", "b", "c") for i, t in rows], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        if name == "packing":
            assert {r.doc_id for r in got} == {i for i, _ in rows}
        else:
            assert out.columns == COLUMNS
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in got) == ["1", "4", "6", "7", "None"]  # a text that only null ids have is never compared
        elif name in ("toxicity", "suffix_array_dedup", "decontamination"):
            assert len(got) == len(rows)
        if name == "suffix_array_dedup":
            text = {r.doc_id: r.text for r in got}
            assert text[1] == long and text[2] == "" and text[4] == "" and text[6] == other
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
