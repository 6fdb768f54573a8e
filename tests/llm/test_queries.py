"""Every registered query of the subpackage, the pipeline, and their oracles on the smallest tables."""

import duckdb
import pytest

from tidemark.llm import registry

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def rows(df):
    number = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted(repr([number(v) for v in r]) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    expected = con.execute(registry.oracle_sql()[name]).df()
    found = registry.queries()[name](spark, data).toPandas()
    assert set(found.columns) == set(expected.columns)
    for f in (found, expected):
        for c in f.columns:
            if str(f[c].dtype).lower().startswith(("int", "float")):
                f[c] = f[c].astype("float64")
    assert rows(found) == rows(expected)


def test_every_operator_has_a_query():
    names = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert names == list(range(1, 11))


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        assert docs.columns == columns, name
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    whole = {r.doc_id for r in corpus_pipeline.run(spark, data).select("doc_id").collect()}
    assert whole == ids


def test_pipeline_equals_brute_force(spark, tmp_path):
    """A small corpus with toxic texts, copies, benchmark passages and personal data, stage by stage."""
    from tidemark.llm import toxicity
    from tidemark.llm.common import space_words

    from .fixtures import prose
    from .test_joins import brute_classes, edited
    from .test_row_local import brute_hits, toxic_rows

    texts = [t for t, _ in toxic_rows(240)]
    labels = [(k, 1, y) for k, (_, y) in enumerate(toxic_rows(240))]
    base = [prose(500 + k, 120, 3000) for k in range(8)]
    texts += base + [edited(base[k % 8], k, 1) for k in range(24)] + base[:3]
    passage = prose(900, 30, 3000)
    texts += [prose(700 + k, 40, 3000) + " " + passage[k : k + 150] for k in range(5)] + [f"write jo{k}@mail.example.com or 10.9.8.{k}" for k in range(4)] + ["lamp 1d10t", "", None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "never seen in any document here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scorer = toxicity.Scorer(toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    left = [k for k, t in enumerate(texts) if scorer.score(t) < 0.5]
    assert len(left) == len(texts) - 81
    found = brute_classes([texts[k] for k in left])
    left = [left[k] for k, (_, c) in found.items() if c == k or not texts[left[k]]]
    left = [k for k in left if not brute_hits(texts[k], [(1, passage), (2, "never seen in any document here")])[1]]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(left)
    assert {r.doc_id: r.length for r in rows} == {k: len(space_words(texts[k])) + 1 for k in left}
