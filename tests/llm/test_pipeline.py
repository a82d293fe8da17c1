"""The pipeline's stages, each against its own definition, and the entry's registration."""

import brute
import corpus_pipeline
import __spark_entry__ as entry
from emberline.llm import queries, toxicity
from tools.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stage(function(spark, docs, FOLDER), name)
        kept[name] = (before, docs)
        if name != "tokens":
            assert docs.columns == columns
    before, after = kept["toxicity"]
    scores = toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    assert after.count() == scores.filter("score < 0.5").count()
    before, after = kept["near_duplicates"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    left = {r.doc_id for r in after.collect()}
    sets = [(d, brute.shingle_set(t, 5)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if brute.alike(x, y) >= 0.8]
    assert sum(not {a, b} <= left for a, b in links) >= 0.9 * len(links)
    assert {d for d, _ in rows} - left <= {max(pair) for pair in links}  # clean documents stay
    before, after = kept["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    bad = brute.contamination([tuple(r) for r in before.select("doc_id", "text").collect()], items)
    assert {r.doc_id for r in after.collect()} == {d for d, verdict in bad.items() if not verdict[4]}
    before, after = kept["mixing"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    before, after = kept["tokens"]
    assert after.count() == before.count()


def test_registration():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert "pipeline" in names and set(queries.ORACLES) <= set(queries.QUERIES)


def test_sql_definitions(spark):
    sql = connect(FOLDER)
    for name, text in queries.ORACLES.items():
        result = sql.execute(text)
        verdict = compare(queries.QUERIES[name](spark, FOLDER), ([d[0] for d in result.description], result.fetchall()))
        assert verdict.startswith("ok"), (name, verdict)
