"""The pipeline's stages against brute-force versions, each on its own input."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from navstead.llm.marks import with_mark
from navstead.llm.quality import quality_rules
from navstead.session import cut_lineage

from . import brute
from .test_operators import CLASH, DOCS, PROSE, SHARED, words


def test_stages(spark):
    near = PROSE.split()
    texts = [None, "", PROSE, " ".join(near[:60] + ["edit"] + near[60:]), "junk " * 90, f"{SHARED}\n{words(1, 70)}", f"{SHARED}\n{words(2, 70)}", f"{SHARED}\n{words(3, 70)}\npassword: hunter2222", " ".join(f"v{i}" for i in range(4000))]
    rows = [(i, t, "en", "s", None if t is None else len(t), *CLASH) for i, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        verdicts = {r.doc_id: r.kept for r in quality_rules(docs).collect()} if name == "quality_rules" else {}
        after = cut_lineage(stage(spark, docs, ""))
        if name == "best_fit_packing":
            assert {r.doc_id for r in after.collect()} == {d for d, _ in before} and after.agg(F.max("length")).first()[0] <= 1024
            break
        assert after.columns == docs.columns
        got = sorted((r.doc_id, r.text) for r in after.select("doc_id", "text").collect())
        if name == "quality_rules":
            assert got == sorted((d, t) for d, t in before if verdicts[d])
            assert {d for d, t in before if brute.quality_base(t)[-1]} == {0, 1, 4} and {d for d, _ in got} == {2, 3, 5, 6, 7, 8}
        elif name == "line_dedup":
            assert sorted((d, brute.sha(t)) for d, t in got) == sorted((r[0], r[3]) for r in brute.line_dedup(before))
        elif name == "ngram_jaccard_join":
            component = brute.jaccard_components(list(dict(before).items()))
            assert [d for d, _ in got] == sorted(d for d in component if component[d] == d) and 3 not in dict(got)
        else:
            assert got == sorted((d, brute.redact(t)) for d, t in before) and "[secret]" in dict(got)[7]
        assert all(r.n_chars == len(r.text) for r in after.where("text IS NOT NULL").collect())
        seen[name], docs = got, after
    assert list(seen) == [n for n, _ in corpus_pipeline.STAGES[:-1]] and corpus_pipeline.ORACLE_SQL is None


def test_an_empty_table_goes_through(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, ""))
    assert docs.count() == 0


def test_only_texts_that_may_go_are_shuffled(spark):
    """Without broadcast joins every text used to pass a shuffle by doc_id."""
    rows = [(i, f"{words(i, 60)} {i}") for i in range(400)] + [(1000 + i, f"{words(i, 60)} {i}") for i in range(5)] + [(None, "no id"), (7, f"{words(7, 60)} 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = with_mark(docs, docs.where("doc_id >= 1000").select("doc_id"))
    assert {r.doc_id for r in marked.where("_listed").collect()} >= set(range(1000, 1005)) and marked.where("_listed").count() < 10
    assert marked.count() == len(rows) and marked.where("doc_id IS NULL AND NOT _listed").count() == 1
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = corpus_pipeline.near_copy_stage(spark, docs, "")
        got = sorted((r.doc_id for r in after.collect()), key=str)
        plan = after._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    component = brute.jaccard_components([(d, t) for d, t in rows if d is not None])
    assert got == sorted([None, *(d for d in component if component[d] == d)], key=str)
    assert "LeftSemi" not in plan and "bitmap_construct_agg" in plan
