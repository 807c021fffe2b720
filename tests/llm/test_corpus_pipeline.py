"""Stages of the pipeline: columns kept, decisions effective, queries registered."""

import __spark_entry__
import corpus_pipeline
from loomwork.llm import common as C
from loomwork.llm import mixing, toxicity
from tests.llm.test_corpus_operators import EDGE, components_of, edge_rows
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = C.read(spark, SF, "documents")
    names = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = C.stored(stage(spark, docs, SF), name)
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    assert docs.columns == ["doc_id", "n_tokens", "tokens", "round_trip"]
    assert sizes[1] < sizes[0] and sizes[4] == sizes[3] and docs.where("not round_trip").count() == 0


def test_queries_are_registered():
    queries = __spark_entry__.queries()
    assert "pipeline" in queries and all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11))


def test_oracles(spark):
    from loomwork.llm import queries

    con = connect(SF)
    for name, sql in queries.ORACLE.items():
        assert compare(queries.QUERIES[name](spark, SF), con, sql) is None, name


def test_stages_on_edge_cases_and_empty_tables(spark):
    """Nulls, repeated ids and rows, ties, very long texts and clashing columns go through every stage; an empty table stays empty."""
    C.importable(spark)
    rows = edge_rows()
    whole = spark.createDataFrame(rows, EDGE).repartition(2)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = C.stored(stage(spark, whole, SF), name)
        counts[name] = out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == whole.columns, name
        assert stage(spark, whole.limit(0), SF).count() == 0, name
    assert counts["toxicity"] == counts["repeats"] == counts["tokens"] == len(rows)
    assert counts["near_duplicates"] == len(rows) - 3


def test_the_whole_run_against_plain_stages(spark):
    """The four cutting stages by plain Python over their own inputs, in a chain, on the smallest tables."""
    import collections

    docs = C.stored(C.read(spark, SF, "documents"), "documents")
    read = lambda df: {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    scores = {r.doc_id: r.score for r in toxicity.digest(docs, C.read(spark, SF, "labels")).collect()}
    (_, toxic), (_, near), (_, cut), (_, mix), _ = corpus_pipeline.STAGES
    one = C.stored(toxic(spark, docs, SF), "one")
    assert set(read(one)) == {i for i, s in scores.items() if s < 0.5}
    two = C.stored(near(spark, one, SF), "two")
    assert set(read(two)) == {i for i, (_, c) in components_of(sorted(read(one).items())).items() if i == c}
    three = C.stored(cut(spark, two, SF), "three")
    first, had = {}, sorted(read(two).items())
    for i, t in had:
        w = t.encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in read(three).items():
        w = dict(had)[i].encode().split()
        gone = [any(first[tuple(w[k : k + 50])] < i for k in range(max(0, j - 49), min(j, len(w) - 50) + 1)) for j in range(len(w))]
        assert t == (" ".join(x.decode() for x, g in zip(w, gone, strict=True) if not g) if any(gone) else dict(had)[i])
    four = C.stored(mix(spark, three, SF), "four")
    copies = collections.Counter(r.doc_id for r in four.select("doc_id").collect())
    wanted = {r.doc_id: r.copies for r in mixing.copies(three).collect()}
    assert copies == collections.Counter({i: n for i, n in wanted.items() if n})


def test_mix_comes_near_each_target(spark):
    """Taken words of a source differ from its target by the draw's chance only."""
    from pyspark.sql import functions as F

    rows = mixing.digest(C.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source"))
    per = rows.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum(F.col("size") * F.col("size")).alias("squares")).collect()
    assert per and all(abs(r.taken - r.target) <= 3 * 0.5 * r.squares**0.5 + 1 for r in per)
