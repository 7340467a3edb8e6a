import corpus_pipeline
from flockline.llm import stages
from tests.llm import brute


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step, seen = docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = step
        step = stage(spark, before, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert step.columns == docs.columns and step.dtypes == docs.dtypes
        step = step.persist()
        seen.append((name, before.count(), step.count()))
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {i for i, _, c in brute.classes(rows, 5, 80) if i == c}
            assert {r.doc_id for r in step.collect()} == want
    counts = [a for _, a, _ in seen] + [seen[-1][2]]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[2] > 0.7 * counts[0]
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, step.collect()))


def test_near_duplicates_go_by_row(spark, docs_of):
    a, b, c, d = (" ".join(f"{x}{j}" for j in range(30)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (6, c), (6, c), (7, c + " more"), (8, d), (8, d + " end"), (None, a), (None, a), (9, None), (9, ""), (9, "")]
    docs = docs_of(rows, "key string, block string, db int, rep long")
    kept = stages.near_duplicates(spark, docs.withColumnRenamed("rep", "th").withColumnRenamed("db", "component_id"), "")
    assert kept.columns == ["doc_id", "text", "key", "block", "component_id", "th"]
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    eight = next(t for i, t in got if i == "8")
    assert eight in (d, d + " end")
    assert got == sorted((str(i), str(t)) for i, t in [(1, a), (5, b), (6, c), (8, eight), (None, a), (None, a), (9, None), (9, ""), (9, "")])
    assert stages.near_duplicates(spark, docs.where("false"), "").collect() == []


def test_near_duplicates_without_a_broadcast(spark, docs_of, monkeypatch):
    text = " ".join(f"w{i}" for i in range(30))
    docs = docs_of([(1, text), (2, text), (3, "other words"), (3, "other words"), (None, None)])
    some = sorted(map(str, stages.near_duplicates(spark, docs, "").collect()))
    monkeypatch.setattr(stages, "BROADCAST_ROWS", 0)
    assert sorted(map(str, stages.near_duplicates(spark, docs, "").collect())) == some and len(some) == 3
