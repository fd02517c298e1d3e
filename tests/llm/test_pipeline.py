"""The pipeline, stage by stage, against plain versions of what each must do."""

import corpus_pipeline
from siftmark.llm.line_rules import judge
from siftmark.llm.queries import toxic_model
from siftmark.llm.toxicity import scorer
from test_lsh_forest import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if n + 1 < len(corpus_pipeline.STAGES):
            assert out.schema.simpleString() == start.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name + " out"] = docs.collect()

    ids = {k: {r.doc_id for r in rows} for k, rows in kept.items()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = scorer(toxic_model(start, labels))
    rows = kept["toxicity"]
    harmless = {r.doc_id for r, s in zip(rows, score([r.text for r in rows]), strict=True) if s < 0.5}
    assert ids["toxicity out"] == harmless

    verdicts = {r.doc_id: judge(r.text.encode()) for r in kept["quality_rules"]}
    assert {r.doc_id: r.text for r in kept["quality_rules out"]} == {
        i: v[9].decode() for i, v in verdicts.items() if v[6]
    }
    assert all(r.n_chars == len(r.text) for r in kept["quality_rules out"])

    groups = brute([(r.doc_id, r.text) for r in kept["near_duplicates"]], corpus_pipeline.NEAR)
    assert ids["near_duplicates out"] == {i for i, g in groups.items() if g[2]}

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in kept["decontamination"] if not any(i in r.text for i in items)}
    assert ids["decontamination out"] <= clean
    assert len(clean) - len(ids["decontamination out"]) <= 1

    pieces = sorted(kept["packing out"], key=lambda r: (r.sequence_id, r.offset))
    assert ids["packing out"] == ids["decontamination out"]
    at = 0
    for p in pieces:
        assert p.sequence_id * 4096 + p.offset == at
        at += p.length
    assert at == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_run_and_empty_input(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_rows_without_ids_of_their_own(spark):
    """Repeated rows, null ids, one id with two texts: one row of each group stays."""
    texts = [" ".join(f"w{g}x{i}" for i in range(40)) for g in range(5)]
    near = texts[0] + " more"
    rows = [
        (1, texts[0], "a"), (1, texts[0], "a"), (2, near, "a"), (None, texts[0], "b"),
        (3, texts[1], "a"), (3, texts[2], "a"), (4, texts[2], "c"),
        (None, texts[3], "a"), (None, texts[3], "a"), (None, "", "a"), (None, None, "a"), (5, "", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    found = sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr)
    assert found == sorted(
        [(1, texts[0]), (3, texts[1]), (3, texts[2]), (None, texts[3]), (None, ""), (None, None), (5, "")],
        key=repr,
    )


def test_numbered_rows_give_the_groups_of_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_id = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()}
    extra = docs.limit(1).select(*[docs[c] if c != "doc_id" else docs[c] for c in docs.columns])
    again = corpus_pipeline.near_duplicate_stage(spark, docs.unionByName(extra), SF).collect()
    assert sorted(r.doc_id for r in again) == sorted(by_id)
