import corpus_pipeline as pipeline
from tablekeep.llm import quality_model, quality_rules, repeats, simhash
from tablekeep.llm.queries import QUERIES
from tests.llm.samples import documents, prose


def written(spark, root, docs):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(*d, "own") for d in docs]
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{root}/documents.parquet")
    labels = [(d[0], int(i % 3 > 0)) for i, d in enumerate(docs) if d[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    rules = pipeline.quality_rules(spark, docs, data)
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    assert {r.doc_id for r in rules.collect()} == kept < {r.doc_id for r in docs.collect()}
    model = quality_model.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    good = {r.doc_id for r in quality_model.score(rules, model).filter("predicted = 1").collect()}
    scored = pipeline.quality_classifier(spark, rules, data)
    assert {r.doc_id for r in scored.collect()} == good
    single = pipeline.near_duplicates(spark, scored, data)
    groups = simhash.near_duplicates(scored).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in groups}
    cleaned = pipeline.repeated_strings(spark, single, data)
    texts = {r.doc_id: r.kept_text for r in repeats.remove_repeats(single).collect()}
    assert {r.doc_id: r.text for r in cleaned.collect()} == texts
    for stage in (rules, scored, single, cleaned):
        assert stage.columns == names
        assert all(r.n_chars == len(r.text) for r in stage.collect())
    packed = pipeline.packed_sequences(spark, cleaned, data)
    assert {r.doc_id for r in packed.collect()} == set(texts)


def test_run_over_awkward_rows(spark, root):
    written(spark, root, documents() + [(200 + i, prose(i, 60 + i), "en", "s", 0) for i in range(20)])
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{root}/documents.parquet")
        result = stage(spark, docs, root)
        assert result.columns == docs.columns
        assert {r.kept for r in result.collect()} <= {"own"}
    assert pipeline.run(spark, root).count() >= 0


def test_run_over_nothing(spark, root):
    written(spark, root, [])
    assert pipeline.run(spark, root).collect() == []


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert len(pipeline.STAGES) == 5
