"""Registered queries with SQL twins, and the pipeline's stages one by one."""

import tracemalloc

import pyarrow as pa
import pytest

import compare
import corpus_pipeline
from grainmill import session
from grainmill.llm import jaccard, pii, queries, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    cursor = compare.connect(FOLDER).execute(queries.ORACLES[name])
    want = compare.table([d[0] for d in cursor.description], cursor.fetchall())
    assert compare.table(frame.columns, [tuple(r) for r in frame.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_covers_the_whole_table(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER).toPandas()
    if "doc_id" in frame:
        assert set(frame.doc_id) == {r.doc_id for r in queries.documents(spark, FOLDER).select("doc_id").collect()}


def test_stages(spark, tmp_path):
    docs, kept = queries.documents(spark, FOLDER), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        kept.append(docs.toPandas())
    before = queries.documents(spark, FOLDER).toPandas()
    for frame in kept[:4]:
        assert sorted(frame.columns) == sorted(corpus_pipeline.COLUMNS) and frame.doc_id.is_unique
    toxic, copies, masked, mixed, packed = kept
    assert set(toxic.doc_id) <= set(before.doc_id) and len(toxic) > 0.8 * len(before)
    assert copies.text.map(lambda t: " ".join(t.lower().split())).is_unique
    assert set(masked.doc_id) == set(copies.doc_id) and (masked.n_chars == masked.text.str.len()).all()
    assert not masked.text.str.contains(r"[a-z]@mail\d").any()
    assert set(mixed.doc_id) < set(masked.doc_id)
    assert set(packed.doc_id) == set(mixed.doc_id)
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.max()).all()


def test_stages_on_an_empty_table(spark, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing.select(*corpus_pipeline.COLUMNS), FOLDER).count() == 0


def test_stages_on_odd_documents(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, odd, FOLDER).collect()
        assert rows, name


def test_near_copies_keep_every_text_that_heads_a_group(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(1, a, None), (1, b, "en"), (1, None, "en"), (2, a + " end", "en"), (3, b, "en"), (4, " ", "de"), (None, a, "en")]
    docs = spark.createDataFrame([(i, t, lang, "src0", 1) for i, t, lang in rows], queries.DOCUMENTS)
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id or 0, str(r.text)[:2]) for r in kept) == [(0, "a0"), (1, "No"), (1, "a0"), (1, "b0")]


TEXT_STEPS = {
    "toxicity": lambda df: toxicity.score(df, MODEL),
    "sets": lambda df: jaccard._sets(df, jaccard.WORDS, 38, 8),
    "full sets": lambda df: jaccard._full_sets(df, jaccard.WORDS),
    "personal data": lambda df: pii.redact(df, pii.train()),
}
MODEL = toxicity.Model(b"alpha beta " * 40, b"gamma delta " * 40, (0.1,) * (toxicity.GAPS + 3))


@pytest.mark.parametrize("step", TEXT_STEPS)
def test_tasks_hold_little_of_a_batch(spark, monkeypatch, step):
    df, caught = spark.createDataFrame([(1, 2, "a")], "id bigint, seal bigint, text string"), []
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, kind: caught.append(f) or real(self, f, kind))
    TEXT_STEPS[step](df)
    words = [f"w{i * 7919 % 4001}" for i in range(500)]
    texts = [" ".join(words[i % 7 :: 1 + i % 3]) for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"id": range(3000), "seal": range(3000), "text": texts})
    tracemalloc.start()
    rows = sum(out.num_rows for out in caught[0](iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and most < (60e6 if step == "toxicity" else 30e6)


def test_texts_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    columns = ["id AS doc_id", "repeat('word ', 800) AS text", "'en' AS lang", "'src1' AS source", "4000L AS n_chars"]
    docs = spark.range(0, 6000, 1, 1).selectExpr(*columns)
    try:
        corpus_pipeline.mask_personal_data(spark, docs, FOLDER)
        found = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").collect()
        spark.conf.set(name, "12345678")
        session.small_batches(spark)
        assert spark.conf.get(name) == "12345678"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert sum(r.n for r in found) > 24e6 and max(r.n for r in found) < 1.1 * session.BATCH_BYTES
