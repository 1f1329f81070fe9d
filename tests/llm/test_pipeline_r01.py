"""The pipeline's last stage keeps the training order over several files, and the token ids."""

import random

import corpus_pipeline
from gaitline.llm import mixing, pieces, queries
from gaitline.llm.common import materialize


def test_order_and_ids_survive(spark):
    rng = random.Random(3)
    rows = [(i, f"w{i} " + "word " * rng.choice([1, 5, 400]), f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [i for _, i in sorted((p, r.doc_id) for r in mixing.mix(docs).collect() for p in r.positions)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mixed = materialize(corpus_pipeline.mix_sources(spark, docs, ""), "test-mixing")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(mixed.inputFiles()) > 3
    got = sorted(corpus_pipeline.encode_pieces(spark, mixed, "").collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(want))) and [r.doc_id for r in got] == want
    texts = {i: t for i, t, _ in rows}
    model = pieces.load_model(queries.piece_model())
    assert all(r.ids == [*model.encode([texts[r.doc_id]])[0], model.eos] and r.n_tokens == len(r.ids) for r in got)
