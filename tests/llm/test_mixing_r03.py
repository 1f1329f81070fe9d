"""Operator 2: copies of one position stand in a defined order."""

from pyspark.sql import functions as F

from gaitline.llm import mixing


def test_ties_of_position_stand_by_id_and_text(spark):
    """Documents without words lie where their neighbour begins, so many share a position."""
    rows = [(k, "", "s") for k in range(30)] + [(None, " ", "s"), (None, "  ", "s"), (30, "one two", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = mixing.mix(docs).select("doc_id", "text", F.explode("positions").alias("position"), F.xxhash64("text").alias("h")).collect()
    want = [(r.doc_id, r.text) for r in sorted(placed, key=lambda r: (r.position, r.doc_id is not None, r.doc_id or 0, r.h))]
    for parts in (1, 5):
        got = [(r.doc_id, r.text) for r in mixing.mixed_rows(docs.repartition(parts)).collect()]
        assert got == want
