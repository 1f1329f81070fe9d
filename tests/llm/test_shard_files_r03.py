"""Files of shards follow the bytes."""

from collections import Counter

from gaitline.llm import sharding


def test_a_large_shard_has_several_files(spark, tmp_path):
    rows = spark.range(4000).selectExpr("if(id < 2000, 7, id) as doc_id", "repeat(sha2(cast(id as string), 512), 20) as text")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    try:
        for least in ("200k", "64m"):
            spark.conf.set(size, least)
            sharding.write_shards(rows, str(tmp_path / least))
    finally:
        spark.conf.unset(size)
    sharding.write_shards(rows, str(tmp_path / "dealt"), files_per_shard=2)
    files = {k: Counter(f.parent.name for f in (tmp_path / k).rglob("part-*")) for k in ("200k", "64m", "dealt")}
    assert max(files["200k"].values()) > 1 and set(files["64m"].values()) == {1} and max(files["dealt"].values()) <= 2
    want = Counter(map(tuple, sharding.place(rows).select("doc_id", "text", "shard").collect()))
    assert all(Counter(map(tuple, spark.read.parquet(str(tmp_path / k)).select("doc_id", "text", "shard").collect())) == want for k in files)
