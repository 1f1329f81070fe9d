"""Every operator and stage on odd rows, on clashing names and on empty tables, with results that don't depend on other columns."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaitline.llm import common, html_text, jaccard, media, mixing, pieces, pii, queries, sharding, toxicity, vptree, warc

NAMES = """sig n fp id comp rep part token band text_key own_id own_key extra mentions base spans payload media mix_none mix_src mix_order mix_bucket mix_used table_slot table_shard slot shard
position size source_size target taken copies positions __none __order __slot __shard __id __key __spans __lose __tie __src known toxic order held_out score predicted q v dim place far own_text
lost_id lost_text masked payload_sha1 refers_to first_id group_id url html label embedding vec_id x y n_chars rank least kind error _size _slot""".split()
LONG = "one two three four five six seven " * 3000
TEXTS = [None, "", " \n ", "a", LONG, LONG + "eight", "mail me at a.b@c.de or +1 (555) 010-9999", "mail me at a.b@c.de or +1 (555) 010-9999", "漢字 \x00 😀", "same words in these two rows of text", "same words in these two rows of text"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, None if i % 3 else f"s{i % 2}", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[7], rows[7], (None, None, None, None)], "doc_id long, text string, source string, n_chars int")


def widened(df):
    """``df`` with a column of every name that an operator might use for itself."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("x").alias(c) for c in NAMES if c.lower() not in have])


def rows(df, columns):
    return Counter(tuple(str(v) for v in r) for r in df.select(columns).collect())


def same(make, df, columns=None, widths=None):
    """The result on the widened table is that on the table; an empty table gives an empty one with the same columns."""
    plain = make(df)
    columns = columns or plain.columns
    got = rows(plain, columns)
    wide = make(widened(df))
    names = widths(wide) if widths else columns
    assert rows(wide, names) == got
    none = make(widened(df).limit(0))
    assert none.columns == wide.columns and none.count() == 0
    return got


def test_texts(odd):
    assert sum(same(lambda d: pieces.encode_documents(d, queries.piece_model()), odd).values()) == odd.count()
    assert sum(same(media.media_features, odd).values()) == odd.count()
    assert sum(same(lambda d: pii.digest(pii.find(d)), odd).values()) == odd.count()


def test_mixing(odd):
    new = ["size", "source_size", "target", "taken", "copies", "positions"]
    last = lambda d: [*odd.columns, *d.columns[-6:]]
    got = same(mixing.mix, odd, [*odd.columns, *new], last)
    assert sum(got.values()) == odd.count()
    kept = same(mixing.mixed_rows, odd, odd.columns)
    copies = Counter()
    for r, n in got.items():
        copies[r[: len(odd.columns)]] += n * int(r[-2])
    assert kept == +copies


def test_sharding(odd):
    got = same(sharding.place, odd, [*odd.columns, "slot", "shard"], lambda d: [*odd.columns, *d.columns[-2:]])
    assert sum(got.values()) == odd.count() and sharding.place(widened(odd)).columns[-2:] == common.fresh(widened(odd), "slot", "shard")


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (2, None), (4, 7)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"{'vile rude words here' if i % 2 else 'kind mild words here'} {i}", "s", i) for i in range(40)], odd.schema)
    model = toxicity.train(widened(docs), widened(labels))
    again = toxicity.train(docs, labels, most_broadcast=0)
    assert (model.place == again.place).all() and model.weight == pytest.approx(again.weight, rel=1e-6)
    assert sum(same(lambda d: toxicity.score(d, model), odd).values()) == odd.count()
    kept = same(lambda d: toxicity.keep_clean(d, model), odd, odd.columns)
    scores = {(str(r.doc_id), str(r.text)): s.score for r, s in zip(odd.collect(), toxicity.score(odd, model).collect(), strict=True)}
    assert sum(kept.values()) == sum(scores[str(r.doc_id), str(r.text)] < 0.3 for r in odd.collect())


def test_near_copies(odd):
    got = same(jaccard.link_components, odd)
    assert got[("4", str(len({tuple((LONG.split())[i : i + 5]) for i in range(7)})), "4")] == 1 and got[("10", "4", "9")] == 1
    kept = same(jaccard.keep_one, odd, odd.columns)
    # rows without words stay, repeated rows and near copies leave one: of LONG and its longer twin that of the smaller id
    assert sum(n for r, n in kept.items() if r[1] in ("None", "", " \n ")) == sum(r.text is None or not r.text.strip() for r in odd.collect())
    assert {r[0] for r in kept if r[1] not in ("None", "", " \n ")} == {"None", "4", "6", "8", "9"}


def test_one_of_each_text_under_repeated_ids(spark):
    """An id with two texts: only the near copy goes; of equal rows one stays; missing ids come last."""
    base = " ".join(f"w{i}" for i in range(60))
    rows_ = [(1, base), (2, base + " end"), (2, "quite another text of its own here"), (2, "quite another text of its own here"), (None, base), (None, "alone among the missing ids is this"), (None, "alone among the missing ids is this"), (3, None), (3, None)]
    got = jaccard.keep_one(spark.createDataFrame(rows_, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter([(1, base), (2, "quite another text of its own here"), (None, "alone among the missing ids is this"), (3, None), (3, None)])


def test_personal_data(spark, odd):
    got = same(pii.redact, odd, odd.columns)
    assert sum(got.values()) == odd.count() and got[("6", "mail me at <EMAIL> or <PHONE>", "s0", "6")] == 1 and got[("0", "None", "s0", "0")] == 1
    taught = [(i, f"please call me at user{i}@mail.example.com today") for i in range(6)] + [(10, "please call me at user77(at)mail today"), (10, "please call me at user77(at)mail today")]
    docs = spark.createDataFrame(taught, "doc_id long, text string")
    assert rows(pii.redact(docs, most_spans=0), docs.columns) == rows(pii.redact(docs), docs.columns) == Counter({**{(str(i), "please call me at <EMAIL> today"): 1 for i in range(6)}, ("10", "please call me at <EMAIL> today"): 2})


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>one</p>"), (1, "u", "<p>one</p>"), (2, None, None), (None, "u", ""), (3, "u", "<div>" + "<p>para text</p>" * 5000), (4, "u", "<p>one</p>")], "page_id long, url string, html string")
    got = same(html_text.extract_pages, pages)
    assert got[("1", "u", "one", "3")] == 2 and got[("2", "None", "", "0")] == 1 and got[("3", "u", "\n\n".join(["para text"] * 5000), str(11 * 5000 - 2))] == 1
    records = same(warc.round_trip, pages)
    assert sum(records.values()) == 6 and sum(n for r, n in records.items() if r[4] == "revisit") == 2
    few = rows(warc.read_records(common.materialize(warc.write_segments(warc.mark_revisits(pages, most_groups=0)), "warc")), warc.round_trip(pages).columns)
    assert few == records


def test_vectors(spark):
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)] + [(1, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (70, None), (71, []), (72, [0.0, 0.0, 0.0]), (73, [None, 1.0, 1.0]), (74, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = same(lambda d: vptree.neighbours(d, F.col("vec_id") % 20 == 0, k=4, factor=1.0, shard_rows=8, block_rows=2), vectors)
    ids = {int(r[0]) for r in got}
    assert ids == {0, 20, 40} and all(n == 1 for n in got.values()) and len(got) == 12


def test_stages_on_odd_and_empty_tables(spark, odd, tmp_path):
    labels = spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = widened(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    written = common.materialize(docs, "odd")
    last = corpus_pipeline.encode_pieces(spark, written, str(tmp_path))
    assert last.count() == docs.count() and sorted(r.position for r in last.collect()) == list(range(docs.count()))


def test_stages_equal_brute_force(spark, sf):
    """Each stage of the pipeline against a plain version over the rows of the one before."""
    import sentencepiece

    from .test_llm import brute_components

    docs = common.table(spark, sf, "documents")
    model = toxicity.train(docs, common.table(spark, sf, "labels"))
    steps = dict(corpus_pipeline.STAGES)
    clean = common.materialize(steps["toxicity"](spark, docs, sf), "t")
    assert rows(clean, docs.columns) == Counter(tuple(str(v) for v in r) for r in docs.collect() if model.score([r.text or ""])[0] < 0.3)
    unique = common.materialize(steps["near_copies"](spark, clean, sf), "n")
    found = brute_components([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id for r in unique.collect()} == {i for i, (n, c) in found.items() if i == c} and unique.count() == len({c for _, c in found.values()})
    masked = common.materialize(steps["personal_data"](spark, unique, sf), "p")
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(unique).collect()}
    for r in unique.collect():
        want = list(r.text or "")
        for k, (kind, a, b) in enumerate(sorted(spans[r.doc_id], key=lambda s: (s[1], s[2]))):
            first = all(a >= e for _, _, e in sorted(spans[r.doc_id], key=lambda s: (s[1], s[2]))[:k])
            want[a:b] = [f"<{kind.upper()}>" if first else ""] + [""] * (b - a - 1)
        assert "".join(want) == masked.where(F.col("doc_id") == r.doc_id).first().text if spans[r.doc_id] else True
    mixed = common.materialize(steps["mixing"](spark, masked, sf), "m")
    positions = sorted((p, r.doc_id) for r in mixing.mix(masked).collect() for p in r.positions)
    encoded = steps["pieces"](spark, mixed, sf)
    order = [r.doc_id for r in encoded.orderBy("position").collect()]
    assert sorted(order) == sorted(i for _, i in positions)
    place = {}
    for p, i in positions:
        place.setdefault(i, []).append(p)
    assert [place[i].pop(0) for i in order] == [p for p, _ in positions]
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = {r.doc_id: r.text or "" for r in masked.collect()}
    for r in encoded.collect():
        ids = lib.encode(texts[r.doc_id]) + [lib.eos_id()]
        assert list(r.ids) == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
