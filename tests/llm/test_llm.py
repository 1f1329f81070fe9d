"""The training-data operators against brute force, exact round trips and held-out labels."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaitline.llm import common, html_text, jaccard, media, mixing, oracles, pieces, pii, queries, sharding, toxicity, vptree, warc
from tests.test_queries import compare

ODD = [None, "", " ", "   \n ", "a", "a" * 4000, "x " * 3000, "ab\n  cd   ", "▁▁ a▁b", "漢字 かな 😀", "\x00\x01 <s>", "same text here again and again", "same text here again and again"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with ours."""
    rows = [(i if i != 3 else None, t, None if i % 3 else f"s{i % 2}", "x", i) for i, t in enumerate(ODD)] + [(7, ODD[7], "s1", "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, n int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.table(spark, sf, "documents")


def nothing(df):
    return df.limit(0)


def test_pieces_equal_the_library(spark, odd, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    for df in (odd, docs):
        texts = Counter((r.doc_id, r.text) for r in df.collect())
        want = Counter()
        for (i, t), k in texts.items():
            ids = lib.encode(t or "") + [lib.eos_id()]
            want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += k
        assert Counter(tuple(r) for r in pieces.encode_documents(df, queries.piece_model()).collect()) == want
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab eE tshn ▁\n漢é1.…  aaa the ing") for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [" " * n + "a" for n in range(50)] + [" " * n for n in range(70)]
    assert pieces.load_model(queries.piece_model()).encode(texts) == lib.encode(texts)
    assert pieces.encode_documents(nothing(docs), queries.piece_model()).count() == 0


def test_mixing(spark, odd, docs, sf):
    compare(queries.op2_mixing(spark, sf), oracles.OP2, sf)
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and rows[0].__fields__[-6:] == ["_size", "source_size", "target", "taken", "copies", "positions"]
    assert all(r.taken <= 3 * r["_size"] and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) for r in rows)
    mixed = mixing.mix(docs).collect()
    total = sum(r.size for r in mixed)
    by = defaultdict(int)
    for r in mixed:
        by[r.source] += r.taken
    for r in mixed:
        assert abs(by[r.source] - r.target) <= max(x.size for x in mixed if x.source == r.source)
    assert abs(sum({r.source: r.target for r in mixed}.values()) - total) < 1e-6 * total
    copies = {r.doc_id: r.copies for r in mixed}
    assert Counter(r.doc_id for r in mixing.mixed_rows(docs).collect()) == Counter({i: c for i, c in copies.items() if c})
    assert mixing.mix(nothing(docs)).count() == 0


def test_media_round_trip(spark, odd, docs):
    for df in (odd, docs):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            raw = (r.text or "").encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            want[(r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
        assert Counter(tuple(r)[:5] for r in media.media_features(df).collect()) == want
    rng = np.random.default_rng(0)
    samples = rng.integers(0, 256, (40, 576), dtype=np.uint8)
    frames = media.encode_frames(samples)
    assert (np.array(media.decode_frames(frames)) == samples).all()
    avi = media.write_avi(frames)
    assert media.read_avi(avi) == (frames, 25.0)
    assert media.shots(np.eye(16)[[0, 0, 0, 3, 3, 3, 3, 5, 5, 5]]) == [(0, 3), (3, 7), (7, 10)]
    broken = spark.createDataFrame([(1, bytearray(avi)), (2, None), (3, bytearray(b"no avi")), (4, bytearray(avi[:3000])), (5, bytearray(avi))], "k int, media binary")
    got = {r.k: r for r in media.read_media(broken, ["k"], with_payload=True).collect()}
    assert bytes(got[1].payload) == bytes(got[5].payload) == samples.tobytes() and all(got[k].error for k in (2, 3, 4))
    assert media.clip_rows(broken, ["k"]).where("k = 1").count() == len(got[1].clips)
    assert media.media_features(nothing(docs)).count() == 0


def test_sharding(spark, odd, docs, sf, tmp_path):
    compare(queries.op4_sharding(spark, sf), oracles.OP4, sf)
    table = sharding.fill()
    sizes = Counter(table)
    assert set(sizes) == set(range(32)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill(sharding.SHARDS[:-1])
    assert sum(a != b for a, b in zip(table, fewer) if a != 31) < 0.1 * len(table)
    with pytest.raises(ValueError):
        sharding.fill(slots=4094)
    assert sharding.place(odd.withColumn("shard", F.lit(1))).columns[-2:] == ["slot", "_shard"] and sharding.place(odd).count() == odd.count()
    sharding.write_shards(docs, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count() and sharding.place(nothing(docs)).count() == 0


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    tp, fp, fn = (sum(r.predicted == p and r.toxic == t for r in held) for p, t in ((1, 1), (1, 0), (0, 1)))
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.85
    assert len({r.score for r in toxicity.score(odd.where("text is null or text = ''"), model).collect()}) == 1
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.keep_clean(odd, model).columns == odd.columns
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.5}
    assert toxicity.score(nothing(docs), model).count() == 0


def test_neighbours(spark):
    vectors = common.table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = m @ m[q]
        order = [k for k in np.lexsort((ids, -score)) if k != q][:20]
        want[int(ids[q])] = [int(ids[k]) for k in order]
    for factor, least in ((1.0, 1.0), (2.0, 0.9)):
        got = defaultdict(list)
        for r in vptree.neighbours(vectors, F.col("vec_id") % 20 == 0, factor=factor, shard_rows=128).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
            assert r.score == pytest.approx(float(m[ids == r.vec_id][0] @ m[ids == r.query_id][0]), abs=1e-12)
        assert np.mean([len(set(got[q]) & set(w)) / 20 for q, w in want.items()]) >= least
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, []), (8, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vptree.neighbours(odd, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.5)]
    assert vptree.neighbours(nothing(odd), F.col("vec_id") == 0).count() == 0


def test_warc(spark, sf, tmp_path):
    pages = common.table(spark, sf, "pages")
    odd = spark.createDataFrame([(5, "u", None), (3, None, ""), (9, "http://a b", "é\r\n\r\nx"), (2, "u", "é\r\n\r\nx"), (None, "u", "z"), (4, "u", "long" * 50_000)], "page_id long, url string, html string")
    for df in (pages, odd):
        rows = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
        first = {}
        for i, p in rows:
            if i is not None:
                first[p] = min(i, first.get(p, i))
        want = Counter((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if first.get(p, i) != i else "response", first[p] if first.get(p, i) != i else None) for i, p in rows)
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()) == want
    segments = warc.write_segments(warc.mark_revisits(odd)).orderBy("archive", "segment").collect()
    by = defaultdict(bytes)
    for s in segments:
        by[s.archive] += bytes(s.content)
    for name, content in by.items():
        (tmp_path / name).write_bytes(content)
    assert warc.read_records(spark.read.format("binaryFile").load(f"{tmp_path}/*.warc.gz"), with_payload=True).count() == 6
    whole = next(iter(by.values()))
    assert list(warc.records([whole])) == list(warc.records([whole[k : k + 7] for k in range(0, len(whole), 7)]))
    with pytest.raises(ValueError):
        list(warc.records([whole[:-3]]))
    assert warc.round_trip(nothing(pages)).count() == 0


def brute_components(rows):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(sets)
    for a in items:
        for b in items:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_join(spark, sf, docs):
    compare(queries.op8_jaccard(spark, sf), oracles.OP8, sf)
    rng = random.Random(7)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 60))] for _ in range(25)]
    common_part = [f"c{k}" for k in range(30)]
    rows = []
    for i in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
        rows.append((i, " ".join(w + common_part if rng.random() < 0.3 else w)))
    rows += [(400, None), (401, ""), (402, " \n"), (403, "One"), (404, "oNE"), (405, "x y"), (406, rows[0][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(df.withColumn("sig", F.lit(1))).collect()}
    assert got == brute_components(rows)
    missing = jaccard.link_components(spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert sorted(str(r.component_id) for r in missing) == ["3", "3", "None"]
    assert jaccard.link_components(nothing(docs)).count() == 0
    kept = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert kept == {i for i, (n, c) in got.items() if c == i}


def test_html(spark, sf):
    pages = common.table(spark, sf, "pages")

    def marked(page):
        import html

        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", body))
        return "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)

    for r in html_text.extract_pages(pages, ("page_id", "url", "html")).collect():
        assert r.text == marked(r.html) and r.n_chars == len(r.text)
    plain = "<body><div id='main-menu'><a href=x>Home</a></div><header><h1>Site</h1></header><div><h1>Title here</h1><p>Some long text of the body that goes on and on, for quite a while &eacute; &amp; so on and on and on again.</p><div class='ad-box'>Buy now!</div><p>Second\n para.</p></div><div class=comments><p>nice!</p></div><footer>c</footer>"
    assert html_text.extract(plain) == "Title here\n\nSome long text of the body that goes on and on, for quite a while é & so on and on and on again.\n\nSecond para."
    assert [html_text.extract(x) for x in (None, "", "<p>hi", "<script>var a='<p>x</p>'</script>", "<!-- x")] == ["", "", "hi", "", ""]
    assert html_text.extract_pages(nothing(pages)).count() == 0


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_long_runs():
    for text, n in (("1" * 500_000, 0), ("x" * 500_000 + "1", 0), ("0" * 6000 + ".1.2.3", 1), ("y" * 500_000, 0)):
        spans = pii.base_spans(text)
        assert len(spans) == n and len(pii.mentions(text, spans)) <= 1


def test_pii(spark, odd, docs):
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "@", ".", "b-c", "1", "22", "4111 1111 1111 1111", "+1 (555) ", "255", " ", "é", "300.", "@x.y"]) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == brute_spans(text)
    for df in (odd, docs):
        rows = pii.digest(pii.find(df)).collect()
        want = Counter()
        for r in df.collect():
            spans = brute_spans(r.text or "")
            want[(r.doc_id, *(sum(s[0] == k for s in spans) for k in FORMS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
        assert Counter(tuple(r)[:6] for r in rows) == want
    taught = [(i, f"please call me at user{i}@mail.example.com today") for i in range(6)] + [(10, "please call me at user77(at)mail today"), (11, "nothing of 123456 here")]
    found = {r.doc_id: r for r in pii.digest(pii.find(spark.createDataFrame(taught, "doc_id long, text string"))).collect()}
    assert found[10].n_email == 0 and found[10].spans == "email:18:32" and found[11].spans == ""
    masked = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(taught, "doc_id long, text string")).collect()}
    assert masked[0] == "please call me at <EMAIL> today" and masked[10] == "please call me at <EMAIL> today" and masked[11] == taught[-1][1]
    assert pii.find(nothing(docs)).count() == 0 and pii.redact(nothing(docs)).count() == 0 and pii.redact(odd).columns == odd.columns


def test_pipeline(spark, sf, docs):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {json.dumps(f.dataType.jsonValue()) for f in out.schema} == {json.dumps(f.dataType.jsonValue()) for f in docs.schema}
