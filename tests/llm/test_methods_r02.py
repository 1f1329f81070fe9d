"""The methods themselves against plain versions: classifier, line blocks, archives, keys of the similarity join."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gaitline.llm import common, html_text, jaccard, pieces, queries, toxicity, warc

from .test_llm import brute_components


def plain_grams(text, orders, bits):
    framed = [c if ord(c) >= 128 or c.isalnum() else " " for c in f" {text.lower()} "]
    out = set()
    for n in orders:
        for i in range(len(framed) - n + 1):
            code = 1469598103934665603
            for c in framed[i : i + n]:
                code = (code ^ ord(c)) * 1099511628211 % 2**64
            out.add((code * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits))
    return out


def test_toxicity_counts_ratios_and_fit(spark):
    rng = random.Random(3)
    words = ["kind", "mild", "vile", "Rude", "é!", "sun", "x1"]
    texts = [(" ".join(rng.choice(words[2:4] if k % 3 == 0 and rng.random() < 0.6 else words) for _ in range(rng.randint(0, 9))), int(k % 3 == 0)) for k in range(90)]
    clean, toxic, n_clean, n_toxic = toxicity.bucket_counts(spark.createDataFrame(texts, "text string, toxic int").repartition(5), least=1, bits=12)
    want = [Counter(), Counter()]
    for t, y in texts:
        want[y].update(plain_grams(t, toxicity.ORDERS, 12))
    assert (n_clean, n_toxic) == (60, 30)
    assert {k: int(v) for k, v in enumerate(clean) if v} == dict(want[0]) and {k: int(v) for k, v in enumerate(toxic) if v} == dict(want[1])
    ratio = toxicity.log_ratios(toxic, clean, n_toxic, n_clean)
    for b in range(1 << 12):
        t, c = want[1][b] + 1, want[0][b] + 1
        plain = math.log(t / 32) - math.log(c / 62)
        assert ratio[b] == pytest.approx(plain if abs(plain) >= 0.7 and abs(plain) >= 4 * math.sqrt(1 / t + 1 / c) else 0.0)
    x = [sorted(rng.sample(range(4), rng.randint(0, 4))) for _ in range(12)]
    y, r = [rng.randint(0, 1) for _ in x], [0.9, -1.1, 0.8, 2.0]
    w, b, mw, mb, sw, sb = [0.0] * 4, 0.1, [0.0] * 4, 0.0, [0.0] * 4, 0.0
    for k in range(1, 21):  # the same steps, one number at a time
        off = [1 / (1 + math.exp(-(b + sum(w[j] * r[j] for j in row)))) - t for row, t in zip(x, y)]
        grad = [sum(o * r[j] for o, row in zip(off, x) if j in row) / len(x) + 0.01 * w[j] for j in range(4)]
        slope = sum(off) / len(x)
        mw, sw = [0.9 * a + 0.1 * g for a, g in zip(mw, grad)], [0.99 * a + 0.01 * g * g for a, g in zip(sw, grad)]
        mb, sb = 0.9 * mb + 0.1 * slope, 0.99 * sb + 0.01 * slope**2
        step = lambda m, s: 0.05 / (1 + k / 40) * (m / (1 - 0.9**k)) / (math.sqrt(s / (1 - 0.99**k)) + 1e-8)  # noqa: E731, B023
        w, b = [a - step(m, s) for a, m, s in zip(w, mw, sw)], b - step(mb, sb)
    owner, feature = np.array([i for i, row in enumerate(x) for _ in row]), np.array([j for row in x for j in row])
    weight, bias = toxicity._fit(owner, feature, np.array(y, float), np.array(r), 0.1, 20, 0.01)
    assert weight == pytest.approx([a * c for a, c in zip(w, r)]) and bias == pytest.approx(b)
    place = np.full(1 << 20, -1, np.int32)
    some = sorted(plain_grams("vile rude", toxicity.ORDERS, 20))[:20]
    place[some] = np.arange(20)
    model = toxicity.Model(place, np.linspace(-1, 1, 20), 0.2)
    for t, _ in texts[:30]:
        total = 0.2 + sum(np.linspace(-1, 1, 20)[some.index(g)] for g in plain_grams(t, toxicity.ORDERS, 20) if g in some)
        assert model.score([t])[0] == pytest.approx(1 / (1 + math.exp(-total)))


def test_surges_against_their_definition():
    rng = random.Random(4)
    for _ in range(300):
        w = [rng.choice([0, 0, 0, 5, 40, 300]) for _ in range(rng.randint(0, 25))]
        sums = [sum(w[k : k + 2]) for k in range(len(w))]
        starts = [k for k in range(len(w)) if sums[k] and (k == 0 or not sums[k - 1])]
        ranges = [(a, next((k for k in range(a, len(w)) if not sums[k]), len(w))) for a in starts]
        high = [i for i, (a, b) in enumerate(ranges) if max(sums[a:b]) >= max(sums) / 3]
        want = [(a, min(len(w), b + 1)) for i, (a, b) in enumerate(ranges) if high and high[0] <= i <= high[-1]]
        assert html_text.surges(w) == want


def marked(page):
    import html

    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", body))
    return "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_pages_without_marks(spark):
    """The line blocks find the article where nothing marks it, and most adverts and footers where nothing marks those."""
    pages = [r.html for r in common.table(spark, "/root/testdata/sf0.1", "pages").select("html").collect()]
    whole = bare = 0
    for page in pages:
        want = marked(page)
        assert html_text.extract(page) == want == html_text.extract(page.replace("<article>", "<div>").replace("</article>", "</div>"))
        plain = re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|aside|header|form)\b[^>]*>", r"<\1div>", page))
        got = html_text.extract(plain)
        whole += want in got
        bare += got == want
    assert whole == len(pages) and bare >= 0.9 * len(pages)


def test_page_probes():
    text = "Words of the article that go on for a while, and then for a while longer."
    long = " ".join([text] * 6)
    probes = [
        (f"<article><div class='article-header'><h1>Title</h1></div><p>{text}</p><section class='related-work'><h2>Related work</h2><p>{long}</p></section></article>", f"Title\n\n{text}\n\nRelated work\n\n{long}"),
        (f"<article><h1>T</h1><div class='ad'>Buy<p>{text}</p><p>second</p></article><footer>x</footer>", f"T\n\n{text}\n\nsecond"),
        (f"<article><p>{text}</p><ins class='adsbygoogle'>AD AD</ins><p>two</p></article>", f"{text}\n\ntwo"),
        (f"<div><h1>T</h1><p>{long}</p><p><a href=x>Read all of it here</a></p><p>{long}</p></div><div>Copyright 2020 Foo</div><div>Contact us</div><div>Terms of use</div>", f"T\n\n{long}\n\nRead all of it here\n\n{long}"),
        (f"<body><nav><a href=1>x</a><div><h1>T</h1><p>{long}</p></div></body>", f"x\n\nT\n\n{long}"),
        (f"<body><header><h1>Site</h1></header><div class='content has-sidebar'><header class='entry-header'><h1>Title</h1></header><p>{text}</p></div>", f"Title\n\n{text}"),
        (f"<form action=x><div><h1>T</h1><p>{long}</p></div></form>", f"T\n\n{long}"),
        (f"<div><p>{long}</p></div><div class='comments'><p>{long} So true.</p></div>", long),
        (f"<div id='menu'><ul><li><a>Home</a><li><a>News</a></ul></div><div>{long}</div>", long),
    ]
    for page, want in probes:
        assert html_text.extract(page).removeprefix("x\n\n") == want.removeprefix("x\n\n"), page[:90]
    began = time.time()
    for page in ("<b>" * 100_000 + "x", "<p>" * 100_000, "<div class=ad>" * 20_000 + "x", "<div>x" * 20_000, "<" * 100_000, "<a " * 50_000):
        html_text.extract(page)
    assert time.time() - began < 30


def test_archives_of_others(spark):
    import gzip
    import hashlib

    def record(head, block):
        return gzip.compress(("WARC/1.0\r\n" + "".join(f"{x}\r\n" for x in head) + f"content-length:{len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n")

    web = b"HTTP/1.0 200 OK\r\nserver: x\r\n\r\nbody"
    good = [
        record(["WARC-Type:response", "WARC-Target-URI:http://a", "WARC-Block-Digest:sha256:" + hashlib.sha256(web).hexdigest()], web),
        record(["warc-type: warcinfo"], b"software: x"),
        record(["WARC-Type: response", "WARC-Target-URI: dns:a", "Folded: one\r\n two"], b"a. 3600 IN A 1.2.3.4"),
        record(["WARC-Type: revisit", "WARC-Payload-Digest: sha1:ABC"], b""),
        record(["WARC-Type: response", "WARC-Block-Digest: sha256:" + "0" * 64], web),
        record(["WARC-Type: response", "WARC-Payload-Digest: sha1:ABC"], web),
        record(["WARC-Type: response"], web),
    ]
    broken = bytearray(good[6])
    broken[len(broken) // 2] ^= 255
    whole = b"".join([*good[:4], bytes(broken), *good[4:]])
    files = spark.createDataFrame([(bytearray(whole),), (bytearray(whole[:-9]),), (None,), (bytearray(b"no archive"),)], "content binary")
    got = warc.read_records(files, with_payload=True).collect()
    first = got[:7]
    sha = lambda b: warc._base32(hashlib.sha1(b).digest())
    assert [(r.url, r.payload_digest, r.record_type) for r in first[:3]] == [("http://a", sha(b"body"), "response"), ("dns:a", sha(b"a. 3600 IN A 1.2.3.4"), "response"), (None, "ABC", "revisit")]
    assert [bool(r.error) for r in first] == [False, False, False, True, True, True, False] and bytes(first[6].payload) == b"body"
    assert sum(bool(r.error) for r in got[7:14]) == 4 and got[-1].error
    packed = b"".join(record(["WARC-Type: response"], bytes(random.Random(k).randbytes(60_000))) for k in range(300))
    began = time.time()
    assert sum(1 for _ in warc.records([packed])) == 300
    assert time.time() - began < 3


def test_join_of_a_large_group_and_a_common_line(spark):
    """A group of thousands of near copies, some just under the threshold, and a line that many short texts share."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(40)]
    line = "this very common line stands in a great many of the texts".split()
    rows = []
    for i in range(3000):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(40)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(3000 + i, " ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 6))] + line)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(df).collect()}
    assert got == quick_components(rows)


def quick_components(rows):
    """As brute_components, over a matrix of all pairs."""
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    known = {g: k for k, g in enumerate({g for s in sets.values() for g in s})}
    ids = sorted(sets)
    count = Counter(g for s in sets.values() for g in s)
    shared = {g: k for k, g in enumerate(g for g in known if count[g] > 1)}
    m = np.zeros((len(ids), len(shared)), np.float32)
    for k, i in enumerate(ids):
        m[k, [shared[g] for g in sets[i] if g in shared]] = 1
    n = np.array([len(sets[i]) for i in ids], np.float32)
    both = m @ m.T
    link = (100 * both >= 75 * (n[:, None] + n[None] - both)) | np.eye(len(ids), dtype=bool)
    label = np.arange(len(ids))
    while True:
        new = np.array([label[row].min() for row in link])
        if (new == label).all():
            return {i: (len(sets[i]), ids[label[k]]) for k, i in enumerate(ids)}
        label = np.minimum(new, label[new])


def test_combinations_of_frequent_keys(spark, monkeypatch):
    """With nearly every key frequent, and no leaders' round that links all, combinations find the rest."""
    monkeypatch.setattr(jaccard, "_CROWD", 1)
    monkeypatch.setattr(jaccard, "_SPARSE", 10**9)
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(6, 40))] for _ in range(12)]
    rows = []
    for i in range(350):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string"), leader_rounds=1).collect()}
    assert got == brute_components(rows)


def test_texts_are_cut_into_slices():
    texts = ["a" * n for n in (3, 0, 10, 2, 2, 50, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(8))], names=["t", "k"])
    parts = list(common.text_slices([batch.slice(0, 0), batch, batch.slice(3)], 0, 10))
    assert [p.column(1).to_pylist() for p in parts] == [[0, 1], [2], [3, 4], [5], [6, 7], [3, 4], [5], [6, 7]]


def test_models_that_normalise_are_refused(monkeypatch):
    import sentencepiece

    real = sentencepiece.SentencePieceProcessor
    monkeypatch.setattr(real, "normalize", lambda self, text: text.lower())
    with pytest.raises(ValueError):
        pieces.PieceModel(queries.piece_model())
