"""Discovery of personal data that no form knows, and toxicity of texts longer than a chunk."""

import random
from collections import Counter, defaultdict

import numpy as np

from gaitline.llm import pii, toxicity

MENTION = "surface string, kind string, left2 string, left1 string, right1 string"


def planted(rng):
    """Texts in which fields name identifiers that the forms know or miss, among numbers that are none; and what is to be found by text."""
    filler = [f"w{''.join(rng.choice('abcdefgh') for _ in range(5))}" for _ in range(400)]
    few = lambda: " ".join(rng.choice(filler) for _ in range(rng.randint(3, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(good):
        while True:
            n = digits(16)
            if pii._luhn(n) == good:
                return n

    fields = {
        "phone": (["phone:", "Tel", "mobile", "call"], lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f"555-{digits(4)}"),
        "card": (["card", "Card:", "visa"], lambda: card(True), lambda: card(False)),
        "email": (["mail", "e-mail:", "Contact"], lambda: f"a{digits(3)}@mail.example.com", lambda: f"bob{digits(3)}@intranet"),
        "ip": (["host", "ip:"], lambda: f"10.{digits(2)}.1.{digits(2)}", lambda: f"3{digits(2)}.{digits(2)}.1.{digits(2)}"),
    }
    texts, want = [], {}
    for kind, (names, known, odd) in fields.items():
        for name in names:
            texts += [f"{few()} {name} {known()} {few()}" for _ in range(25)]
            for _ in range(10):
                surface = odd()
                if not pii.base_spans(surface):
                    texts.append(f"{few()} {name} {surface} {few()}")
                    want[texts[-1]] = (kind, surface)
    decoys = [("tracking", lambda: card(False)), ("order", lambda: digits(8)), ("call", lambda: digits(1)), ("version", lambda: f"{digits(1)}.{digits(1)}"), ("on", lambda: f"20{digits(2)}-1{digits(1)}-1{digits(1)}"), (rng.choice(filler), lambda: card(False))]
    texts += [f"{few()} {word} {make()} {few()}" for word, make in decoys for _ in range(25)]
    texts += [f"{few()} {known()} {few()} {odd()} {few()}" for _, known, odd in fields.values() for _ in range(30)]
    return texts, want


def test_planted_identifiers_are_found(spark):
    texts, want = planted(random.Random(33))
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    hits = extra = 0
    for r in rows:
        text = texts[r.doc_id]
        base = pii.base_spans(text)
        assert [tuple(s) for s in r.base] == base and set(base) <= {tuple(s) for s in r.spans}
        for kind, a, b in {tuple(s) for s in r.spans} - set(base):
            extra += 1
            hits += want.get(text) == (kind, text[a:b])
    assert len(want) > 100 and hits >= 0.8 * len(want) and hits >= 0.9 * extra, (len(want), hits, extra)


def brute(rows, sure=0.8):
    """The graph with builds, round by round, over plain dictionaries."""
    def words_of(l2, l1, r1):
        core = l1.strip(".:")
        return [p for p, full in ((("left", f"{l2} {l1}"), l2), (("around", f"{l1} _ {r1}"), l1 and r1), (("word", core), core)) if full]

    def built(s):
        n = sum(c.isdigit() for c in s)
        number = "few" if n < 7 else "some" if n < 16 else "card" if n < 20 else "many"
        return "@" if "@" in s else ("letters " if any(c.isalpha() for c in s) else "") + number

    seed = {s: k for s, k, *_ in rows if k}
    sides = defaultdict(set)
    for s, _, *words in rows:
        for p in words_of(*words):
            sides[p].add(s)
    sides = {p: s for p, s in sides.items() if len(s) >= 3}
    like = {(k, built(s)) for s, k in seed.items()}
    part = Counter(seed[s] for of in sides.values() for s in of if s in seed)
    known = dict(seed)
    while True:
        share = {}
        for p, of in sides.items():
            yes = Counter(known[s] for s in of if s in known)
            no = sum(s not in known and built(s) not in {b for _, b in like} for s in of)
            for k, n in yes.items():
                c = n / part[k] / sum(m / part[j] for j, m in yes.items()) * n / (n + no)
                if n >= (5 if p[0] == "word" else 3) and c >= 0.5:
                    share[p, k] = c
        doubts = defaultdict(lambda: 1.0)
        for (p, k), c in share.items():
            for s in sides[p] - set(known):
                if p[0] != "word" or (k, built(s)) in like:
                    doubts[s, k] *= max(1 - c, 1e-9)
        best = {}
        for (s, k), d in doubts.items():
            best[s] = max(best.get(s, (0, "")), (round(1 - d, 9), k))
        new = {s: k for s, (c, k) in best.items() if c >= sure}
        if not new:
            return {s: k for s, k in known.items() if s not in seed}
        known |= new


def test_graph_with_builds_equals_brute_force(spark):
    rng, seen = random.Random(8), 0
    for _ in range(3):
        make = {"phone": lambda: str(rng.randrange(10**8, 10**9)), "card": lambda: str(rng.randrange(10**15, 10**16)), "email": lambda: f"m{rng.randrange(500)}@x", None: lambda: rng.choice([f"z{rng.randrange(99)}", str(rng.randrange(99)), str(rng.randrange(10**8, 10**9)), str(rng.randrange(10**15, 10**16)), f"u{rng.randrange(500)}@x"])}
        home = {"phone": ["tel", "tel:", "w1"], "card": ["card", "pay", "w1"], "email": ["mail.", "w1"], None: ["tel", "card", "mail.", "pay", "w1", "w2", ""]}
        rows = []
        for _ in range(220):
            kind = rng.choice(["phone", "card", "card", "email", None, None, None])
            surface = make[kind]()
            rows += [(surface, kind, rng.choice(["", "a", "b", "c"]), rng.choice(home[kind]), rng.choice(["", "x", "y"])) for _ in range(rng.randint(1, 2))]
        _, found = pii.score_graph(spark.createDataFrame(rows, MENTION), builds=True)
        got = {r.surface: r.kind for r in found.collect()}
        assert got == brute(rows)
        seen += len(got)
    assert seen > 30


def test_parts_of_long_texts_give_the_same_buckets():
    rng = random.Random(2)
    texts = ["", "ΑΣ", "x" * 50, *("".join(rng.choice("abc ΣİÉ.") for _ in range(rng.randrange(400))) for _ in range(20))]

    def all_of(limit):
        return toxicity.distinct((owner.astype(np.int64) << 20 | bucket for owner, bucket in toxicity.ngram_buckets(texts, limit=limit)), most=500).tolist()

    whole = all_of(1 << 20)
    assert whole and all(all_of(limit) == whole for limit in (1, 3, 7, 64, 399))


def test_a_text_of_twenty_megabytes_takes_bounded_memory():
    import tracemalloc

    text = "some plain words of a long text. " * 600_000
    place = np.arange(1 << toxicity.BITS, dtype=np.int32)
    tracemalloc.start()
    owner, _ = toxicity.present([text], place)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(owner) and peak < 12 * len(text)
