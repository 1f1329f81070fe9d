"""Bootstrapped patterns of op10_pii against brute force, and the candidates for discovery."""

import math
import random
from collections import defaultdict

from gaitline.llm import pii

MENTION = "surface string, kind string, left2 string, left1 string, right1 string"


def brute_graph(rows, least=3, sure=0.8):
    seeds, free = defaultdict(dict), defaultdict(set)
    for surface, kind, left2, left1, right1 in rows:
        for full, words in ((left2, ("left", f"{left2} {left1}")), (left1 and right1, ("around", f"{left1} _ {right1}"))):
            if full and kind:
                seeds[words][surface] = kind
            elif full:
                free[surface].add(words)
    known, hops = {}, 0
    while True:
        share = {}
        for words in {*seeds, *(w for of in free.values() for w in of)}:
            voters = [*seeds[words].values(), *(k for s, k in known.items() if words in free[s])]
            share |= {(words, k): voters.count(k) / len(voters) for k in set(voters) if voters.count(k) >= least}
        new = {}
        for surface in set(free) - set(known):
            sums = {k: 1 - math.prod(max(1 - share[w, k], 1e-9) for w in free[surface] if (w, k) in share) for k in pii.KINDS}
            belief, kind = max((round(b, 9), k) for k, b in sums.items())
            if belief >= sure:
                new[surface] = kind
        if not new:
            return known, hops
        known, hops = known | new, hops + 1


def test_graph_equals_brute_force(spark):
    chain = []
    for i in range(5):  # a sure pattern, then patterns of 3 seeds in 6 that only the instances of the one before can lift
        chain += [(f"s{i}{j}", "email" if j < 3 else "phone", f"w{i}", "at", "") for j in range(6 if i else 3)]
        chain += [(f"u{k}{j}", None, f"w{i}", "at", "") for j in range(9) for k in (i, i - 1) if k >= 0]
    crowd = [(f"c{i}", "card", "pay", "with", "") for i in range(6)] + [(f"n{i}", None, "pay", "with", "") for i in range(40)]
    weak = [(f"k{p}{j}", "ip" if j < 3 else "card", f"p{p}", "is", "") for p in range(2) for j in range(4)] + [("both", None, f"p{p}", "is", "") for p in range(2)] + [("one", None, "p0", "is", "")]
    rng = random.Random(5)
    noise = []
    for i in range(120):
        kind = rng.choice([None, None, "email", "email", "phone"])
        noise += [(f"r{i}", kind, f"l{rng.randint(0, 2)}", f"m{rng.randint(0, 3)}", f"n{rng.randint(0, 4)}") for _ in range(rng.randint(1, 3))]
    rows = chain + crowd + weak + noise
    want, hops = brute_graph(rows)
    _, belief = pii.score_graph(spark.createDataFrame(rows, MENTION))
    assert {r.surface: r.kind for r in belief.collect()} == want
    assert hops >= 5 and {"u48", "n39", "both"} <= set(want)


def test_found_instances_induce_patterns(spark):
    """No seed stands in the second and third context: their patterns are learnt from what the rounds before have found."""
    rows = [(f"s{j}", "email", "write", "to", "") for j in range(3)]
    rows += [(f"a{j}", None, *c, "") for j in range(3) for c in (("write", "to"), ("ping", "him"))]
    rows += [(f"b{j}", None, *c, "") for j in range(4) for c in (("ping", "him"), ("ask", "for"))]
    rows += [("last", None, "ask", "for", ""), ("stranger", None, "read", "this", "")]
    patterns, belief = pii.score_graph(spark.createDataFrame(rows, MENTION))
    assert {r.surface for r in belief.collect()} == {*(f"a{j}" for j in range(3)), *(f"b{j}" for j in range(4)), "last"}
    assert {(r.words, r.kind) for r in patterns.collect()} == {("write to", "email"), ("ping him", "email"), ("ask for", "email")}
    _, first = pii.score_graph(spark.createDataFrame(rows, MENTION), rounds=1)
    assert {r.surface for r in first.collect()} == {f"a{j}" for j in range(3)}


def test_candidates_and_contexts(spark):
    numbers = ["555 123 4567", "(743) 555-3824", "4111 1111 1111 1112", "4711", "12.34-56"]
    for form in ("call {} now", "call" + " " * 100 + "{}" + "\n" * 100 + "now"):
        for number in numbers:
            text = form.format(number)
            got = {m["surface"]: (m["left1"], m["right1"]) for m in pii.mentions(text, pii.base_spans(text))}
            assert got[number] == ("call", "now")
    long = pii.mentions("x" * 300 + " a@b.cd " + "y" * 300, [("email", 301, 307)])
    assert (long[0]["left1"], long[0]["right1"]) == ("x" * 300, "y" * 300)
    assert [m["surface"] for m in pii.mentions("on 12 34th a", [])] == ["12", "34th"]
    taught = [(i, f"please call me at +1 (743) 555-38{i}0 today") for i in range(6)] + [(10 + i, f"please call me at {n} today") for i, n in enumerate(numbers)]
    df = spark.createDataFrame(taught, "doc_id long, text string")
    assert {r.text for r in pii.redact(df).collect()} == {"please call me at <PHONE> today"}
    assert all(len(r.spans) == 1 for r in pii.find(df).collect())
    for text in ("1," * 100_000, "a@b.c," * 30_000, "1 " * 100_000 + "x"):  # linear: minutes otherwise
        rows = pii.mentions(text, pii.base_spans(text))
        assert sum(len(m["left1"]) + len(m["left2"]) + len(m["right1"]) for m in rows) < 5 * len(text)
