"""Operators 11 to 13: against the library, against plain versions, on odd rows, on clashing names and on empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

from gaitline.llm import bytepieces, oracles, queries, repair, trie

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHES = "conv block pos digest size depth k1 k2 p1 p2 none kind audit letters c a nc na w1 w2 w3 s1 g1 last head base n h n_tokens ids decoded ids_sha256 edges cost".split()


def widened(df):
    return df.select("*", *[F.lit("x").alias(n) for n in CLASHES])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def model():
    return bytepieces.ByteModel(queries.byte_ranks())


@pytest.fixture(scope="module")
def library(model):
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


SIGNS = ["abc de", "'s't're've'm'll'd '", "   \n\t x", "漢字かな éüß", "12 3", "!?. -", "😀👍 a", "\u3000 \x1c\x85z"]


@pytest.mark.parametrize("leaf, piece_leaf, remembered", [(7, 3, 4), (3, 1, 1), (20, 2, 30)])
def test_joined_halves_equal_the_library(model, library, monkeypatch, leaf, piece_leaf, remembered):
    for name, value in (("LEAF", leaf), ("PIECE_LEAF", piece_leaf), ("REMEMBERED", remembered)):
        monkeypatch.setattr(bytepieces, name, value)
    model.cache.clear()
    model.words.clear()
    rng = random.Random(leaf)
    for k in range(1500):
        text = "".join(rng.choice(rng.choice(SIGNS)) * rng.choice([1, 1, 1, 2, 3, 9]) for _ in range(rng.randrange(60)))
        if k % 3 == 0:
            model.learn([text, text[::-1]])
        ids = list(model.encode(text))
        assert ids == library.encode_ordinary(text), text
        assert model.decode(ids) == text.encode()
    model.cache.clear()
    model.words.clear()


def test_one_long_word_and_one_long_run(model, library):
    for text in ("ab" * 30_000, "a" * 20_001, " " * 50_001 + "x", "é漢" * 20_000, "x y" * 40_000):
        assert list(model.encode(text)) == library.encode_ordinary(text)


def test_another_pattern_is_refused():
    with pytest.raises(ValueError):
        bytepieces.ByteModel(queries.byte_ranks(), pattern=r"\w+")


def test_byte_pieces_of_documents(spark, library):
    texts = [None, "", " \n ", "a", "one two " * 30_000, "same", "same", "漢字 \x00 😀"]
    docs = spark.createDataFrame([(None if k == 2 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = []
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.append((None if k == 2 else k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(bytepieces.encode_documents(docs, queries.byte_ranks())) == sorted(want, key=str)
    assert rows_of(bytepieces.encode_documents(widened(docs), queries.byte_ranks())) == sorted(want, key=str)
    assert bytepieces.encode_documents(docs.limit(0), queries.byte_ranks()).count() == 0
    whole = bytepieces.encode_documents(docs, queries.byte_ranks(), with_ids=True).where("doc_id = 7").first()
    assert list(whole.ids) == library.encode_ordinary(texts[7]) and bytes(whole.decoded).decode() == texts[7]


def plain_trie(rows):
    by=defaultdict(list)
    for c,t,r,x in rows:
        if c is not None: by[c].append((t is not None,t or 0,r or "",x or ""))
    for c in by: by[c].sort(key=lambda v:(v[0],v[1],hashlib.md5(f"{len(v[2])}:{v[2]}{v[3]}".encode()).digest()))
    turns={c:[(r,x) for _,_,r,x in v] for c,v in by.items()}
    full={}
    for c in turns:
        h=zlib.crc32(str(c).encode())%6
        base=c-int(abs(c)%100*(1 if c>=0 else -1))
        full[c]=turns.get(base,[])[:h]+turns[c][h:]
    mem=defaultdict(list)
    for c,s in full.items():
        for d in range(len(s)+1): mem[tuple(s[:d])].append(c)
    kids=defaultdict(list)
    for n in mem:
        if n: kids[n[:-1]].append(n)
    leaves={};saved={}
    for n in sorted(mem,key=len,reverse=True):
        leaves[n]=sum(leaves[k] for k in kids[n]) if kids[n] else 1
        saved[n]=sum(saved[k] for k in kids[n])+((len(mem[n])-1)*len(n[-1][1]) if n else 0)
    out=[]
    for n,m in mem.items():
        ends=sorted(c for c in m if len(full[c])==len(n))
        out.append((min(m),len(n),min(mem[n[:-1]]) if n else None,len(m),len(kids[n]),leaves[n],saved[n],hashlib.sha256(",".join(map(str,ends)).encode()).hexdigest()))
    return sorted(out)


def test_trie_equals_a_plain_one(spark, monkeypatch):
    """Blocks of 4 turns, families of 4 siblings and tasks of 20 arcs at the end: every way of dealing is taken."""
    monkeypatch.setattr(trie, "SIBLINGS", 4)
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    ranking = trie.list_rank
    monkeypatch.setattr(trie, "list_rank", lambda arcs: ranking(arcs, 40, 400))
    rng = random.Random(3)
    rows = []
    for c in range(-30, 130):
        for t in range(rng.choice([0, 1, 2, 3, 8, 9, 20])):
            rows.append((c, rng.choice([t, t, t, None, t // 2]), rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else "user", rng.choice(["a", "b", "", None, "ccc"]) if t > 1 else rng.choice("ab")))
    rows += rows[:40] + [(None, 1, "user", "x"), (9999, 0, "user", "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(trie.conversation_trie(df)) == sorted(plain_trie(rows), key=str)
    assert trie.conversation_trie(df.limit(0)).count() == 0


def test_trie_on_clashing_names(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, None, None, None), (3, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(trie.conversation_trie(widened(df))) == sorted(plain_trie(rows), key=str)


def test_list_ranking_of_a_shuffled_list(spark):
    """No range of arcs holds a chain worth shrinking, so coins are tossed."""
    rng, n = random.Random(1), 300
    order = list(range(n))
    rng.shuffle(order)
    arcs = [(order[i], 0, order[i + 1] if i + 1 < n else None, 0 if i + 1 < n else None, 1, i % 3, i) for i in range(n)]
    got = trie.list_rank(spark.createDataFrame(arcs, "c long, a long, nc long, na long, w1 long, w2 long, w3 long"), 60, 80).collect()
    place = {order[i]: i for i in range(n)}
    assert len(got) == n and all((r.w1, r.w3) == (place[r.c], place[r.c] * (place[r.c] - 1) // 2) for r in got)


def test_trie_sql(sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert sorted(con.execute(oracles.OP12).fetchall(), key=str) == sorted(plain_trie(con.execute("select * from conversations").fetchall()), key=str)


def plain_repair(rows):
    by=defaultdict(list)
    for c,t,r,x in rows:
        k=zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode())%20
        r=" " if r is None else r; x=" " if x is None else x
        by[c]
        if k==0: continue
        if k==1: x=""
        if k==2: x="".join(ch for ch in x if ch not in ".!?")
        if k==4: r="user"
        by[c]+=[(t,r,x)]*(2 if k==3 else 1)
    out=[]
    for c,v in by.items():
        v.sort(key=lambda z:(z[0] is not None,z[0] or 0,hashlib.md5(f"{len(z[1])}:{z[1]}{z[2]}".encode()).digest()))
        seen=set(); f=[]
        for t,r,x in v:
            s=x.strip(" \t\n\x0b\x0c\r")
            f.append("b" if not s else "d" if (r,x) in seen else "t" if s[-1] not in ".!?" else "")
            seen.add((r,x))
        ts=[t for t,_,_ in v if t is not None]
        gaps=max(ts)-min(ts)+1-len(set(ts)) if ts else 0
        ill=sum((v[i][1][:1]+v[i+1][1][:1]) not in("su","ua","au") for i in range(len(v)-1))
        best=[2*len(v)+1,"~",None]
        step={("","s"):"s",("","u"):"u",("s","u"):"u",("a","u"):"u",("u","a"):"a"}
        def go(i,st,cost,aud,got):
            if cost>best[0]: return
            if i==len(v) and st in("","a") and (cost,aud)<(best[0],best[1]): best[:]=[cost,aud,got]
            for role in("user","assistant"):
                if (st,role[0]) in step: go(i,step[st,role[0]],cost+5,aud+"I",got+[(role,"")])
            if i<len(v):
                go(i+1,st,cost+2,aud+"D",got)
                if f[i] in("","t"):
                    e=5 if f[i] else 0; r=v[i][1]
                    if (st,r[:1]) in step: go(i+1,step[st,r[:1]],cost+e,aud+"K",got+[(r,v[i][2])])
                    for role in("user","assistant"):
                        if (st,role[0]) in step: go(i+1,step[st,role[0]],cost+e+1,aud+"R",got+[(role,v[i][2])])
        go(0,"",0,"",[])
        out.append((c,gaps,f.count("b"),f.count("d"),f.count("t"),ill,best[0],best[1],hashlib.sha256("\n".join(f"{r}:{x}" for r,x in best[2]).encode()).hexdigest()))
    return sorted(out,key=str)


def odd_conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 4, 5, 6, 7])):
            rows.append((c, rng.choice([t, t, t, t, None, t // 2, 2 * t]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "User", "sys"]), rng.choice(["a.", "b", "c!", "", None, " \n", "d? ", "e.", "f.", "g."])))
    return rows + rows[:30] + [(None, 1, "user", "x."), (None, None, "assistant", "q!"), (None, 3, None, None)]


@pytest.mark.parametrize("bits", [1, 10])
def test_repairs_equal_a_search_of_all_edits(spark, monkeypatch, bits):
    """With blocks of two turn numbers, conversations are put together from many blocks."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = odd_conversations(random.Random(bits), 150)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_repair(rows)
    assert rows_of(repair.repair(df)) == want
    if bits == 10:
        assert rows_of(repair.repair(widened(df))) == want
        assert repair.repair(df.limit(0)).count() == 0


def test_the_agenda_takes_the_least_audit_among_equals():
    edges = {(p, q): (cost, audit) for p, q, cost, audit in repair.block_edges("KC")}  # a duplicate, then an a without a u before it
    assert edges[repair.START, repair.ASSISTANT] == (7, "DIK") and edges[repair.START, repair.START] == (4, "DD")
    whole, parts = repair.repair_blocks([repair.block_edges("B"), repair.block_edges("C")])
    assert (whole, "".join(parts)) == (0, "KK")


def test_repair_of_a_long_conversation(spark):
    """Three blocks of turns, each row fine: what the damage does is undone at the least cost, and the audit is as long as the rows."""
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(2500)]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA)).first()
    kept = [c for c in got.audit if c != "I"]
    faults = sum(zlib.crc32(f"7:{t}".encode()) % 20 != 0 for t in range(2500)) + sum(zlib.crc32(f"7:{t}".encode()) % 20 == 3 for t in range(2500))
    assert len(kept) == faults and got.cost > 0
