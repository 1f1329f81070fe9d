"""Conversation structure repair by Knuth's lightest-derivation agenda (operator 13).

An item (i, q) says that the first i rows of a conversation can be edited so that the roles kept
lead to state q of the form ``(s?(ua)+)?``. Deductions are hyperedges: an item and the fact of a row
give, by keeping, re-roling or deleting it, an item of i + 1; an insertion gives an item of i. Each
edge's function adds to (cost, audit): it is monotone and never gives less than it got, so an item
is final when the agenda first gives it out. Rows are dealt to blocks of turn numbers; a block's
lightest ways from each state to each other are the edges of the agenda over a conversation's blocks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, materialize, text_slices

BLOCK_BITS = 10
#: States: nothing yet, after a leading s, after u, after a; what each initial leads to, and where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
#: Costs of edits; a truncated row that stays costs more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A row as one letter: its fault (none, truncated, duplicate, blank) times four and its initial (s, u, a, other).
LETTERS = "ABCDEFGHIJKLMNOP"
INITIALS, FAULTS = "sua?", ("", "truncated", "duplicate", "blank")
_CHUNK_BYTES = 1 << 20

Value = tuple[int, str]
Edges = list[tuple[int, int, int, str]]  # from state, to state, cost, audit


# --- the agenda ------------------------------------------------------------------------------------


def lightest(facts: list[Edges], start: int, inserts: bool) -> dict[int, Value]:
    """The lightest (cost, audit) of each state after all facts, from ``start`` before them.

    ``facts[i]`` are the edges that fact i allows. Items leave the agenda by rising value; an item of i and fact i, both final, give items of i + 1.
    """
    n = len(facts)
    agenda: list[tuple[Value, int, int]] = [((0, ""), i, -1) for i in range(n)]  # the facts, by state -1
    agenda.append(((0, ""), 0, start))
    heapq.heapify(agenda)
    final: dict[tuple[int, int], Value] = {}

    def conclude(i: int, state: int, edges: Iterable[tuple[int, int, int, str]], step: int) -> None:
        cost, audit = final[i, state]
        for origin, target, more, letters in edges:
            if origin == state and (i + step, target) not in final:
                heapq.heappush(agenda, ((cost + more, audit + letters), i + step, target))

    goals = set(range(4))
    while agenda and goals:
        value, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final[i, state] = value
        if state < 0:
            for q in range(4):
                if (i, q) in final:
                    conclude(i, q, facts[i], 1)
            continue
        if i == n:
            goals.discard(state)
        elif (i, -1) in final:
            conclude(i, state, facts[i], 1)
        if inserts:
            conclude(i, state, _INSERTS, 0)
    return {q: final[n, q] for q in range(4) if (n, q) in final}


_INSERTS: Edges = [(p, q, INSERT, "I") for (p, initial), q in NEXT.items() if initial in ROLES]


@lru_cache(maxsize=None)
def row_edges(letter: str) -> Edges:
    """What a row allows: deletion from each state to itself and, without a blank or duplicate fault, keeping and re-roling."""
    fault, initial = divmod(LETTERS.index(letter), 4)
    edges: Edges = [(q, q, DELETE, "D") for q in range(4)]
    if FAULTS[fault] not in ("blank", "duplicate"):
        extra = TRUNCATED if fault else 0
        edges += [(p, q, extra, "K") for (p, role), q in NEXT.items() if role == INITIALS[initial]]
        edges += [(p, q, extra + REROLE, "R") for (p, role), q in NEXT.items() if role in ROLES]
    return edges


@lru_cache(maxsize=50_000)
def block_edges(letters: str) -> Edges:
    """The lightest edits of a block of rows, from each state to each other."""
    facts = [row_edges(x) for x in letters]
    return [(p, q, *value) for p in range(4) for q, value in lightest(facts, p, True).items()]


def repair_blocks(blocks: list[Edges]) -> tuple[int, list[str]]:
    """The least cost and each block's audit of the edits that give a whole conversation its form."""
    if len(blocks) == 1:
        cost, audit = min(e[2:] for e in blocks[0] if e[0] == START and e[1] in ENDS)
        return cost, [audit]
    found = lightest(blocks, START, False)
    cost, audit = min(found[q] for q in ENDS if q in found)
    return cost, _cut(audit, blocks)


def _cut(audit: str, blocks: list[Edges]) -> list[str]:
    """The audit of a whole conversation cut into those of its blocks: the one way that leads on by edges."""
    places = [{(0, START): ""}]  # (length, state) after each block and the block's part
    backs: list[dict[tuple[int, int], tuple[int, int]]] = []
    for edges in blocks:
        reached, back = {}, {}
        for at, state in places[-1]:
            for p, q, _, part in edges:
                if p == state and audit.startswith(part, at):
                    reached.setdefault((at + len(part), q), part)
                    back.setdefault((at + len(part), q), (at, state))
        places.append(reached)
        backs.append(back)
    here = next((len(audit), q) for q in ENDS if (len(audit), q) in places[-1])
    parts = []
    for k in range(len(blocks), 0, -1):
        parts.append(places[k][here])
        here = backs[k - 1][here]
    return parts[::-1]


# --- rows ------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(none, conv, block, turn, role, text, dropped): every row as the damage leaves it, twice where it repeats it; missing roles and texts are one space.

    ``none`` marks a missing conv_id, whose rows are a conversation too.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    turn = F.col("turn").cast("long")
    rows = conversations.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.coalesce(F.shiftright(turn, BLOCK_BITS), F.lit(-(1 << 62))).alias("block"),
        turn.alias("turn"), said("role").alias("role"), said("text").alias("text"), code.alias("code"),
    )
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("none", "conv", "block", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def _blocks(rows: DataFrame) -> DataFrame:
    """(none, conv, block, letters, lo, hi, turns): the rows of a block in order, a letter each, and their turn numbers."""
    key = ["none", "conv", "block"]
    trimmed = F.rtrim("text", F.lit(BLANKS.decode()))
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == x, k) for k, x in enumerate(INITIALS[:3])], F.lit(3))
    fault = F.when(trimmed == "", 3).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    narrow = rows.where("not dropped").select(*key, "turn", _digest().alias("digest"), initial.alias("initial"), fault.alias("fault"))
    several = rows.where("not dropped").groupBy("none", "conv").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("none", "conv")
    dealt = narrow.repartition(*key)  # this one shuffle serves all that follows
    counted = dealt.groupBy(*key, "turn", "digest", "initial", "fault").agg(F.count(F.lit(1)).cast("int").alias("m"))
    first = F.col("turn").eqNullSafe(F.min("turn").over(Window.partitionBy(*key, "digest")))
    if several.isEmpty():
        counted = counted.withColumn("new", first)
    else:  # a row may repeat one of an earlier block
        where_first = narrow.join(several, ["none", "conv"], "left_semi").groupBy("none", "conv", "digest").agg(F.min("block").alias("earliest"))
        counted = counted.withColumn("new", first).join(where_first, ["none", "conv", "digest"], "left").withColumn("new", F.col("new") & (F.coalesce("earliest", "block") == F.col("block"))).drop("earliest")
    letter = lambda f: F.substring(F.lit(LETTERS), (4 * f + F.col("initial") + 1).cast("int"), F.lit(1))
    again = letter(F.when(F.col("fault") == 3, 3).otherwise(2))
    run = F.when(F.col("new"), F.concat(letter(F.col("fault")), F.repeat(again, F.col("m") - 1))).otherwise(F.repeat(again, F.col("m")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "digest", run.alias("run"))))
    letters = F.array_join(F.transform(ordered, lambda r: r["run"]), "")
    return counted.groupBy(*key).agg(letters.alias("letters"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.size(F.collect_set("turn")).cast("long").alias("turns"))


_EDGE = "array<struct<p:int,q:int,cost:long,audit:string>>"
_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def _block_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: dict[str, list] = {k: [] for k in ("blank", "duplicate", "truncated", "illegal", "ends", "edges")}
        for letters in batch.column("letters").to_pylist():
            codes = list(map(LETTERS.index, letters))
            for k, name in enumerate(FAULTS[1:], 1):
                made[name].append(sum(c // 4 == k for c in codes))
            initials = "".join(INITIALS[c % 4] for c in codes)
            made["illegal"].append(_illegal(initials))
            made["ends"].append(initials[0] + initials[-1])
            made["edges"].append([dict(zip(("p", "q", "cost", "audit"), e, strict=True)) for e in block_edges(letters)])
        kept = [batch.column(k) for k in ("none", "conv", "block", "lo", "hi", "turns")]
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, t in zip(made.values(), types, strict=True))], names=["none", "conv", "block", "lo", "hi", "turns", *made])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("none", "conv", *_STATS, "audits")
    for batch in batches:
        out: dict[str, list] = {c: [] for c in names}
        for none, conv, lo, hi, turns, blank, duplicate, truncated, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cost, audits = repair_blocks([[(e["p"], e["q"], e["cost"], e["audit"]) for e in b["edges"]] for b in blocks])
            illegal = sum(b["illegal"] for b in blocks) + sum(_illegal(a["ends"][1] + b["ends"][0]) for a, b in zip(blocks, blocks[1:], strict=False))
            gaps = 0 if lo is None else hi - lo + 1 - turns
            row = (none, conv, gaps, blank, duplicate, truncated, illegal, cost, [{"block": b["block"], "audit": a} for b, a in zip(blocks, audits, strict=True)])
            for c, v in zip(names, row, strict=True):
                out[c].append(v)
        types = [pa.bool_(), *[pa.int64()] * 7, pa.list_(pa.struct([("block", pa.int64()), ("audit", pa.string())]))]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(names))


def repairs(rows: DataFrame) -> DataFrame:
    """(none, conv, gaps, blank, duplicate, truncated, illegal, cost, audits): the lightest repair of each conversation that has rows; audits are an array of (block, audit)."""
    ways = _blocks(rows).mapInArrow(_block_ways, f"none boolean, conv long, block long, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, ends string, edges {_EDGE}")
    total = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated")]]
    whole = ways.groupBy("none", "conv").agg(*total, F.array_sort(F.collect_list(F.struct("block", "illegal", "ends", "edges"))).alias("blocks"))
    return whole.mapInArrow(_whole, f"none boolean, conv long, {', '.join(f'{c} long' for c in _STATS)}, audits array<struct<block:long,audit:string>>")


class Repairer:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, emit: Callable[[str, str], None]):
        self.emit, self.state, self.audit, self.at = emit, START, "", 0

    def begin(self, audit: str) -> None:
        self.insertions()
        self.audit, self.at = audit, 0

    def _put(self, role: str, text: str) -> None:
        self.state = NEXT[self.state, role[0]]
        self.emit(role, text)

    def _wanted(self) -> str:
        return ROLES["a" if self.state == USER else "u"]

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._put(self._wanted(), "")

    def row(self, role: str, text: str) -> None:
        self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._put(role if edit == "K" else self._wanted(), text)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of its repaired rows ``role:text``, joined by newlines.

    Rows without conv_id are one conversation, whose conv_id is missing. Missing roles and texts are one space, missing turns come
    first, rows of equal turn stand by their digest, so repeated rows stand together and all but the first are
    duplicates. An empty table gives no row; a conversation whose rows are all dropped gives zeros. Other columns aren't read.
    Texts are shuffled once and stream through the hash, which is a chain and so one task's for each conversation; a conversation's audit is one string.
    """
    rows = damaged(conversations)
    fixes = materialize(repairs(rows), "repair-audits")
    nothing = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in names]
    stats = [(c, "long") for c in _STATS]
    heads = fixes.select("*", F.inline("audits")).select("none", "conv", "block", F.lit(0).alias("kind"), *nothing(("turn", "long"), ("digest", "binary"), ("role", "string")), F.col("audit").alias("text"), *_STATS)
    texts = rows.where("not dropped").select("none", "conv", "block", F.lit(1).alias("kind"), "turn", _digest().alias("digest"), "role", "text", *nothing(*stats))
    gone = rows.where("dropped").select("none", "conv").distinct().select("none", "conv", F.lit((1 << 62)).alias("block"), F.lit(2).alias("kind"), *nothing(("turn", "long"), ("digest", "binary"), ("role", "string"), ("text", "string"), *stats))
    dealt = heads.unionByName(texts).unionByName(gone).repartition("none", "conv").sortWithinPartitions("none", "conv", "block", "kind", "turn", "digest")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in _STATS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sha = fixer = None
        numbers, audit, begun = None, [], False
        out: list[tuple] = []

        def emit(role: str, text: str) -> None:
            nonlocal begun
            sha.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
            begun = True

        def close() -> None:
            if now is not None:
                fixer.insertions()
                out.append((None if now[0] else now[1], *(numbers or (0,) * len(_STATS)), "".join(audit), sha.hexdigest()))

        def given() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if k <= len(_STATS) else pa.string()) for k, c in enumerate(zip(*out, strict=True))], names=schema.names)
            out.clear()
            return found

        for batch in text_slices(batches, 4, _CHUNK_BYTES):
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for none, conv, kind, role, text, *values in zip(*columns, strict=True):
                if (none, conv) != now:
                    close()
                    now, sha, numbers, audit, begun = (none, conv), hashlib.sha256(), None, [], False
                    fixer = Repairer(emit)
                if kind == 0:
                    numbers = tuple(values)
                    audit.append(text)
                    fixer.begin(text)
                elif kind == 1:
                    fixer.row(role, text)
            if out:
                yield given()
        close()
        if out:
            yield given()

    return dealt.select("none", "conv", "kind", "role", "text", *_STATS).mapInArrow(run, schema)
