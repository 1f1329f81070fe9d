"""Prefix trie of conversations by the Euler-tour technique (operator 12).

A node is a distinct sequence of first turns. Its key adds up, in lanes of 32 bits, a hash of each
turn with its depth, so keys are prefix sums and need no walk along a conversation. Each node has
an enter and an exit arc; the arcs' order is a linked list, which is ranked by contraction: ranges
of arcs shrink to their chains' heads until one small list is left, and ranks go back down. What the
ranks of a node's two arcs enclose is its subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Turns of one conversation, children of one parent and ids of one node are dealt to blocks of this many.
BLOCK_BITS = 10
SIBLINGS = 4096
#: Arcs that one task ranks at the end, and the most that one takes while the list is longer.
LAST_ARCS, MOST_ARCS = 1 << 14, 1 << 20
LANES = ("s1", "s2", "s3", "s4")
WEIGHTS = ("w1", "w2", "w3")


# --- conversations ---------------------------------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, digest, size) of each turn, pos from 1 by turn, missing first, then by digest; and (conv, n).

    Rows without conv_id take no part; a missing role or text is empty. A conversation is
    dealt to blocks of turn numbers, so no task holds a long one.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    block = F.coalesce(F.shiftright(F.col("turn").cast("long"), BLOCK_BITS), F.lit(-(1 << 62)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), block.alias("block"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size"))
    inside = F.row_number().over(Window.partitionBy("conv", "block").orderBy("turn", "digest")).cast("long")
    turns = materialize(rows.select("conv", "block", inside.alias("pos"), "digest", "size"), "trie-turns")
    sizes = turns.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    turns = _shifted(turns, sizes.select("conv", "block", before.alias("shift")).where("shift is not null"), ["pos"])
    return turns, sizes.groupBy("conv").agg(F.sum("n").alias("n"))


def _shifted(rows: DataFrame, shifts: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` without block, the columns moved on by the ``shift`` columns of their (conv, block); most conversations have one block and no shift."""
    names = [c for c in shifts.columns if c not in ("conv", "block")]
    if shifts.isEmpty():
        return rows.drop("block")
    moved = dict(zip(columns, names, strict=True))
    joined = rows.join(shifts, ["conv", "block"], "left")
    return joined.select(*[(F.col(c) + F.coalesce(F.col(moved[c]), F.lit(0))).alias(c) if c in moved else F.col(c) for c in rows.columns if c != "block"])


def rebuilt(turns: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, size) of rebuilt conversations, and (conv, depth) with their numbers of turns.

    A conversation c takes the first h turns of c - c % 100 (all, if fewer), then its own behind its first h; h = crc32(c in decimal) % 6.
    """
    head = F.array_sort(F.collect_list(F.struct("pos", "digest", "size")))
    heads = turns.where("conv % 100 = 0 and pos <= 5").groupBy(F.col("conv").alias("base")).agg(head.alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    convs = counts.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base")).join(heads, "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    convs = materialize(convs.select("conv", "n", "h", taken.alias("head")), "trie-heads")
    borrowed = convs.select("conv", F.inline("head")).select("conv", F.col("pos").alias("depth"), "digest", "size")
    starts = convs.select("conv", "h", F.size("head").cast("long").alias("b"))
    own = turns.join(starts, "conv").where("pos > h").select("conv", (F.col("b") + F.col("pos") - F.col("h")).alias("depth"), "digest", "size")
    return borrowed.unionByName(own), convs.select("conv", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("depth"))


# --- trie ------------------------------------------------------------------------------------------


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences, one row each: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    ``turns`` has (conv, depth, digest, size), depths from 1 without gaps, ``convs`` has each
    (conv, depth) once, depth being its number of turns (0: a member of the root only).
    Without any conversation there is no node. Equal sequences share all nodes; a common
    first turn, conversation or parent is pre-aggregated, salted or dealt to blocks. Only
    the SHA-256 of a node's ids, a chain by its nature, is one task's; it streams over strings of up to 1,024 ids.
    """
    members = _members(turns, convs)
    node = ["depth", "k1", "k2"]
    found = members.groupBy(*node).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    nodes = materialize(found.unionByName(root.select(*zero(*node), "conv", "n_convs", *zero("size", "p1", "p2"))), "trie-nodes")
    families = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = materialize(nodes.join(families, node, "left").fillna(0, ["n_children"]), "trie-families")
    parents = counted.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"), F.col("n_children").alias("n_siblings"))
    below = counted.where("depth > 0").join(parents, ["depth", "p1", "p2"])
    both = ["depth", "k1", "k2", "conv", "n_convs", "size", "n_children", "parent", "n_siblings"]
    linked = _linked(materialize(below.select(*both).unionByName(counted.where("depth = 0").select(*both[:-2], F.lit(None).cast("long").alias("parent"), F.lit(1).cast("long").alias("n_siblings"))), "trie-linked"))
    arcs = _arcs(linked)
    ranked = list_rank(arcs)
    side, at = F.col("a") % 2, F.shiftright("a", 1)
    inside = lambda w: (F.max(F.when(side == 1, F.col(w))) - F.max(F.when(side == 0, F.col(w)))).alias(w)
    subtrees = ranked.groupBy(F.col("c").alias("conv"), at.alias("depth")).agg(inside("w2"), inside("w3"))
    ends = _ends(members.where("last").select(*node, "conv").unionByName(convs.where("depth = 0").select(*zero(*node), "conv")))
    out = linked.join(subtrees, ["conv", "depth"]).join(ends, node, "left")
    sha = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("w2").alias("n_leaves"), F.col("w3").alias("saved_tokens"), sha.alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of rebuilt conversations.

    Rows without conv_id take no part, missing roles and texts are empty, a missing turn comes first, turns of
    equal number stand by their digest and repeated rows stay; other columns aren't read; an empty table has no node.
    """
    turns, convs = rebuilt(*numbered_turns(conversations))
    return prefix_trie(turns, convs)


def _members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Each turn of each sequence with the key of its node (k1, k2), that of its parent (p1, p2), and whether it is the last."""
    hashes = [F.xxhash64(F.lit(k), "digest", "depth") for k in (1, 2)]
    low, high = (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda h: F.shiftrightunsigned(h, 32))
    block = F.shiftright("depth", BLOCK_BITS).cast("long")
    rows = turns.join(convs.withColumnRenamed("depth", "length"), "conv").select("conv", block.alias("block"), "depth", "size", (F.col("depth") == F.col("length")).alias("last"), *[f(h).alias(f"g{2 * k + j + 1}") for k, h in enumerate(hashes) for j, f in enumerate((high, low))])
    so_far = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = materialize(rows.select("*", *[F.sum(f"g{k}").over(so_far).alias(s) for k, s in enumerate(LANES, 1)]), "trie-sums")
    totals = summed.groupBy("conv", "block").agg(*[F.sum(f"g{k}").alias(s) for k, s in enumerate(LANES, 1)])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.where("block > 0").select("conv").distinct().join(totals, "conv").select("conv", "block", *[F.sum(s).over(before).alias(f"shift_{s}") for s in LANES]).where("shift_s1 is not null")
    whole = _shifted(summed, shifts, list(LANES))

    def key(values: list[Column]) -> list[Column]:
        lanes = [v.bitwiseAND(F.lit(0xFFFFFFFF)) for v in values]
        return [F.shiftleft(lanes[i], 32).bitwiseOR(lanes[i + 1]) for i in (0, 2)]

    own, up = key([F.col(s) for s in LANES]), key([F.col(s) - F.col(f"g{k}") for k, s in enumerate(LANES, 1)])
    return whole.select("conv", "depth", "size", "last", own[0].alias("k1"), own[1].alias("k2"), up[0].alias("p1"), up[1].alias("p2"))


def _linked(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``first``, the conv of their first child, and ``following``, that of their next sibling.

    Siblings stand by salt and conv; a family of up to 4,096 has one salt, so no window is larger than about that.
    """
    salt = F.pmod(F.xxhash64("conv"), F.ceil(F.col("n_siblings") / SIBLINGS)).cast("long")
    salted = nodes.withColumn("salt", salt)
    family = ["parent", "depth", "salt"]
    children = salted.where("depth > 0")
    beside = children.withColumn("following", F.lead("conv").over(Window.partitionBy(*family).orderBy("conv")))
    firsts = children.where(F.col("n_siblings") > SIBLINGS).groupBy(*family).agg(F.min("conv").alias("head"))
    over = firsts.select(*family, F.lead("head").over(Window.partitionBy("parent", "depth").orderBy("salt")).alias("head"))
    placed = beside.join(over, family, "left").withColumn("following", F.coalesce("following", "head")).drop("head", "salt")
    placed = placed.unionByName(nodes.where("depth = 0").withColumn("following", F.lit(None).cast("long")))
    eldest = children.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.min(F.struct("salt", "conv"))["conv"].alias("first"))
    return materialize(placed.join(eldest, ["conv", "depth"], "left"), "trie-tour")


def _arcs(linked: DataFrame) -> DataFrame:
    """(c, a, nc, na, weights): the arcs of the tour, a being twice the depth and one more for an exit, each with the arc behind it; weights are 1 and, on entering, leaf and savings."""
    d = F.col("depth") * 2
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    down = F.struct(d.alias("a"), F.coalesce("first", "conv").alias("nc"), F.when(F.col("first").isNull(), d + 1).otherwise(d + 2).alias("na"), one.alias("w1"), leaf.alias("w2"), saved.alias("w3"))
    up = F.struct((d + 1).alias("a"), F.coalesce("following", "parent").alias("nc"), F.when(F.col("following").isNotNull(), d).when(F.col("parent").isNotNull(), d - 1).alias("na"), one.alias("w1"), none.alias("w2"), none.alias("w3"))
    return linked.select(F.col("conv").alias("c"), F.inline(F.array(down, up)))


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the hash of the ids of the sequences that end at a node, ascending, joined by commas."""
    node = ["depth", "k1", "k2"]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    strings = ends.groupBy(*node, F.shiftright("conv", BLOCK_BITS).alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *key, text in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*node, "ends_sha256"), o, strict=True)) for o in out], schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*node, "ends_sha256"), (*now, state.hexdigest()), strict=True))], schema)

    schema = pa.schema([*((c, pa.int64()) for c in node), ("ends_sha256", pa.string())])
    dealt = strings.repartition(*node).sortWithinPartitions(*node, "block").select(*node, "ids")
    return dealt.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


# --- list ranking ----------------------------------------------------------------------------------


def list_rank(arcs: DataFrame, last_arcs: int = LAST_ARCS, most_arcs: int = MOST_ARCS) -> DataFrame:
    """(c, a, w1, w2, w3) for each arc of one linked list: the sums of the weights of all arcs before it.

    ``arcs`` has (c, a, nc, na, w1, w2, w3); the last arc's nc and na are missing. In a round each
    task takes a range of arcs and shrinks each chain within it to the chain's head, with the
    chain's weight; if ranges hold hardly any chains, a round by coin tosses splices out about a
    quarter of all arcs. At most ``last_arcs`` are ranked by one task. Each round is a written table.
    """
    spark, levels = arcs.sparkSession, []
    current, tossed = materialize(arcs, "trie-arcs"), 0
    count = current.count()
    while True:
        parts = 1 if count <= last_arcs else max(-(-count // most_arcs), min(-(-count // last_arcs), 2 * spark.sparkContext.defaultParallelism))
        dealt = current.coalesce(1) if parts == 1 else current.repartitionByRange(parts, "c", "a")
        level = materialize(dealt.mapInArrow(_contract, _LEVEL), "trie-level")
        levels.append(level)
        if parts == 1:
            break
        heads, shrunk = _heads(level), level.where("t1 is not null").count()
        while 3 * shrunk > 2 * count and shrunk > last_arcs:
            tossed += 1
            level = materialize(_splice(heads, tossed), "trie-splice")
            levels.append(level)
            heads, count, shrunk = _heads(level), shrunk, level.where("t1 is not null").count()
        current, count = heads, shrunk
    ranked = levels.pop().select("c", "a", F.col("o1").alias("w1"), F.col("o2").alias("w2"), F.col("o3").alias("w3"))
    for level in reversed(levels):
        above = ranked.select(F.col("c").alias("hc"), F.col("a").alias("ha"), *WEIGHTS)
        ranked = level.join(above, ["hc", "ha"]).select("c", "a", *[(F.col(w) + F.col(f"o{k}")).alias(w) for k, w in enumerate(WEIGHTS, 1)])
    return ranked


_LEVEL = "c long, a long, hc long, ha long, o1 long, o2 long, o3 long, nc long, na long, t1 long, t2 long, t3 long"


def _heads(level: DataFrame) -> DataFrame:
    """The shrunken list of a level: its chains' heads with their chains' weights."""
    return level.where("t1 is not null").select("c", "a", "nc", "na", *[F.col(f"t{k}").alias(w) for k, w in enumerate(WEIGHTS, 1)])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of arcs: each with the head of its chain and the weights from there; heads also with what follows the chain and its weights."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    c, a, nc, na, *weights = (pc.fill_null(table.column(k), -1).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7))
    weight = np.stack(weights)
    names, place = np.unique(c, return_inverse=True)
    most = int(a.max()) + 1
    key = place * most + a
    order = np.argsort(key)
    there = np.minimum(np.searchsorted(names, nc), len(names) - 1)
    wanted = there * most + na
    found = np.minimum(np.searchsorted(key, wanted, sorter=order), len(key) - 1)
    inside = (na >= 0) & (na < most) & (names[there] == nc) & (key[order[found]] == wanted)
    before = np.arange(len(c))
    before[order[found[inside]]] = np.flatnonzero(inside)
    offset = np.where(before != np.arange(len(c)), weight[:, before], 0)
    while True:
        further = before[before]
        if (further == before).all():
            break
        offset += offset[:, before]
        before = further
    tails = np.flatnonzero(~inside)
    heads = before[tails]
    after = np.full((5, len(c)), -1)
    after[0, heads], after[1, heads] = nc[tails], na[tails]
    after[2:, heads] = offset[:, tails] + weight[:, tails]
    is_head = before == np.arange(len(c))
    follows = is_head & (after[1] >= 0)
    arrays = [pa.array(x) for x in (c, a, c[before], a[before], *offset)]
    arrays += [pa.array(after[k], mask=~(follows if k < 2 else is_head)) for k in range(5)]
    yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _LEVEL.split(", ")])


def _splice(arcs: DataFrame, toss: int) -> DataFrame:
    """A level whose chains are pairs: an arc that tossed 1 joins the one before it, if that tossed 0."""
    coin = F.pmod(F.xxhash64(F.lit(toss), "c", "a"), F.lit(2))
    tossed = arcs.withColumn("coin", coin)
    first = tossed.where("coin = 0 and na is not null").select(F.col("c").alias("hc"), F.col("a").alias("ha"), F.col("nc").alias("c"), F.col("na").alias("a"), *[F.col(w).alias(f"o{k}") for k, w in enumerate(WEIGHTS, 1)])
    pairs = tossed.where("coin = 1").join(first, ["c", "a"])
    none = [F.lit(None).cast("long").alias(x) for x in ("nc", "na", "t1", "t2", "t3")]
    gone = pairs.select("c", "a", "hc", "ha", "o1", "o2", "o3", *none)
    longer = pairs.select(F.col("hc").alias("c"), F.col("ha").alias("a"), F.lit(True).alias("longer"), F.col("nc").alias("nc2"), F.col("na").alias("na2"), *[(F.col(f"o{k}") + F.col(w)).alias(f"t{k}") for k, w in enumerate(WEIGHTS, 1)])
    left = arcs.join(gone.select("c", "a"), ["c", "a"], "left_anti").join(longer, ["c", "a"], "left")
    pick = lambda old, new: F.when(F.col("longer"), F.col(new)).otherwise(F.col(old))
    zero = [F.lit(0).cast("long").alias(f"o{k}") for k in (1, 2, 3)]
    kept = left.select("c", "a", F.col("c").alias("hc"), F.col("a").alias("ha"), *zero, pick("nc", "nc2").alias("nc"), pick("na", "na2").alias("na"), *[pick(w, f"t{k}").alias(f"t{k}") for k, w in enumerate(WEIGHTS, 1)])
    return kept.unionByName(gone)
