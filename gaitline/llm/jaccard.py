"""N-gram Jaccard join by token-combination prefixes (operator 8).

A document's set holds its distinct five-word shingles, each as a 64-bit hash. Documents
with equal sets form a class, named by a 64-bit hash of the set; two classes link when
the Jaccard similarity of their sets is at least ``share``. The steps:

1. *Hash prefixes.* In the order of their hashes, two similar sets share at least k
   shingles of their first ``n - ceil(share * n) + k``. With k growing with n (an extended
   prefix), a class lives on only if enough of its prefix occurs in other classes too.
   This drops nearly all documents without a partner at a third of the shuffle.
2. *Rare first.* The whole sets of the classes that live on are ordered by how many of
   them hold a shingle. Each keeps the first part of this order, extended by one.
3. *Leaders.* Every prefix shingle names one of its classes, at first that with the fewest
   shingles of its own: the original in a group of near copies. A class is checked against
   the two that most of its shingles name. So a large group becomes a star, not all pairs.
4. *Keys.* What may still link lies in different components. A key is a prefix shingle and
   a band of sizes. The smaller class of a pair asks, the larger one holds; a pair of
   classes needs the more shared shingles the less its sizes differ, so a class asks only
   with the first seventh of its set, and holds a key only as far down as the sizes and
   components of those that ask there need. While keys would still meet in many more pairs
   than they have rows, and rounds of leaders find links, another round goes first.
5. *Combinations.* Keys of few rows are looked up as they are. Of a frequent key, the
   combinations with the shingles that follow it in the class's extended prefix are, where
   these are fewer than the pairs that the key alone makes. Pairs that meet are verified.

Every filter is exact, so no link between different components is lost; pairs inside
a component need no check, as they can't change it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import column, fresh, materialize, text_slices, texts_of

SHINGLE = 5
SHARE = (75, 100)
_EXTRA = 16  # the hash prefix is extended by a sixteenth of the set
_CROWD = 64 * 64  # a key that makes more pairs is frequent: it is combined with a second shingle
_FEW = 50  # rounds of leaders end when fewer than one of so many checked pairs is a link
_SPARSE = 4  # or when keys make at most so many pairs for each of their rows
_CHUNK = 1 << 19  # bytes of text at a time: its hashes take about fifty times that
_OFTEN = 8
_BITS = 26
_MASK = (1 << 48) - 1
_SEEN = 1 << 17  # classes and common shingles that a task remembers
_BROADCAST_ROWS = 500_000  # rows of two or three longs
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)
_PRIME = _U(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        _POWER = np.multiply.accumulate(np.full(max(n, 2 * len(_POWER)), _PRIME))
    return _POWER[:n]


_POWER = np.full(1, _PRIME)
_INVERSE = _U(pow(int(_PRIME), -1, 1 << 64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, 64-bit hash) of every word, A-Z in lower case; all words of a chunk at once."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_LOWER) + b" ", np.uint8)
    blank = _BLANK[data]
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    last = np.flatnonzero(~blank & np.r_[blank[1:], True])
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Polynomial hash of data[a..b]: the difference of running sums, brought to the same power.
    with np.errstate(over="ignore"):
        power = _powers(len(data))
        total = np.cumsum(np.where(blank, _U(0), _BYTE[data] * power), dtype=np.uint64)
        value = total[last] - np.where(first > 0, total[np.maximum(first - 1, 0)], _U(0))
        inverse = _inverse_powers(len(data))[first]
        hashed = _mix(value * inverse + (last - first).astype(np.uint64))
    starts = np.r_[0, np.cumsum([len(r) + 1 for r in raw])[:-1]]
    return np.searchsorted(starts, first, side="right") - 1, hashed


_BACK = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _BACK
    if len(_BACK) < n:
        _BACK = np.multiply.accumulate(np.full(max(n, 2 * len(_BACK)), _INVERSE))
    return _BACK[:n]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; fewer words than a shingle has make one, no word none."""
    owner, word = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        size = max(0, len(word) - SHINGLE + 1)
        grams = np.zeros(size, np.uint64)
        for k in range(SHINGLE):
            grams = _mix(grams * _PRIME + word[k : k + size])
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(grams[end - n : end - SHINGLE + 1]))
        elif n:
            code = _U(n)
            with np.errstate(over="ignore"):
                for w in word[end - n : end]:
                    code = _mix(np.array([code * _PRIME + w]))[0]
            out.append(np.array([code], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _must(n: int) -> int:
    """Least overlap of a set of n with a similar one."""
    return -(-SHARE[0] * n // SHARE[1])


def _k(n: int) -> int:
    return n // _EXTRA + 1


def _longs(arrays: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if a is None else len(a) for a in arrays]
    flat = np.concatenate([a for a in arrays if a is not None and len(a)] or [np.zeros(0, np.uint64)]).view(np.int64)
    offsets = pa.array([None if a is None else o for a, o in zip(arrays, np.r_[0, np.cumsum(sizes)].tolist())] + [int(sum(sizes))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fp (a hash of the text), n, sig of every row; sig is null for a row without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2, _CHUNK):
            sets = shingle_sets(texts_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) if len(s) else None for s in sets], pa.int64())], names=["id", "fp", "n", "sig"])

    rows = docs.select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("fp"), column(text_col).alias("text"))
    return rows.mapInArrow(run, StructType([StructField("id", rows.schema["id"].dataType), *(StructField(c, LongType()) for c in ("fp", "n", "sig"))]))


def _postings(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, part): 48 bits each of the shingles of the extended hash prefixes and of their classes, each class about once a task.

    A shingle that a task has sent for several classes is shared for sure: it is not sent
    again, but a token of its own under two names stands for it. So no token has more rows
    than a few for each task, however common it is. Tokens or classes that agree in 48
    bits only can let more classes live on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        cells, often = np.zeros(1 << 20, np.uint8), {}
        for batch in text_slices(batches, 0, _CHUNK):
            tokens, parts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in shingle_sets(texts_of(batch.column(0))):
                if len(s) < 3 or (sig := _class(s)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(sig)
                p = s[: len(s) - _must(len(s)) + _k(len(s))]
                cell = (p & _U((1 << 20) - 1)).astype(np.int64)
                crowded = np.flatnonzero(cells[cell] >= _OFTEN)
                cells[cell] = np.minimum(cells[cell], 250) + 1
                known = 0
                if len(crowded):
                    stay = np.ones(len(p), bool)
                    for j in crowded.tolist():
                        t = int(p[j])
                        sent = often.get(t, 0)
                        if sent >= _OFTEN:
                            stay[j] = False
                        else:
                            if len(often) >= _SEEN:
                                often.clear()
                            often[t] = sent + 1
                    known = int((~stay).sum())
                    p = p[stay]
                part = sig & _MASK
                tokens.append(p)
                parts.append(np.full(len(p), part))
                if known:
                    with np.errstate(over="ignore"):
                        own = _mix(_U(part) * _PRIME + np.arange(known, dtype=np.uint64))
                    tokens += [own, own]
                    parts += [np.full(known, part), np.full(known, part ^ 1)]
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(tokens) & _U(_MASK)).astype(np.int64)), pa.array(np.concatenate(parts))], names=["token", "part"])

    return docs.select(column(text_col)).mapInArrow(run, "token long, part long")


def _whole_sets(docs: DataFrame, id_col: str, text_col: str, wanted: np.ndarray) -> DataFrame:
    """(sig, n, tokens) of the rows whose id's bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, _CHUNK):
            bit = batch.column(0).to_numpy() & ((1 << _BITS) - 1)
            hit = (shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            kept = [s for s in shingle_sets(texts_of(batch.column(1).filter(pa.array(hit.astype(bool))))) if len(s) > 2]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in kept], pa.int64()), pa.array([len(s) for s in kept], pa.int64()), _longs(kept)], names=["sig", "n", "tokens"])

    return docs.select(F.xxhash64(column(id_col)).alias("h"), column(text_col)).mapInArrow(run, "sig long, n long, tokens array<long>")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """2**26 bits (8 MB, whatever the input), those of the given ``h`` set; ids that share a bit only add work."""
    bit = F.col("h").bitwiseAND(F.lit((1 << _BITS) - 1))
    rows = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits")).toArrow()
    out = np.zeros(1 << (_BITS - 3), np.uint8)
    for block, bits in zip(rows["block"].to_pylist(), rows["bits"].to_pylist()):
        out[block * 4096 : block * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _small(rows: DataFrame) -> DataFrame:
    """A written table of a few longs a row, to be broadcast where its counted rows allow it."""
    return F.broadcast(rows) if rows.count() <= _BROADCAST_ROWS else rows


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, of classes whose sets are similar. Only sets that occur in a pair are shuffled.

    Many pairs may name one class as b, so the sets of the a, which spread, come first.
    """
    names = _small(materialize(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), "names"))
    sets = sets.join(names, "sig", "left_semi")
    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), F.size("ta").alias("na"), F.size("tb").alias("nb"))
    return joined.where(SHARE[1] * F.col("both") >= SHARE[0] * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(sig, comp) for every end of the links (a, b): the smallest sig that they reach.

    Contraction: each round every vertex joins its smallest neighbour and the links move
    to what their ends have joined, until none is left. Class names are random, so a round
    leaves a part of the vertices only. Each round is a written table.
    """
    links = materialize(links.where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = _small(materialize(ends.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "joined"))
        if labels is None:
            labels = step.select(F.col("v").alias("sig"), F.col("to").alias("comp"))
        else:
            labels = materialize(labels.join(step, F.col("comp") == F.col("v"), "left").select("sig", F.coalesce("to", "comp").alias("comp")), "labels")
        a = step.select(F.col("v").alias("a"), F.col("to").alias("ta"))
        b = step.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        links = materialize(links.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("sig"), F.col("b").alias("comp"))


def _classes(docs: DataFrame, id_col: str, text_col: str, leader_rounds: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, fp, n, sig), and (sig, comp) of the classes that have a link."""
    members = materialize(_members(docs, id_col, text_col), "members")
    classes = members.where("n > 2").groupBy("sig").agg(F.max("n").alias("n"), F.min("id").alias("rep"))

    # 1: classes with enough shared shingles in their hash prefixes.
    posted = _postings(docs, text_col)
    same = Window.partitionBy("token")
    shared = posted.select("part", (F.min("part").over(same) < F.max("part").over(same)).alias("met")).where("met").groupBy("part").agg(F.count(F.lit(1)).alias("shared"))
    partner = _partner(F.col("n"))
    least = F.floor(partner / _EXTRA) + 1
    alive = materialize(classes.withColumn("part", F.col("sig").bitwiseAND(F.lit(_MASK))).join(shared, "part").where(F.col("shared") >= least).select("sig", F.xxhash64("rep").alias("h")), "alive")

    # 2: whole sets of these (of a class more than once only where ids repeat or share a bit), rare shingles first.
    sets = materialize(_whole_sets(docs, id_col, text_col, _bitmap(alive)), "sets")
    if alive.count() > 1 << (_BITS - 3):  # the bits no longer tell enough
        sets = sets.join(alive.select("sig"), "sig", "left_semi")
    prefix = materialize(_prefixes(sets), "prefix")

    # 3: leaders, each round with others; whatever they miss is left to the last step.
    links, labels = None, None
    for turn in range(leader_rounds):
        asked = materialize(_leaders(prefix, labels, turn), "asked")
        found = materialize(_verify(asked, sets), "found")
        links = found if links is None else materialize(links.union(found), "links")
        labels = _small(components(links))
        keys = materialize(_keys(prefix, labels), "keys")
        rows, pairs = _meetings(keys).agg(F.coalesce(F.sum(F.col("asks") + F.col("holds")), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0.0))).first()
        if pairs <= _SPARSE * rows or found.count() * _FEW < asked.count():
            break

    # 4 and 5: what meets in different components.
    pairs = materialize(_meet(keys, prefix), "pairs")
    if pairs.isEmpty():
        return members, labels
    return members, components(links.union(_verify(pairs, sets)))


def _partner(n: Column) -> Column:
    """The size of the smallest similar set, which is also the least overlap with any."""
    return F.ceil(SHARE[0] * n / SHARE[1])


def _overlap(one: Column, two: Column) -> Column:
    """Least overlap of two similar sets of these sizes."""
    return F.ceil(SHARE[0] * (one + two) / sum(SHARE))


def _band(n: Column) -> Column:
    """Sizes in bands that grow as the sizes of similar sets may differ."""
    return F.floor(F.log(n.cast("double")) / math.log(SHARE[1] / SHARE[0]))


def _prefixes(sets: DataFrame) -> DataFrame:
    """(sig, n, single, pos, token): the extended prefix of every class, rarest shingles first, but for the ``single`` ones that it alone holds."""
    post = sets.select("sig", "n", F.explode("tokens").alias("token"))
    often = post.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = post.join(often, "token").groupBy("sig").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("df", "token"))).alias("list"))
    single = F.col("n") - F.size("list")
    take = F.col("n") - _partner(F.col("n")) + 2 - single
    kept = ranked.where(F.size("list") >= _partner(F.col("n"))).where(take > 0).select("sig", "n", single.alias("single"), F.posexplode(F.slice("list", F.lit(1), take.cast("int"))).alias("at", "t"))
    return kept.select("sig", "n", "single", (F.col("single") + F.col("at")).alias("pos"), "t.token")


def _labelled(prefix: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The prefix rows with their component; a class without links is its own."""
    return prefix.withColumn("comp", F.col("sig")) if labels is None else prefix.join(labels, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))


def _leaders(prefix: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """The pairs (a, b) to check in a round: each class with at most two others, of other components.

    In the first round a shingle names its class with the fewest shingles of its own, so that a group
    agrees on the one that its members were made from; later ones hash the shingle too, so that a class tries others.
    """
    now = _labelled(prefix, labels)
    order = F.struct("single", F.xxhash64("sig").alias("h")) if turn == 0 else F.struct(F.xxhash64("sig", "token", F.lit(turn)).alias("h"))
    named = now.groupBy("token").agg(F.min(F.struct(order.alias("order"), F.col("sig").alias("lead"), F.col("n").alias("lead_n"), F.col("comp").alias("lead_comp"))).alias("by"), F.count(F.lit(1)).alias("m")).where("m > 1")
    near = SHARE[1] * F.least("n", "by.lead_n") >= SHARE[0] * F.greatest("n", "by.lead_n")
    votes = now.join(named, "token").where(F.col("comp") != F.col("by.lead_comp")).where(near).groupBy("sig", "by.lead").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("sig").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "lead")), asc=False), 1, 2).alias("best"))
    return best.select(F.col("sig").alias("a"), F.explode("best.lead").alias("b"))


def _keys(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    """(ask, sig, n, pos, token, band, comp): the prefix rows that can still meet one of another component.

    A class asks with the first ``n - overlap + 1`` of its shingles, in its own band and the next; what it must find
    there, and how far down the larger ones hold, follows from the smallest size that asks and the components on either side.
    """
    own = _labelled(prefix, labels)
    asks = own.where(F.col("pos") <= F.col("n") - _overlap(F.col("n"), F.col("n")))
    asks = asks.select(F.lit(True).alias("ask"), "sig", "n", "pos", "token", F.explode(F.sequence(_band(F.col("n")), _band(F.floor(F.col("n") * SHARE[1] / SHARE[0])))).alias("band"), "comp")
    holds = own.where(F.col("pos") <= F.col("n") - _partner(F.col("n"))).select(F.lit(False).alias("ask"), "sig", "n", "pos", "token", _band(F.col("n")).alias("band"), "comp")
    both = asks.unionByName(holds)
    some, other = F.col("ask"), ~F.col("ask")
    sides = both.groupBy("token", "band").agg(
        F.min(F.when(some, F.col("n"))).alias("least"),
        F.min(F.when(some, F.col("comp"))).alias("ask_lo"),
        F.max(F.when(some, F.col("comp"))).alias("ask_hi"),
        F.max(F.when(other, F.col("n"))).alias("most"),
        F.min(F.when(other, F.col("comp"))).alias("hold_lo"),
        F.max(F.when(other, F.col("comp"))).alias("hold_hi"),
    )
    sides = sides.where("least <= most and not (ask_lo = ask_hi and hold_lo = hold_hi and ask_lo = hold_lo)")
    kept = both.join(sides, ["token", "band"])
    asks = some & (F.col("n") <= F.col("most")) & ((F.col("comp") != F.col("hold_lo")) | (F.col("comp") != F.col("hold_hi")))
    down = F.col("n") - _overlap(F.greatest(F.col("least"), _partner(F.col("n"))), F.col("n"))
    holds = other & (F.col("n") >= F.col("least")) & (F.col("pos") <= down) & ((F.col("comp") != F.col("ask_lo")) | (F.col("comp") != F.col("ask_hi")))
    return kept.where(asks | holds).select("ask", "sig", "n", "pos", "token", "band", "comp")


def _meetings(keys: DataFrame) -> DataFrame:
    """(token, band, asks, holds, top, pairs, combos): for each key its rows on either side, the component with most of them, the pairs
    of rows that are not both of that one, and about how many combinations the rows have.
    """
    after = F.col("n") - F.when(F.col("ask"), _overlap(F.col("n"), F.col("n"))).otherwise(_partner(F.col("n"))) + 1 - F.col("pos")
    own = keys.groupBy("token", "band", "comp").agg(F.count_if("ask").cast("double").alias("a"), F.count_if(~F.col("ask")).cast("double").alias("h"), F.sum(after).alias("c"))
    sides = own.groupBy("token", "band").agg(F.sum("a").alias("asks"), F.sum("h").alias("holds"), F.sum("c").alias("combos"), F.max(F.struct((F.col("a") + F.col("h")).alias("m"), "comp", "a", "h")).alias("top"))
    pairs = F.col("top.a") * (F.col("holds") - F.col("top.h")) + (F.col("asks") - F.col("top.a")) * F.col("holds")
    return sides.select("token", "band", "asks", "holds", F.col("top.comp").alias("top"), pairs.alias("pairs"), "combos").where("pairs > 0")


def _meet(keys: DataFrame, prefix: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes of different components that meet by a key, or by a combination where the key is frequent.

    Of the component with most rows of a key, those that ask only look among the rows of others.
    """
    frequent = (F.col("pairs") > _CROWD) & (F.col("combos") < F.col("pairs"))
    sides = keys.join(_meetings(keys).select("token", "band", "top", frequent.alias("frequent")), ["token", "band"]).withColumn("own", F.col("comp") == F.col("top")).drop("top")
    after = prefix.select("sig", F.col("token").alias("next"), F.col("pos").alias("at"))
    single = sides.where("not frequent").withColumn("next", F.lit(0).cast("long")).withColumn("at", F.col("pos"))
    combined = sides.where("frequent").join(after, "sig").where("at > pos")
    index = single.unionByName(combined)
    asks = index.where("ask").withColumn("among", F.explode(F.when(F.col("own"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).drop("ask", "frequent", "own")
    holds = index.where("not ask").select("token", "band", "next", F.col("own").alias("among"), F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("pos").alias("pb"), F.col("at").alias("ab"))
    must = _overlap(F.col("n"), F.col("nb"))
    smaller = (F.col("n") < F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("sig") < F.col("b")))
    near = SHARE[1] * F.col("n") >= SHARE[0] * F.col("nb")
    within = (F.col("pos") <= F.col("n") - must) & (F.col("pb") <= F.col("nb") - must) & (F.col("at") <= F.col("n") - must + 1) & (F.col("ab") <= F.col("nb") - must + 1)
    met = asks.join(holds, ["token", "band", "next", "among"]).where((F.col("comp") != F.col("cb")) & smaller & near & within)
    return met.select(F.col("sig").alias("a"), "b").distinct()


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leader_rounds: int = 8) -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` (the smallest id reachable by links) of every row.

    A row without words, or without a text, has 0 shingles and is its own component. Rows
    with equal sets are linked, ids missing or repeated or not; a missing id is never the
    smallest of a component that has another. An empty table gives an empty one; texts are read whole,
    however long. Other columns are not read. Two different sets or shingles with the same
    64-bit hash would count as one. Needs ``spark.checkpoint.dir``.
    """
    members, labels = _classes(docs, id_col, text_col, leader_rounds)
    named = members.join(labels, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    least = named.where("n > 0").groupBy("comp").agg(F.min("id").alias("least"))
    out = named.join(least, "comp", "left").select("id", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with its smallest id (ties: least hash of the text; a missing id comes last).

    Rows without words all stay; columns are unchanged; an empty table stays empty. Rows that repeat both id and text
    count as one. The rows that go join the texts by id and text hash: by broadcast up to half a million of them, by a shuffle beyond.
    """
    members, labels = _classes(docs, id_col, text_col, 8)
    rank = F.struct(F.col("id").isNull().alias("missing"), "id", "fp")
    named = members.where("n > 0").join(labels, "sig", "left").select(F.coalesce("comp", "sig").alias("comp"), rank.alias("rank"))
    first = named.groupBy("comp").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    among = materialize(named.join(first, "comp").groupBy("rank").agg(F.max(F.col("rank") == F.col("first")).alias("stays"), F.count(F.lit(1)).alias("m")).select("rank.id", "rank.fp", "stays", "m"), "ranked")
    mine, theirs, print_ = fresh(docs, "own_text", "lost_id", "lost_text")
    out = docs.withColumn(mine, F.xxhash64(column(text_col)))

    def of(rows: DataFrame, how: str) -> DataFrame:
        rows = _small(materialize(rows.select(F.col("id").alias(theirs), F.col("fp").alias(print_)), "named"))
        return out.join(rows, column(id_col).eqNullSafe(F.col(theirs)) & (F.col(mine) == F.col(print_)), how)

    kept = of(among.where("not stays"), "left_anti")
    again = among.where("stays and m > 1")
    if not again.isEmpty():
        out = kept
        kept = of(again, "left_anti").unionByName(of(again, "left_semi").dropDuplicates([id_col, mine]))
    return kept.drop(mine)
