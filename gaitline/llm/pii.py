"""Personal data by bootstrapped contextual extraction (operator 10).

Seeds are matches of four fixed forms (e-mail, IP address, payment card, phone). The
words around seeds become lexical patterns (kind, side, words): two words on the left, the words
on both sides, and the one word on the left, such as the name of a field, for surfaces built like the kind's seeds.
Spark holds a bipartite graph of patterns and instances (identifier-like tokens, by their surface) and scores it
in rounds until nothing changes: a pattern is as sure as the known instances it meets, less
those of other kinds and those built like no seed; an
instance as sure as the patterns that meet it. Tokens that no form knows become personal
data when patterns make them sure. The seeds' spans always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, fresh, materialize, text_slices, texts_of

KINDS = ("email", "ip", "card", "phone")
# The four forms of the contract.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of the IP form never begins inside a run of digits, nor a token inside a word: said so, long runs take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"\S+")
# Digit groups joined by blanks, dots, hyphens or brackets; all but the last group of such a run.
_RUN = re.compile(r"(?<![\w@])\(?[0-9]++(?:[\x20()\[\].-]++[0-9]++)*+\)?+")
_GROUPS = re.compile(r"\(?[0-9]+(?:[\x20()\[\].-]+[0-9]+)*(?=[\x20()\[\].-]+[0-9]+\)?$)|")
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
MENTIONS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("surface", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("left1", "left2", "right1"))]))
_CHUNK = 1 << 20  # bytes of text at a time
_MENTION = pa.list_(pa.struct([("kind", pa.string()), ("surface", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("left1", pa.string()), ("left2", pa.string()), ("right1", pa.string())]))


def _text_key(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _luhn(digits: str) -> bool:
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(_DOUBLED[d] for d in back[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four forms, by kind as listed, then start; code points, end exclusive."""
    out: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def _candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Places off the spans that may be identifiers: tokens with a digit or @, and digit groups joined by blanks, dots, hyphens or brackets."""
    covered, out = sorted((a, b) for _, a, b in spans), {}
    j = 0
    for m in _TOKEN.finditer(text):
        while j < len(covered) and covered[j][1] <= m.start():
            j += 1
        if j == len(covered) or covered[j][0] >= m.end():
            a, b = m.span()
            while b > a and not text[b - 1].isalnum():
                b -= 1
            while a < b and not text[a].isalnum():
                a += 1
            if a < b:
                out[a, b] = None
    at = 0
    for begin, end in [*covered, (len(text), len(text))]:
        for m in _RUN.finditer(text, at, begin) if at < begin else ():
            a, b = m.span()
            if b < len(text) and (text[b].isalnum() or text[b] in "_@"):  # the last group begins a longer token
                b = a + _GROUPS.match(m.group()).end()
            if a < b and _DIGIT.search(text, a, b):
                if text[a] == "(" and ")" not in text[a:b]:
                    a += 1
                out[a, b] = None
        at = max(at, end)
    return list(out)


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds, and candidates for discovery, with the whole words around them in lower case.

    A word also ends where a seed begins or ends, and what is joined to a mention without
    a blank where another candidate does: so texts without blanks take linear time.
    """
    found = [(k, a, b) for k, a, b in spans]
    if _DIGIT.search(text) or "@" in text:
        found += [(None, a, b) for a, b in _candidates(text, spans)]
    every, seeds = (sorted({x for _, a, b in rows for x in (a, b)}) for rows in (found, spans))

    def before(at: int) -> tuple[int, int]:
        edges = every
        while at and text[at - 1].isspace():
            at, edges = at - 1, seeds
        k = bisect.bisect_left(edges, at)
        begin, least = at, edges[k - 1] if k else 0
        while begin > least and not text[begin - 1].isspace():
            begin -= 1
        return begin, at

    def after(at: int) -> tuple[int, int]:
        edges = every if at < len(text) and not text[at].isspace() else seeds
        while at < len(text) and text[at].isspace():
            at += 1
        k = bisect.bisect_right(edges, at)
        m = _WORD.match(text, at, edges[k] if k < len(edges) else len(text))
        return at, m.end() if m else at

    out = []
    for kind, a, b in found:
        left1, right1 = before(a), after(b)
        left2 = before(left1[0])
        words = [text[x:y].lower() for x, y in (left1, left2, right1)]
        out.append({"kind": kind, "surface": text[a:b], "start": a, "end": b, "left1": words[0], "left2": words[1], "right1": words[2]})
    return out


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ``text_key`` (SHA-256 of the text), ``base`` spans and ``mentions`` of each row. No shuffle."""
    rows = docs.select(column(id_col), column(text_col))
    schema = T.StructType([rows.schema[0], T.StructField("text_key", T.StringType()), T.StructField("base", SPAN), T.StructField("mentions", MENTIONS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1, _CHUNK):
            keys, base, found = [], [], []
            for t in texts_of(part.column(1)):
                spans = base_spans(t)
                keys.append(_text_key(t))
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                found.append(mentions(t, spans))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.string()), pa.array(base, _SPAN), pa.array(found, _MENTION)], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def build(surface: str) -> F.Column:
    """How a surface is built: ``@``; else letters or none, dots alone as joints or not, and its digits by number as the forms of the contract part them."""
    text, digits = F.col(surface), F.regexp_count(surface, F.lit("[0-9]"))
    number = F.when(digits < 7, "few").when(digits < 16, "some").when(digits < 20, "card").otherwise("many")
    plain = F.concat(F.when(text.rlike(r"\p{L}"), "letters ").otherwise(""), F.when(text.rlike(r"^[^.]*\.[^.]*\.[^.]*\.[^.]*$") & ~text.rlike(r"[^\p{L}0-9.]"), "dots ").otherwise(""), number)
    return F.when(text.contains("@"), F.lit("@")).otherwise(plain)


def score_graph(found: DataFrame, rounds: int | None = None, least_seeds: int = 3, sure: float = 0.8, builds: bool = False, least_word_seeds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Patterns (kind, side, words, confidence) that are sure and instances (surface, kind, confidence) of mention rows.

    An edge joins a surface to each pattern beside it: the two words on the left, or the
    word on the left with the one on the right. Known are the seeds and the instances found so far: a surface of
    no kind yet has no vote. A pattern of a kind has at least ``least_seeds`` different known surfaces of that kind, so
    that what one round finds induces the patterns of the next; its confidence is the share of the kind
    among its known surfaces. An instance has 1 minus the product of the doubts of all
    its patterns, sure or not, and is found, for good, when its surest kind gets to
    ``sure``. Rounds go on until one finds nothing (``rounds`` may bound them).
    Surfaces count once for each pattern, so copies of a document add nothing. Edges are
    summed before each shuffle.

    With ``builds`` a surface's build (see :func:`build`) counts. The word on the left alone, without the marks at
    its ends, is a pattern, too, with ``least_word_seeds`` known surfaces, and speaks only for
    surfaces built like some seed of its kind. A surface not found and built like no seed of any kind votes
    against its patterns: confidence is the kind's share, each kind by its part of all seeds' edges so that the commonest
    kind does not win beside every word, times the share of known surfaces of the kind among these and
    those against. A pattern under 0.5 gives no evidence, so that many weak ones add up to nothing.
    """
    word = F.regexp_replace("left1", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    sides = [
        F.struct(F.lit("left").alias("side"), F.concat_ws(" ", "left2", "left1").alias("words"), (F.col("left2") != "").alias("full")),
        F.struct(F.lit("around").alias("side"), F.concat_ws(" _ ", "left1", "right1").alias("words"), ((F.col("left1") != "") & (F.col("right1") != "")).alias("full")),
    ]
    if builds:
        sides.append(F.struct(F.lit("word").alias("side"), word.alias("words"), (word != "").alias("full")))
    place, pattern = ["side", "words"], ["side", "words", "pkind"]
    edges = found.select("surface", "kind", F.explode(F.array(*sides)).alias("e")).where("e.full").groupBy("surface", "e.side", "e.words").agg(F.max("kind").alias("seed"))
    # Only where at least least_seeds different surfaces stand can a pattern ever be.
    often = edges.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_seeds).drop("n")
    graph = edges.join(often, place)
    if builds:  # a few builds for each kind at most
        graph = graph.withColumn("build", build("surface"))
        like = materialize(found.where("kind is not null").select(F.col("kind").alias("pkind"), build("surface").alias("build")).distinct(), "pii-builds")
        graph = graph.join(F.broadcast(like.select("build").distinct().withColumn("known_build", F.lit(True))), "build", "left").withColumn("against", F.col("seed").isNull() & F.col("known_build").isNull()).drop("known_build")
    graph = materialize(graph, "pii-graph")
    voter = F.when(F.col("seed").isNotNull(), F.col("seed"))
    voter = voter.when(F.col("against"), F.lit("")) if builds else voter
    votes = materialize(graph.select(*place, voter.alias("pkind")).where("pkind is not null").groupBy(*pattern).agg(F.count(F.lit(1)).alias("yes")), "pii-votes")
    part = votes.where("pkind != ''").groupBy("pkind").agg((F.lit(1.0) / F.sum("yes")).alias("weight"))  # a row for each kind
    least = F.when(F.col("side") == "word", least_word_seeds).otherwise(least_seeds)
    unseen, known, done = graph.where("seed is null").drop("seed"), None, 0
    while True:
        if builds:
            weighed = votes.join(F.broadcast(part), "pkind", "left").withColumn("own", F.col("yes") * F.coalesce("weight", F.lit(0.0)))
            every = weighed.groupBy(*place).agg(F.sum("own").alias("all"), F.sum(F.when(F.col("pkind") == "", F.col("yes")).otherwise(0)).alias("no"))
            share = F.col("own") / F.col("all") * F.col("yes") / (F.col("yes") + F.col("no"))
            patterns = weighed.where((F.col("pkind") != "") & (F.col("yes") >= least)).join(every, place).select(*pattern, share.alias("confidence")).where("confidence >= 0.5")
        else:
            every = votes.groupBy(*place).agg(F.sum("yes").alias("all"))
            patterns = votes.where(F.col("yes") >= least_seeds).join(every, place).select(*pattern, (F.col("yes") / F.col("all")).alias("confidence"))
        left = unseen if known is None else unseen.join(known.select("surface"), "surface", "left_anti")
        spoken = left.join(patterns, place)
        if builds:
            alike = F.broadcast(like.withColumn("alike", F.lit(True)))
            spoken = spoken.join(alike, ["pkind", "build"], "left").where("side != 'word' or alike")
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        belief = spoken.groupBy("surface", "pkind").agg(F.round(1 - F.exp(doubt), 9).alias("confidence"))
        best = belief.groupBy("surface").agg(F.max(F.struct("confidence", F.col("pkind").alias("kind"))).alias("b")).where(F.col("b.confidence") >= sure)
        new = materialize(best.select("surface", "b.kind", "b.confidence"), "pii-belief")
        known, done, ended = (new if known is None else known.unionByName(new)), done + 1, new.isEmpty()
        if ended or done == rounds:
            break
        met = unseen.join(new.select("surface", F.col("kind").alias("pkind")), "surface")
        turns = [F.struct("pkind", F.lit(1).alias("by"))]
        if builds:  # who was against and is found now changes sides
            turns.append(F.when(F.col("against"), F.struct(F.lit("").alias("pkind"), F.lit(-1).alias("by"))))
        more = met.select(*place, F.explode(F.array(*turns)).alias("v")).where("v is not null").groupBy(*place, "v.pkind").agg(F.sum("v.by").alias("yes"))
        votes = materialize(votes.unionByName(more).groupBy(*pattern).agg(F.sum("yes").alias("yes")), "pii-votes")
    return patterns.where(F.col("confidence") >= sure).withColumnRenamed("pkind", "kind"), known


def discovered(scanned: DataFrame, rounds: int | None = None, least_seeds: int = 3, sure: float = 0.8) -> DataFrame:
    """(own_id, own_key, extra): the spans beyond the base ones of each id and text of :func:`scan` that has any."""
    found = scanned.where(F.size("mentions") > 0).select(F.col(scanned.columns[0]).alias("own_id"), F.col("text_key").alias("own_key"), F.explode("mentions").alias("m")).select("own_id", "own_key", "m.*")
    _, belief = score_graph(found, rounds, least_seeds, sure, builds=True)
    best = belief.select(F.col("surface").alias("known"), F.col("kind").alias("found_kind"))
    # Of nested places the widest stays: a run of digit groups takes the place of the tokens in it.
    wider = Window.partitionBy("own_id", "own_key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    places = found.where("kind is null").join(best, F.col("surface") == F.col("known")).select("own_id", "own_key", F.col("found_kind").alias("kind"), "start", "end").distinct()
    widest = places.withColumn("reach", F.max("end").over(wider)).where("reach is null or reach < end")
    return widest.groupBy("own_id", "own_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, least_seeds: int = 3, sure: float = 0.8) -> DataFrame:
    """id, ``text_key``, ``base`` and ``spans`` (base and discovered ones, by kind as listed, then start), one row per row of ``docs``.

    A missing text counts as empty: no spans. A discovered span has the kind that its
    patterns make surest, and never overlaps a base span. Rows that repeat give equal rows, an empty table
    an empty one; other columns are not read. Only mentions, never whole texts, are shuffled.
    """
    scanned = materialize(scan(docs, id_col, text_col), "pii-scan")
    extra = discovered(scanned, rounds, least_seeds, sure)
    joined = scanned.drop("mentions").join(extra, column(id_col).eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")), "left")
    both = F.concat("base", F.coalesce("extra", F.array().cast(SPAN)))
    place = F.transform(both, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(place), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(column(id_col), "text_key", "base", ordered.alias("spans"))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base forms by kind, ``base_sha256`` and ``spans`` as text."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in KINDS]
    return found.select(id_col, *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with its spans replaced by their kinds in angle brackets; overlapping ones as one, by the kind of the first."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_spans: int = 100_000, **options) -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind in angle brackets; other columns stay as they are, as does a missing text.

    Base spans are found again in the pass that masks, so only the documents with discovered ones are
    named to it: by broadcast up to ``most_spans`` of those by count, else by a join on id and text hash. An empty
    table gives an empty one; long texts are masked whole, repeated rows alike.
    """
    extra = materialize(discovered(materialize(scan(docs, id_col, text_col), "pii-scan"), **options), "pii-extra")
    key, theirs, their_key, spans = fresh(docs, "text_key", "own_id", "own_key", "extra")
    extra = extra.toDF(theirs, their_key, spans)
    if (extra.agg(F.sum(F.size(spans))).first()[0] or 0) <= most_spans:
        extra = F.broadcast(extra)
    hashed = docs.withColumn(key, F.sha2(F.encode(F.coalesce(column(text_col), F.lit("")), "UTF-8"), 256))
    both = hashed.join(extra, column(id_col).eqNullSafe(F.col(theirs)) & (F.col(key) == F.col(their_key)), "left").select(*map(column, docs.columns), spans)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at, _CHUNK):
            texts = [t if t is None else masked(t, base_spans(t) + [(x["kind"], x["start"], x["end"]) for x in more or ()]) for t, more in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
            columns = list(part.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, docs.schema)
