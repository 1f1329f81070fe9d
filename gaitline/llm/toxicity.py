"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios (operator 5).

A text, in lower case and with blanks for all but letters and digits, has a feature for
each hashed character n-gram that it holds. Over all labelled training rows Spark counts
in how many toxic and how many other texts each bucket occurs; the log ratio of the two
smoothed shares scales the feature, and buckets without a significant ratio have none.
A logistic regression with a weight for each scaled feature gives the score. Labels are
an input of training only; a score depends on nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, materialize, text_slices, texts_of

ORDERS = (4, 5, 6)
BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1099511628211)
_SEED = np.uint64(1469598103934665603)
_CHUNK = 1 << 19  # bytes of text at a time: its n-grams take about a hundred times that
_PLAIN = np.array([c if chr(c).isalnum() else 32 for c in range(128)], np.uint32)


def _parts(texts: list[str], shared: int, limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """(text numbers, parts) of at most about ``limit`` characters at a time; parts of one text share ``shared`` characters with the next."""
    numbers, parts, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - shared, 1), limit):
            if size >= limit:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            parts.append(text[at : at + limit + shared])
            numbers.append(k)
            size += len(parts[-1])
    if parts:
        yield numbers, parts


def ngram_buckets(texts: list[str], orders: tuple[int, ...] = ORDERS, bits: int = BITS, limit: int = _CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) arrays for the character n-grams of each order, each text framed by blanks; of a long text part by part, whose shared characters may give a bucket twice."""
    for numbers, parts in _parts([f" {t.lower()} " for t in texts], max(orders) - 1, limit):
        data = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        data = np.where(data < 128, _PLAIN[np.minimum(data, 127)], data).astype(np.uint64)
        part = np.repeat(np.arange(len(parts), dtype=np.int32), [len(t) for t in parts])
        owner = np.array(numbers, np.int32)[part]
        code, width = np.full(len(data), _SEED), 0
        for n in sorted(orders):
            while width < n:
                tail = data[width:]
                code = (code[: len(tail)] ^ tail) * _STEP
                width += 1
            same = part[: len(code)] == part[n - 1 : n - 1 + len(code)]
            yield owner[: len(code)][same], ((code[same] * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def distinct(found: Iterator[np.ndarray], most: int = 1 << 22) -> np.ndarray:
    """The distinct numbers of all arrays, sorted; beyond ``most`` numbers held they are thinned as they come, so that a text of any length takes bounded memory."""
    held, size = [np.zeros(0, np.int64)], 0
    for numbers in found:
        held.append(numbers)
        size += len(numbers)
        if size > most:
            held = [np.unique(np.concatenate(held))]
            size = len(held[0])
    return np.unique(np.concatenate(held))


@dataclass(frozen=True)
class Model:
    """place: the feature of each bucket, -1 for none; weight: of each feature, its naive Bayes ratio included."""

    place: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        owner, feature = present(texts, self.place)
        return _sigmoid(self.bias + np.bincount(owner, weights=self.weight[feature], minlength=len(texts)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def present(texts: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the features that each text holds, each once."""

    def kept() -> Iterator[np.ndarray]:
        for owner, bucket in ngram_buckets(texts):
            at = place[bucket]
            held = at >= 0
            yield owner[held].astype(np.int64) << 32 | at[held]

    pairs = distinct(kept())
    return pairs >> 32, pairs & 0xFFFFFFFF


def held_out(id_col) -> F.Column:
    """True where crc32 of the id as text leaves 2 on division by 4; a missing id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(column(id_col).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def bucket_counts(rows: DataFrame, least: int = 8, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Over all rows (text, toxic): in how many other and toxic texts each bucket occurs, and how many texts of either there are.

    Each task adds up its own texts before the shuffle; what reaches the driver is at
    most 2**bits counts, whatever the input's size. Buckets of under ``least`` texts count 0.
    """
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size + 1), np.int32)
        for batch in text_slices(batches, 0, _CHUNK):
            own = np.array(batch.column(1).to_pylist(), np.int64)
            for label in (0, 1):
                counts[label, size] += int((own == label).sum())
            pair = distinct(owner.astype(np.int64) << bits | bucket for owner, bucket in ngram_buckets(texts_of(batch.column(0)), orders, bits))
            np.add.at(counts, (own[pair >> bits], pair & (size - 1)), 1)
        at = np.flatnonzero(counts.any(axis=0))
        for k in range(0, len(at), 50_000):
            part = at[k : k + 50_000].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1, part]), pa.array(counts[0, part])], names=["bucket", "toxic", "clean"])

    total = rows.mapInArrow(run, "bucket int, toxic int, clean int").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    table = total.where((F.col("toxic") + F.col("clean") >= least) | (F.col("bucket") == size)).toArrow()
    got = np.zeros((2, size + 1))
    got[0, table["bucket"].to_numpy()], got[1, table["bucket"].to_numpy()] = table["clean"].to_numpy(), table["toxic"].to_numpy()
    return got[0, :size], got[1, :size], got[0, size], got[1, size]


def log_ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, smooth: float = 1.0, clear: float = 0.7, sure: float = 4.0) -> np.ndarray:
    """Log of the ratio of the smoothed shares of toxic and other texts with a bucket; 0 where it is small or not significant."""
    ratio = np.log((toxic + smooth) / (n_toxic + 2 * smooth)) - np.log((clean + smooth) / (n_clean + 2 * smooth))
    spread = np.sqrt(1 / (toxic + smooth) + 1 / (clean + smooth))
    return np.where((np.abs(ratio) >= clear) & (np.abs(ratio) >= sure * spread), ratio, 0.0)


def _fit(owner: np.ndarray, feature: np.ndarray, y: np.ndarray, ratio: np.ndarray, base: float, rounds: int, damping: float) -> tuple[np.ndarray, float]:
    """Weights (the ratios included) and bias of the damped logistic regression, by accelerated gradient steps."""
    n, m = len(y), len(ratio)
    value = ratio[feature]
    w, bias = np.zeros(m), base
    mean_w, mean_b, sq_w, sq_b = np.zeros(m), 0.0, np.zeros(m), 0.0
    for k in range(1, rounds + 1):
        off = _sigmoid(bias + np.bincount(owner, weights=w[feature] * value, minlength=n)) - y
        grad = np.bincount(feature, weights=off[owner] * value, minlength=m) / n + damping * w
        slope = off.mean()
        mean_w, mean_b = 0.9 * mean_w + 0.1 * grad, 0.9 * mean_b + 0.1 * slope
        sq_w, sq_b = 0.99 * sq_w + 0.01 * grad**2, 0.99 * sq_b + 0.01 * slope**2
        rate = 0.05 / (1 + k / 40)
        w = w - rate * (mean_w / (1 - 0.9**k)) / (np.sqrt(sq_w / (1 - 0.99**k)) + 1e-8)
        bias = bias - rate * (mean_b / (1 - 0.9**k)) / (np.sqrt(sq_b / (1 - 0.99**k)) + 1e-8)
    return w * ratio, float(bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 20_000, rounds: int = 150, damping: float = 3e-4, most_broadcast: int = 500_000) -> Model:
    """A model from the labelled rows that are not held out.

    The counts cover all of them; the regression over the scaled features is fitted on
    about ``fit_rows`` of them at most, by a hash of their id. Labels other than 0 and 1
    and missing ids are left out. Without labels of both kinds every score is the
    smoothed share of toxic rows. Up to ``most_broadcast`` labels (an id and a bit each, some
    32 MB in all) are broadcast to the texts, by their counted number, and the texts are read where they lie; more labels
    join the texts by a shuffle, once, into a written table. An empty table of either kind is one without labels.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & column(id_col).isNotNull() & ~held_out(id_col)).groupBy(column(id_col).alias("known")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = materialize(known, "toxic-labels")
    few = known.count() <= most_broadcast
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    rows = texts.join(F.broadcast(known) if few else known, F.col("id") == F.col("known")).select("text", "toxic", F.pmod(F.hash("id"), F.lit(1_000_000)).alias("order"))
    if not few:
        rows = materialize(rows, "toxic-train")
    clean, toxic, n_clean, n_toxic = bucket_counts(rows.select("text", "toxic"))
    share = (n_toxic + 1) / (n_toxic + n_clean + 2)
    base = float(np.log(share / (1 - share)))
    ratio = log_ratios(toxic, clean, n_toxic, n_clean) if n_toxic and n_clean else np.zeros(1 << BITS)
    used = np.flatnonzero(ratio)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    if not len(used):
        return Model(place, np.zeros(1), base)
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0, _CHUNK):
            owner, feature = present(texts_of(batch.column(0)), shared.value)
            offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=batch.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32))), batch.column(1)], names=["x", "toxic"])

    part = min(1.0, fit_rows / (n_toxic + n_clean))
    got = rows.where(F.col("order") < int(1_000_000 * part)).select("text", "toxic").mapInArrow(held, "x array<int>, toxic int").toArrow()
    lists = got["x"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    weight, bias = _fit(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64), got["toxic"].to_numpy().astype(float), ratio[used], base, rounds, damping)
    return Model(place, weight, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """id, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every row; a missing text scores as an empty one.

    An empty table gives an empty one; a text counts whole, however long. Rows that repeat
    give equal rows; other columns are not read. The model (2**20 numbers and a few) is
    broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own_id = docs.select(column(id_col)).schema[0]
    schema = T.StructType([own_id, T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches, 2, _CHUNK):
            p = own.score(texts_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return docs.select(column(id_col), held_out(id_col).alias("held_out"), column(text_col)).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under ``cut``, all their columns unchanged; missing, empty, long and repeated texts as in ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches, at, _CHUNK):
            yield batch.filter(pa.array(own.score(texts_of(batch.column(at))) < cut))

    return docs.mapInArrow(run, docs.schema)
