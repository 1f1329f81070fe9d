"""Bouts at any number of thresholds from one merge tree.

As the threshold falls, frames join and bouts grow and merge. A bout between two such events is a life: it
is there for all thresholds above ``low`` up to ``high``. There is at most one life for each frame, however many thresholds are
asked for; a grid is a look-up. What is a bout at the least threshold is a tree by itself, so a video falls into
pieces, found by segments of frames; a piece lies in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitline.operators.segments import SEGMENT


def _pieces(frames: DataFrame, least: float, max_gap: int, keys: tuple[str, ...], order: str, prob: str, segment: int) -> DataFrame:
    """(keys, pos, f, p arrays of the frames of a piece, last and last_f of its group): islands of the frames that reach ``least``."""
    own = [*keys, "__seg"]
    rows = frames.select(*keys, F.floor(F.col(order) / segment).cast("long").alias("__seg"), F.col(order).cast("long").alias("f"), F.col(prob).cast("double").alias("p"))
    w = Window.partitionBy(*own).orderBy("f")
    placed = rows.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    placed = placed.withColumn("at", F.when(F.col("p") >= least, F.col("pos")))
    before = F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parted = placed.withColumn("part", F.sum(F.coalesce((F.col("at") - before - 1 > max_gap).cast("int"), F.lit(0))).over(w))
    hit = F.when(F.col("at").isNotNull(), F.struct("pos", "f", "p"))
    local = parted.groupBy(*own, "part").agg(F.array_sort(F.collect_list(hit)).alias("hits"), F.count(F.lit(1)).alias("n"), F.max("f").alias("far"))
    segments = local.groupBy(*own).agg(F.sum("n").alias("rows"), F.max("far").alias("far"), F.array_sort(F.collect_list(F.when(F.size("hits") > 0, F.struct("part", "hits")))).alias("parts"))
    so_far = Window.partitionBy(*keys).orderBy("__seg")
    whole = Window.partitionBy(*keys)
    moved = segments.select("*", F.coalesce(F.sum("rows").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), (F.sum("rows").over(whole) - 1).alias("last"), F.max("far").over(whole).alias("last_f"))
    listed = moved.select(*own, "offset", "last", "last_f", F.inline("parts"))
    listed = listed.withColumn("hits", F.transform("hits", lambda h: h.withField("pos", h["pos"] + F.col("offset"))))
    run = Window.partitionBy(*keys).orderBy("__seg", "part")
    end = F.lag(F.element_at("hits", -1)["pos"]).over(run)
    apart = listed.withColumn("new", F.coalesce((F.element_at("hits", 1)["pos"] - end - 1 > max_gap).cast("int"), F.lit(1)))
    piece = apart.withColumn("piece", F.sum("new").over(run)).groupBy(*keys, "piece").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__seg", "part", "hits"))), lambda s: s["hits"])).alias("hits"), F.max("last").alias("last"), F.max("last_f").alias("last_f"))
    return piece.select(*keys, *[F.col(f"hits.{c}").alias(c) for c in ("pos", "f", "p")], "last", "last_f")


def _tree(pos: list[int], p: list[float], max_gap: int, min_length: int) -> list[tuple[int, int, int, float, float]]:
    """(first, last, n, low, high) of each life in a piece: indices of its first and last frame, frames, and the thresholds above low up to high that see it."""
    n, out = len(pos), []
    root = list(range(n))
    first, last, size, born = list(range(n)), list(range(n)), [0] * n, [0.0] * n

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def ends(r: int, now: float) -> None:
        if born[r] > now:
            if size[r] >= min_length:
                out.append((first[r], last[r], size[r], now, born[r]))
            born[r] = now

    for i in sorted(range(n), key=p.__getitem__, reverse=True):
        now, mine = p[i], i
        size[i], born[i] = 1, p[i]
        for step in (-1, 1):
            j = i + step
            while 0 <= j < n and abs(pos[j] - pos[i]) <= max_gap + 1:
                if size[j] or root[j] != j:
                    other = find(j)
                    if other != mine:
                        ends(other, now)
                        ends(mine, now)
                        if size[other] < size[mine]:
                            mine, other = other, mine
                        root[mine] = other
                        first[other], last[other] = min(first[other], first[mine]), max(last[other], last[mine])
                        size[other] += size[mine]
                        mine = other
                    break
                j += step
    for r in range(n):
        if root[r] == r and size[r] >= min_length:
            out.append((first[r], last[r], size[r], -np.inf, born[r]))
    return out


def bout_lives(frames: DataFrame, least: float, min_length: int = 16, max_gap: int = 3, keys: tuple[str, ...] = ("stem",), order: str = "frame", prob: str = "prob", segment: int = SEGMENT) -> DataFrame:
    """(keys, low, high, start_pos, end_pos, start_frame, end_frame, n_positive): the lives of bouts for thresholds from ``least`` on.

    A bout at threshold t is a life with low < t <= high; it ends at the last row where its gap to it is allowed, as in ``bouts``.
    """
    pieces = _pieces(frames, least, max_gap, keys, order, prob, segment)
    fields = [f for f in pieces.schema.fields if f.name in keys]
    names = ["low", "high", "start_pos", "end_pos", "start_frame", "end_frame", "n_positive"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "low double, high double, start_pos int, end_pos int, start_frame int, end_frame int, n_positive long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("pos", "f", "p", "last", "last_f")}
            owner, rows = [], []
            for k, (pos, f, p, last, last_f) in enumerate(zip(*columns.values(), strict=True)):
                for a, b, n, low, high in _tree(pos, p, max_gap, min_length):
                    to_end = last - pos[b] <= max_gap
                    owner.append(k)
                    rows.append((low, high, pos[a], last if to_end else pos[b], f[a], last_f if to_end else f[b], n))
            values = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.float64(), pa.float64(), *[pa.int32()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(pa.array(owner, pa.int64())) for f in fields), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=[*(f.name for f in fields), *names])

    return pieces.mapInArrow(run, schema)


def lives_at(lives: DataFrame, thresholds: list[float]) -> DataFrame:
    """The bouts at each threshold of a grid: its lives, looked up."""
    grid = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    seen = F.filter(grid, lambda t: (t > F.col("low")) & (t <= F.col("high")))
    return lives.select(*[c for c in lives.columns if c not in ("low", "high")], F.explode(seen).alias("threshold"))


def totals_at(lives: DataFrame, thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, threshold, n_bouts, positives): counts at each threshold of a grid of any size; each life counts at its first and behind its last threshold only."""
    ordered = sorted(float(t) for t in thresholds)
    grid = lives.sparkSession.createDataFrame(list(enumerate(ordered)), "at int, threshold double")
    place = lambda c: F.size(F.filter(F.array(*map(F.lit, ordered)), lambda t: t <= F.col(c)))
    edges = lives.select(*by, "n_positive", F.inline(F.array(F.struct(place("low").alias("at"), F.lit(1).alias("sign")), F.struct(place("high").alias("at"), F.lit(-1).alias("sign")))))
    steps = edges.groupBy(*by, "at").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("n_positive")).alias("positives"))
    groups = lives.select(*by).distinct().crossJoin(F.broadcast(grid)) if by else grid
    whole = groups.join(steps, [*by, "at"], "left").fillna(0, ["n", "positives"])
    so_far = Window.partitionBy(*(by or [F.lit(0)])).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return whole.select(*by, "threshold", F.sum("n").over(so_far).alias("n_bouts"), F.sum("positives").over(so_far).alias("positives"))
