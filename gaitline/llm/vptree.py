"""Approximate nearest neighbours by vantage-point trees (operator 6).

Nearness is the inner product. Trees are built on the angles between vectors, which obey the triangle inequality; of a
ball or a shell of angles, the largest product that it can hold follows from its least angle to the query and
its longest vector. Vectors are dealt to bands of length, each up to a factor of the root of two, so that long vectors do
not widen what others may reach. A band's vectors are dealt to the nearest of a bounded number of pivots; each
pivot's vectors, in parts of bounded size, have trees of their own. A query first searches the
trees of the pivot with which its product is largest, then those of pivots whose ball may hold something
nearer. A ball, and inside a tree a shell, is skipped when its angle to the query is more than the angle at which
its longest vector would still be among the k nearest so far, divided by ``factor``: 1 restores exact search.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize

LEAF = 48
_SAMPLE_BYTES = 1 << 25
_SLACK = 1e-7  # what rounding may add to an angle


def _log_length(matrix: np.ndarray) -> np.ndarray:
    """Binary logarithms of the lengths of nonzero vectors, also of those whose squares overflow or vanish."""
    most = np.abs(matrix).max(axis=1)
    return np.log2(most) + np.log2(((matrix / most[:, None]) ** 2).sum(axis=1)) / 2


def _scaled(matrix: np.ndarray, shift: np.ndarray | float) -> np.ndarray:
    """Vectors divided by two to the power ``shift``."""
    most = np.abs(matrix).max(axis=1)
    return matrix / most[:, None] * np.exp2(np.log2(most) - shift)[:, None]


def _bands(matrix: np.ndarray) -> np.ndarray:
    """The band b of each vector: its length is over 2 ** ((b - 1) / 2) and up to 2 ** (b / 2), within rounding."""
    return np.ceil(2 * _log_length(matrix) - 1e-9).astype(np.int32)


def _unit(matrix: np.ndarray) -> np.ndarray:
    return _scaled(matrix, _log_length(matrix))


def _relative(score: np.ndarray, log_query: np.ndarray, log_longest: np.ndarray | float) -> np.ndarray:
    """The cosine at which a vector of this length has the product with a query of this length; more than 1 if none has."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = np.sign(score) * np.exp2(np.log2(np.abs(score)) - log_query - log_longest)
    return np.where(score == 0, 0.0, out)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _reach(cosine: np.ndarray, factor: float) -> np.ndarray:
    """The angle up to which something is not skipped; less than nothing where its longest vector is too short.

    Beyond a right angle, where products are negative and candidates few, the relaxation fades; without a k-th neighbour nothing is skipped.
    """
    widest = _angle(cosine)
    relaxed = widest / factor + np.maximum(widest - np.pi / 2, 0) * (2 - 2 / factor)
    return np.where(cosine > 1 + 1e-9, -np.inf, np.where(np.isneginf(cosine), np.inf, relaxed + _SLACK))


class VPTree:
    """A tree over the rows of ``vectors`` (float64); ``ids`` name them. Equal vectors share a leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: int, seed: int = 7):
        order = np.lexsort((ids, *vectors.T[::-1])) if vectors.size else np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)]
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        rank = np.arange(len(ids)) - begin[group]
        kept = rank < copies  # of equal vectors only so many can ever be among the nearest: those of the smallest ids
        self.sizes = np.bincount(group[kept])
        unique, self.rng = vectors[begin], np.random.default_rng(seed)
        self.length = _log_length(unique) if len(unique) else np.zeros(0)
        self.nodes: list = []  # (vantage direction, inner lo, hi, outer lo, hi, longest inner, outer, inner child, outer child) or (first row, end row)
        perm: list[np.ndarray] = []
        self._row = 0
        self._build(_scaled(unique, self.length) if len(unique) else unique, np.arange(len(unique)), perm)
        at = np.concatenate(perm) if perm else np.zeros(0, int)
        starts = np.r_[0, np.cumsum(self.sizes)]
        rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in at]) if len(at) else np.zeros(0, int)
        self.ids, self.rows = ids[kept][rows], vectors[kept][rows]

    def _build(self, unit: np.ndarray, at: np.ndarray, perm: list[np.ndarray]) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if len(at) <= LEAF:
            first = self._row
            self._row += int(self.sizes[at].sum())
            perm.append(at)
            self.nodes[me] = (first, self._row)
            return me
        tries = self.rng.choice(len(at), min(8, len(at)), replace=False)
        sample = at[self.rng.choice(len(at), min(64, len(at)), replace=False)]
        spread = [_angle(unit[sample] @ unit[at[t]]).std() for t in tries]
        vantage = unit[at[tries[int(np.argmax(spread))]]]
        far = _angle(unit[at] @ vantage)
        half = np.argsort(far, kind="stable")
        inner, outer = half[: len(at) // 2], half[len(at) // 2 :]
        a = self._build(unit, at[inner], perm)
        b = self._build(unit, at[outer], perm)
        self.nodes[me] = (vantage, far[inner].min(), far[inner].max(), far[outer].min(), far[outer].max(), self.length[at[inner]].max(), self.length[at[outer]].max(), a, b)
        return me

    def search(self, names: np.ndarray, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (n, k) of the nearest found to each query, its own id left out; -inf where there are fewer.

        ``bound``: the score of each query's k-th neighbour found elsewhere, -inf for none.
        """
        n = len(queries)
        bound = np.full(n, -np.inf) if bound is None else bound
        best, found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        length = _log_length(queries)
        unit = _scaled(queries, length)
        scanned = np.zeros(len(self.nodes), object)

        def away(q: np.ndarray, vantage: np.ndarray) -> np.ndarray:
            return _angle(unit[q] @ vantage)

        def scan(node: int, q: np.ndarray) -> None:
            first, end = self.nodes[node]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = np.einsum("qd,rd->qr", queries[q], self.rows[first:end])
            scores[np.isnan(scores)] = -np.inf
            scores[names[q][:, None] == self.ids[first:end]] = -np.inf
            all_s = np.c_[best[q], scores]
            all_i = np.c_[found[q], np.where(np.isneginf(scores), np.iinfo(np.int64).max, self.ids[None, first:end])]
            order = np.lexsort((all_i, -all_s))[:, :k]
            best[q], found[q] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)

        stack = [(0, np.arange(n))]  # first the leaf nearest to each query, for a bound to start with
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            parts = self.nodes[node]
            if len(parts) == 2:
                scan(node, q)
                scanned[node] = q
                continue
            vantage, _, ihi, olo, _, _, _, a, b = parts
            near = away(q, vantage) < (ihi + olo) / 2
            stack += [(a, q[near]), (b, q[~near])]
        stack = [(0, np.arange(n))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            parts = self.nodes[node]
            if len(parts) == 2:
                before = scanned[node]
                if isinstance(before, np.ndarray):
                    q = q[~np.isin(q, before)]
                if len(q):
                    scan(node, q)
                continue
            vantage, ilo, ihi, olo, ohi, longest, longest_out, a, b = parts
            d, least = away(q, vantage), np.maximum(best[q, -1], bound[q])
            for lo, hi, long, child in ((ilo, ihi, longest, a), (olo, ohi, longest_out, b)):
                reach = _reach(_relative(least, length[q], long), factor)
                stack.append((child, q[(d <= hi + reach) & (d >= lo - reach)]))
        return best, found


class Pivots:
    """The pivots of each group (dim, band) of vectors. A group without pivots has one place, 0."""

    def __init__(self, found: dict[tuple[int, int], np.ndarray]):
        self.rows = {g: v for g, v in found.items() if len(v)}

    def nearest(self, group: tuple[int, int], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector of a group, and its angle; 0 where the group has none."""
        if group not in self.rows:
            return np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        away = _angle(_unit(vectors) @ self.rows[group].T)
        return away.argmin(axis=1).astype(np.int32), away.min(axis=1)

    def away(self, group: tuple[int, int], unit: np.ndarray) -> np.ndarray:
        """Angles (n, places) of directions to pivots; 0 to a group without pivots, as anything may be near."""
        if group not in self.rows:
            return np.zeros((len(unit), 1))
        return _angle(unit @ self.rows[group].T)


def _by_size(pdf: pd.DataFrame):
    """(dim, row numbers, matrix) of the vectors of each size in a batch."""
    for dim, part in pdf.groupby("dim", sort=False):
        yield int(dim), part.index.to_numpy(), np.array(part["v"].tolist(), float)


def _by_band(pdf: pd.DataFrame):
    """((dim, band), row numbers, matrix) of the vectors of each group in a batch."""
    for dim, at, matrix in _by_size(pdf):
        bands = _bands(matrix)
        for band in np.unique(bands):
            yield (dim, int(band)), at[bands == band], matrix[bands == band]


def neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, factor: float = 2.0, shard_rows: int = 8192, block_rows: int = 1024, most_pivots: int = 1024, sample_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, by inner product, ties to the smaller id.

    ``is_query``: condition on ``vectors`` that marks queries. Vectors that are null, all
    zero, or hold a null or a component that is not finite take no part, nor do missing
    ids. Rows that repeat id and vector count once; an id that repeats with other vectors is in a list once, with its largest score,
    and as a query has one list. A query never finds rows of its id. A query with fewer candidates gets them all. Queries find vectors of their
    size, however long. A product beyond the range of doubles is infinite; those under it are not found. An empty
    table gives an empty one; other columns are not read, whatever their names.

    The pivots, one for each ``shard_rows`` vectors but ``most_pivots`` at most, come from a sample of about
    ``sample_rows`` vectors, of 32 MB at most; every row is indexed, but of equal vectors only the k + 1 of the
    smallest ids, as no others can be among the nearest. A group that a task holds has about ``shard_rows``
    vectors and ``block_rows`` queries, whatever the input's size: a tree goes to as many blocks as the queries that visit it fill.
    """
    value = F.transform(column(vector_col), lambda x: x.cast("double"))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = column(id_col).isNotNull() & column(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(value, lambda x: x != 0)
    rows = vectors.where(usable).select(column(id_col).cast("long").alias("id"), value.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialize(rows.groupBy("id", "v").agg(F.max("q").alias("q")).withColumn("dim", F.size("v")), "vectors")
    n, cells = rows.agg(F.count(F.lit(1)), F.sum("dim")).first()
    repeats = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    taken, wanted = k * repeats, min(most_pivots, max(1, -(-n // shard_rows)))  # rows that surely hold k ids
    sample_rows = max(1, min(sample_rows, (_SAMPLE_BYTES // 8) * n // max(cells or 0, 1)))
    sample = rows.where(F.pmod(F.xxhash64("id", "v", F.lit(2)), F.lit(1 << 20)) < min(1 << 20, (sample_rows << 20) // max(n, 1) + 1)).select("dim", "v").toPandas()
    spark, pivots = vectors.sparkSession, Pivots({g: _spread(_unit(m), max(1, round(wanted * len(m) / len(sample)))) for g, _, m in _by_band(sample)})
    shared = spark.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            band, place, far = np.zeros(len(pdf), np.int32), np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for group, at, matrix in _by_band(pdf):
                band[at] = group[1]
                place[at], far[at] = shared.value.nearest(group, matrix)
            yield pdf.assign(band=band, place=place, far=far)

    dealt = materialize(rows.mapInPandas(deal, "id long, v array<double>, q boolean, dim int, band int, place int, far double"), "dealt")
    least = Window.partitionBy("dim", "v").orderBy("id")
    indexed = dealt.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1).drop("nth")
    indexed = materialize(indexed.select("id", "v", "dim", "band", "place", "far"), "indexed")
    # One row for each pivot: how many parts its vectors make, and their widest angle to it.
    places = indexed.groupBy("dim", "band", "place").agg(F.count(F.lit(1)).alias("m"), F.max("far").alias("radius")).toPandas()
    places["parts"] = -(-places["m"] // shard_rows)
    parts = F.broadcast(spark.createDataFrame([tuple(map(int, r)) for r in places[["dim", "band", "place", "parts"]].to_numpy()], "dim int, band int, place int, parts int"))
    radius = {(int(d), int(b)): np.array([p["radius"].get(j, -1.0) for j in range(len(pivots.rows.get((int(d), int(b)), [0])))]) for (d, b), p in ((g, t.set_index("place")) for g, t in places.groupby(["dim", "band"]))}
    keys = ["dim", "band", "place", "part"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = VPTree(pdf["id"].to_numpy(np.int64), np.array(pdf["v"].tolist(), float), k + 1)
        return pdf[keys].head(1).assign(tree=[pickle.dumps(tree, protocol=5)])

    split = indexed.join(parts, ["dim", "band", "place"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    trees = materialize(split.select("id", "v", *keys).groupBy(*keys).applyInPandas(build, "dim int, band int, place int, part int, tree binary"), "trees")

    def search(queries: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(tree):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        names, own = queries["id"].to_numpy(np.int64), np.array(queries["v"].tolist(), float)
        bound = queries["bound"].to_numpy(float)
        score, found = pickle.loads(tree["tree"].iloc[0]).search(names, own, taken, factor, bound)
        hit = ~np.isneginf(score) & (score >= bound[:, None])  # what can no longer be among the nearest stays here
        return pd.DataFrame({"query_id": np.repeat(names, hit.sum(axis=1)), "vec_id": found[hit], "score": score[hit]})

    def visit(asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of queries (id, v, bound, dim, band, place) in all parts of their place."""
        asked = asked.join(parts, ["dim", "band", "place"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        blocks = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        asked = asked.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
        copies = trees.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        every = [*keys, "block"]
        return asked.groupBy(*every).cogroup(copies.groupBy(*every)).applyInPandas(search, "query_id long, vec_id long, score double")

    def nearest(got: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        once = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The place with whose pivot a query's product is largest; of a size without pivots, that of its longest vectors."""
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            band, place = np.zeros(len(pdf), np.int32), np.zeros(len(pdf), np.int32)
            for dim, at, matrix in _by_size(pdf):
                unit, most = _unit(matrix), np.full(len(at), -np.inf)
                groups = sorted(g for g in radius if g[0] == dim)
                top = groups[-1][1]
                band[at] = top
                for group in groups:
                    if group in shared.value.rows:
                        product = np.where(radius[group] < 0, -np.inf, unit @ shared.value.rows[group].T) * np.exp2((group[1] - top) / 2)
                        better = product.max(axis=1) > most
                        most = np.maximum(most, product.max(axis=1))
                        band[at[better]], place[at[better]] = group[1], product.argmax(axis=1)[better]
            yield pdf.assign(band=band, place=place)

    asks = "id long, v array<double>, dim int, band int, place int"
    queries = materialize(dealt.where("q").select("id", "v", "dim").mapInPandas(aim, asks), "aimed")
    near = materialize(nearest(visit(queries.withColumn("bound", F.lit(float("-inf"))))).drop("rank"), "near")
    bounds = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf, others = pdf.reset_index(drop=True), [[] for _ in range(len(pdf))]
            bound = pdf["bound"].fillna(-np.inf).to_numpy(float)
            first = pdf[["band", "place"]].to_numpy()
            for dim, at, matrix in _by_size(pdf):
                length = _log_length(matrix)
                unit = _scaled(matrix, length)
                for group, size in radius.items():
                    if group[0] == dim:
                        reach = _reach(_relative(bound[at], length, group[1] / 2 + 1e-9), factor)
                        open_ = (shared.value.away(group, unit) - size <= reach[:, None]) & (size >= 0)
                        open_[np.flatnonzero(first[at, 0] == group[1]), first[at, 1][first[at, 0] == group[1]]] = False
                        for r, j in zip(*np.nonzero(open_), strict=True):
                            others[at[r]].append({"band": group[1], "place": int(j)})
            yield pdf.drop(columns=["band", "place"]).assign(places=others)

    bounded = queries.join(bounds, F.col("id") == F.col("query_id"), "left").drop("query_id")
    routed = bounded.mapInPandas(route, "id long, v array<double>, dim int, bound double, places array<struct<band:int,place:int>>")
    further = routed.select("id", "v", "dim", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), F.inline("places"))
    got = near.unionByName(visit(materialize(further, "further")))
    return nearest(got).select("query_id", "rank", "vec_id", "score")


def _spread(rows: np.ndarray, wanted: int) -> np.ndarray:
    """Up to ``wanted`` of the rows, each the furthest from those before among some that a fixed seed draws."""
    rng, chosen = np.random.default_rng(7), []
    near = np.full(len(rows), np.inf)
    for _ in range(min(wanted, len(rows))):
        tries = rng.choice(len(rows), min(16, len(rows)), replace=False)
        at = tries[int(np.argmax(near[tries]))]
        if chosen and near[at] == 0:
            continue
        chosen.append(rows[at])
        near = np.minimum(near, ((rows - rows[at]) ** 2).sum(axis=1))
    return np.array(chosen)
