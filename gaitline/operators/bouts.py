"""Labels, windows, scoring, bouts and their metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitline.functions import geometry as G
from gaitline.operators.lives import bout_lives, lives_at
from gaitline.operators.segments import segmented_bouts

# --- annotations -----------------------------------------------------------------------------------


def pair_events(events: DataFrame) -> DataFrame:
    """(stem, behavior, start, stop) of each STOP whose event before it is a START.

    A later START replaces an earlier one; a stray STOP is ignored. Rows of equal index
    are ordered by ``row_id`` if there is one, else STARTs come first.
    """
    tie = "row_id" if "row_id" in events.columns else "event_type"
    w = Window.partitionBy("stem", "behavior").orderBy("image_index", tie)
    known = events.where(F.col("event_type").isin("START", "STOP"))
    before = known.select("*", F.lag("event_type").over(w).alias("before"), F.lag("image_index").over(w).alias("start"))
    return before.where((F.col("event_type") == "STOP") & (F.col("before") == "START")).select("stem", "behavior", "start", F.col("image_index").alias("stop"))


def label_frames(frames: DataFrame, intervals: DataFrame, behaviors: list[str]) -> DataFrame:
    """Stem, frame and a 0/1 column for each behaviour, 1 on [start, stop); equi-join, no range join."""
    hit = intervals.where("stop > start and stop > 0").select("stem", "behavior", F.explode(F.sequence(F.greatest("start", F.lit(0)), F.col("stop") - 1)).alias("frame"))
    wide = hit.groupBy("stem", "frame").agg(*[F.max((F.col("behavior") == b).cast("int")).alias(b) for b in behaviors])
    return frames.select("stem", "frame").join(wide, ["stem", "frame"], "left").fillna(0, subset=behaviors)


def reconcile_labels(features: DataFrame, labels: DataFrame, behaviors: list[str]) -> DataFrame:
    """Features with the behaviours' labels; absent behaviours and frames give 0, others are dropped."""
    known = labels.select("stem", "frame", *[(F.coalesce(F.col(b), F.lit(0)) if b in labels.columns else F.lit(0)).cast("int").alias(b) for b in behaviors])
    return features.join(known, ["stem", "frame"], "left").fillna(0, subset=behaviors)


def row_mismatches(features: DataFrame, labels: DataFrame) -> DataFrame:
    """S5's guard: stems whose features and labels have different numbers of rows; stems without any labels are all negative and no mismatch."""
    count = lambda df, n: df.groupBy("stem").agg(F.count(F.lit(1)).alias(n))
    return count(features, "n_features").join(count(labels, "n_labels"), "stem").where("n_features <> n_labels")


def label_mismatches(features: DataFrame, labels: DataFrame) -> DataFrame:
    """J1's guard: frames that only one side has."""
    a, b = features.select("stem", "frame", F.lit(1).alias("f")), labels.select("stem", "frame", F.lit(1).alias("l"))
    return a.join(b, ["stem", "frame"], "full_outer").where("f is null or l is null").select("stem", "frame", F.when(F.col("f").isNull(), "features").otherwise("labels").alias("missing_in"))


def merge_behaviors(long: DataFrame, behaviors: list[str]) -> DataFrame:
    """Long (stem, frame, behavior, truth, prob, pred) to one row per frame, by one shuffle instead of chained outer joins."""
    pick = lambda b, c: F.max(F.when(F.col("behavior") == b, F.col(c)))
    return long.groupBy("stem", "frame").agg(*[pick(b, c).alias(f"{n}_{b}") for b in behaviors for c, n in (("truth", "true"), ("prob", "prob"), ("pred", "pred"))])


# --- windows ---------------------------------------------------------------------------------------


def window_count(n: Column, size: int, stride: int) -> Column:
    """A3: windows of a video of n frames."""
    return F.when(n < size, F.lit(0)).otherwise(1 + F.floor((n - size) / stride)).cast("long")


def window_rows(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """A2, exploded: each frame once for each window that holds it, with ``start`` and ``pos``."""
    n = F.count(F.lit(1)).over(Window.partitionBy("stem"))
    counted = frames.select("*", n.alias("__n")).where(F.col("__n") >= size)
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - size + 1) / stride))
    last = F.least(F.floor(F.col("frame") / stride), F.floor((F.col("__n") - size) / stride))
    return counted.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("__k")).withColumn("start", (F.col("__k") * stride).cast("int")).withColumn("pos", (F.col("frame") - F.col("start")).cast("int")).drop("__n", "__k")


def window_arrays(frames: DataFrame, columns: list[str], size: int, stride: int, label: str | None = None) -> DataFrame:
    """A2: (stem, start, x array of (pos, features), y): only for scorers that need whole windows."""
    fields = [F.col("pos"), F.array(*[F.col(c).cast("float") for c in columns]).alias("features"), *([F.col(label).cast("tinyint").alias("y")] if label else [])]
    rows = window_rows(frames, size, stride).groupBy("stem", "start").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("w"))
    pair = F.transform("w", lambda s: F.struct(s["pos"].alias("pos"), s["features"].alias("features")))
    return rows.select("stem", "start", pair.alias("x"), *([F.transform("w", lambda s: s["y"]).alias("y")] if label else []))


def window_norms(frames: DataFrame, columns: list[str], size: int, stride: int) -> DataFrame:
    """Per stem the least, largest and mean frame norm, and the windows that are zero throughout."""
    norm = F.sqrt(sum((F.coalesce(F.col(c), F.lit(0.0)) * F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)))
    rows = window_rows(frames.select("stem", "frame", norm.alias("norm")), size, stride).groupBy("stem", "start").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"), F.sum("norm").alias("total"), F.count(F.lit(1)).alias("n"))
    return rows.groupBy("stem").agg(F.min("lo").alias("min_norm"), F.max("hi").alias("max_norm"), (F.sum("total") / F.sum("n")).alias("mean_norm"), F.count_if(F.col("hi") == 0).alias("zero_windows"), F.count(F.lit(1)).alias("windows"))


# --- scoring ---------------------------------------------------------------------------------------


def score_windows(windows: DataFrame, scorer: Callable[[list], list], batch: int = 256) -> DataFrame:
    """(stem, start, probs) by a scorer of batches: list of (T, D) windows to list of T probabilities, checked.

    The scorer travels with the function to the Python workers and sees Arrow batches.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                x = [[s["features"] for s in w] for w in part["x"]]
                probs = [[float(p) for p in row] for row in scorer(x)]
                if [len(p) for p in probs] != [len(w) for w in x]:
                    raise ValueError("a scorer must give one probability for each frame of each window")
                yield pd.DataFrame({"stem": part["stem"], "start": part["start"], "probs": probs})

    return windows.select("stem", "start", "x").mapInPandas(run, "stem string, start int, probs array<double>")


def score_members(windows: DataFrame, scorers: dict[int, Callable[[list], list]], seen: DataFrame, batch: int = 256) -> DataFrame:
    """(member, stem, start, probs): every member of an ensemble scores the windows of the videos that it has not seen.

    Windows are recused before they are copied to Python; a task scores its rows of each member with that member's scorer.
    """
    members = windows.sparkSession.createDataFrame([(m,) for m in scorers], "member int")
    kept = recuse(windows.select("stem", "start", "x"), members, seen)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for member, own in pdf.groupby("member", sort=False):
                for a in range(0, len(own), batch):
                    part = own.iloc[a : a + batch]
                    x = [[s["features"] for s in w] for w in part["x"]]
                    probs = [[float(p) for p in row] for row in scorers[int(member)](x)]
                    if [len(p) for p in probs] != [len(w) for w in x]:
                        raise ValueError("a scorer must give one probability for each frame of each window")
                    yield pd.DataFrame({"member": part["member"], "stem": part["stem"], "start": part["start"], "probs": probs})

    return kept.select("member", "stem", "start", "x").mapInPandas(run, "member int, stem string, start int, probs array<double>")


def scored_frames(scored: DataFrame) -> DataFrame:
    """Window rows (…, frame, prob) of scored windows, ready to be reconstructed."""
    rest = [c for c in scored.columns if c != "probs"]
    return scored.select(*rest, F.posexplode("probs").alias("pos", "prob")).withColumn("frame", F.col("start") + F.col("pos"))


def restored_windows(windows: DataFrame, recorded: DataFrame, size: int, width: int) -> DataFrame:
    """For each stem, the windows recorded and those made again that have the right shape; ``valid`` where they are as many."""
    whole = windows.where((F.size("x") == size) & F.forall("x", lambda s: F.size(s["features"]) == width)).groupBy("stem").agg(F.count(F.lit(1)).alias("restored"))
    return recorded.join(whole, "stem", "left").fillna(0, subset=["restored"]).withColumn("valid", F.col("recorded") == F.col("restored"))


def fit_baseline(frames: DataFrame, value: str = "prob", truth: str = "truth", reach: int = 2, alpha: float = 0.7, fitted: Column | None = None):
    """A logistic model of a frame's value and its neighbours', with weight ``alpha`` on positives; ``fitted`` marks the rows to fit on.

    Returns a function from frames to (stem, frame, truth, prob).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    w = Window.partitionBy("stem").orderBy("frame")
    near = [F.coalesce(F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w), F.col(value)).alias(f"c{k + reach}") for k in range(-reach, reach + 1)]
    assembler = VectorAssembler(inputCols=[f"c{k}" for k in range(2 * reach + 1)], outputCol="features")

    def ready(df: DataFrame) -> DataFrame:
        rows = df.select("stem", "frame", F.col(truth).alias("truth"), *near, (F.lit(True) if fitted is None else fitted).alias("fitted"))
        return assembler.transform(rows.withColumn("weight", F.when(F.col("truth") == 1, alpha).otherwise(1 - alpha)))

    model = LogisticRegression(labelCol="truth", weightCol="weight", maxIter=20).fit(ready(frames).where("fitted"))
    return lambda df: model.transform(ready(df)).select("stem", "frame", "truth", vector_to_array("probability")[1].alias("prob"))


def recuse(windows: DataFrame, members: DataFrame, seen: DataFrame) -> DataFrame:
    """Windows times members, without the stems that a member has seen; before any scoring.

    ``members`` is one row per model of an ensemble.
    """
    return windows.crossJoin(F.broadcast(members)).join(seen.select("member", "stem"), ["member", "stem"], "left_anti")


def mean_in_order(values: Column) -> Column:
    """Mean of the ``v`` of an array of structs, added one after the other, so that a mean near a threshold has the same last bit in every run; NULL if empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda total, x: total + x["v"]), F.size(values))


def reconstruct(scored: DataFrame, threshold: float, prob: str = "prob", truth: str | None = "truth", keys: tuple[str, ...] = ("stem", "frame")) -> DataFrame:
    """A4, A5, P10: frames from rows of overlapping windows and members: one sum over one count, largest truth, threshold on the double.

    Values are added by ``member``, and the latest ``start`` of a member first, as far as the rows have these columns.
    """
    places = [p for c, p in (("member", F.col("member")), ("start", -F.col("start"))) if c in scored.columns]
    value = F.struct(*[p.alias(f"at{i}") for i, p in enumerate(places)], F.col(prob).cast("double").alias("v"))
    mean = mean_in_order(F.sort_array(F.collect_list(F.when(F.col(prob).isNotNull(), value))))
    out = scored.groupBy(*keys).agg(mean.alias("prob"), *([F.max(truth).cast("int").alias("truth")] if truth else [])).where(F.col("prob").isNotNull())
    return out.withColumn("pred", (F.col("prob") >= threshold).cast("int"))


def coverage(windows: DataFrame, frames: DataFrame, size: int) -> DataFrame:
    """Totals over the universe of max(start) + size frames of each stem, and what was scored."""
    total = windows.groupBy("stem").agg((F.max("start") + size).alias("n"))
    scored = frames.groupBy("stem").agg(F.count(F.lit(1)).alias("scored"))
    both = total.join(scored, "stem", "left").fillna(0, subset=["scored"])
    out = both.agg(F.sum("n").cast("long").alias("n_total_frames"), F.sum("scored").cast("long").alias("n_scored_frames"), F.count(F.lit(1)).alias("n_total_videos"), F.count_if(F.col("scored") > 0).alias("n_scored_videos"))
    return out.select("*", F.coalesce(F.try_divide("n_scored_frames", "n_total_frames"), F.lit(0.0)).alias("frame_coverage"), (F.col("n_total_videos") - F.col("n_scored_videos")).alias("n_fully_recused_videos"))


# --- bouts -----------------------------------------------------------------------------------------


def bouts(frames: DataFrame, positive: Column, min_length: int = 16, max_gap: int = 3, keys: tuple[str, ...] = ("stem",), order: str = "frame") -> DataFrame:
    """Islands of positive rows with gaps of at most ``max_gap``, of at least ``min_length`` positives.

    Rows run by position in the table, so dropped frames close up. An island whose gap to
    the end is allowed ends at the last row. Gives keys, start_pos, end_pos, start_frame, end_frame, n_positive.
    """
    return segmented_bouts(frames, positive, min_length, max_gap, keys, order).drop("n_frames", "valued", "total", "most")


def bouts_at(frames: DataFrame, thresholds: DataFrame, min_length: int = 16, max_gap: int = 3, keys: tuple[str, ...] = ("stem",), order: str = "frame", prob: str = "prob") -> DataFrame:
    """The bouts at every threshold of a grid: keys, threshold and what ``bouts`` gives; no frame is copied.

    The grid, a setting of a user, is read first; its bouts are looked up among the lives of bouts.
    """
    grid = [r.threshold for r in thresholds.select("threshold").distinct().collect()]
    return lives_at(bout_lives(frames, min(grid), min_length, max_gap, keys, order, prob), grid)


def bout_table(frames: DataFrame, positive: Column, min_length: int = 16, max_gap: int = 3, keys: tuple[str, ...] = ("stem",)) -> DataFrame:
    """A10: bouts with number of frames, mean and largest probability, frames in gaps included: one pass finds bouts and sums."""
    found = segmented_bouts(frames, positive, min_length, max_gap, keys, "frame", F.col("prob"))
    return found.select(*keys, "start_frame", "end_frame", "n_frames", F.try_divide("total", "valued").alias("mean_probability"), F.col("most").alias("max_probability"))


# --- metrics ---------------------------------------------------------------------------------------


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def with_rates(df: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn; 0 where undefined."""
    out = df.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return out.withColumn("f1", ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def binary_metrics(frames: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Counts, precision, recall, f1 and accuracy of 0/1 columns."""
    t, p = F.col(truth), F.col(pred)
    cells = [F.count_if((t == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]
    counts = frames.groupBy(*by).agg(*cells) if by else frames.agg(*cells)
    return with_accuracy(counts)


def with_accuracy(counts: DataFrame) -> DataFrame:
    return with_rates(counts).withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.greatest(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), F.lit(1)))


def eligible_pairs(pred: DataFrame, truth: DataFrame, overlap: float = 0.2, keys: tuple[str, ...] = ("stem",), bin_frames: int = 4096, pred_keys: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs (pred_start, pred_end, true_start, true_end, overlap) that share at least ``overlap`` of the prediction.

    Both sides are cut into bins of frames, so the join stays an equi-join; a pair counts
    in the first bin that both touch. Predictions may have more keys than they share with truths.
    """
    cut = lambda df, n: df.select(*(pred_keys or keys if n == "pred" else keys), F.col("start_frame").alias(f"{n}_start"), F.col("end_frame").alias(f"{n}_end"), F.explode(F.sequence(F.floor(F.col("start_frame") / bin_frames), F.floor(F.col("end_frame") / bin_frames))).alias("bin"))
    both = cut(pred, "pred").join(cut(truth, "true"), [*keys, "bin"]).where(F.col("bin") == F.floor(F.greatest("pred_start", "true_start") / bin_frames))
    shared = G.overlap_length(F.col("pred_start"), F.col("pred_end"), F.col("true_start"), F.col("true_end"))
    return both.withColumn("overlap", shared).where((F.col("overlap") > 0) & (F.col("overlap") >= overlap * (F.col("pred_end") - F.col("pred_start") + 1))).drop("bin")


def largest_matching(edges: list[tuple[int, int, int]]) -> dict[int, int]:
    """A largest one-to-one choice from (left, right, strength): right by left.

    Lefts with few choices go first, strong partners are tried first; each left then looks
    for an augmenting path, by an explicit stack.
    """
    choices: dict[int, list[int]] = {}
    for left, right, _ in sorted(edges, key=lambda e: (e[0], -e[2], e[1])):
        choices.setdefault(left, []).append(right)
    owner: dict[int, int] = {}
    for root in sorted(choices, key=lambda k: (len(choices[k]), k)):
        visited: set[int] = set()
        trail = [(root, iter(choices[root]), None)]
        while trail:
            left, options, _ = trail[-1]
            right = next((r for r in options if r not in visited), None)
            if right is None:
                trail.pop()
                continue
            visited.add(right)
            trail[-1] = (left, options, right)
            if right not in owner:
                for taker, _, taken in trail:
                    owner[taken] = taker
                break
            trail.append((owner[right], iter(choices[owner[right]]), None))
    return {left: right for right, left in owner.items()}


def _chains(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, ``__piece`` and ``edges`` (pred_start, true_start, pred_end, true_end, overlap in this order): pairs that share bouts, one chain of overlapping bouts a row."""
    begin = F.least("pred_start", "true_start")
    earlier = Window.partitionBy(*keys).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys).orderBy("begin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pairs.select(*keys, "pred_start", "true_start", "pred_end", "true_end", "overlap", begin.alias("begin"))
    apart = rows.withColumn("apart", F.coalesce(F.col("begin") > F.max(F.greatest("pred_end", "true_end")).over(earlier), F.lit(False)).cast("long"))
    edge = F.struct("pred_start", "true_start", "pred_end", "true_end", "overlap")
    return apart.withColumn("__piece", F.sum("apart").over(so_far)).groupBy(*keys, "__piece").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def match_bouts(pairs: DataFrame, keys: tuple[str, ...] = ("stem",)) -> DataFrame:
    """A largest one-to-one matching of eligible pairs, in each group of ``keys``.

    Pairs without a rival on either side match by themselves in the JVM; the chains of
    contested ones reach Python as rows, many in an Arrow batch.
    """
    p, t = Window.partitionBy(*keys, "pred_start"), Window.partitionBy(*keys, "true_start")
    counted = pairs.select("*", F.count(F.lit(1)).over(p).alias("np"), F.count(F.lit(1)).over(t).alias("nt"))
    kept = ["pred_start", "pred_end", "true_start", "true_end"]
    alone = counted.where("np = 1 and nt = 1").select(*keys, *kept)
    chains = _chains(counted.where("np > 1 or nt > 1"), keys).withColumn("chosen", F.array().cast("array<long>"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            chosen = []
            for edges in pdf["edges"]:
                got = largest_matching([(e["pred_start"], e["true_start"], e["overlap"]) for e in edges])
                chosen.append([k for k, e in enumerate(edges) if got.get(e["pred_start"]) == e["true_start"]])
            yield pdf.assign(chosen=chosen)

    solved = chains.mapInPandas(solve, chains.schema).select(*keys, F.explode(F.transform("chosen", lambda k: F.get("edges", k.cast("int")))).alias("e"))
    return alone.unionByName(solved.select(*keys, *[F.col(f"e.{c}").alias(c) for c in kept]))


def matched_count(pairs: DataFrame, keys: tuple[str, ...] = ("stem",), by: tuple[str, ...] = ()) -> DataFrame:
    """``by`` and ``m``: the size of a largest matching, without choosing one.

    Bouts of either side are disjoint and in order, so that a chain's pairs, by their starts, meet
    a bout's pairs one after the other: taking each pair whose bouts are both free, from the left, is largest. A fold of built-in functions.
    """
    empty = F.struct(F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("t"), F.lit(0).cast("long").alias("m"))

    def step(acc, e):
        taken = acc["p"].eqNullSafe(e["pred_start"].cast("long")) | acc["t"].eqNullSafe(e["true_start"].cast("long"))
        return F.when(taken, acc).otherwise(F.struct(e["pred_start"].cast("long").alias("p"), e["true_start"].cast("long").alias("t"), (acc["m"] + 1).alias("m")))

    sizes = _chains(pairs, keys).select(*by, F.aggregate("edges", empty, step, lambda acc: acc["m"]).alias("m"))
    return sizes.groupBy(*by).agg(F.sum("m").alias("m")) if by else sizes.agg(F.sum("m").alias("m"))


def bout_errors(pred: DataFrame, truth: DataFrame, matches: DataFrame, keys: tuple[str, ...] = ("stem",)) -> DataFrame:
    """Unmatched predictions and truths."""
    a = pred.join(matches.select(*keys, F.col("pred_start").alias("start_frame")), [*keys, "start_frame"], "left_anti").select(*keys, "start_frame", "end_frame", F.lit("false_positive").alias("error_type"))
    b = truth.join(matches.select(*keys, F.col("true_start").alias("start_frame")), [*keys, "start_frame"], "left_anti").select(*keys, "start_frame", "end_frame", F.lit("false_negative").alias("error_type"))
    return a.unionByName(b)


def episode_metrics(pred: DataFrame, truth: DataFrame, overlap: float = 0.2, keys: tuple[str, ...] = ("stem",), by: tuple[str, ...] = ()) -> DataFrame:
    """True and false episodes over all stems of each ``by`` group.

    Truth without the columns of ``by`` holds for each of its groups.
    """
    shared = tuple(k for k in keys if k in truth.columns)
    matches = matched_count(eligible_pairs(pred, truth, overlap, shared, pred_keys=keys), keys, by)
    named = [c for c in by if c in truth.columns]
    part = lambda df, n, cols: df.select(*cols, *[F.lit(int(n == m)).cast("long").alias(m) for m in ("p", "t")])
    found = matches.select(*by, F.coalesce("m", F.lit(0)).alias("m"), F.lit(0).cast("long").alias("p"))
    if len(named) == len(by):
        true_rows = part(truth, "t", by)
    else:  # one count of truths for every group
        groups = pred.select(*by).distinct()
        true_rows = F.broadcast(part(truth, "t", named).groupBy(*named).agg(F.sum("p").alias("p"), F.sum("t").alias("t")))
        true_rows = (groups.join(true_rows, named) if named else groups.crossJoin(true_rows)).select(*by, "p", "t")
    rows = found.withColumn("t", F.lit(0).cast("long")).unionByName(part(pred, "p", by).withColumn("m", F.lit(0).cast("long"))).unionByName(true_rows.withColumn("m", F.lit(0).cast("long")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = [total("m").alias("tp"), (total("p") - total("m")).alias("fp"), (total("t") - total("m")).alias("fn")]
    return with_rates(rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)).select("*", (F.col("tp") + F.col("fp")).alias("n_predicted_episodes"), (F.col("tp") + F.col("fn")).alias("n_true_episodes"))


def macro_average(rows: DataFrame, level: str = "level") -> DataFrame:
    """Plain means over behaviours."""
    return rows.groupBy(level).agg(*[F.avg(m).alias(f"macro_{m}") for m in ("f1", "precision", "recall")])
