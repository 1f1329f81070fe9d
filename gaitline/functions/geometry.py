"""Column expressions: pose geometry, intervals, losses and rank keys.

All of them are built-in expressions, so they stay inside whole-stage code generation.
Missing is NULL throughout; a division by zero gives NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TIP_SUFFIXES = (
    "left_posterior", "left_lateral", "right_posterior", "right_lateral", "tip_separation", "midpoint_posterior",
    "midpoint_lateral", "mean_origin_tip_distance", "distance_asymmetry", "left_signed_angle", "right_signed_angle", "angle_asymmetry",
)
CIRCULAR_SUFFIXES = ("left_signed_angle", "right_signed_angle")


def hypotenuse(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance(p1: str, p2: str) -> Column:
    """Euclidean distance of two keypoints."""
    return hypotenuse(F.col(f"{p1}_x") - F.col(f"{p2}_x"), F.col(f"{p1}_y") - F.col(f"{p2}_y"))


def clip(value: Column, low: float, high: float) -> Column:
    """Value kept within bounds; NULL stays NULL (``least`` and ``greatest`` would skip it)."""
    return F.when(value > high, F.lit(high)).when(value < low, F.lit(low)).otherwise(value)


def angle(p1: str, p2: str, p3: str) -> Column:
    """Angle at the middle keypoint in degrees."""
    ax, ay = F.col(f"{p1}_x") - F.col(f"{p2}_x"), F.col(f"{p1}_y") - F.col(f"{p2}_y")
    bx, by = F.col(f"{p3}_x") - F.col(f"{p2}_x"), F.col(f"{p3}_y") - F.col(f"{p2}_y")
    cosine = (ax * bx + ay * by) / (hypotenuse(ax, ay) * hypotenuse(bx, by) + 1e-10)
    return F.degrees(F.acos(clip(cosine, -1.0, 1.0)))


def guarded(value: Column, scale: Column, epsilon: float = 1e-8) -> Column:
    """Value divided by a scale that is larger than epsilon, else NULL."""
    return F.when(F.abs(scale) > epsilon, value / scale)


def wrap_half_turns(delta: Column) -> Column:
    """An angle difference in units of pi, brought into (-1, 1]."""
    return F.atan2(F.sin(math.pi * delta), F.cos(math.pi * delta)) / math.pi


def overlap_length(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Frames that two closed intervals share."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1)


def focal_loss(truth: Column, prob: Column, alpha: Column | float = 0.7, gamma: Column | float = 2.0, epsilon: float = 1e-7) -> Column:
    """Binary focal loss of one prediction."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    alpha, gamma, p = as_column(alpha), as_column(gamma), clip(prob, epsilon, 1 - epsilon)
    hit = -alpha * F.pow(1 - p, gamma) * F.log(p)
    miss = -(1 - alpha) * F.pow(p, gamma) * F.log(1 - p)
    return F.when(truth == 1, hit).otherwise(miss)


def candidate_rank(f1: str = "f1", precision: str = "precision", recall: str = "recall", threshold: str = "threshold") -> Column:
    """Order key of threshold candidates: larger is better."""
    return F.struct(F.col(f1), F.least(precision, recall), F.col(precision), F.col(recall), -F.abs(F.col(threshold) - 0.5), -F.col(threshold))


def maximum_rolling_mean(values: Column, width: int) -> Column:
    """Largest mean of ``width`` neighbours in an array; NULL if it is shorter."""
    if width <= 0:
        raise ValueError("the rolling width must be positive")
    starts = F.sequence(F.lit(1), F.size(values) - width + 1)
    mean = lambda s: F.aggregate(F.slice(values, s, F.lit(width)), F.lit(0.0), lambda a, x: a + x.cast("double")) / width
    return F.when(F.size(values) >= width, F.array_max(F.transform(starts, mean)))


def stem_of_path(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)
