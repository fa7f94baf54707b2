"""Evaluation metrics as column expressions over confusion counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def confusion(pred: Column, truth: Column, null_as_negative: bool = False) -> list[Column]:
    """tp, fp, tn, fn aggregates.  A null prediction is in no cell unless it counts as negative."""
    if null_as_negative:
        pred = F.coalesce(pred, F.lit(0))
    cells = {"tp": (1, 1), "fp": (1, 0), "tn": (0, 0), "fn": (0, 1)}
    return [F.count_if((pred == p) & (truth == t)).alias(k) for k, (p, t) in cells.items()]


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(empty).cast("double"))


def binary_metrics(empty: float | None = 0.0, digits: int = 6) -> dict[str, Column]:
    """accuracy ... mcc from columns tp, fp, tn, fn; 0/0 gives `empty`."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall, spec = ratio(tp, tp + fp, empty), ratio(tp, tp + fn, empty), ratio(tn, tn + fp, empty)
    out = {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn, empty), "precision": precision, "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn, empty), "balanced_accuracy": (recall + spec) / 2,
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), empty),
    }
    return {k: F.round(v, digits) for k, v in out.items()}


def wilson(k: Column, n: Column) -> dict[str, Column]:
    """Point and 95 % limits of a share; nulls for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p, z2 = k / n, Z95 * Z95
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    some = n > 0
    return {"point": F.when(some, p), "low": F.when(some, F.greatest(F.lit(0.0), mid - half)), "high": F.when(some, F.least(F.lit(1.0), mid + half))}


def kappa(agree: Column, chance: Column) -> Column:
    return F.when(chance != 1, (agree - chance) / (1 - chance)).otherwise(1.0)
