"""Scaling and weighting expressions: columns in, columns out; null stays null unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Between the bounds; unlike ``least`` and ``greatest`` alone, null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def bounded_in(name: str, of: str, inverse: bool = False) -> Column:
    """``bounded`` (or ``inverse_bounded``) of the column ``name`` in the range ``of``, a struct of lo and hi, parsed at once instead
    of being put together call by call."""
    x, low, high = f"CAST({name} AS DOUBLE)", f"{of}.lo", f"{of}.hi"
    top = f"CASE WHEN {high} > {low} THEN {high} ELSE {low} + 1.0D END"
    share = f"(({top}) - {x}) / (({top}) - {low})" if inverse else f"({x} - {low}) / (({top}) - {low})"
    return F.expr(f"CASE WHEN ({share}) IS NOT NULL THEN greatest(0.0D, least(1.0D, {share})) END")


def bounded(x: Column, low: Column, high: Column) -> Column:
    """Where x stands between low (0) and high (1); a range without width counts as one wide."""
    x = x.cast("double")
    return clip((x - low) / (F.when(high > low, high).otherwise(low + 1.0) - low))


def inverse_bounded(x: Column, low: Column, high: Column) -> Column:
    """Where x stands between high (0) and low (1)."""
    x = x.cast("double")
    top = F.when(high > low, high).otherwise(low + 1.0)
    return clip((top - x) / (top - low))


def log_penalty(x: Column, start: float, most: Column) -> Column:
    """0 up to ``start``, then growing as a logarithm to 1 at ``most``."""
    x = x.cast("double")
    over = F.when(x.isNotNull(), F.greatest(x - float(start), F.lit(0.0)))
    return clip(F.log1p(over) / F.log1p(F.greatest(most - float(start), F.lit(1.0))))


def weighted(parts: Sequence[tuple[float, Column]]) -> Column:
    total = parts[0][1] * parts[0][0]
    for weight, part in parts[1:]:
        total = total + part * weight
    return total


def dominant_floor(base: Column, components: Sequence[Column], policy: dict, scope: str) -> Column:
    """The base score, raised to the strongest component once that reaches the policy's threshold."""
    if not policy["enabled"] or policy["mode"] != "floor" or not policy["scope"].get(scope, False) or not components:
        return base
    filled = [F.coalesce(c, F.lit(0.0)) for c in components]
    top = F.greatest(*filled) if len(filled) > 1 else filled[0]
    return F.when(top >= policy["threshold"], F.greatest(base, top)).otherwise(base)


def confidence(score: Column, least: float, power: float) -> Column:
    """How far a score is from 0.5, as a weight between ``least`` and 1."""
    return clip(least + (1.0 - least) * F.pow(F.abs(score - 0.5) / 0.5, F.lit(float(power))), least, 1.0)


def is_neutral(score: Column, policy: dict) -> Column:
    return F.abs(score - policy["neutral_score"]) <= policy["epsilon"]


def shares(a: Column, b: Column) -> tuple[Column, Column]:
    """Two weights summing to 1 in proportion (halves if both are zero), in single precision."""
    share = lambda w: F.when(a + b > 0, w / F.when(a + b > 0, a + b)).otherwise(0.5).cast("float")
    return share(a), share(b)


def neutral_override(left: Column, right: Column, w_left: Column, w_right: Column, policy: dict) -> tuple[Column, Column]:
    """Both weights with that of a neutral score dropped, as shares."""
    return shares(F.when(is_neutral(left, policy), 0.0).otherwise(w_left), F.when(is_neutral(right, policy), 0.0).otherwise(w_right))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -60.0, 60.0)))


def sigmoid_gate(left: Column, right: Column, steepness: float) -> tuple[Column, Column]:
    """Weights of left and right by the logistic curve of their difference."""
    w = sigmoid((right - left) * float(steepness))
    return 1.0 - w, w
