"""Per-row scoring expressions: links, losses, slices, stresses and guards. All are columns inside code generation."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(x), F.lit(low)), F.lit(high))


def sigmoid(z: Column | str) -> Column:
    """1 / (1 + exp(-z)), z clipped to 30 either way."""
    return 1 / (1 + F.exp(-clip(z, -30.0, 30.0)))


#: Fixed values of the polynomial for the normal tail (Abramowitz and Stegun 26.2.17; error under 7.5e-8).
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_STEP = 0.2316419


def normal_pdf(z: Column | str) -> Column:
    return F.exp(-_col(z) * _col(z) / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column | str) -> Column:
    """The standard normal distribution function, to 7.5e-8."""
    z = _col(z)
    t = 1 / (1 + TAIL_STEP * F.abs(z))
    upper = F.lit(0.0)
    for b in reversed(TAIL):
        upper = (upper + b) * t
    upper = upper * normal_pdf(z)
    return F.when(z >= 0, 1 - upper).when(z < 0, upper)


def normal_cdf_sql(z: str) -> str:
    t, tail = f"(1 / (1 + {TAIL_STEP!r}::DOUBLE * abs({z})))", "0e0"
    for b in reversed(TAIL):
        tail = f"(({tail}) + {b!r}::DOUBLE) * {t}"
    tail = f"({tail} * exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE)"
    return f"(CASE WHEN ({z}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


def log_loss(y: Column | str, p: Column | str, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(_col(y) * F.ln(q) + (1 - _col(y)) * F.ln(1 - q))


def log_score(y: Column | str, p: Column | str) -> Column:
    """Log loss clipped at 1e-12."""
    return log_loss(y, p, 1e-12)


def brier(y: Column | str, p: Column | str) -> Column:
    return (_col(y) - _col(p)) * (_col(y) - _col(p))


def absolute_error(y: Column | str, p: Column | str) -> Column:
    return F.abs(_col(y) - _col(p))


def entropy(rate: Column | str, eps: float = 1e-12) -> Column:
    q = clip(rate, eps, 1 - eps)
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def slice_predicate(text: str | None) -> Column:
    """A row filter written with names, comparisons and & | ~ ( ), or and / or / not; empty, all and none take every row."""
    if text is None or text.strip().lower() in ("", "all", "none"):
        return F.lit(True)
    quoted = re.split(r"('[^']*'|\"[^\"]*\")", text)
    for i in range(0, len(quoted), 2):
        part = re.sub(r"\band\b|&&?", " AND ", quoted[i])
        part = re.sub(r"\bor\b|\|\|?", " OR ", part)
        part = re.sub(r"\bnot\b|~", " NOT ", part)
        quoted[i] = part.replace("==", "=")
    # comparisons joined by & bind closer than SQL's AND only where the writer put parentheses
    return F.expr("".join(q.replace('"', "'") if i % 2 else q for i, q in enumerate(quoted)))


STRESS = re.compile(r"^\s*([A-Za-z_]\w*)\s*([+\-*])\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*$")


def stress(df: DataFrame, text: str | None) -> DataFrame:
    """One feature shifted or scaled, as in "income*0.9"; none leaves the rows as they are."""
    if text is None or text.strip().lower() in ("", "none"):
        return df
    found = STRESS.match(text)
    if not found or found[1] not in df.columns:
        raise ValueError(f"no stress of a known feature: {text!r}")
    name, op, value = found[1], found[2], float(found[3])
    x = F.col(name)
    return df.withColumn(name, x + value if op == "+" else x - value if op == "-" else x * value)


def monotone_violations(df: DataFrame, score, signs: Mapping[str, int], step: float = 0.25, tolerance: float = 1e-9) -> DataFrame:
    """feature, rate: how often raising a feature by `step` standard deviations moves score(columns) against its sign.

    score takes a mapping of feature columns; signs gives each constrained feature's direction. One pass after the deviations.
    """
    cols = {c: F.col(c) for c in df.columns}
    spread = df.agg(*[F.stddev_pop(c).alias(f"sd_{c}") for c in signs])
    rates = []
    wide = df.crossJoin(F.broadcast(spread))  # one row
    for c, sign in signs.items():
        moved = score({**cols, c: cols[c] + step * F.col(f"sd_{c}")}) - score(cols)
        rates.append(F.avg((sign * moved < -tolerance).cast("double")).alias(c))
    return wide.agg(*rates).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, signs)), F.array(*signs))).alias("feature", "rate"))


def check_losses(df: DataFrame, losses: Sequence[str], flags: Sequence[str] = (), ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row of violation counts: losses that are null, NaN, infinite or negative; null flags; values out of range."""
    kinds = dict(df.dtypes)
    for f in flags:
        if kinds[f] != "boolean":
            raise TypeError(f"{f} must be boolean, not {kinds[f]}")
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) < 0)).alias(f"bad_{c}") for c in losses]
    bad += [F.count_if(F.col(f).isNull()).alias(f"bad_{f}") for f in flags]
    bad += [F.count_if(F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi)).alias(f"range_{c}") for c, (lo, hi) in (ranges or {}).items()]
    return df.agg(F.count("*").alias("n"), *bad)


def checked(df: DataFrame, losses: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """df itself, if check_losses finds nothing; else ValueError."""
    row = check_losses(df, losses, flags).first().asDict()
    wrong = {k: v for k, v in row.items() if k.startswith("bad_") and v}
    if wrong:
        raise ValueError(f"invalid rows: {wrong}")
    return df
