"""Tails of the t, F and hypergeometric laws as column expressions: folds over a bounded number of steps, no Python workers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAN, _INF = math.nan, math.inf
_SHIFT = 10


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _correction(x: Column) -> Column:
    """What Stirling's formula lacks of the log of the gamma function, for x of 10 or more."""
    return _let(1 / (x * x), lambda s: (((s / 1188 - 1 / 1680) * s + 1 / 1260) * s - 1 / 360) * s + 1 / 12) / x


def log_beta(a: Column, b: Column) -> Column:
    """Log of the beta function of positive arguments, from ratios, so that large ones lose no digits."""

    def shifted(s: Column) -> Column:
        a, b = s["a"], s["b"]
        far_a, far_b = a + _SHIFT, b + _SHIFT
        near = sum((F.log1p(a / (b + i)) + F.log1p(far_b / (a + i)) for i in range(1, _SHIFT)), F.log1p(a / b) + F.log1p(far_b / a))
        stirling = (0.5 - far_a) * F.log1p(far_b / far_a) - far_b * F.log1p(far_a / far_b) - F.ln(far_b) / 2 + 0.5 * math.log(2 * math.pi)
        return near + stirling + _correction(far_a) + _correction(far_b) - _correction(far_a + far_b)

    return _let(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")), shifted)


def log_incomplete_beta(a: Column, b: Column, x: Column, y: Column) -> Column:
    """log I_x(a, b), the regularised incomplete beta function; y is 1 - x, given apart for its digits near 0.

    The continued fraction is taken from its end, on the side where it converges, in about sqrt(max(a, b)) steps.
    """

    def fraction(s: Column) -> Column:
        p, q, z = s["p"], s["q"], s["z"]
        steps = F.ceil(F.sqrt(F.greatest(p, q)) * 6).cast("int") + 60

        def inner(g: Column, j: Column) -> Column:
            m = F.floor(j / 2)
            top = F.when(j % 2 == 0, m * (q - m)).otherwise(-(p + m) * (p + q + m))
            return 1 + top * z / ((p + j - 1) * (p + j)) / F.when(g == 0, 1e-300).otherwise(g)

        return F.aggregate(F.sequence(steps, F.lit(1), F.lit(-1)), F.lit(1.0), inner)

    def tail(s: Column) -> Column:
        z, w = s["z"], s["w"]
        logs = s["p"] * F.when(z < 0.5, F.ln(z)).otherwise(F.log1p(-w)) + s["q"] * F.when(w < 0.5, F.ln(w)).otherwise(F.log1p(-z))
        own = logs - log_beta(s["p"], s["q"]) - F.ln(s["p"]) - F.ln(fraction(s))
        return _let(own, lambda v: F.when(~s["swapped"], v).when(v < 0, F.ln(-F.expm1(v))).otherwise(-_INF))

    def sides(s: Column) -> Column:
        other = s["x"] >= (s["a"] + 1) / (s["a"] + s["b"] + 2)
        turned = lambda u, v, name: F.when(other, s[u]).otherwise(s[v]).alias(name)
        inside = _let(F.struct(turned("b", "a", "p"), turned("a", "b", "q"), turned("y", "x", "z"), turned("x", "y", "w"), other.alias("swapped")), tail)
        known = s["a"].isNotNull() & s["b"].isNotNull() & s["x"].isNotNull() & s["y"].isNotNull()
        return F.when(~known, None).when(F.isnan(s["x"]) | F.isnan(s["a"]) | F.isnan(s["b"]), _NAN).when(s["x"] <= 0, -_INF).when(s["y"] <= 0, F.lit(0.0)).otherwise(inside)

    return _let(F.struct(*[c.cast("double").alias(n) for c, n in ((a, "a"), (b, "b"), (x, "x"), (y, "y"))]), sides)


def f_log_tail(f: Column, d1: Column, d2: Column) -> Column:
    """log P(F > f): 0 where f is 0 or less, or no number."""
    own = log_incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))
    return F.when(F.isnan(f) | (f <= 0), F.lit(0.0)).when(f == _INF, -_INF).otherwise(own)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|); no number where t is none or there are no degrees of freedom."""
    square = t * t
    own = F.exp(log_incomplete_beta(df / 2, F.lit(0.5), df / (df + square), square / (df + square)))
    return F.when(F.isnan(t) | (df <= 0), _NAN).when(F.abs(t) == _INF, F.lit(0.0)).otherwise(own)


def _log_choose(n: Column, k: Column) -> Column:
    return -F.log1p(n) - log_beta(n - k + 1, k + 1)


def log_hypergeometric(k: Column, row: Column, col: Column, n: Column) -> Column:
    """Log of the chance of k in the corner of a 2x2 table with these margins."""
    return _log_choose(row, k) + _log_choose(n - row, col - k) - _log_choose(n, col)


def _spread(row: Column, col: Column, n: Column) -> Column:
    """Standard deviation of the corner of a 2x2 table."""
    return F.sqrt(row * col / n * (n - row) / n * (n - col) / F.greatest(n - 1, F.lit(1.0)))


def fisher_exact_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Struct (odds_ratio, p_value) of the 2x2 table [[a, b], [c, d]]: the sample ratio and the chance of as much in a or more.

    Counts are integers of 0 or more. The tail is summed away from the mean, where each term is less than the one before,
    over 12 standard deviations and 100 steps: what lies beyond weighs less than the last digit.
    """

    def summed(start: Column, steps: Column, s: Column, sign: int) -> Column:
        row, col, rest = s["row"], s["col"], s["n"] - s["row"] - s["col"]

        def add(acc: Column, i: Column) -> Column:
            k = start + sign * i
            ratio = (row - k) * (col - k) / ((k + 1) * (rest + k + 1)) if sign > 0 else k * (rest + k) / ((row - k + 1) * (col - k + 1))
            return F.struct((acc["term"] * ratio).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

        total = F.aggregate(F.sequence(F.lit(0), steps.cast("int")), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), add, lambda acc: acc["sum"])
        return F.exp(log_hypergeometric(start, row, col, s["n"])) * total

    def chance(s: Column) -> Column:
        a, row, col, n = s["a"], s["row"], s["col"], s["n"]
        reach = F.ceil(12 * _spread(row, col, n)) + 100
        least, most = F.greatest(F.lit(0.0), row + col - n), F.least(row, col)
        above = summed(a, F.least(most - a, reach), s, 1)
        below = _let(a - 1, lambda start: summed(start, F.least(start - least, reach), s, -1))
        return F.when(n.isNull(), None).when(a <= least, F.lit(1.0)).when(a > row * col / n, F.least(F.lit(1.0), above)).otherwise(F.greatest(F.lit(0.0), 1 - below))

    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    margins = F.struct(a.alias("a"), (a + b).alias("row"), (a + c).alias("col"), (a + b + c + d).alias("n"))
    odds = F.when((a * d == 0) & (b * c == 0), _NAN).when(b * c == 0, _INF).otherwise(F.try_divide(a * d, b * c))
    return F.struct(odds.alias("odds_ratio"), _let(margins, chance).alias("p_value"))


def expected_cell_information(row: Column, col: Column, n: Column) -> Column:
    """Expected share in the mutual information of a cell with these margins, its count being hypergeometric.

    Summed within 12 standard deviations (and 12 steps) of the mean; the rest weighs less than 1e-30.
    """

    def summed(s: Column) -> Column:
        row, col, n, low = s["row"], s["col"], s["n"], s["low"]

        def add(acc: Column, i: Column) -> Column:
            k = low + i
            share = k / n * F.ln(n * k / (row * col)) * F.exp(acc["log_p"])
            # The last count has no next one: its ratio is 0, and the null log is not read.
            ratio = (row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1))
            return F.struct((acc["log_p"] + F.ln(ratio)).alias("log_p"), (acc["sum"] + share).alias("sum"))

        start = F.struct(log_hypergeometric(low, row, col, n).alias("log_p"), F.lit(0.0).alias("sum"))
        return F.aggregate(F.sequence(F.lit(0), (s["high"] - low).cast("int")), start, add, lambda acc: acc["sum"])

    def bounded(s: Column) -> Column:
        row, col, n = s["row"], s["col"], s["n"]
        mean, reach = row * col / n, 12 * _spread(row, col, n) + 12
        low = F.greatest(F.lit(1.0), row + col - n, F.floor(mean - reach).cast("double"))
        high = F.least(row, col, F.floor(mean + reach).cast("double") + 1)
        return _let(F.struct(row.alias("row"), col.alias("col"), n.alias("n"), low.alias("low"), high.alias("high")), summed)

    return _let(F.struct(*[c.cast("double").alias(k) for c, k in ((row, "row"), (col, "col"), (n, "n"))]), bounded)
