"""Hypergeometric tails, false discovery rates and collocation scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms summed beyond the first: so many standard deviations and some. What is left out is below 1e-16 of the sum.
SPREADS, SPARE = 10, 60


def ln_factorial(n: Column) -> Column:
    """ln n! for n >= 0, by Stirling's series after a shift of 8."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    shift = n.cast("double") + 1
    for i in range(2, 9):
        shift = shift * (n.cast("double") + i)
    return series - F.log(shift)


def _choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def hypergeometric_tail(k: Column, n_study: Column, k_bg: Column, n_bg: Column) -> Column:
    """P(X >= k) for the hits among n_study draws from n_bg entities of which k_bg are marked.

    The tail beyond the mean is summed from its first term by the ratio of neighbours; before the mean it
    is 1 less the lower tail, so that neither a vanishing first term nor cancellation spoils it.
    """
    k, n, m, total = (c.cast("double") for c in (k, n_study, k_bg, n_bg))
    mean = n * m / total
    spread = F.sqrt(F.greatest(mean * (1 - m / total), F.lit(0.0)))
    reach = F.ceil(spread * SPREADS) + SPARE
    least, most = F.greatest(F.lit(0.0), n + m - total), F.least(n, m)
    term = lambda x: F.exp(_choose(m, x) + _choose(total - m, n - x) - _choose(total, n))

    def summed(first: Column, steps: Column, ratio) -> Column:
        start = F.struct(first.alias("t"), first.alias("s"), F.lit(0.0).alias("i"))

        def step(acc: Column, _: Column) -> Column:
            t = acc["t"] * ratio(acc["i"])
            return F.struct(t.alias("t"), (acc["s"] + t).alias("s"), (acc["i"] + 1).alias("i"))

        walk = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(walk, start, step)["s"]

    up = summed(term(k), F.least(most - k, reach), lambda i: (m - k - i) * (n - k - i) / ((k + i + 1) * (total - m - n + k + i + 1)))
    low = k - 1
    down = summed(term(low), F.least(low - least, reach), lambda i: (low - i) * (total - m - n + low - i) / ((m - low + i + 1) * (n - low + i + 1)))
    return F.when(k <= least, F.lit(1.0)).when(k <= mean, F.greatest(F.lit(0.0), 1 - down)).otherwise(F.least(F.lit(1.0), up))


def npmi(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information of a pair; null where the pair is in all n."""
    p_ab, p_a, p_b = (c.cast("double") / n for c in (both, a, b))
    return F.when(both < n, F.log(p_ab / (p_a * p_b)) / -F.log(p_ab))
