"""Tail probabilities and quantiles that numpy lacks."""

from __future__ import annotations

import math
from statistics import NormalDist


def chi2_tail(x: float, k: float) -> float:
    """P(X > x) for chi-squared with k degrees, by the incomplete gamma's series or continued fraction."""
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


normal_quantile = NormalDist().inv_cdf
normal_cdf = NormalDist().cdf

# MacKinnon (1994, 2010) response surfaces of the Dickey-Fuller statistic, one variable.
ADF_CRITICAL = {"none": ((-2.56574, -2.2358, -3.627, 0.0), (-1.94100, -0.2686, -3.365, 31.223), (-1.61682, 0.2656, -2.714, 25.364)), "constant": ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)), "trend": ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380))}
ADF_P = {"none": (-1.04, -19.04, 0.74, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066)), "constant": (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)), "trend": (-2.89, -16.18, 0.70, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285))}


def adf_p(stat: float, kind: str) -> float:
    star, low, high, small, large = ADF_P[kind]
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    return normal_cdf(sum(c * stat**i for i, c in enumerate(small if stat <= star else large)))


def adf_critical(n: int, kind: str) -> dict[str, float]:
    return {level: sum(c / n**i for i, c in enumerate(row)) for level, row in zip(("1%", "5%", "10%"), ADF_CRITICAL[kind])}
