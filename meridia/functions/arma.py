"""ARMA and SARIMA by an exact state-space likelihood: system, filter, fit and forecast, in numpy."""

from __future__ import annotations

import math

import numpy as np

MODEL_SCHEMA = (
    "order array<int>, seasonal_order array<int>, include_mean boolean, names array<string>, coefs array<double>, "
    "loglik double, aic double, aicc double, bic double, nobs int, status string, message string, model_id string"
)
FIELDS = [f.split()[0] for f in MODEL_SCHEMA.split(", ")]
DIFFUSE = 1e6


def check(order, seasonal) -> None:
    if len(order) != 3 or len(seasonal) != 4 or any(int(v) != v or v < 0 for v in (*order, *seasonal)):
        raise ValueError("order has three and seasonal_order four non-negative integers")
    if any(seasonal[:3]) and seasonal[3] < 2:
        raise ValueError("a seasonal part needs a period of 2 or more")


def labels(order, seasonal, mean: bool) -> list[str]:
    s = seasonal[3]
    out = ["mean"] if mean else []
    out += [f"ar_L{i}" for i in range(1, order[0] + 1)] + [f"ma_L{i}" for i in range(1, order[2] + 1)]
    out += [f"s_ar_L{i * s}" for i in range(1, seasonal[0] + 1)] + [f"s_ma_L{i * s}" for i in range(1, seasonal[2] + 1)]
    return out + ["sigma2_η"]


def _polynomial(short: np.ndarray, long: np.ndarray, s: int, sign: float) -> np.ndarray:
    """Coefficients after the leading 1 of (1 + sign·short(L))(1 + sign·long(L^s)), times ``sign``."""
    a, b = np.r_[1.0, sign * short], np.zeros(len(long) * s + 1)
    b[0] = 1.0
    if len(long):
        b[s::s] = sign * long
    return sign * np.convolve(a, b)[1:]


def _stable(raw: np.ndarray) -> np.ndarray:
    """Unbounded numbers to stationary lag coefficients, by partial autocorrelations."""
    pac, out = np.tanh(raw), np.zeros(0)
    for r in pac:
        out = np.r_[out - r * out[::-1], r]
    return out


def system(order, seasonal, mean, coefs):
    """Z, T, RQR, d, H, a1, P1 of the coefficients (as named by :func:`labels`)."""
    (p, d, q), (P, D, Q, s) = order, seasonal
    c = np.asarray(coefs, float)
    mu, c = (c[0], c[1:]) if mean else (0.0, c)
    ar = _polynomial(c[:p], c[p + q : p + q + P], s, -1.0)
    ma = _polynomial(c[p : p + q], c[p + q + P : p + q + P + Q], s, 1.0)
    var = c[-1]
    m = max(len(ar), len(ma) + 1, 1)
    block = np.zeros((m, m))
    block[: len(ar), 0] = ar
    block[:-1, 1:] = np.eye(m - 1)
    r = np.zeros(m)
    r[0] = 1.0
    r[1 : len(ma) + 1] = ma
    rqr = var * np.outer(r, r)
    # Stationary covariance: X = T X T' + RQR, by doubling.
    a, x = block.copy(), rqr.copy()
    for _ in range(60):
        x, a = x + a @ x @ a.T, a @ a
        if not np.isfinite(x).all() or np.abs(a).max() < 1e-18:
            break
    k = d + D * s
    diff = np.array([1.0])
    for _ in range(d):
        diff = np.convolve(diff, [1.0, -1.0])
    for _ in range(D):
        diff = np.convolve(diff, np.r_[1.0, np.zeros(s - 1), -1.0])
    n = k + m
    Z, T, R = np.zeros(n), np.zeros((n, n)), np.zeros((n, n))
    T[k:, k:], R[k:, k:] = block, rqr
    Z[k] = 1.0
    if k:  # the last k observations, newest first: y = -sum(diff) past + arma
        Z[:k] = -diff[1:]
        T[0, :] = Z
        T[1:k, : k - 1] = np.eye(k - 1)
    P1 = np.zeros((n, n))
    P1[:k, :k] = DIFFUSE * var * np.eye(k)
    P1[k:, k:] = x
    return Z, T, R, mu, 0.0, np.zeros(n), P1


#: From so many rows without a gap on, a filter whose gain has settled goes on in pieces that are scanned side by side.
SETTLED_ROWS = 256


def _settled(y: np.ndarray, Z, M, K, d, a) -> tuple[np.ndarray, np.ndarray]:
    """Fitted values of rows without gaps under a constant gain, and the last state: a' = M a + K (y - d).

    Pieces are scanned at once from a zero state; what the state before each adds is linear in it.
    """
    n, m = len(y), len(a)
    length = max(1, math.isqrt(n))
    count = n // length
    head = (y[: count * length] - d).reshape(count, length)
    own, part = np.empty((length, count)), np.zeros((m, count))
    lead, power = np.empty((length, m)), np.eye(m)
    for t in range(length):
        own[t], lead[t] = Z @ part, Z @ power
        part = M @ part + np.outer(K, head[:, t])
        power = M @ power
    starts = np.empty((m, count))
    for j in range(count):
        starts[:, j] = a
        a = power @ a + part[:, j]
    fitted = np.empty(n)
    fitted[: count * length] = (own + lead @ starts).T.ravel()
    for t in range(count * length, n):
        fitted[t] = Z @ a
        a = M @ a + K * (y[t] - d)
    return fitted + d, a


def kalman(y: np.ndarray, Z, T, RQR, d, H, a, P):
    """Per row fitted, residual, standardised residual; then log likelihood, its count, and the final state.

    A NaN is a gap: fitted is given, residuals are NaN, the state only moves on.  Where the state's variance no longer
    changes, the rows up to the next gap share one gain.
    """
    n, limit = len(y), DIFFUSE / 100 * (Z @ RQR @ Z)  # a variance beyond it is still that of an unknown start
    fitted, resid, std = np.empty(n), np.full(n, np.nan), np.full(n, np.nan)
    like, used, eye = 0.0, 0, np.eye(len(Z))
    gaps = np.append(np.flatnonzero(~np.isfinite(y)), n) if n >= SETTLED_ROWS else None
    t = 0
    while t < n:
        pz = P @ Z
        f = Z @ pz + H
        fitted[t] = Z @ a + d
        was, seen = P, bool(np.isfinite(y[t]) and f > 0)
        if seen:
            v = y[t] - fitted[t]
            K = pz / f
            a = a + K * v
            i = eye - np.outer(K, Z)
            P = i @ P @ i.T + H * np.outer(K, K)
            resid[t], std[t] = v, v / math.sqrt(f)
            if f < limit:
                like -= 0.5 * (math.log(2 * math.pi * f) + v * v / f)
            used += 1
        a = T @ a
        P = T @ P @ T.T + RQR
        P = 0.5 * (P + P.T)
        t += 1
        if gaps is not None and seen and f < limit and np.abs(P - was).max() <= 1e-14 * np.abs(P).max():
            stop = int(gaps[np.searchsorted(gaps, t)])
            pz = P @ Z
            f = Z @ pz + H
            if stop - t >= SETTLED_ROWS and f > 0:
                K, run = T @ pz / f, slice(t, stop)
                fitted[run], a = _settled(y[run], Z, T - np.outer(K, Z), K, d, a)
                resid[run] = y[run] - fitted[run]
                std[run] = resid[run] / math.sqrt(f)
                like -= 0.5 * ((stop - t) * math.log(2 * math.pi * f) + float(resid[run] @ resid[run]) / f)
                used, t = used + stop - t, stop
    return fitted, resid, std, like, used, (a, P)


def forecast(state, Z, T, RQR, d, H, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation 1..h steps after the last row."""
    a, P = state
    mean, sd = np.empty(h), np.empty(h)
    for i in range(h):
        mean[i], sd[i] = Z @ a + d, math.sqrt(max(0.0, Z @ P @ Z + H))
        a, P = T @ a, T @ P @ T.T + RQR
    return mean, sd


def _simplex(f, x0: np.ndarray, steps: int) -> np.ndarray:
    """Nelder-Mead."""
    n = len(x0)
    pts = [x0] + [x0 + 0.3 * np.eye(n)[i] for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < 1e-9 * (1 + abs(val[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = mid + 0.5 * (pts[-1] - mid)
            fc = f(c)
            if fc < val[-1]:
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]


def _told(base: dict, coefs: list[float], loss: float, nobs: int) -> dict:
    k = len(coefs)
    aicc = 2 * k + 2 * loss + (2 * k * (k + 1) / (nobs - k - 1) if nobs > k + 1 else math.nan)
    return base | {"coefs": coefs, "loglik": -loss, "aic": 2 * k + 2 * loss, "aicc": aicc, "bic": k * math.log(nobs) + 2 * loss, "status": "ok", "message": ""}


def fit(y, order=(1, 0, 0), seasonal=(0, 0, 0, 0), mean: bool = False, steps: int = 600, model_id: str = "") -> dict:
    """Maximum likelihood; failure is data: status ``failed`` with a message."""
    check(order, seasonal)
    y = np.asarray(y, float)
    y = np.where(np.isfinite(y), y, np.nan)
    nobs = int(np.isfinite(y).sum())
    base = {"order": list(order), "seasonal_order": list(seasonal), "include_mean": mean, "names": labels(order, seasonal, mean), "nobs": nobs, "model_id": model_id}
    failed = lambda why: base | {"coefs": None, "loglik": None, "aic": None, "aicc": None, "bic": None, "status": "failed", "message": why}
    if nobs == 0:
        return failed("no observations")
    (p, _, q), (P, _, Q, _) = order, seasonal
    level, spread = np.nanmean(y), float(np.nanstd(y)) or 1.0
    if not any(order) and not any(seasonal[:3]):  # white noise: mean and variance are the estimates
        with np.errstate(over="ignore"):
            square = float(np.nansum((y - (level if mean else 0.0)) ** 2))
        if not math.isfinite(square):
            return failed("the likelihood is not finite")
        var = max(1e-300, square / nobs)
        return _told(base, [float(level), var] if mean else [var], 0.5 * (nobs * math.log(2 * math.pi * var) + square / var), nobs)

    def coefs(x: np.ndarray) -> np.ndarray:
        x, out = list(x), []
        if mean:
            out.append(level + spread * x.pop(0))
        x = np.array(x)
        cut = np.cumsum([p, q, P, Q])
        out += [*_stable(x[: cut[0]]), *(-_stable(x[cut[0] : cut[1]])), *_stable(x[cut[1] : cut[2]]), *(-_stable(x[cut[2] : cut[3]])), 1.0]
        return np.array(out)

    def profile(x: np.ndarray) -> tuple[float, np.ndarray]:
        """The variance has a closed form given the rest."""
        c = coefs(x)
        Z, T, R, mu, H, a, P1 = system(order, seasonal, mean, c)
        with np.errstate(all="ignore"):
            _, _, std, _, used, _ = kalman(y, Z, T, R, mu, H, a, P1)
            c[-1] = max(1e-300, float(np.nanmean(std**2)))
            like = kalman(y, *system(order, seasonal, mean, c))[3]
        return (-like if np.isfinite(like) else 1e300), c

    try:
        x = _simplex(lambda v: profile(v)[0], np.zeros(p + q + P + Q + bool(mean)), steps) if p + q + P + Q + bool(mean) else np.zeros(0)
        loss, c = profile(x)
    except (np.linalg.LinAlgError, FloatingPointError, ValueError) as e:
        return failed(str(e))
    if loss >= 1e300 or not np.isfinite(c).all():
        return failed("the likelihood is not finite")
    return _told(base, c.tolist(), loss, nobs)


class Filter:
    """A fitted model's system, built once; :meth:`step` filters one row."""

    def __init__(self, model: dict, horizon: int = 0):
        self.model_id, self.horizon = model["model_id"], horizon
        *self.system, a, P = system(model["order"], model["seasonal_order"], model["include_mean"], model["coefs"])
        self.first = a, P

    def step(self, value: float, state=None):
        """(fitted, residual, standardised residual, forecasts), then the state for the next row."""
        f, r, s, _, _, state = kalman(np.array([value]), *self.system, *(state or self.first))
        ahead = forecast(state, *self.system, self.horizon)[0] if self.horizon else ()
        return np.r_[f[0], r[0], s[0], ahead], state


def apply(model: dict, y: np.ndarray, state=None, horizon: int = 0):
    """Filter rows with a fitted model; state goes in and out, so that batches can be chained."""
    own = Filter(model, horizon)
    state, out = state or own.first, np.empty((len(y), 3 + horizon))
    for i, value in enumerate(y):
        out[i], state = own.step(value, state)
    return out[:, :3], out[:, 3:], state
