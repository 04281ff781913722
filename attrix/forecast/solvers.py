"""Per-series forecasting solvers (numpy), run by ``groupBy(series)
.applyInPandas`` — Spark partitions the series, each task fits its own.

A daily series holds one row per calendar day, so every group is bounded by
the calendar span (a few thousand rows), whatever the size of the raw data.

* Holt–Winters, additive trend + additive weekly season.
* ARIMA(2,1,1) by Hannan–Rissanen two-stage least squares (published
  method); interval from the ψ-weights; AIC/BIC from the Gaussian
  conditional likelihood.  Numbers differ from an exact-likelihood fit.
* Additive trend + seasonality model (piecewise-linear trend with 25
  changepoints in the first 80 % of the history, yearly Fourier order 10,
  weekly order 3), fitted as one ridge-penalised least-squares problem.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

SEASON = 7
Z95 = 1.959963984540054
Z80 = 1.2815515655446004


# ---------------------------------------------------------------------------
# Holt–Winters
# ---------------------------------------------------------------------------

def _hw_sse(y: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray, m: int = SEASON):
    """Vectorised over parameter sets: returns (sse, level, trend, season)
    arrays after running the additive recursion over ``y``."""
    n = len(y)
    b0 = (y[m:2 * m].mean() - y[:m].mean()) / m if n >= 2 * m else (y[-1] - y[0]) / max(n - 1, 1)
    l0 = y[:m].mean() - b0 * (m + 1) / 2.0
    p = len(a)
    lev = np.full(p, l0)
    tr = np.full(p, b0)
    season = np.tile(y[:m] - (l0 + b0 * np.arange(1, m + 1)), (p, 1))
    sse = np.zeros(p)
    for t in range(n):
        j = t % m
        s_old = season[:, j]
        fc = lev + tr + s_old
        err = y[t] - fc
        sse += err * err
        new_lev = a * (y[t] - s_old) + (1 - a) * (lev + tr)
        new_tr = b * (new_lev - lev) + (1 - b) * tr
        season[:, j] = g * (y[t] - lev - tr) + (1 - g) * s_old
        lev, tr = new_lev, new_tr
    return sse, lev, tr, season


COARSE, FINE = np.linspace(0.0, 1.0, 11), np.linspace(-0.05, 0.05, 11)


def hw_best(y: np.ndarray, alphas, betas, gammas, m: int = SEASON) -> tuple[float, float, float, float]:
    """``(sse, alpha, beta, gamma)`` of the best of a grid (ties: the first)."""
    A, B, G = (x.ravel() for x in np.meshgrid(alphas, betas, gammas, indexing="ij"))
    sse, *_ = _hw_sse(y, A, B, G, m)
    i = int(np.argmin(sse))
    return float(sse[i]), float(A[i]), float(B[i]), float(G[i])


def hw_around(centre: tuple[float, float, float], part: int | None = None) -> list[np.ndarray]:
    """The fine grid around a point; ``part``: one of its values of alpha."""
    grids = [np.clip(c + FINE, 0.0, 1.0) for c in centre]
    return grids if part is None else [grids[0][part:part + 1], *grids[1:]]


def hw_forecast_at(y: np.ndarray, horizon: int, a: float, b: float, g: float, m: int = SEASON) -> np.ndarray:
    _, lev, tr, season = _hw_sse(y, np.array([a]), np.array([b]), np.array([g]), m)
    h = np.arange(1, horizon + 1)
    return lev[0] + h * tr[0] + season[0][(len(y) + h - 1) % m]


def holt_winters_forecast(y: np.ndarray, horizon: int, m: int = SEASON):
    """One series in one place; ``models.holt_winters`` deals the grids to tasks."""
    _, *centre = hw_best(y, COARSE, COARSE, COARSE, m)
    _, a, b, g = hw_best(y, *hw_around(tuple(centre)), m)
    return hw_forecast_at(y, horizon, a, b, g, m), (a, b, g)


# ---------------------------------------------------------------------------
# ARIMA(2,1,1)
# ---------------------------------------------------------------------------

def _lagmat(x: np.ndarray, p: int) -> np.ndarray:
    return np.column_stack([x[p - i - 1:len(x) - i - 1] for i in range(p)])


def arima211_forecast(y: np.ndarray, horizon: int):
    w = np.diff(y)
    n = len(w)
    p_long = int(max(3, min(10, n // 4)))
    # stage 1: long AR for innovations
    X1 = _lagmat(w, p_long)
    coef1, *_ = np.linalg.lstsq(X1, w[p_long:], rcond=None)
    e = np.zeros(n)
    e[p_long:] = w[p_long:] - X1 @ coef1
    # stage 2: w_t on w_{t-1}, w_{t-2}, e_{t-1}
    start = p_long + 1
    X2 = np.column_stack([w[start - 1:n - 1], w[start - 2:n - 2], e[start - 1:n - 1]])
    coef2, *_ = np.linalg.lstsq(X2, w[start:], rcond=None)
    phi1, phi2, theta = (float(c) for c in coef2)
    resid = w[start:] - X2 @ coef2
    m_res = len(resid)
    sigma2 = float(np.mean(resid ** 2)) if m_res else 0.0
    # forecast differences, then integrate
    w_hist = list(w[-2:])
    e_last = float(resid[-1]) if m_res else 0.0
    out, level = [], float(y[-1])
    for h in range(horizon):
        wn = phi1 * w_hist[-1] + phi2 * w_hist[-2] + (theta * e_last if h == 0 else 0.0)
        w_hist.append(wn)
        level += wn
        out.append(level)
    # psi weights of (1 - phi1 B - phi2 B^2)(1 - B) y = (1 + theta B) e
    ar = [1.0 + phi1, phi2 - phi1, -phi2]
    psi = [1.0]
    for j in range(1, horizon):
        v = theta if j == 1 else 0.0
        for i in range(1, min(j, 3) + 1):
            v += ar[i - 1] * psi[j - i]
        psi.append(v)
    var = sigma2 * np.cumsum(np.square(psi))
    half = Z95 * np.sqrt(var)
    k = 4
    if m_res and sigma2 > 0:
        loglik = -0.5 * m_res * (np.log(2 * np.pi * sigma2) + 1.0)
        aic = float(-2 * loglik + 2 * k)
        bic = float(-2 * loglik + k * np.log(m_res))
    else:
        aic = bic = float("nan")
    fc = np.array(out)
    return fc, fc - half, fc + half, (phi1, phi2, theta, sigma2, aic, bic)


# ---------------------------------------------------------------------------
# additive trend + seasonality
# ---------------------------------------------------------------------------

N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
YEARLY_ORDER, WEEKLY_ORDER = 10, 3


def _design(days: np.ndarray, t: np.ndarray, cps: np.ndarray) -> np.ndarray:
    cols = [np.ones_like(t), t]
    cols += [np.maximum(t - c, 0.0) for c in cps]
    for period, order in ((365.25, YEARLY_ORDER), (7.0, WEEKLY_ORDER)):
        for k in range(1, order + 1):
            ang = 2.0 * np.pi * k * days / period
            cols += [np.sin(ang), np.cos(ang)]
    return np.column_stack(cols)


def additive_forecast(days: np.ndarray, y: np.ndarray, horizon: int):
    """Returns (fitted+forecast yhat, trend, lower, upper) over history and
    the ``horizon`` future days.  ``days`` are day numbers (epoch days)."""
    n = len(y)
    d0, span = days[0], max(days[-1] - days[0], 1)
    all_days = np.concatenate([days, days[-1] + np.arange(1, horizon + 1)]).astype(float)
    t_all = (all_days - d0) / span
    t_hist = t_all[:n]
    n_cp = min(N_CHANGEPOINTS, max(n - 2, 0))
    cps = (np.linspace(0, CHANGEPOINT_RANGE, n_cp + 2)[1:-1] if n_cp else np.array([]))
    scale = float(np.max(np.abs(y))) or 1.0
    X = _design(all_days, t_all, cps)
    Xh = X[:n]
    # ridge: tiny on intercept/slope, changepoints ~ Laplace(0.05) as a
    # Gaussian penalty, seasonality prior scale 10
    pen = np.concatenate([[1e-8, 1e-8], np.full(len(cps), 4.0),
                          np.full(X.shape[1] - 2 - len(cps), 1e-4)])
    beta = np.linalg.solve(Xh.T @ Xh + np.diag(pen), Xh.T @ (y / scale))
    yhat = X @ beta * scale
    trend = X[:, :2 + len(cps)] @ beta[:2 + len(cps)] * scale
    resid_sd = float(np.std(y - yhat[:n])) if n > 1 else 0.0
    return yhat, trend, yhat - Z80 * resid_sd, yhat + Z80 * resid_sd


# ---------------------------------------------------------------------------
# grouped-pandas adapters
# ---------------------------------------------------------------------------

def _series(pdf: pd.DataFrame):
    pdf = pdf.sort_values("date")
    return pdf, pdf["y"].to_numpy(dtype=float)


def arima_group(keys, horizon):
    cols = [*keys, "date", "yhat", "lower", "upper", "aic", "bic"]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, y = _series(pdf)
        if len(y) < 10:
            return pd.DataFrame(columns=cols)
        fc, lo, hi, (_, _, _, _, aic, bic) = arima211_forecast(y, horizon)
        last = pd.Timestamp(pdf["date"].iloc[-1])
        out = pd.DataFrame({"date": [(last + pd.Timedelta(days=i)).date()
                                     for i in range(1, horizon + 1)],
                            "yhat": fc, "lower": lo, "upper": hi, "aic": aic, "bic": bic})
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out[cols]
    return fn


def additive_group(keys, horizon):
    cols = [*keys, "date", "actual", "yhat", "trend", "lower", "upper", "is_future"]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, y = _series(pdf)
        if len(y) < 2:
            return pd.DataFrame(columns=cols)
        dates = pd.to_datetime(pdf["date"])
        days = (dates - pd.Timestamp("1970-01-01")).dt.days.to_numpy()
        yhat, trend, lo, hi = additive_forecast(days, y, horizon)
        last = dates.iloc[-1]
        fut = [(last + pd.Timedelta(days=i)).date() for i in range(1, horizon + 1)]
        out = pd.DataFrame({
            "date": list(dates.dt.date) + fut,
            "actual": np.concatenate([y, np.full(horizon, np.nan)]),
            "yhat": yhat, "trend": trend, "lower": lo, "upper": hi,
            "is_future": [False] * len(y) + [True] * horizon,
        })
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out[cols]
    return fn
