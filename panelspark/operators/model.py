"""Monthly state features and expanding-window logistic probabilities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.calendar import resample_last
from panelspark.functions.stats import div


def state_features(track: DataFrame, factors: DataFrame, dispersion: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per month: factor changes, book volatility, momentum, drawdown, dispersion, next-month target.

    ``track`` (date, ret) and ``dispersion`` (date, value) are daily; ``factors`` is long
    (date, asset, value) with the listed series.
    """
    m = track.groupBy(F.last_day("date").alias("month_end")).agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("r")).withColumn("_k", F.lit(0))
    f = resample_last(factors.filter(F.col("asset").isin(*names)), ["value"])
    wide = f.groupBy("month_end").pivot("asset", list(names)).agg(F.max("value"))
    d = resample_last(dispersion.withColumn("_k", F.lit(0)), ["value"], ["_k"]).select("month_end", F.col("value").alias("carry_dispersion"))
    w = Window.partitionBy("_k").orderBy("month_end")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = m.join(wide, "month_end", "left").join(d, "month_end", "left")
    for c in names:
        x = x.withColumn(c, F.last(c, True).over(upto))
    full = lambda n, e: F.when(F.count("r").over(w.rowsBetween(-(n - 1), 0)) >= n, e(w.rowsBetween(-(n - 1), 0)))
    comp = lambda win: F.product(1 + F.col("r")).over(win) - 1
    x = x.withColumn("_w", F.product(1 + F.col("r")).over(upto))
    nxt = F.lead("r").over(w)
    return x.select(
        "month_end", *[(div(F.col(c), F.lag(c).over(w)) - 1).alias(f"{c}_change") for c in names],
        full(3, lambda v: F.stddev_samp("r").over(v)).alias("carry_volatility_3m"), full(3, comp).alias("carry_momentum_3m"), full(12, comp).alias("carry_momentum_12m"),
        (div(F.col("_w"), F.max("_w").over(upto)) - 1).alias("carry_drawdown"), "carry_dispersion",
        F.when(F.coalesce(nxt, F.lit(0.0)) > 0, 1.0).otherwise(0.0).alias("target_next_positive"), nxt.alias("next_return"))


def logistic_slope(x: np.ndarray, y: np.ndarray, b: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Gradient of the penalised loss of :func:`fit_logistic`."""
    return np.column_stack([np.ones(len(x)), x]).T @ (1.0 / (1.0 + np.exp(-(b[0] + x @ b[1:]))) - y) + np.r_[0.0, b[1:] / c]


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 100, start: np.ndarray | None = None) -> np.ndarray:
    """Ridge-penalised logistic fit by Newton steps from ``start``; the intercept (first entry) is free."""
    a = np.column_stack([np.ones(len(x)), x])
    pen = np.full(a.shape[1], 1.0 / c)
    pen[0] = 0.0
    b = np.zeros(a.shape[1]) if start is None else start

    def loss(v):
        z = a @ v
        return np.logaddexp(0.0, z).sum() - y @ z + 0.5 * (pen * v) @ v

    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-(a @ b)))
        g = a.T @ (p - y) + pen * b
        if np.abs(g).max() < 1e-10:
            break
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pen)
        h[0, 0] += 1e-12
        d = np.linalg.solve(h, g)
        t, now = 1.0, loss(b)
        while loss(b - t * d) > now and t > 1e-8:
            t *= 0.5
        b = b - t * d
    return b


def expanding_logistic(data: DataFrame, features: Sequence[str], target: str, min_train: int = 60, date: str = "month_end", keys: Sequence[str] = (), pieces: int = 8) -> DataFrame:
    """Probability for every row from a fit on all earlier rows, with the coefficients used, the training rows' number and medians, and
    ``residual``, the largest entry of the loss's gradient at the fit.

    A series is cut into ``pieces`` runs of rows; a task fits the cut-offs of one run, each from the last one's coefficients, and gets the
    rows up to the run's end. So a row is sent ``pieces`` times at most, however long the series. Nulls of a feature become its median over
    the training rows; a feature without any value counts as constant. Cut-offs whose training targets are all alike are left out.
    """
    features, keys = list(features), list(keys)
    ks = keys or ["_k"]
    base = data if keys else data.withColumn("_k", F.lit(0))
    idx = base.select(*ks, date, target, *features).withColumn("_i", F.row_number().over(Window.partitionBy(*ks).orderBy(date)) - 1)
    n = idx.groupBy(*ks).agg((F.max("_i") + 1).alias("_len"))
    own = F.expr(f"cast(_i * {pieces} div _len as int)")
    fan = idx.join(n, ks).withColumn("_own", own).withColumn("_run", F.explode(F.sequence("_own", F.lit(pieces - 1)))).drop("_len")
    types = dict(fan.dtypes)
    columns = [*ks, date, "probability", "n_train", "residual", "intercept", *[f"coef_{f}" for f in features], *[f"med_{f}" for f in features]]
    schema = ", ".join([f"{k} {types[k]}" for k in ks] + [f"{date} date, probability double, n_train long, residual double, intercept double", *[f"coef_{f} double" for f in features], *[f"med_{f} double" for f in features]])

    def run(key, pdf):
        pdf = pdf.sort_values("_i").reset_index(drop=True)
        raw, y = pdf[features].to_numpy(dtype=float), pdf[target].to_numpy(dtype=float)
        rows, b = [], None
        for cut in pdf.index[(pdf["_own"] == key[-1]) & (pdf["_i"] >= min_train)]:
            use = np.flatnonzero(~np.isnan(y[:cut]))
            t = y[use]
            if not len(t) or (t == t[0]).all():
                continue
            x = raw[use]
            med = pd.DataFrame(x).median().to_numpy()
            fill = lambda m: np.where(np.isfinite(m), m, np.nan_to_num(med))  # noqa: B023, E731
            x = fill(x)
            mu, sd = x.mean(axis=0), x.std(axis=0)
            sd[sd == 0] = 1.0
            x = (x - mu) / sd
            b = fit_logistic(x, t, start=b)
            z = b[0] + ((fill(raw[cut]) - mu) / sd) @ b[1:]
            rows.append((*key[:-1], pdf[date][cut], 1.0 / (1.0 + np.exp(-z)), len(t), np.abs(logistic_slope(x, t, b)).max(), *b, *[None if np.isnan(m) else m for m in med]))
        return pd.DataFrame(rows, columns=columns) if rows else pd.DataFrame(columns=columns, dtype=object)

    out = fan.groupBy(*ks, "_run").applyInPandas(lambda key, pdf: run(key, pdf), schema)
    return out if keys else out.drop("_k")
