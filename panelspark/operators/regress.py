"""Regressions per key from aggregated moments; only one row per key ever reaches Python.

Slopes come from the covariance matrix of the regressors (stable, map-side combined).  The
Newey-West middle term uses one symmetric sum: with h(t) = g(t)/2 + sum_l w_l g(t-l) the
weighted autocovariances add up to sum_t g h' + h g'.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import ANN_DAYS
from panelspark.functions.ranking import global_position
from panelspark.functions.stats import div
from panelspark.session import cut_lineage

Keys = Sequence[str]


def _moments(live: DataFrame, keys: Keys, y: str, xs: Sequence[str], real) -> DataFrame:
    only = lambda c: F.when(real, F.col(c))
    aggs = [F.count(only(y)).alias("n"), F.avg(only(y)).alias("_my"), F.var_pop(only(y)).alias("_vy")]
    aggs += [F.array(*[F.avg(only(x)) for x in xs]).alias("_mx"), F.array(*[F.covar_pop(only(x), only(y)) for x in xs]).alias("_cxy")]
    aggs += [F.array(*[F.covar_pop(only(a), only(b)) for a in xs for b in xs]).alias("_cxx")]
    return live.groupBy(*keys).agg(*aggs)


def _stack(col: pd.Series, *shape: int) -> np.ndarray:
    return np.array(col.tolist(), dtype=float).reshape(len(col), *shape)


def _inverse(sxx: np.ndarray) -> np.ndarray:
    """Pseudo-inverses of covariance matrices [row, k, k], on the scale of correlations."""
    scale = np.sqrt(np.maximum(np.einsum("rii->ri", sxx), 0))
    inv = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    grid = inv[:, :, None] * inv[:, None, :]
    return np.linalg.pinv(sxx * grid, rcond=1e-12, hermitian=True) * grid


def _solve(m: DataFrame, keys: Keys, k: int) -> DataFrame:
    """Slopes, intercept and R2 per key; singular designs get the smallest slopes that fit."""
    types = dict(m.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in keys] + ["n long, _mx array<double>, _cxx array<double>, _alpha double, _beta array<double>, r2 double, _vy double"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            sxx, sxy, mx = _stack(pdf["_cxx"], k, k), _stack(pdf["_cxy"], k), _stack(pdf["_mx"], k)
            pdf = pdf.copy()
            beta = (_inverse(sxx) @ sxy[:, :, None])[:, :, 0]
            pdf["_beta"] = list(beta)
            pdf["_alpha"] = pdf["_my"].to_numpy() - (beta * mx).sum(axis=1)
            vy = pdf["_vy"].to_numpy()
            pdf["r2"] = np.divide((beta * sxy).sum(axis=1), vy, out=np.full(len(vy), np.nan), where=vy > 0)
            pdf["r2"] = pdf["r2"].astype(object).where(pdf["r2"].notna(), None)
            yield pdf[names]

    return m.mapInPandas(run, schema)


def ols(df: DataFrame, keys: Keys, y: str, xs: Sequence[str]) -> DataFrame:
    """Pooled least squares with classical t-statistics, one row per key and variable."""
    keys = list(keys)
    live = df.dropna(subset=[y, *xs]).select(*keys, y, *xs)
    k = len(xs)
    m = _moments(live, keys, y, xs, F.lit(True)).filter(F.col("n") > k + 2)
    s = _solve(m, keys, k)
    types = dict(s.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in keys] + ["variable string, coefficient double, t_stat double, n_obs long"])

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            n = pdf["n"].to_numpy(dtype=float)
            sxx, mx, beta = _stack(pdf["_cxx"], k, k), _stack(pdf["_mx"], k), _stack(pdf["_beta"], k)
            sig = pdf["_vy"].to_numpy() * (1 - pdf["r2"].to_numpy(dtype=float)) * n / np.maximum(n - k - 1, 1)
            inv = _inverse(sxx) / n[:, None, None]
            v0 = 1 / n + np.einsum("ri,rij,rj->r", mx, inv, mx)
            co = np.column_stack([pdf["_alpha"].to_numpy(), beta])
            se = np.sqrt(np.maximum(sig[:, None] * np.column_stack([v0, np.einsum("rii->ri", inv)]), 0))
            se[se == 0] = np.nan  # no t-statistic without an error
            for i, name in enumerate(["const", *xs]):
                out = pdf[keys].copy()
                out["variable"], out["coefficient"], out["t_stat"], out["n_obs"] = name, co[:, i], co[:, i] / se[:, i], pdf["n"]
                yield out

    return s.mapInPandas(run, schema)


def newey_west(df: DataFrame, keys: Keys, y: str, xs: Sequence[str], lags: int = 5, min_obs: int = 250, order: Sequence[str] = ("date",),
               block: str | None = None, context: str | None = None, periods: float = ANN_DAYS) -> DataFrame:
    """OLS per key with Newey-West t-statistics: n, r2, alpha (annualised), alpha_t, beta_x, t_x.

    Lags are rows after dropping NULLs, so one key is one ordered series.  A key too long for one
    task comes cut into ``block`` pieces with ``context`` rows in front (:func:`in_blocks`).
    """
    keys = list(keys)
    live = df.dropna(subset=[y, *xs])
    real = F.lit(True) if context is None else ~F.col(context)
    k = len(xs)
    m = _moments(live, keys, y, xs, real).filter(F.col("n") >= min_obs)
    s = _solve(m, keys, k)
    j = live.join(s.drop("_cxx", "_vy", "r2", "n"), keys)
    fit = F.col("_alpha")
    for i, x in enumerate(xs):
        fit = fit + F.col("_beta")[i] * F.col(x)
    j = j.withColumn("_g0", F.col(y) - fit)
    for i, x in enumerate(xs):
        j = j.withColumn(f"_g{i + 1}", F.col("_g0") * (F.col(x) - F.col("_mx")[i]))
    w = Window.partitionBy(*keys, *([block] if block else [])).orderBy(*order)
    zero = F.lit(0.0)
    for i in range(k + 1):
        h = F.col(f"_g{i}") / 2
        for lag in range(1, lags + 1):
            h = h + F.lit(1 - lag / (lags + 1)) * F.coalesce(F.lag(f"_g{i}", lag).over(w), zero)
        j = j.withColumn(f"_h{i}", h)
    cross = F.array(*[F.sum(F.when(real, F.col(f"_g{a}") * F.col(f"_h{b}") + F.col(f"_h{a}") * F.col(f"_g{b}"))) for a in range(k + 1) for b in range(k + 1)])
    mid = j.groupBy(*keys).agg(cross.alias("_s"))
    full = s.join(mid, keys)
    types = dict(full.dtypes)
    cols = ["n long", "r2 double", "alpha_ann double", "alpha_t double"] + [f"{p}_{x} double" for x in xs for p in ("beta", "t")]
    schema = ", ".join([f"{c} {types[c]}" for c in keys] + cols)
    names = keys + [c.split()[0] for c in cols]

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            n = pdf["n"].to_numpy(dtype=float)
            mx, beta, mid_ = _stack(pdf["_mx"], k), _stack(pdf["_beta"], k), _stack(pdf["_s"], k + 1, k + 1)
            bread = np.zeros((len(pdf), k + 1, k + 1))
            bread[:, 0, 0] = 1 / n
            bread[:, 1:, 1:] = _inverse(_stack(pdf["_cxx"], k, k)) / n[:, None, None]
            v = bread @ mid_ @ bread
            t = np.tile(np.eye(k + 1), (len(pdf), 1, 1))
            t[:, 0, 1:] = -mx
            v = t @ v @ t.transpose(0, 2, 1)
            se = np.sqrt(np.maximum(np.einsum("rii->ri", v), 0))
            se[se == 0] = np.nan  # no t-statistic without an error
            out = pdf[[*keys, "n", "r2"]].copy()
            out["alpha_ann"] = pdf["_alpha"] * periods
            out["alpha_t"] = pdf["_alpha"].to_numpy() / se[:, 0]
            for i, x in enumerate(xs):
                out[f"beta_{x}"], out[f"t_{x}"] = beta[:, i], beta[:, i] / se[:, i + 1]
            yield out[names]

    return full.mapInPandas(run, schema)


def in_blocks(df: DataFrame, first: str, second: str, lags: int, rows: int = 100_000) -> DataFrame:
    """Global order (first, second) cut into blocks of ``rows`` rows, each preceded by its ``lags`` context rows.

    Positions come from ranges sorted apart (:func:`global_position`), so no task holds more than one range or block.
    """
    pos = global_position(df, [first, second], "_i")
    blk = F.floor(F.col("_i") / rows)
    ahead = F.when(F.col("_i") % rows >= rows - lags, F.array(F.struct(blk.alias("b"), F.lit(False).alias("c")), F.struct((blk + 1).alias("b"), F.lit(True).alias("c"))))
    both = F.coalesce(ahead, F.array(F.struct(blk.alias("b"), F.lit(False).alias("c"))))
    return pos.withColumn("_e", F.explode(both)).select("*", F.col("_e.b").alias("_block"), F.col("_e.c").alias("_context")).drop("_e")


def pooled_newey_west(df: DataFrame, y: str, xs: Sequence[str], lags: int, min_obs: int = 24, periods: float = 12.0, asset: str = "asset", date: str = "month_end", rows: int = 100_000) -> DataFrame:
    """All assets as one sample in (asset, date) order, lags running across asset borders."""
    live = df.dropna(subset=[y, *xs]).select(asset, date, y, *xs)
    # a value taken from the rows, so that the join on it stays an equi-join
    b = in_blocks(live, asset, date, lags, rows).withColumn("_pool", F.substring(F.concat(F.lit("POOLED"), asset), 1, 6))
    out = newey_west(b, ["_pool"], y, xs, lags, min_obs, ["_i"], "_block", "_context", periods)
    return out.withColumnRenamed("_pool", asset)


def factor_correlation(df: DataFrame, keys: Keys, value: str, factors: Sequence[str]) -> DataFrame:
    """Correlation of ``value`` with each factor, and the number of complete pairs, one row per key and factor."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors])).alias("_f")
    live = df.select(*keys, F.col(value).alias("_y"), pairs).select(*keys, "_y", "_f.factor", "_f.x").dropna(subset=["_y", "x"])
    return live.groupBy(*keys, "factor").agg(F.count(F.lit(1)).alias("n"), F.corr("_y", "x").alias("corr"))


def mean_standard_error(df: DataFrame, keys: Keys, ret: str, lags: int = 5, order: Sequence[str] = ("date",)) -> DataFrame:
    """Mean, Newey-West standard error of the mean and its t, without leaving SQL."""
    keys = list(keys)
    live = df.filter(F.col(ret).isNotNull())
    m = live.groupBy(*keys).agg(F.avg(ret).alias("_m"))
    j = live.join(m, keys).withColumn("_u", F.col(ret) - F.col("_m"))
    w = Window.partitionBy(*keys).orderBy(*order)
    h = F.col("_u") / 2
    for lag in range(1, lags + 1):
        h = h + F.lit(1 - lag / (lags + 1)) * F.coalesce(F.lag("_u", lag).over(w), F.lit(0.0))
    s = j.withColumn("_h", h).groupBy(*keys).agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.sum(2 * F.col("_u") * F.col("_h")).alias("_s"))
    se = F.sqrt("_s") / F.col("n")
    return s.select(*keys, "n", "mean", se.alias("nw_se"), div(F.col("mean"), se).alias("nw_t"))


def spanning_pairs(tracks: DataFrame, pairs: Sequence[tuple[str, str]], track: str = "track", date: str = "date") -> DataFrame:
    """Long table (test, date, y, x) of two-way spanning tests."""
    out = None
    for a, b in pairs:
        one = (
            tracks.filter(F.col(track) == a).select(date, F.col("ret").alias("y"))
            .join(tracks.filter(F.col(track) == b).select(date, F.col("ret").alias("x")), date)
            .withColumn("test", F.lit(f"{a} on {b}"))
        )
        out = one if out is None else out.unionByName(one)
    return out


def _gram(df: DataFrame, column: str) -> np.ndarray:
    """A'A of the rows ``column`` (arrays of one length): a partial product per partition, summed by entry."""
    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                a = np.stack(pdf[column].to_list())
                total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel()]})

    parts = df.select(column).mapInPandas(run, "g array<double>").select(F.posexplode("g").alias("i", "v"))
    rows = parts.groupBy("i").agg(F.sum("v").alias("v")).collect()  # squared basis size, whatever the data
    m = int(round(np.sqrt(len(rows))))
    out = np.zeros(m * m)
    for r in rows:
        out[r["i"]] = r["v"]
    return out.reshape(m, m)


def _turned(column: str, matrix: np.ndarray):
    @F.pandas_udf("array<double>")
    def turn(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_list()) @ matrix))

    return turn(column)


def _times(cells: DataFrame, table: DataFrame, along: str, out: str, width: int) -> DataFrame:
    """Sums over ``along`` of cell x row array, one array per ``out``."""
    j = cells.join(table.select(along, F.col("_a")), along)
    return j.groupBy(out).agg(F.array(*[F.sum(F.col("_x") * F.col("_a")[i]) for i in range(width)]).alias("_a"))


def principal_components(df: DataFrame, value: str, k: int = 3, top: int = 8, date: str = "date", asset: str = "asset", min_obs: int = 60,
                         spare: int = 8, rounds: int = 8, tol: float = 1e-7) -> dict[str, DataFrame]:
    """Explained variance, loadings and scores on complete dates.

    A block Krylov method: the centred cells (date, asset, value) multiply a block of ``top + spare`` vectors by joins and sums, there and
    back, the images extend an orthonormal basis kept as one short array per asset, and the small projected problem gives the components.
    Neither a date nor an asset-by-asset matrix is ever in one place; the driver holds matrices of the basis size only. ``residual`` has, for
    each component, the norm of (C v - lambda v) over the largest lambda; rounds end below ``tol`` or when the basis is complete.
    Components are turned so that they correlate positively with the average over assets (that is, their loadings have a positive sum).
    """
    spark = df.sparkSession
    ok = df.groupBy(asset).agg(F.count(value).alias("_n")).filter(F.col("_n") >= min_obs).select(asset)
    width = ok.count()
    live = df.filter(F.col(value).isNotNull()).join(ok, asset, "left_semi").select(F.col(date).alias("date"), F.col(asset).cast("string").alias("asset"), F.col(value).cast("double").alias("_v"))
    whole = live.groupBy("date").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == width).select("date")
    live = live.join(whole, "date", "left_semi")
    cells = cut_lineage(live.join(live.groupBy("asset").agg(F.avg("_v").alias("_m")), "asset").select("date", "asset", (F.col("_v") - F.col("_m")).alias("_x")))
    total = cells.agg(F.sum(F.col("_x") * F.col("_x"))).first()[0]
    if total is None:
        raise ValueError("no date is complete for the selected assets")
    b = min(top + spare, width)
    start = F.array(*[F.xxhash64("asset", F.lit(i)) / F.lit(2.0**63) for i in range(b)])
    new = cells.select("asset").distinct().select("asset", start.alias("_a"))
    g = _gram(new, "_a")
    lam, turn = np.linalg.eigh(g)
    keep = lam > lam[-1] * 1e-10
    new, size = cut_lineage(new.select("asset", _turned("_a", turn[:, keep] / np.sqrt(lam[keep])).alias("_a"))), int(keep.sum())
    state = None
    for step in range(rounds):
        image = _times(cells, _times(cells, new, "asset", "date", size), "date", "asset", size)
        both = new.withColumnRenamed("_a", "_q").join(image.withColumnRenamed("_a", "_c"), "asset")
        if state is not None:
            both = state.join(both.withColumnsRenamed({"_q": "_q2", "_c": "_c2"}), "asset").select("asset", F.concat("_q", "_q2").alias("_q"), F.concat("_c", "_c2").alias("_c"))
        state = cut_lineage(both)
        g = _gram(state.select(F.concat("_q", "_c").alias("_a")), "_a")
        m = len(g) // 2
        qq, qc, cc = g[:m, :m], g[:m, m:], g[m:, m:]
        lam, y = np.linalg.eigh((qc + qc.T) / 2)
        lam, y = lam[::-1][:top], y[:, ::-1][:, :top]
        off = np.einsum("ij,ij->j", y, cc @ y) - 2 * lam * np.einsum("ij,ij->j", y, qc @ y) + lam**2 * np.einsum("ij,ij->j", y, qq @ y)
        residual = np.sqrt(np.maximum(off, 0)) / lam[0]
        if residual.max() < tol or m >= width:
            break
        # what the newest images add to the basis, twice orthogonalised
        last = slice(m - size, m)
        lift = np.zeros((2 * m, size))
        lift[:m], lift[m:][last] = -qc[:, last], np.eye(size)
        rest = lift.T @ g @ lift
        lam_r, turn = np.linalg.eigh((rest + rest.T) / 2)
        keep = lam_r > max(lam_r[-1], lam[0] ** 2 * 1e-12) * 1e-10
        if not keep.any():
            break
        whole = state.select("asset", "_q", F.concat("_q", "_c").alias("_a"))
        new = cut_lineage(whole.select("asset", "_q", _turned("_a", lift @ (turn[:, keep] / np.sqrt(lam_r[keep]))).alias("_a")))
        g = _gram(new.select(F.concat("_q", "_a").alias("_a")), "_a")
        cross, own = g[:m, m:], g[m:, m:] - g[:m, m:].T @ g[:m, m:]
        lam_r, turn = np.linalg.eigh((own + own.T) / 2)
        keep = lam_r > lam_r[-1] * 1e-6
        fix = turn[:, keep] / np.sqrt(lam_r[keep])
        new = cut_lineage(new.select("asset", F.concat("_q", "_a").alias("_a")).select("asset", _turned("_a", np.vstack([-cross @ fix, fix])).alias("_a")))
        size = int(keep.sum())
    k = min(k, len(lam))
    raw = state.select("asset", _turned("_q", y[:, :k]).alias("_a"))
    sums = raw.agg(*[F.sum(F.col("_a")[i]) for i in range(k)]).first()
    turned = cut_lineage(raw.select("asset", F.array(*[F.col("_a")[i] * (-1.0 if sums[i] < 0 else 1.0) for i in range(k)]).alias("_a")))
    columns = [F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)]
    scores = _times(cells, turned, "asset", "date", k).select(F.col("date").alias(date), *columns)
    share = np.maximum(lam, 0) / total if total else np.zeros(len(lam))
    explained = spark.createDataFrame([(f"PC{i + 1}", float(v), float(c)) for i, (v, c) in enumerate(zip(share, np.cumsum(share)))], "component string, explained_variance double, cumulative_variance double")
    left = spark.createDataFrame([(f"PC{i + 1}", float(v)) for i, v in enumerate(residual)], "component string, residual double")
    return {"explained": explained, "loadings": turned.select("asset", *columns), "scores": scores, "residual": left}


def component_correlations(scores: DataFrame, factors: DataFrame, names: Sequence[str], date: str = "date") -> DataFrame:
    """Correlation of each component's scores with each factor (columns ``names``) on common dates."""
    long = scores.unpivot([date], [c for c in scores.columns if c != date], "component", "score")
    return factor_correlation(long.join(factors.select(date, *names), date), ["component"], "score", list(names))
