"""Latent factors.  Moments are aggregated by Spark; only matrices of names or characteristics are solved in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pca(rows: DataFrame, row: str, item: str, value: str, k: int = 3) -> DataFrame:
    """(item, component, loading, share) of the covariance over items, from pairwise sums of the long table."""
    mean = rows.groupBy(item).agg(F.avg(value).alias("_m"))
    x = rows.join(mean, item).select(row, item, (F.col(value) - F.col("_m")).alias("x"))
    pairs = x.alias("a").join(x.alias("b"), F.col(f"a.{row}") == F.col(f"b.{row}")).groupBy(F.col(f"a.{item}").alias("i"), F.col(f"b.{item}").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("c"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot(index="i", columns="j", values="c").fillna(0.0).sort_index()
        c = c[c.index]
        values, vectors = np.linalg.eigh(c.to_numpy())
        out = []
        for j in range(min(k, len(c))):
            v = vectors[:, -1 - j]
            v = v * np.sign(v[np.argmax(np.abs(v))])
            out += [(name, j, float(z), float(values[-1 - j] / values.sum())) for name, z in zip(c.index, v, strict=True)]
        return pd.DataFrame(out, columns=[item, "component", "loading", "share"])

    kind = dict(rows.dtypes)[item]
    return pairs.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, f"{item} {kind}, component int, loading double, share double")


def _start(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative start from the singular vectors' positive or negative parts, whichever are larger, zeros at the mean."""
    u, s, wt = np.linalg.svd(v, full_matrices=False)
    w, h = np.zeros((len(v), k)), np.zeros((k, v.shape[1]))
    for j in range(min(k, len(s))):
        parts = [(np.maximum(sign * u[:, j], 0), np.maximum(sign * wt[j], 0)) for sign in (1, -1)]
        a, b = max(parts, key=lambda x: np.linalg.norm(x[0]) * np.linalg.norm(x[1]))
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        if na > 0 and nb > 0:
            w[:, j], h[j] = np.sqrt(s[j] * na * nb) * a / na, np.sqrt(s[j] * na * nb) * b / nb
    mean = v.mean()
    w[w == 0], h[h == 0] = mean, mean
    return w, h


def factorise(v: np.ndarray, k: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(W, H), both non-negative, that bring WH near V by multiplicative updates of the squared error."""
    w, h = _start(v, k)
    for _ in range(steps):
        h *= (w.T @ v) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (v @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
    return w, h


def heldout_error(v: np.ndarray, k: int, steps: int = 200, seed: int = 7) -> float:
    """Relative error of a fifth of the rows, projected on factors of the others."""
    order = np.random.default_rng(seed).permutation(len(v))
    cut = int(0.8 * len(v))
    _, h = factorise(v[order[:cut]], k, steps)
    rest = v[order[cut:]]
    w = np.full((len(rest), k), max(rest.mean(), 1e-6))
    for _ in range(steps):
        w *= (rest @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
    return float(np.linalg.norm(rest - w @ h) / max(np.linalg.norm(rest), 1e-12))


def nmf(rows: DataFrame, period: str, row: str, item: str, value: str, k: int | None = None, grid: tuple[int, ...] = (2, 3, 4, 6, 8), first: int = 8, steps: int = 200) -> DataFrame:
    """(period, item, factor, loading, row_weight, error): non-negative factors of each period's row-by-item shares.

    Without ``k``, their number is the smallest of ``grid`` whose held-out error, meant over the
    ``first`` periods, is within a fiftieth of the best.  Each period is one task, which holds its
    matrix: rows times items times 8 bytes.  row_weight is the factor's sum over rows.
    """
    kinds = dict(rows.dtypes)
    slim = rows.groupBy(period, row, item).agg(F.sum(value).alias(value))

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.pivot(index=row, columns=item, values=value).fillna(0.0).sort_index().sort_index(axis=1)

    if k is None:
        early = slim.select(period).distinct().orderBy(period).limit(first)

        def errors(pdf: pd.DataFrame) -> pd.DataFrame:
            v = matrix(pdf).to_numpy()
            return pd.DataFrame([(j, heldout_error(v, j, steps)) for j in grid if len(v) >= 5 and j <= min(v.shape)], columns=["k", "error"])

        found = {r.k: r.error for r in slim.join(F.broadcast(early), period).groupBy(period).applyInPandas(errors, "k int, error double").groupBy("k").agg(F.avg("error").alias("error")).collect()}
        k = min((j for j, e in found.items() if e <= 1.02 * min(found.values())), default=grid[0])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        v = matrix(pdf)
        w, h = factorise(v.to_numpy(), min(k, *v.shape), steps)
        error = float(np.linalg.norm(v.to_numpy() - w @ h) / max(np.linalg.norm(v.to_numpy()), 1e-12))
        order = np.argsort(-h.sum(axis=1), kind="stable")
        out = [(pdf[period].iloc[0], name, j, float(h[f, i]), float(w[:, f].sum()), error) for i, name in enumerate(v.columns) for j, f in enumerate(order)]
        return pd.DataFrame(out, columns=[period, item, "factor", "loading", "row_weight", "error"])

    return slim.groupBy(period).applyInPandas(solve, f"{period} {kinds[period]}, {item} {kinds[item]}, factor int, loading double, row_weight double, error double")


def ipca(rows: DataFrame, period: str, characteristics: list[str], ret: str, k: int = 2, steps: int = 200) -> DataFrame:
    """(characteristic, factor, loading, r2): instrumented factors by alternating least squares on per-period moments Z'Z/n and Z'r/n."""
    z = characteristics
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    moments = rows.dropna(subset=[*z, ret]).groupBy(period).agg(F.count("*").alias("n"), *[F.avg(F.col(z[i]) * F.col(z[j])).alias(f"w{i}_{j}") for i, j in pairs], *[F.avg(F.col(c) * F.col(ret)).alias(f"x{i}") for i, c in enumerate(z)])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(period)
        t, m = len(pdf), len(z)
        w = np.zeros((t, m, m))
        for i, j in pairs:
            w[:, i, j] = w[:, j, i] = pdf[f"w{i}_{j}"]
        x, n = pdf[[f"x{i}" for i in range(m)]].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float)
        u, _, _ = np.linalg.svd(x.T @ x)
        gamma = u[:, :k]
        for _ in range(steps):
            f = np.stack([np.linalg.lstsq(gamma.T @ w[s] @ gamma, gamma.T @ x[s], rcond=None)[0] for s in range(t)])
            a = sum(n[s] * np.kron(w[s], np.outer(f[s], f[s])) for s in range(t))
            b = sum(n[s] * np.outer(x[s], f[s]).ravel() for s in range(t))
            new = np.linalg.lstsq(a, b, rcond=None)[0].reshape(m, k)
            q, r = np.linalg.qr(new)
            q = q * np.sign(np.where(q[np.abs(q).argmax(axis=0), range(k)] == 0, 1, q[np.abs(q).argmax(axis=0), range(k)]))
            done = np.abs(q - gamma).max() < 1e-10
            gamma = q
            if done:
                break
        fit = sum(n[s] * (2 * x[s] @ gamma @ f[s] - f[s] @ gamma.T @ w[s] @ gamma @ f[s]) for s in range(t))
        base = sum(n[s] * (x[s] @ x[s]) for s in range(t))
        return pd.DataFrame([(c, j, float(gamma[i, j]), float(fit / base)) for i, c in enumerate(z) for j in range(k)], columns=["characteristic", "factor", "loading", "r2"])

    return moments.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, "characteristic string, factor int, loading double, r2 double")


def ridge_walk_forward(rows: DataFrame, period: str, key: str, xs: list[str], y: str, penalty: float = 1.0) -> DataFrame:
    """``rows`` with ``forecast``: ridge fitted on strictly earlier periods, from running sums of per-period moments."""
    from pyspark.sql import Window

    names = ["_one", *xs]
    data = rows.withColumn("_one", F.lit(1.0)).dropna(subset=xs)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    known = F.col(y).isNotNull()
    sums = data.groupBy(period).agg(*[F.sum(F.when(known, F.col(names[i]) * F.col(names[j]))).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(F.col(c) * F.col(y)).alias(f"b{i}") for i, c in enumerate(names)])
    past = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(period, *[F.sum(c).over(past).alias(c) for c in sums.columns if c != period])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(m: pd.DataFrame) -> pd.Series:
        out = []
        for row in m.to_numpy(dtype=float):
            if np.isnan(row).any():
                out.append(None)
                continue
            k = len(names)
            a = np.zeros((k, k))
            for v, (i, j) in zip(row, pairs, strict=False):
                a[i, j] = a[j, i] = v
            eye = np.eye(k) * penalty
            eye[0, 0] = 0
            out.append(np.linalg.lstsq(a + eye, row[len(pairs) :], rcond=None)[0].tolist())
        return pd.Series(out)

    columns = [c for c in sums.columns if c != period]
    beta = sums.select(period, solve(F.struct(*columns)).alias("_beta"))
    return data.join(beta, period).withColumn("forecast", sum(F.col(c) * F.col("_beta")[i] for i, c in enumerate(names))).drop("_beta", "_one")


def ica(rows: DataFrame, row: str, item: str, value: str, k: int = 4, steps: int = 500, seed: int = 1) -> DataFrame:
    """(row, component, source, kurtosis, ar1, kind): independent components of the rows' k leading principal scores.

    Scores are summed by Spark; one task holds a row of k numbers per period.  The two
    sources of highest kurtosis are ``forced``, of the rest the two of most persistence
    ``informed``.  Signs make each source's skewness positive.
    """
    loadings = pca(rows, row, item, value, k).select(item, "component", "loading")
    mean = rows.groupBy(item).agg(F.avg(value).alias("_m"))
    scores = rows.join(mean, item).join(loadings, item).groupBy(row, "component").agg(F.sum((F.col(value) - F.col("_m")) * F.col("loading")).alias("score"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index=row, columns="component", values="score").fillna(0.0).sort_index()
        z = x.to_numpy() - x.to_numpy().mean(axis=0)
        values, vectors = np.linalg.eigh(z.T @ z / len(z))
        keep = values > max(values.max(), 0.0) * 1e-10
        z = z @ vectors[:, keep] / np.sqrt(values[keep])
        m = z.shape[1]
        u, _, v = np.linalg.svd(np.random.default_rng(seed).normal(size=(m, m)))
        w = u @ v
        for _ in range(steps):
            g = np.tanh(z @ w.T)
            u, _, v = np.linalg.svd(g.T @ z / len(z) - np.diag((1 - g * g).mean(axis=0)) @ w)
            new = u @ v
            done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max(initial=0.0) < 1e-10
            w = new
            if done:
                break
        s = z @ w.T
        s = s * np.where((s**3).mean(axis=0) < 0, -1.0, 1.0)
        kurtosis, ar1 = (s**4).mean(axis=0) - 3, (s[1:] * s[:-1]).mean(axis=0)
        order = np.argsort(-kurtosis)
        informed = sorted(order[2:], key=lambda c: -abs(ar1[c]))[:2]
        kind = {c: "forced" if c in order[:2] else "informed" if c in informed else "other" for c in range(m)}
        return pd.DataFrame([(t, j, float(s[i, c]), float(kurtosis[c]), float(ar1[c]), kind[c]) for j, c in enumerate(order) for i, t in enumerate(x.index)], columns=[row, "component", "source", "kurtosis", "ar1", "kind"])

    kind_ = dict(rows.dtypes)[row]
    return scores.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, f"{row} {kind_}, component int, source double, kurtosis double, ar1 double, kind string")


def gls_weights(rows: DataFrame, row: str, item: str, value: str, shrink: float = 0.25, by: str = "one") -> DataFrame:
    """(by, row, weight): C⁻¹1 for the rows' cosines C within each ``by``, shrunk to the identity by ``shrink``.

    With unit rows U, C = UU', so the inverse needs only the items' Gram matrix U'U, solved in
    one task per ``by``; rows, however many, stay distributed.  Rows of zeros have no weight.
    """
    rows = rows if by in rows.columns else rows.withColumn(by, F.lit(1))
    norm = rows.groupBy(by, row).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_n")).where("_n > 0")
    unit = rows.join(norm, [by, row]).select(by, row, item, (F.col(value) / F.col("_n")).alias("u")).where("u <> 0")
    same = (F.col(f"a.{row}") == F.col(f"b.{row}")) & (F.col(f"a.{by}") == F.col(f"b.{by}"))
    pairs = unit.alias("a").join(unit.alias("b"), same).groupBy(F.col(f"a.{by}").alias(by), F.col(f"a.{item}").alias("i"), F.col(f"b.{item}").alias("j"))
    pairs = pairs.agg(F.sum(F.col("a.u") * F.col("b.u")).alias("c"), F.sum(F.when(F.col(f"a.{item}") == F.col(f"b.{item}"), F.col("a.u"))).alias("s"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot(index="i", columns="j", values="c").fillna(0.0).sort_index()
        c = c[c.index]
        s = pdf[pdf["i"] == pdf["j"]].set_index("i")["s"].reindex(c.index).to_numpy(dtype=float)
        return pd.DataFrame({by: pdf[by].iloc[0], item: c.index, "_x": np.linalg.solve(c.to_numpy() + shrink / (1 - shrink) * np.eye(len(c)), s)})

    kinds = dict(rows.dtypes)
    x = pairs.groupBy(by).applyInPandas(solve, f"{by} {kinds[by]}, {item} {kinds[item]}, _x double")
    return unit.join(x, [by, item]).groupBy(by, row).agg(((1 - F.sum(F.col("u") * F.col("_x"))) / shrink).alias("weight"))


def tree_walk_forward(rows: DataFrame, period: str, xs: list[str], y: str, refit: int = 8, seed: int = 1) -> DataFrame:
    """``rows`` with forecasts of a forest and of boosted trees, fitted on strictly earlier periods, and their mean rank.

    The driver loops over blocks of ``refit`` periods, never over rows.  Rows before the
    first block and rows with a null regressor are left out.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    from .crosssection import pct_rank

    data = VectorAssembler(inputCols=xs, outputCol="_x").transform(rows.dropna(subset=xs))
    first, last = data.agg(F.min(period), F.max(period)).first()
    models = {"forest": RandomForestRegressor(featuresCol="_x", labelCol=y, numTrees=20, maxDepth=4, seed=seed), "boosted": GBTRegressor(featuresCol="_x", labelCol=y, maxIter=10, maxDepth=3, seed=seed)}
    out = None
    for start in [] if first is None else range(first + refit, last + 1, refit):
        past = data.where((F.col(period) < start) & F.col(y).isNotNull())
        block = data.where(F.col(period).between(start, start + refit - 1))
        for name, model in models.items():
            block = model.setPredictionCol(name).fit(past).transform(block)
        out = block if out is None else out.unionByName(block)
    if out is None:
        return rows.limit(0).select("*", *[F.lit(None).cast("double").alias(c) for c in (*models, "ensemble")])
    return out.drop("_x").withColumn("ensemble", (pct_rank(F.col("forest"), [period]) + pct_rank(F.col("boosted"), [period])) / 2)


def correlation_groups(rows: DataFrame, row: str, item: str, value: str, number: int = 4) -> DataFrame:
    """(item, group, weight): items joined greedily by the highest mean correlation until ``number`` groups are left; within a group weights follow positive Sharpe ratios.

    Correlations and Sharpe ratios come from Spark; one task holds a number per pair of items.
    """
    x = rows.where(F.col(value).isNotNull()).select(row, item, F.col(value).alias("x"))
    corr = x.alias("a").join(x.alias("b"), F.col(f"a.{row}") == F.col(f"b.{row}")).groupBy(F.col(f"a.{item}").alias("i"), F.col(f"b.{item}").alias("j")).agg(F.corr("a.x", "b.x").alias("c"))
    sharpe = x.groupBy(F.col(item).alias("i")).agg(F.try_divide(F.avg("x"), F.stddev_samp("x")).alias("s"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot(index="i", columns="j", values="c").fillna(0.0).sort_index()
        c = c[c.index]
        m, s = c.to_numpy(), pdf.groupby("i")["s"].first().reindex(c.index).fillna(0.0).clip(lower=0).to_numpy()
        groups = [[k] for k in range(len(m))]
        while len(groups) > max(number, 1):
            _, a, b = max((m[np.ix_(g, h)].mean(), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
            groups[-a] += groups.pop(-b)
        return pd.DataFrame([(c.index[k], n, float(s[k] / s[g].sum()) if s[g].sum() > 0 else 1.0 / len(g)) for n, g in enumerate(groups) for k in g], columns=[item, "group", "weight"])

    return corr.join(sharpe, "i").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, f"{item} {dict(rows.dtypes)[item]}, `group` int, weight double")
