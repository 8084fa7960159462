"""Linear models by sufficient statistics: one pass sums products of features, the driver solves a small system."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moments(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """Sums of the columns' pairwise products."""
    n = len(columns)
    row = df.agg(*[F.sum(columns[i] * columns[j]) for i in range(n) for j in range(i, n)]).first()
    out = np.zeros((n, n))
    at = iter(row)
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = next(at) or 0.0
    return out


def _dot(columns: list[Column], weights: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, w in zip(columns, weights.tolist(), strict=True):
        out = out + c * w
    return out


def first_component(df: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """(means, direction) of the first principal component; its largest part is positive."""
    m = _moments(df, [*[F.col(f).cast("double") for f in features], F.lit(1.0)])
    n, mean = m[-1, -1], m[-1, :-1] / max(m[-1, -1], 1)
    cov = m[:-1, :-1] / max(n, 1) - np.outer(mean, mean)
    direction = np.linalg.eigh(cov)[1][:, -1]
    direction *= np.sign(direction[np.abs(direction).argmax()])
    return mean.tolist(), direction.tolist()


def project(df: DataFrame, features: list[str], name: str = "pc1") -> DataFrame:
    """df with its first component, moved to [0, 1] by least and largest value."""
    mean, direction = first_component(df, features)
    score = _dot([F.col(f) - m for f, m in zip(features, mean, strict=True)], np.array(direction))
    low, high = df.agg(F.min(score), F.max(score)).first()
    return df.withColumn(name, (score - low) / F.lit((high - low) or 1.0))


def ridge(df: DataFrame, features: list[str], label: str, penalty: float = 1.0) -> list[float]:
    """Coefficients of ridge regression without intercept (what a linear kernel gives)."""
    m = _moments(df, [F.col(c).cast("double") for c in [*features, label]])
    return np.linalg.solve(m[:-1, :-1] + penalty * np.eye(len(features)), m[:-1, -1]).tolist()


def ridge_residuals(train: DataFrame, df: DataFrame, features: list[str], label: str, penalty: float = 1.0) -> DataFrame:
    """df with the absolute residual of the model fitted on train."""
    w = np.array(ridge(train, features, label, penalty))
    return df.withColumn("residual", F.abs(F.col(label) - _dot([F.col(f) for f in features], w)))


def gaussian_process(train: DataFrame, df: DataFrame, features: list[str], label: str, noise: float = 1.0, offset: float = 1.0) -> DataFrame:
    """df with ``mean`` and ``std`` of a Gaussian process with kernel x.y + offset ** 2 and white noise.

    Its posterior is that of Bayesian linear regression over the features and a constant, so a
    pass of products replaces the kernel matrix of all pairs.
    """
    own = lambda: [*[F.col(f).cast("double") for f in features], F.lit(float(offset))]
    m = _moments(train, [*own(), F.col(label).cast("double")])
    inverse = np.linalg.inv(m[:-1, :-1] / noise + np.eye(len(features) + 1))
    weights = inverse @ m[:-1, -1] / noise
    x = own()
    variance = F.lit(float(noise))
    for i, row in enumerate(inverse):
        variance = variance + x[i] * _dot(x, row)
    return df.withColumns({"mean": _dot(x, weights), "std": F.sqrt(variance)})


def _evidence(moments: np.ndarray, noise: np.ndarray, offset: float) -> np.ndarray:
    """Log-evidence at many noises of y ~ N(0, F F' + noise), where F are the features and ``offset``.

    ``moments`` are sums of products of features, 1 and y. The eigenvalues of F'F give the
    determinant and the quadratic form, so no matrix of all pairs of rows is made.
    """
    scale = np.append(np.ones(len(moments) - 2), offset)
    n, inner = moments[-2, -2], moments[:-1, :-1] * np.outer(scale, scale)
    values, vectors = np.linalg.eigh(inner)
    part = (vectors.T @ (moments[:-1, -1] * scale)) ** 2
    lam = np.maximum(values, 0)[:, None] + noise[None, :]
    square = (moments[-1, -1] - (part[:, None] / lam).sum(0)) / noise
    return -0.5 * (square + np.log(lam).sum(0) + (n - len(values)) * np.log(noise) + n * np.log(2 * np.pi))


def process_evidence(train: DataFrame, features: list[str], label: str, noises: list[float], offsets: list[float]) -> DataFrame:
    """(noise, offset, evidence): log-evidence of the linear kernel over a grid of its parameters, from one pass."""
    m = _moments(train, [*[F.col(f).cast("double") for f in features], F.lit(1.0), F.col(label).cast("double")])
    rows = [(float(n), float(o), float(e)) for o in offsets for n, e in zip(noises, _evidence(m, np.array(noises, float), o), strict=True)]
    return train.sparkSession.createDataFrame(rows, "noise double, offset double, evidence double")


def fit_process(train: DataFrame, features: list[str], label: str, low: float = 1e-5, high: float = 1e5) -> tuple[float, float, float]:
    """(noise, offset, evidence) of the largest evidence within bounds: one pass, then a grid that closes in on it."""
    m = _moments(train, [*[F.col(f).cast("double") for f in features], F.lit(1.0), F.col(label).cast("double")])
    ends = np.log([low, high])
    spans, best = [ends, ends], (0.0, 0.0, -np.inf)
    for turn in range(12):
        k = 61 if turn == 0 else 13
        noises, offsets = (np.exp(np.linspace(*s, k)) for s in spans)
        table = np.array([_evidence(m, noises, o) for o in offsets])
        i, j = np.unravel_index(np.nanargmax(table), table.shape)
        if table[i, j] > best[2]:
            best = (float(noises[j]), float(offsets[i]), float(table[i, j]))
        step = [(s[1] - s[0]) / (k - 1) * 2 for s in spans]
        spans = [np.clip([np.log(b) - d, np.log(b) + d], *ends) for b, d in zip(best, step, strict=False)]
    return best


def nystroem(df: DataFrame, features: list[str], points: int, length: float, id_col: str = "id", name: str = "phi") -> tuple[DataFrame, list[str]]:
    """(df with features whose products approximate exp(-|x - y|^2 / (2 length^2)), their names).

    The kernel is exact on ``points`` rows, the lowest MD5 keys; with as many points as rows it is
    exact everywhere. A linear process over the features then is one with this kernel.
    """
    from ..semantics import md5_key

    if not points:
        return df, []
    own = [F.col(f).cast("double") for f in features]
    centres = np.array([list(r) for r in df.orderBy(md5_key("nystroem", id_col), id_col).limit(points).select(*own).collect()], float).reshape(-1, len(features))
    gram = np.exp(-((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2) / (2 * length**2))
    values, vectors = np.linalg.eigh(gram)
    kept = values > 1e-10 * max(values.max(initial=0), 1e-300)
    root = vectors[:, kept] / np.sqrt(values[kept])
    near = []
    for c in centres.tolist():
        square = F.lit(0.0)
        for x, v in zip(own, c, strict=True):
            square = square + (x - v) * (x - v)
        near.append(F.exp(-square / (2 * length**2)))
    names = [f"{name}{i}" for i in range(root.shape[1])]
    out = df.withColumns({f"_{name}{i}": c for i, c in enumerate(near)})
    return out.withColumns({n: _dot([F.col(f"_{name}{i}") for i in range(len(near))], root[:, j]) for j, n in enumerate(names)}).drop(*[f"_{name}{i}" for i in range(len(near))]), names


def rbf_process(df: DataFrame, by: str, features: list[str], label: str, train: str, length: float = 1.0, noise: float = 1.0) -> DataFrame:
    """(…, mean, std) by group with a squared-exponential kernel, from the group's rows where ``train`` is true.

    Each group (a seed's run, bounded by its steps) is solved in memory.
    """
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, fit = pdf[features].to_numpy(float), pdf[train].to_numpy(bool)
        kernel = lambda a, b: np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(2) / (2 * length**2))
        if not fit.any():
            return pdf.assign(mean=0.0, std=np.sqrt(1 + noise))
        k = np.linalg.inv(kernel(x[fit], x[fit]) + noise * np.eye(fit.sum()))
        cross = kernel(x, x[fit])
        rest = 1 + noise - np.einsum("ij,jk,ik->i", cross, k, cross)
        return pdf.assign(mean=cross @ k @ pdf[label].to_numpy(float)[fit], std=np.sqrt(np.maximum(rest, 0)))

    return df.groupBy(by).applyInPandas(solve, f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, mean double, std double")


def source_density(df: DataFrame, reference: DataFrame, features: list[str], bias: float) -> DataFrame:
    """df with ``density``: exp(bias * minmax(first component)), with component, range and sum of the reference table."""
    mean, direction = first_component(reference, features)
    score = _dot([F.col(f) - m for f, m in zip(features, mean, strict=True)], np.array(direction))
    low, high = reference.agg(F.min(score), F.max(score)).first()
    weight = F.exp(bias * (score - low) / F.lit((high - low) or 1.0))
    total = reference.agg(F.sum(weight)).first()[0]
    return df.withColumn("density", weight / F.lit(total))


def tilt_normaliser(universe: DataFrame, features: list[str], weights: list[float], lam: float) -> DataFrame:
    """(z): the sum of exp(lam * x.b) over a universe of points."""
    return universe.agg(F.sum(F.exp(lam * _dot([F.col(f) for f in features], np.array(weights)))).alias("z"))
