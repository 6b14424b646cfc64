"""Principal components fitted on a reference side and applied to both."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal_components(reference: DataFrame, columns: list[str], k: int = 2) -> dict:
    """mean, scale (population deviation, 1 for a constant), axes (k x columns) and variances.

    One aggregation gives the covariance; only columns squared numbers reach the driver.  Each axis points
    so that its largest loading is positive.
    """
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = reference.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    scale = np.sqrt(np.diag(cov))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return {"columns": columns, "mean": np.array([row[f"m{i}"] or 0.0 for i in range(d)]), "scale": scale, "axes": axes, "variance": values[order]}


def projected(df: DataFrame, fit: dict, keep: list[str]) -> DataFrame:
    """keep and pc1..pck."""
    out = []
    for n, axis in enumerate(fit["axes"]):
        terms = [(F.col(c) - float(m)) / float(s) * float(a) for c, m, s, a in zip(fit["columns"], fit["mean"], fit["scale"], axis)]
        out.append(sum(terms[1:], terms[0]).alias(f"pc{n + 1}"))
    return df.select(*keep, *out)
