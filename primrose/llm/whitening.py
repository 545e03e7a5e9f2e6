"""Embedding whitening by incremental eigendecomposition.

Every partition keeps the spectrum of the rows it has seen and takes in new
ones by centred rank-one updates: the new eigenvalues are the roots of a secular
equation, after deflation. Spectra are combined by rank-one updates, too, in a
tree of small groups. A Rayleigh-Ritz pass over all rows refines the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primrose.llm.common import kept_table
from primrose.llm.negatives import usable
from primrose.session import ship_package

BLOCK_ROWS = 4096
FAN = 16  # spectra combined by one task
PASSES = 4  # Rayleigh-Ritz passes at most
ROOT_STEPS = 60
EPS = np.finfo(np.float64).eps
LONG = 2**63 - 1


class Spectrum(NamedTuple):
    """Scatter about the mean of ``n`` rows: ``basis * diag(values) * basis'``."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray


def nothing(width: int) -> Spectrum:
    return Spectrum(0, np.zeros(width), np.zeros(width), np.eye(width))


def secular_roots(d: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum w2 / (d - root), one above each rising pole ``d``.

    Returns the origin (the nearer pole) and the offset of each root from it, so
    that differences from poles keep full precision. Each step fits a rational
    function with the two poles around a root (the middle way); what leaves the
    bracket is halved instead.
    """
    m = len(d)
    upper = np.append(d[1:], d[-1] + w2.sum())
    middle = (d + upper) / 2
    at_middle = 1 + (w2[:, None] / (d[:, None] - middle[None, :])).sum(0)
    left = (at_middle >= 0) | (np.arange(m) == m - 1)
    origin = np.where(left, d, upper)
    gap = upper - d
    half = np.where(np.arange(m) == m - 1, gap, gap / 2)
    low, high = np.where(left, 0.0, -half), np.where(left, half, 0.0)
    delta = d[:, None] - origin[None, :]
    below = np.arange(m)[:, None] <= np.arange(m)[None, :]
    pole, after = d - origin, upper - origin
    t = (low + high) / 2
    for _ in range(ROOT_STEPS):
        gaps = delta - t[None, :]
        terms = w2[:, None] / gaps
        slopes = terms / gaps
        f = 1 + terms.sum(0)
        error = m * EPS * (1 + np.abs(terms).sum(0))
        low, high = np.where(f < 0, t, low), np.where(f >= 0, t, high)
        done = (np.abs(f) <= error) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        near, far = pole - t, after - t
        under = np.where(below, slopes, 0).sum(0)
        c = f - near * under - far * (slopes.sum(0) - under)
        a = (near + far) * f - near * far * slopes.sum(0)
        b = near * far * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        moved = t + step
        inside = np.isfinite(moved) & (moved > low) & (moved < high)
        t = np.where(done, t, np.where(inside, moved, (low + high) / 2))
    return origin, t


def rank_one(values: np.ndarray, basis: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of ``basis * diag(values) * basis' + z z'``."""
    w = basis.T @ z
    weight = float(w @ w)
    if weight == 0.0:
        return values, basis
    order = np.argsort(values, kind="stable")
    values, basis, w = values[order], basis[:, order], w[order]
    small = 8 * EPS * max(abs(values[-1]), abs(values[0]), weight)
    # Deflation: within a run of equal values one reflection leaves one weight.
    edges = np.flatnonzero(np.append(np.diff(values) > small, True)) + 1
    start = 0
    for end in edges:
        if end - start > 1:
            part = w[start:end].copy()
            length = np.linalg.norm(part)
            u = part.copy()
            u[-1] += length if part[-1] >= 0 else -length
            size = float(u @ u)
            if size > 0 and length > 0:
                some = basis[:, start:end]
                basis[:, start:end] = some - np.outer(some @ u, u) * (2 / size)
                w[start:end] = 0.0
                w[end - 1] = -length if part[-1] >= 0 else length
        start = end
    # Deflation: what the new direction hardly touches stays.
    live = np.abs(w) * weight**0.5 > small
    if not live.any():
        return values, basis
    d, wl = values[live], w[live]
    origin, offset = secular_roots(d, wl * wl)
    gaps = (d[:, None] - origin[None, :]) - offset[None, :]
    # Weights for which these roots are exact make the vectors orthogonal.
    m = len(d)
    poles = d[:, None] - d[None, :]
    np.fill_diagonal(poles, 1.0)
    ratio = -gaps.copy()
    inner = ratio[:, :-1] / np.where(np.arange(m)[:, None] > np.arange(m - 1)[None, :], -poles[:, :-1], -poles[:, 1:])
    exact = np.sqrt(np.abs(inner.prod(1) * ratio[:, -1]))
    vectors = np.copysign(exact, wl)[:, None] / gaps
    vectors /= np.linalg.norm(vectors, axis=0)
    new_values, new_basis = values.copy(), basis.copy()
    new_values[live] = origin + offset
    new_basis[:, live] = basis[:, live] @ vectors
    return new_values, new_basis


def shifted(a: Spectrum, n: int, mean: np.ndarray) -> Spectrum:
    """``a`` with ``n`` more rows of ``mean``: the update of the means."""
    gap, all_rows = mean - a.mean, a.n + n
    values, basis = rank_one(a.values, a.basis, gap * (a.n * n / all_rows) ** 0.5)
    return Spectrum(all_rows, a.mean + gap * (n / all_rows), values, basis)


def with_rows(a: Spectrum, rows: np.ndarray) -> Spectrum:
    """``a`` and more rows. A block is centred and turned, by an orthogonal
    transformation, into at most as many rows as it has columns; each of these
    is one rank-one update, and the shift of the mean is another."""
    mean = rows.mean(0)
    turned = np.linalg.qr(rows - mean, mode="r")
    values, basis = a.values, a.basis
    for z in turned:
        values, basis = rank_one(values, basis, z)
    return shifted(a._replace(values=values, basis=basis), len(rows), mean)


def combined(a: Spectrum, b: Spectrum) -> Spectrum:
    """Both spectra as one: the pairs of ``b`` are updates of ``a``."""
    values, basis = a.values, a.basis
    for value, vector in zip(b.values, b.basis.T, strict=True):
        if value > 0:
            values, basis = rank_one(values, basis, vector * value**0.5)
    return shifted(a._replace(values=values, basis=basis), b.n, b.mean)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.values
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for b in batches:
        x = _matrix(b.column("x"), width)
        for at in range(0, len(x), BLOCK_ROWS):
            yield x[at : at + BLOCK_ROWS]


def _summed(x: DataFrame, width: int, cells: int, of_block) -> np.ndarray:
    """Sum over all rows of an array of ``cells`` numbers per block; each
    partition sends one row for each number, and these are added by number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for block in _blocks(batches, width):
            total += of_block(block.astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(range(cells), pa.int32()), pa.array(total)], ["cell", "value"])

    rows = x.mapInArrow(add, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(cells)
    for r in rows:
        out[r["cell"]] = r["value"]
    return out


_SPECTRUM = "part int, n long, sums array<decimal(38,0)>, mean array<double>, values array<double>, basis array<double>"


def _as_batch(part: int, sums: list[int], s: Spectrum) -> pa.RecordBatch:
    one = {
        "part": pa.array([part], pa.int32()),
        "n": pa.array([s.n], pa.int64()),
        "sums": pa.array([[Decimal(v) for v in sums]], pa.list_(pa.decimal128(38, 0))),
        "mean": pa.array([s.mean]),
        "values": pa.array([s.values]),
        "basis": pa.array([s.basis.ravel()]),
    }
    return pa.RecordBatch.from_arrays(list(one.values()), list(one))


def fit_spectrum(x: DataFrame, width: int) -> tuple[int, list[int], Spectrum] | None:
    """Number of rows, exact sums of columns and spectrum of ``x`` (``x``: long
    vectors of ``width``); ``None`` without rows. One spectrum for each partition
    is written; groups of ``FAN`` are combined until one is left, so neither a
    task nor the driver holds more than a few of them."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, sums = nothing(width), [0] * width
        for block in _blocks(batches, width):
            s = with_rows(s, block.astype(np.float64))
            most = int(np.abs(block.astype(np.float64)).max(initial=0.0)) * len(block)
            part = block.sum(0) if most < LONG else block.astype(object).sum(0)
            sums = [a + int(b) for a, b in zip(sums, part, strict=True)]
        if s.n:
            yield _as_batch(TaskContext.get().partitionId(), sums, s)

    spectra = kept_table(x.select("x").mapInArrow(of_partition, _SPECTRUM), "spectra")
    highest = spectra.agg(F.max("part")).first()[0]
    if highest is None:
        return None

    def combine(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        s, sums = nothing(width), [0] * width
        for r in rows:
            basis = np.array(r["basis"]).reshape(width, width)
            s = combined(s, Spectrum(r["n"], np.array(r["mean"]), np.array(r["values"]), basis))
            sums = [a + int(b) for a, b in zip(sums, r["sums"], strict=True)]
        return pa.Table.from_batches([_as_batch(rows[0]["part"] // FAN, sums, s)])

    while True:
        grouped = spectra.groupBy((F.col("part") / FAN).cast("int").alias("grp"))
        spectra = kept_table(grouped.applyInArrow(combine, _SPECTRUM), "spectra")
        highest //= FAN
        if not highest:
            break
    r = spectra.first()
    basis = np.array(r["basis"]).reshape(width, width)
    whole = Spectrum(r["n"], np.array(r["mean"]), np.array(r["values"]), basis)
    return r["n"], [int(v) for v in r["sums"]], whole


def refined(x: DataFrame, width: int, mean: np.ndarray, n: int, basis: np.ndarray, components: int):
    """Eigenvalues (falling), unit vectors and trace of the covariance by
    Rayleigh-Ritz on ``basis``, repeated until the leading vectors stay."""
    upper = np.triu_indices(width)
    basis = np.linalg.qr(basis)[0]
    for _ in range(PASSES):

        def products(block: np.ndarray, basis=basis) -> np.ndarray:
            y = (block - mean) @ basis
            return (y.T @ y)[upper]

        h = np.zeros((width, width))
        h[upper] = _summed(x, width, len(upper[0]), products) / n
        h = h + np.triu(h, 1).T
        values, turn = np.linalg.eigh(h)
        values, turn = values[::-1], turn[:, ::-1]
        basis = np.linalg.qr(basis @ turn)[0]
        still = np.abs(np.abs(turn[:, :components]).max(0) - 1).max(initial=0.0)
        if still <= 16 * EPS:
            break
    return values, basis, float(np.trace(h))


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    components: int = 4,
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``:
    one row for each row and leading component.

    Entries become x = floor(scale * entry). The fit list is every distinct x
    vector once: ``n`` vectors with column sums S. ``deviation`` is the sum of
    (n * x - S) squared, exactly; beyond a long it is the largest long.
    ``whitened`` is x - S / n on the component over the root of its eigenvalue;
    ``explained`` the eigenvalue's share of the trace; ``identity_error`` the
    largest entry of the covariance of ``whitened`` over the fit list minus the
    identity, measured over all of it. Components are numbered from 1 by falling
    eigenvalue; the entry of largest size is positive.

    Rows whose vector is null or empty or holds null or non-finite entries are
    dropped, as are vectors of another length than the most frequent one. Zero
    vectors count. Null and repeated ids keep a row each. Entries beyond a long
    become its ends. An eigenvalue of zero (up to rounding) gives ``whitened``
    0 and takes no part in ``identity_error``; fewer dimensions than
    ``components`` give fewer components. An empty table gives an empty result.
    What reaches the driver is one spectrum and a matrix of the width squared.
    """
    ship_package(vectors.sparkSession)
    spark = vectors.sparkSession
    v = F.col(vector_col)
    rows = vectors.filter(usable(v)).select(
        F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x")
    )
    kind = rows.schema["id"].dataType.simpleString()
    out = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    widths = rows.groupBy(F.size("x").alias("w")).agg(F.count(F.lit(1)).alias("rows"))
    most = widths.orderBy(F.desc("rows"), "w").first()
    if most is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, {out}")
    width = most["w"]
    rows = rows.filter(F.size("x") == width)
    fit_list = kept_table(rows.select("x").distinct(), "fit-list")
    n, sums, spectrum = fit_spectrum(fit_list, width)
    mean = np.array([s / n for s in sums])
    top = min(components, width)
    values, basis, trace = refined(fit_list, width, mean, n, spectrum.basis, top)
    e, u = values[:top], basis[:, :top]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(top)] < 0, -1.0, 1.0)
    some = e > width * EPS * trace
    project = np.where(some, u / np.sqrt(np.where(some, e, 1.0)), 0.0)

    def moments(block: np.ndarray) -> np.ndarray:
        y = (block - mean) @ project
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    found = _summed(fit_list, width, top + top * top, moments) / n
    covariance = found[top:].reshape(top, top) - np.outer(found[:top], found[:top])
    error = float(np.abs(covariance - np.eye(top))[np.ix_(some, some)].max(initial=0.0))
    explained = e / trace if trace > 0 else np.zeros(top)
    wrapped = np.array([(s + 2**63) % 2**64 - 2**63 for s in sums], np.int64)
    about = np.array([float(s) for s in sums])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), width)
            near = x.astype(np.float64)
            # Whole numbers wrap at 2**64; a result below 2**63 is exact.
            gap = x * np.int64(n) - wrapped
            deviation = (gap * gap).sum(1)
            size = ((near * n - about) ** 2).sum(1)
            for i in np.flatnonzero(size > 9.2e18):
                whole = sum((n * int(c) - s) ** 2 for c, s in zip(x[i], sums, strict=True)) if size[i] < 9.3e18 else LONG
                deviation[i] = min(whole, LONG)
            white = (near - mean) @ project
            each = np.repeat(np.arange(len(x)), top)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n, np.int64)),
                    pa.array(np.repeat(deviation, top)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ],
                ["id", *[c.split()[0] for c in out.split(", ")]],
            )

    return rows.mapInArrow(apply, f"id {kind}, {out}").withColumnRenamed("id", id_col)
