"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, so counts, sums and deviations are exact. The vectors,
less their mean, are the rows of a matrix X that only exists in blocks on the shared
folder. The bidiagonalisation alternates products Xv and X'u: a pass over the blocks
forms p = Xh and at once X'p and p'p, and only these d + 1 numbers come back. The left
vectors u = Xg are kept by their g in d numbers each, with X'u beside them. So they are
reorthogonalised against all earlier ones without a table of n rows, as the right ones
are. The singular values and right vectors of the small bidiagonal matrix give
components and deviations.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgate.llm.common import materialize

# How an entry becomes a whole number.
STEPS, OFFSET = 64, 1_000_000

# Production parameters: components, vectors of a block, blocks' bytes of a partition,
# relative size below which a singular value counts as zero, and convergence.
COMPONENTS, BLOCK, PARTITION = 32, 1024, 4 << 20
ZERO, CONVERGED = 1e-12, 1e-15


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """``floor(64 c)`` of double entries; beyond 62 bits the nearest such number."""
    return np.clip(np.floor(STEPS * vectors), -(2.0**62), 2.0**62).astype(np.int64)


def _usable(column):
    """Mask of the rows with a vector, not empty, without null or non-finite entry; matrices."""
    lengths = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten()
    entries = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy()
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    ends = np.cumsum(lengths)
    usable = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    return usable, lengths, ends, entries


def _matrix(column):
    usable, lengths, ends, entries = _usable(column)
    kept = np.flatnonzero(usable)
    sizes = set(lengths[kept].tolist())
    if len(sizes) > 1:
        raise ValueError(f"embeddings of different lengths: {sorted(sizes)}")
    d = sizes.pop() if sizes else 0
    rows = (ends[kept] - d)[:, None] + np.arange(d)
    return kept, whole_numbers(entries[rows].reshape(len(kept), d))


def blocks(vectors: DataFrame) -> DataFrame:
    """``d, block``: the usable vectors as whole numbers, up to ``BLOCK`` rows together."""

    def run(batches):
        for batch in batches:
            _, z = _matrix(batch.column("embedding"))
            parts = [z[i : i + BLOCK] for i in range(0, len(z), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.shape[1] for p in parts], pa.int32()),
                 pa.array([p.tobytes() for p in parts], pa.binary())],
                ["d", "block"],
            )

    return vectors.select("embedding").mapInArrow(run, "d int, block binary")


def _each_block(rows, work, width):
    """Sum over all blocks of what ``work`` makes of a block's matrix: ``width`` doubles.

    Every task adds its blocks up before the shuffle; ``width`` numbers reach the driver.
    """

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            for d, block in zip(batch.column("d").to_pylist(), batch.column("block")):
                total += work(np.frombuffer(block.as_buffer(), np.int64).reshape(-1, d))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width), pa.int32()), pa.array(total)], ["i", "s"]
        )

    sums = rows.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    out = np.zeros(width)
    for i, s in sums.collect():
        out[i] = s
    return out


def exact_sums(rows: DataFrame) -> tuple[int, int, np.ndarray, int]:
    """``n, d``, the sum of every dimension and the sum of all squares, exactly.

    Blocks with numbers above 2^25 in size are added as Python integers.
    """

    def run(batches):
        found: dict = {}
        for batch in batches:
            for d, block in zip(batch.column("d").to_pylist(), batch.column("block")):
                z = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, d)
                wide = z if int(np.abs(z).max(initial=0)) < 2**25 else z.astype(object)
                n, sums, squares = found.get(d, (0, np.zeros(d, object), 0))
                found[d] = (n + len(z), sums + wide.sum(axis=0).astype(object),
                            squares + int((wide * wide).sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()),
             pa.array([n for n, _, _ in found.values()], pa.int64()),
             pa.array([[str(s) for s in sums] for _, sums, _ in found.values()],
                      pa.list_(pa.string())),
             pa.array([str(squares) for _, _, squares in found.values()], pa.string())],
            ["d", "n", "sums", "squares"],
        )

    # Text is cast to a decimal with room for 10^38 in all.
    part = rows.mapInArrow(run, "d int, n long, sums array<string>, squares string")
    sized = part.groupBy("d").agg(
        F.sum("n"), F.sum(F.col("squares").cast("decimal(38,0)"))
    ).collect()
    if len(sized) > 1:
        raise ValueError(f"embeddings of different lengths: {sorted(r[0] for r in sized)}")
    if not sized:
        return 0, 0, np.zeros(0, object), 0
    by_place = part.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    )
    sums = np.array([int(r["s"]) for r in sorted(by_place.collect())], object)
    return sized[0][1], sized[0][0], sums, int(sized[0][2])


def _centred(z, low, rest):
    """``z`` less the mean, which is the whole number ``low`` plus ``rest`` below 1."""
    return (z - low).astype(np.float64) - rest


def _orthogonal(vector, basis):
    """``vector`` without its part in the orthonormal rows of ``basis``, taken out twice."""
    for _ in range(2):
        vector = vector - basis.T @ (basis @ vector)
    return vector


def bidiagonalise(product, d: int, wanted: int, seed: int = 7):
    """Leading singular values and right vectors (as columns) of a matrix of ``d`` columns.

    ``product(h)`` gives ``X'Xh`` and ``|Xh|^2`` from one pass. Steps go on until the
    ``wanted`` leading triplets have converged or the space is used up; where it closes
    early, a new direction starts, so that repeated singular values are all found.
    """
    noise = np.random.default_rng(seed)
    start = noise.standard_normal(d)
    right, left, images = [start / np.linalg.norm(start)], [], []
    alphas, betas, scale = [], [], 0.0
    while True:
        v = right[-1]
        h = v - betas[-1] * left[-1] if left and betas[-1] else v.copy()
        image, square = product(h)
        if left:
            g, y = np.array(left), np.array(images)
            for _ in range(2):
                part = g @ image
                h, image = h - part @ g, image - part @ y
                if np.abs(part).max() > 1e-8 * math.sqrt(max(square, 0.0)):
                    # Much was taken out: a fresh pass keeps the product exact.
                    image, square = product(h)
                else:
                    square = max(square - 2 * float(part @ part), 0.0)
        alpha = math.sqrt(max(square, 0.0))
        scale = max(scale, alpha)
        if alpha > ZERO * scale:
            left.append(h / alpha)
            images.append(image / alpha)
            following = images[-1] - alpha * v
        else:
            alpha = 0.0
            left.append(np.zeros(d))
            images.append(np.zeros(d))
            following = np.zeros(d)
        alphas.append(alpha)
        following = _orthogonal(following, np.array(right))
        beta = float(np.linalg.norm(following))
        k = len(alphas)
        small = np.diag(alphas) + np.diag(betas, 1)
        rows, values, columns = np.linalg.svd(small)
        closed = beta <= ZERO * scale
        # What the next step could still move: beta times the last entry of each left vector.
        open_ends = np.abs((0.0 if closed else beta) * rows[-1, :wanted])
        if k == d or (k >= wanted and not closed and open_ends.max() <= CONVERGED * scale):
            break
        betas.append(0.0 if closed else beta)
        if closed:
            following = _orthogonal(noise.standard_normal(d), np.array(right))
            beta = np.linalg.norm(following)
        right.append(_orthogonal(following / beta, np.array(right)))
        right[-1] /= np.linalg.norm(right[-1])
    return values[:wanted], (columns @ np.array(right))[:wanted].T


class Whitening:
    """Mean, components (as columns) with their eigenvalues, and the exact statistics."""

    def __init__(self, n, sums, low, rest, components, eigenvalues, explained, error):
        self.n, self.sums, self.low, self.rest = n, sums, low, rest
        self.components, self.eigenvalues = components, eigenvalues
        self.explained, self.error = explained, error


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """The blocks of the usable vectors and the whitening fitted on all of them."""
    written = materialize(blocks(vectors), "vectors")
    n, d, sums, squares = exact_sums(written)
    if not n:
        empty = np.zeros(0)
        return written, Whitening(0, sums, empty, empty, np.zeros((0, 0)), empty, empty, 0.0)
    tasks = max(1, -(-n * d * 8 // PARTITION))
    rows = materialize(written.repartition(tasks), "blocks")
    low = np.array([s // n for s in sums], object)
    rest = np.array([(s - l * n) / n for s, l in zip(sums, low)], np.float64)
    low = low.astype(np.int64)

    def product(h):
        def work(z):
            x = _centred(z, low, rest)
            p = x @ h
            return np.concatenate([x.T @ p, [p @ p]])

        out = _each_block(rows, work, d + 1)
        return out[:-1], float(out[-1])

    values, found = bidiagonalise(product, d, min(components, d))
    real = values > ZERO * max(values[0], 1.0)
    eigenvalues = values[real] ** 2 / n
    found = found[:, real]
    # Trace of the covariance, out of whole numbers.
    spread = n * squares - sum(int(s) * int(s) for s in sums)
    explained = eigenvalues * n / (spread / n) if spread else eigenvalues
    k = len(eigenvalues)
    scaled = found / np.sqrt(eigenvalues)

    def work(z):
        whitened = _centred(z, low, rest) @ scaled
        return np.concatenate([(whitened.T @ whitened).ravel(), whitened.sum(axis=0)])

    error = 0.0
    if k:
        out = _each_block(rows, work, k * k + k)
        mean = out[k * k :] / n
        covariance = out[: k * k].reshape(k, k) / n - np.outer(mean, mean)
        error = float(np.abs(covariance - np.eye(k)).max())
    return written, Whitening(n, sums, low, rest, found, eigenvalues, explained, error)


def _deviations(z, n, sums):
    """Sum over the dimensions of ``(n z - S)^2``, exactly; more than 63 bits are an error."""
    most = n * int(np.abs(z).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if most * most * max(1, z.shape[1]) < 2**63:
        shifted = n * z - sums.astype(np.int64)
        return (shifted * shifted).sum(axis=1)
    shifted = z.astype(object) * n - sums
    return (shifted * shifted).sum(axis=1)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per usable vector and component the whitened value, beside what describes the fit.

    ``vec_id, component, n, deviation, whitened, explained, identity_error``. Left out are
    rows whose embedding is null, empty, or holds a null or a number that is not finite;
    vectors of different lengths are an error. Repeated rows count and come out each time,
    rows without id with a null id, ids are not compared. Components stop where the vectors
    span no further dimension, so equal vectors, a single one or an empty table give no
    rows; equal eigenvalues come in either order. A deviation that no long can hold is an
    error. Other columns are not read.
    """
    _, fitted = fit(vectors, components)
    n, sums, low, rest = fitted.n, fitted.sums, fitted.low, fitted.rest
    k = len(fitted.eigenvalues)
    scaled = fitted.components / np.sqrt(fitted.eigenvalues) if k else None
    explained, error = fitted.explained, fitted.error
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            kept, z = _matrix(batch.column("embedding"))
            if not len(kept) or not k:
                continue
            ids = batch.column("vec_id").take(pa.array(np.repeat(kept, k)))
            m = len(kept)
            whitened = (_centred(z, low, rest) @ scaled).ravel()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n, np.int64)),
                 pa.array(np.repeat(_deviations(z, n, sums).astype(np.int64), k)),
                 pa.array(whitened), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained",
                 "identity_error"],
            )

    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)
