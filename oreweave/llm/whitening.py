"""Whitening of integer vectors by the exact characteristic polynomial of their scatter matrix.

1. The fit list is each distinct vector once. Tasks add up their vectors' sums and products in
   whole numbers of any size (products of short limbs are exact in double); one row per dimension
   is shuffled, so a task passes on a matrix and never vectors.
2. M = n * sum(x x') - S S' is n * n times the covariance, in whole numbers. Its characteristic
   polynomial is found modulo many primes, dealt over the cluster, each by reduction to
   Hessenberg form; Chinese remaindering gives the coefficients, as many primes as their bound needs.
3. All roots are real, so the sign changes of the polynomial moved to a point count the roots
   above it. Bisection isolates the leading roots and narrows them to `BITS` significant bits.
4. A component spans the null space of M - root: inverse iteration in decimals of so many digits
   that the nearest other root does not disturb it; equal roots share one orthonormal basis.

What the driver holds follows the dimension (its square), never the number of rows.

Defined results: null vectors and those with null or non-finite entries are left out, as are empty
ones (they have no component). Rows with a null id are whitened like others, repeated rows each.
Vectors of each length are fitted by themselves. A component without variance whitens to 0,
explains 0 and is left out of the identity error. Entries beyond a long are cut to it, and so
are deviations.
"""

from __future__ import annotations

import decimal
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.session import stored

from .common import id_in, id_out, query
from .vectors import embeddings, usable

LIMB = 18  # bits: a product of limbs summed over 2^17 rows is exact in double
ROWS = 1 << 16  # vectors multiplied at once
BITS = 256  # significant bits of a root
CELLS = 1 << 24  # most matrix cells on the driver: one length of 4096, or many short ones
PRIME_CELLS = 1 << 20  # matrix cells reduced together
LONG = 2**63 - 1


def whole_numbers(vector: Column | str, scale: int) -> Column:
    """floor(scale * entry), entries as double, as longs."""
    return F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))


# sums and products in whole numbers ----------------------------------------------------------


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Parts of LIMB bits, the lowest first, as doubles; the last one keeps the sign."""
    out, most = [], max(-int(x.min(initial=0)), int(x.max(initial=0)))
    while most >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x, most = x >> LIMB, most >> LIMB
    return [*out, x.astype(np.float64)]


def scatter(x: np.ndarray) -> np.ndarray:
    """x' x in Python's whole numbers."""
    total = np.zeros((x.shape[1],) * 2, object)
    for at in range(0, len(x), ROWS):
        parts = limbs(x[at : at + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def column_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns in Python's whole numbers."""
    return sum(part.sum(axis=0).astype(np.int64).astype(object) * (1 << LIMB * k) for k, part in enumerate(limbs(x)))


def _by_length(values: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for the vectors of each length."""
    sizes = np.array([len(v) for v in values], np.int64)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, np.array([values[i] for i in rows.tolist()], np.int64).reshape(len(rows), size)


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int], np.ndarray]]:
    """n, sums and scatter matrix for the vectors `x` of each length."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for frame in frames:
            for rows, x in _by_length(frame["x"].tolist()):
                own = held.setdefault(x.shape[1], [0, 0, 0])
                own[0] += len(rows)
                own[1] = own[1] + column_sums(x)
                own[2] = own[2] + scatter(x)
        for size, (n, sums, products) in held.items():
            data = [pickle.dumps([s, *row]) for s, row in zip(sums.tolist(), products.tolist())]
            yield pd.DataFrame({"size": size, "i": np.arange(size, dtype=np.int32), "n": n, "data": data})

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for frame in frames:
            for size, i, n, data in zip(frame["size"].tolist(), frame["i"].tolist(), frame["n"].tolist(), frame["data"]):
                own = held.setdefault((size, i), [0, 0])
                own[0] += n
                own[1] = own[1] + np.array(pickle.loads(data), object)
        for (size, i), (n, values) in held.items():
            yield pd.DataFrame({"size": [size], "i": [i], "n": [n], "data": [pickle.dumps(values.tolist())]})

    schema = "size int, i int, n long, data binary"
    sizes = fit.select(F.size("x").alias("size")).distinct()
    cells = sizes.agg(F.sum(F.col("size").cast("long") * F.col("size"))).first()[0] or 0
    if cells > CELLS:
        raise ValueError(f"scatter matrices of {cells} cells: more than {CELLS} are not held on a driver")
    rows = fit.mapInPandas(add, schema).repartition("size", "i").mapInPandas(add_up, schema).collect()
    out: dict[int, tuple] = {}
    for r in sorted(rows, key=lambda r: (r.size, r.i)):
        n, sums, products = out.setdefault(r.size, (r.n, [], []))
        values = pickle.loads(r.data)
        sums.append(values[0])
        products.append(values[1:])
    return {size: (n, sums, np.array(products, object)) for size, (n, sums, products) in out.items()}


# characteristic polynomial ---------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every 32-bit number."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_over(product: int) -> list[int]:
    """The largest primes under 2^31 whose product exceeds a number."""
    out, n, left = [], 2**31 - 1, product
    while left > 0:
        if is_prime(n):
            out.append(n)
            left //= n
        n -= 2
    return out


def _inverses(values: np.ndarray, primes: np.ndarray) -> np.ndarray:
    return np.array([pow(int(v), -1, int(p)) if v else 0 for v, p in zip(values, primes)], np.int64)


def polynomial_modulo(matrices: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients, the constant first, of det(xI - M) of one matrix per prime, residues in int64."""
    count, size = matrices.shape[:2]
    h, all_, p1, p2 = matrices.copy(), np.arange(count), primes[:, None], primes[:, None, None]
    for k in range(size - 2):
        found = h[:, k + 1 :, k] != 0
        row = k + 1 + found.argmax(axis=1)
        h[all_, row], h[all_, k + 1] = h[all_, k + 1].copy(), h[all_, row].copy()
        h[all_, :, row], h[all_, :, k + 1] = h[all_, :, k + 1].copy(), h[all_, :, row].copy()
        factor = h[:, k + 2 :, k] * _inverses(h[:, k + 1, k], primes)[:, None] % p1
        h[:, k + 2 :, k:] = (h[:, k + 2 :, k:] - factor[:, :, None] * h[:, k + 1, None, k:] % p2) % p2
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * factor[:, None, :] % p2).sum(axis=2)) % p1
    # the polynomial of each leading block from those of the smaller ones
    polys = np.zeros((count, size + 1, size + 1), np.int64)
    polys[:, 0, 0] = 1
    for k in range(size):
        share, below = np.zeros((count, k + 1), np.int64), np.ones(count, np.int64)
        for i in range(k, -1, -1):  # entry of row i times the subdiagonal from there to column k
            share[:, i] = h[:, i, k] * below % primes
            if i:
                below = below * h[:, i, i - 1] % primes
        polys[:, k + 1, 1 : k + 2] = polys[:, k, : k + 1]
        gone = (polys[:, : k + 1, : k + 1] * share[:, :, None] % p2).sum(axis=1)
        polys[:, k + 1, : k + 1] = (polys[:, k + 1, : k + 1] - gone) % p1
    return polys[:, size]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Whole coefficients of det(xI - M), the constant first, for a matrix without negative roots."""
    size, trace = len(matrix), sum(matrix.diagonal().tolist())
    bound = max(math.comb(size, i) * (trace // size + 1) ** i for i in range(size + 1))
    primes = primes_over(2 * bound + 1)
    shared = spark.sparkContext.broadcast(matrix)
    together = max(1, PRIME_CELLS // (size * size))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = shared.value
        for frame in frames:
            for at in range(0, len(frame), together):
                some = frame["prime"].to_numpy(np.int64)[at : at + together]
                found = polynomial_modulo(np.array([(whole % int(p)).astype(np.int64) for p in some]), some)
                yield pd.DataFrame({"prime": some, "coefficients": found.tolist()})

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame(pd.DataFrame({"prime": primes})).repartition(tasks)
    rows = dealt.mapInPandas(run, "prime long, coefficients array<long>").collect()
    modulus = math.prod(r.prime for r in rows)
    weights = [(w := modulus // r.prime) * pow(w, -1, r.prime) for r in rows]
    out = [sum(w * c for w, c in zip(weights, column)) % modulus for column in zip(*(r.coefficients for r in rows))]
    return [c - modulus if c > modulus // 2 else c for c in out]


# roots ------------------------------------------------------------------------------------------


class RealRoots:
    """Roots of a monic whole polynomial that has real, non-negative roots only."""

    def __init__(self, coefficients: list[int]):
        self.coefficients, self.degree = coefficients, len(coefficients) - 1
        self.positive = self.degree - next(i for i, c in enumerate(coefficients) if c)
        self.sum = -coefficients[-2] if self.degree else 0

    def above(self, top: int, scale: int) -> int:
        """Number of roots greater than top / 2^scale: sign changes after moving there."""
        if not top:
            return self.positive
        power, moved = 1, []
        for i, c in enumerate(self.coefficients):
            moved.append((c << scale * (self.degree - i)) * power)
            power *= top
        moved.reverse()
        signs = []
        while moved:
            moved = list(accumulate(moved))
            if last := moved.pop():
                signs.append(last > 0)
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def sign(self, top: int, scale: int) -> int:
        value, unit = 0, 1
        for c in reversed(self.coefficients):
            value, unit = value * top + c * unit, unit << scale
        return (value > 0) - (value < 0)

    def largest(self, k: int, bits: int = BITS) -> tuple[Decimal, int, int]:
        """The k-th largest root (from 1) to so many bits, its place among equal ones (from 0) and their number.

        Roots that agree in all these bits count as equal."""
        if k > self.positive:
            return Decimal(0), k - self.positive - 1, self.degree - self.positive
        low, high, scale, under, over = 0, self.sum + 1, 0, self.positive, 0
        while high - low > 1 or low.bit_length() < bits:
            if high - low == 1:
                low, high, scale = 2 * low, 2 * high, scale + 1
            middle = (low + high) // 2
            if under - over == 1:  # alone: its sign tells the side
                left = self.sign(middle, scale) in (0, 1 - 2 * (over % 2))
                low, high = (low, middle) if left else (middle, high)
            elif (count := self.above(middle, scale)) >= k:
                low, under = middle, count
            else:
                high, over = middle, count
        with decimal.localcontext() as context:
            context.prec = bits
            return Decimal(high) / Decimal(1 << scale), k - over - 1, under - over


# components -------------------------------------------------------------------------------------


def null_space(matrix: np.ndarray, root: Decimal, count: int) -> list[np.ndarray]:
    """`count` orthonormal decimal vectors that M - root takes to (almost) nothing."""
    size = len(matrix)
    a = np.array([[Decimal(v) for v in row] for row in matrix.tolist()], object)
    for i in range(size):
        a[i, i] -= root
    tiny = (max(abs(v) for v in a.ravel()) or Decimal(1)).scaleb(15 - decimal.getcontext().prec)
    order = np.arange(size)
    for k in range(size):
        row = k + max(range(size - k), key=lambda i: abs(a[k + i, k]))
        a[[k, row]], order[[k, row]] = a[[row, k]], order[[row, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])

    def solved(right: np.ndarray) -> np.ndarray:
        y = right[order].copy()
        for k in range(size):
            y[k + 1 :] -= a[k + 1 :, k] * y[k]
        for k in range(size - 1, -1, -1):
            y[k] /= a[k, k]
            y[:k] -= a[:k, k] * y[k]
        return y

    draw = np.random.default_rng(size)
    basis = [np.array([Decimal(int(v)) for v in draw.integers(-1000, 1001, size)], object) for _ in range(count)]
    for _ in range(3):
        for k, vector in enumerate(basis):
            vector = solved(vector)
            for _twice in range(2):
                vector = vector / max(abs(v) for v in vector)
                for other in basis[:k]:
                    vector = vector - other * sum(vector * other)
                vector = vector / sum(vector * vector).sqrt()
            basis[k] = vector
    return basis


@dataclass
class Whitening:
    """Fit of the vectors of one length: leading components with their shares."""

    n: int
    sums: list[int]
    components: np.ndarray  # one unit vector a column
    deviations: np.ndarray  # square root of each eigenvalue of the covariance
    explained: np.ndarray
    identity_error: float = 0.0

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in longs where they are wide enough, else in Python's numbers."""
        most = self.n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most <= LONG else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def whiten(self, offsets: np.ndarray) -> np.ndarray:
        projected = (offsets.astype(np.float64) / self.n) @ self.components
        return np.divide(projected, self.deviations, out=np.zeros_like(projected), where=self.deviations > 0)

    def squared(self, offsets: np.ndarray) -> np.ndarray:
        """Exact sum of squares of each row, cut to a long."""
        most = int(np.abs(offsets).max(initial=0))
        if most * most * max(offsets.shape[1], 1) <= LONG:
            return (offsets * offsets).sum(axis=1).astype(np.int64)
        return np.array([min(sum(v * v for v in row), LONG) for row in offsets.astype(object).tolist()], np.int64)


def leading(spark: SparkSession, n: int, sums: list[int], products: np.ndarray, most: int) -> Whitening:
    """The fit of n vectors with these sums and products, without its identity error."""
    size, s = len(sums), np.array(sums, object)
    matrix = n * products - np.outer(s, s)
    roots = RealRoots(characteristic_polynomial(spark, matrix))
    wanted = min(most, size)
    found = [roots.largest(k) for k in range(1, min(wanted + 1, size) + 1)]
    values = [root for root, _, _ in found]
    gaps = [a - b for a, b in zip(values, values[1:]) if a != b]
    columns: list[np.ndarray] = []
    with decimal.localcontext() as context:
        narrow = max((math.ceil((values[0] / g).log10()) for g in gaps), default=0) if values[0] else 0
        context.prec = 2 * BITS // 3 + max(narrow, 0)
        k = 0
        while k < wanted:
            root, _, equal = found[k]
            basis = null_space(matrix, root, min(equal, wanted - k))
            columns += [np.array([float(v) for v in vector]) for vector in basis]
            k += len(basis)
        deviations = np.array([float(root.sqrt() / n) for root in values[:wanted]])
        explained = np.array([float(root / roots.sum) if roots.sum else 0.0 for root in values[:wanted]])
    components = np.array(columns).T
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(wanted)])
    return Whitening(n, sums, components * signs, deviations, explained)


def identity_errors(fit: DataFrame, fits: dict[int, Whitening]) -> dict[int, float]:
    """Largest difference of the whitened fit list's covariance from the identity, by length."""
    shared = fit.sparkSession.sparkContext.broadcast(fits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for _, x in _by_length(frame["x"].tolist()):
                own = shared.value[x.shape[1]]
                w = own.whiten(own.offsets(x))
                w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                held[x.shape[1]] = held.get(x.shape[1], 0.0) + w.T @ w
        for size, sums in held.items():
            i, j = np.indices(sums.shape).reshape(2, -1)
            yield pd.DataFrame({"size": size, "i": i, "j": j, "value": sums.ravel()})

    rows = fit.mapInPandas(run, "size int, i int, j int, value double").groupBy("size", "i", "j").agg(F.sum("value").alias("value"))
    sums = {size: np.zeros((own.components.shape[1] + 1,) * 2) for size, own in fits.items()}
    for r in rows.collect():
        sums[r.size][r.i, r.j] = r.value
    out = {}
    for size, own in fits.items():
        mean = sums[size][0, 1:] / own.n
        covariance = sums[size][1:, 1:] / own.n - np.outer(mean, mean)
        some = own.deviations > 0
        out[size] = float(np.abs((covariance - np.eye(len(mean)))[np.ix_(some, some)]).max(initial=0.0))
    return out


def fit_whitening(rows: DataFrame, most: int, vector: str = "vector") -> dict[int, Whitening]:
    """Fits of the distinct whole-number vectors of a table, by their length."""
    fit = stored(rows.where(F.size(vector) > 0).select(F.col(vector).alias("x")).distinct())
    fits = {size: leading(fit.sparkSession, *sums, most) for size, sums in totals(fit).items()}
    for size, error in identity_errors(fit, fits).items() if fits else ():
        fits[size].identity_error = error
    return fits


def whitened(rows: DataFrame, fits: dict[int, Whitening], vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each row."""
    shared = rows.sparkSession.sparkContext.broadcast(fits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["vec_id"].to_numpy(np.int64)
            for at, x in _by_length(frame["x"].tolist()):
                own = shared.value[x.shape[1]]
                offsets = own.offsets(x)
                w = own.whiten(offsets)
                count, each = w.shape
                yield pd.DataFrame({
                    "vec_id": np.repeat(ids[at], each), "component": np.tile(np.arange(1, each + 1, dtype=np.int32), count),
                    "n": own.n, "deviation": np.repeat(own.squared(offsets), each), "whitened": w.ravel(),
                    "explained": np.tile(own.explained, count), "identity_error": own.identity_error,
                })

    taking = rows.where(F.size(vector) > 0).select(id_in(vec_id).alias("vec_id"), F.col(vector).alias("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return id_out(taking.mapInPandas(run, schema), "vec_id")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).where(usable("embedding")).select("vec_id", whole_numbers("embedding", 256).alias("vector"))
    return whitened(rows, fit_whitening(rows, 4))
