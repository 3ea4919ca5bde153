"""Whitening of embeddings by exact components of their integer scatter.

Entries become integers, so the scatter ``M = n * sum(x x') - S S'`` of the distinct vectors is an
integer matrix that does not depend on the order of sums. Its characteristic polynomial is made
exactly: reduced to Hessenberg form modulo many primes of 31 bits, one Spark row per prime, and
put together by Chinese remaindering. All its roots are real, so the sign changes of the shifted
polynomial count the roots above a point exactly (Descartes); halving isolates the largest roots
and refines them to ``ROOT_BITS`` bits. Each component is then a null vector of ``M - e``, found
by inverse iteration in fixed-point numbers of ``FIXED_BITS`` bits, one Spark row per root.

Sums over vectors are made in tasks as products of 20-bit limbs, each exact in doubles, and
added by Spark as integers; the driver holds only matrices of the dimension's size.

Defined results: rows whose vector is null, holds null or non-finite entries or entries whose
integer needs more than 62 bits are dropped, and so are vectors of another length than the
commonest (the shorter on ties). Rows that repeat are each returned but counted once in the fit.
Components are given for positive eigenvalues only: fewer than ``most`` where the vectors span
less. Of a repeated eigenvalue, some orthonormal basis is given. A ``deviation`` that passes a
long is null. Empty tables, and tables with one distinct vector, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesprep.llm.shared import fresh, stored

#: Entries are counted in steps of 1/64. A constant added to all of them cancels in everything here.
SCALE = 64
COMPONENTS = 16
LIMB_BITS = 20
#: Rows whose limb products still add up exactly in doubles: 2**(2 * 20) * 2**13 = 2**53.
EXACT_ROWS = 8_192
FLUSH_CHUNKS = 512
ROOT_BITS = 256
FIXED_BITS = 384
PRIMES_PER_TASK = 16


# --- exact scatter -----------------------------------------------------------------------------


def integers(vector: Column) -> Column:
    """``floor(64 * c)`` of every entry; null where the row is to be dropped."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(2.0**55), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _limbs(rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` as doubles of 20 bits each, the last with the sign: sum of limb k * 2**(20 k)."""
    limbs = []
    while True:
        limbs.append((rows & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        rows = rows >> LIMB_BITS
        if not rows.any():
            return limbs
        if rows.min() >= -(1 << LIMB_BITS) and rows.max() <= (1 << LIMB_BITS):
            return [*limbs, rows.astype(np.float64)]


def _scatter(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Products of all pairs of columns, summed over a task's rows: ``power, i, j, low, high`` for
    ``(high * 2**32 + low) * 2**(20 * power)``. Column 0 is all ones, so row 0 holds the sums."""
    upper = np.triu_indices(width + 1)
    sums: dict[int, np.ndarray] = {}
    n_chunks = 0

    def told() -> Iterator[pa.RecordBatch]:
        for power, total in sorted(sums.items()):
            value = total[upper]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(value), power, np.int32)),
                    *(pa.array(side.astype(np.int32)) for side in upper),
                    pa.array(value & 0xFFFFFFFF), pa.array(value >> 32),
                ],
                names=["power", "i", "j", "low", "high"],
            )

    for batch in batches:
        rows = _matrix(batch.column("y"), width)
        for at in range(0, len(rows), EXACT_ROWS):
            part = rows[at : at + EXACT_ROWS]
            limbs = _limbs(np.hstack([np.ones((len(part), 1), np.int64), part]))
            for a, left in enumerate(limbs):
                for b, right in enumerate(limbs):
                    product = (left.T @ right).astype(np.int64)
                    sums[a + b] = sums[a + b] + product if a + b in sums else product
            n_chunks += 1
            if n_chunks == FLUSH_CHUNKS:
                yield from told()
                sums, n_chunks = {}, 0
    yield from told()


def scatter_matrix(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """``n``, the sums and ``n * sum(y y') - S S'`` of the vectors ``y``, as Python integers."""
    parts = fit.select("y").mapInArrow(lambda b: _scatter(b, width), "power int, i int, j int, low long, high long")
    sums = parts.groupBy("power", "i", "j").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    total = np.zeros((width + 1, width + 1), object)
    for r in sums.toArrow().to_pylist():
        total[r["i"], r["j"]] += ((r["high"] << 32) + r["low"]) << (LIMB_BITS * r["power"])
    total = np.triu(total) + np.triu(total, 1).T
    n, sums = total[0, 0], total[0, 1:]
    return n, list(sums), n * total[1:, 1:] - np.outer(sums, sums)


# --- characteristic polynomial -----------------------------------------------------------------


def primes_below(limit: int, n: int) -> list[int]:
    """The ``n`` largest primes below ``limit`` (at most 2**32)."""

    def is_prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 7, 61):  # decides for all p below 4,759,123,141
            x = pow(base, odd, p)
            if x in (1, p - 1):
                continue
            for _ in range(twos - 1):
                x = x * x % p
                if x == p - 1:
                    break
            else:
                return False
        return True

    found: list[int] = []
    p = limit - 1 - limit % 2
    while len(found) < n:
        if is_prime(p):
            found.append(p)
        p -= 2
    return found


def _inverse(values: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Inverses modulo primes by Fermat; 0 for 0."""
    result, power, exponent = np.ones_like(values), values.copy(), primes - 2
    for _ in range(31):
        result = np.where(exponent & 1, result * power % primes, result)
        power, exponent = power * power % primes, exponent >> 1
    return np.where(values == 0, 0, result)


def polynomials_modulo(matrices: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients (constant first) of ``det(t - A)`` modulo each prime; ``matrices`` holds the
    residues of one matrix, prime by prime. Works on all primes at once."""
    h, d = matrices.copy(), matrices.shape[1]
    p, every = primes[:, None], np.arange(len(primes))
    for k in range(d - 2):  # column k to zero below row k + 1
        pivot = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        for swap in (h, h.transpose(0, 2, 1)):
            moved = swap[every, pivot].copy()
            swap[every, pivot] = swap[:, k + 1]
            swap[:, k + 1] = moved
        factor = h[:, k + 2 :, k] * _inverse(h[:, k + 1, k], primes)[:, None] % p
        h[:, k + 2 :] = (h[:, k + 2 :] - factor[:, :, None] * h[:, k + 1, None, :] % p[:, :, None]) % p[:, :, None]
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * factor[:, None, :] % p[:, :, None]).sum(2)) % p
    # Of the leading k x k blocks in turn, by expansion along the last column.
    polynomials = np.zeros((d + 1, len(primes), d + 1), np.int64)
    polynomials[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((len(primes), d + 1), np.int64)
        new[:, 1:] = polynomials[k - 1, :, :-1]
        new = (new - h[:, k - 1, k - 1, None] * polynomials[k - 1]) % p
        below = np.ones(len(primes), np.int64)
        for i in range(k - 2, -1, -1):
            below = below * h[:, i + 1, i] % primes
            new = (new - (h[:, i, k - 1] * below % primes)[:, None] * polynomials[i]) % p
        polynomials[k] = new
    return polynomials[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact integer coefficients, constant first, of ``det(t - matrix)`` for a positive
    semi-definite integer matrix."""
    d = len(matrix)
    trace = int(np.trace(matrix))
    # Of non-negative roots the k-th symmetric function is at most C(d, k) * (trace / d)**k.
    bound = max(comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    primes = primes_below(1 << 31, (2 * bound).bit_length() // 30 + 2)  # one more, to check by
    n_tasks = -(-len(primes) // PRIMES_PER_TASK)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column("prime").to_numpy()
            for at in range(0, len(ps), PRIMES_PER_TASK):
                part = ps[at : at + PRIMES_PER_TASK]
                residues = np.array([(matrix % int(p)).astype(np.int64) for p in part])
                rows = polynomials_modulo(residues, part)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(list(rows))], names=["prime", "residues"])

    told = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(n_tasks)
    residues = {r["prime"]: r["residues"] for r in told.mapInArrow(reduced, "prime long, residues array<long>").toArrow().to_pylist()}
    check = primes.pop()
    product = 1
    for p in primes:
        product *= p
    parts = [(product // p * pow(product // p, -1, p), residues[p]) for p in primes]
    coefficients = []
    for k in range(d + 1):
        value = sum(weight * r[k] for weight, r in parts) % product
        coefficients.append(value - product if value > product // 2 else value)
    if any((c - r) % check for c, r in zip(coefficients, residues[check])):
        raise ArithmeticError("the remainders do not fit the bound of the polynomial")
    return coefficients


# --- roots -------------------------------------------------------------------------------------


def roots_above(coefficients: list[int], at: int, bits: int) -> int:
    """Number of roots above ``at / 2**bits``, with multiplicity; exact if all roots are real."""
    d = len(coefficients) - 1
    shifted = [c << (bits * (d - k)) for k, c in enumerate(coefficients)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += at * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(coefficients: list[int], at: int, bits: int) -> int:
    value, scale = 0, 1
    for c in reversed(coefficients):
        value = value * at + c * scale
        scale <<= bits
    return (value > 0) - (value < 0)


@dataclass(frozen=True)
class Root:
    """``many`` roots in ``(low, low + 1] / 2**bits``, the first of them number ``first`` from the
    top. More than one only where they are equal in all bits asked for."""

    first: int
    many: int
    low: int
    bits: int


def largest_roots(coefficients: list[int], most: int, root_bits: int = ROOT_BITS) -> list[Root]:
    """The ``most`` largest roots, positive ones only, each to ``root_bits`` bits.

    Intervals are halved until they hold one root (counted by sign changes) or are as narrow as
    asked for; a single root is then refined by the sign of the polynomial alone.
    """
    top = max(1, sum(abs(c) for c in coefficients[-2:-1])).bit_length()  # all are at most the trace
    found: list[Root] = []
    #: Interval (low, high] / 2**bits with the roots above low and above high.
    waiting = [(0, 1 << top, 0, roots_above(coefficients, 0, 0), 0)]
    while waiting:
        low, high, bits, above_low, above_high = waiting.pop()
        many = above_low - above_high
        if not many or above_high >= most:
            continue
        narrow = low > 0 and high - low == 1 and low.bit_length() > root_bits
        if narrow:
            found.append(Root(above_high + 1, many, low, bits))
            continue
        if many == 1 and low > 0:
            found.append(_refined(coefficients, low, high, bits, above_high + 1, root_bits))
            continue
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        above = roots_above(coefficients, middle, bits)
        waiting.append((low, middle, bits, above_low, above))
        waiting.append((middle, high, bits, above, above_high))
    return found


def _refined(coefficients: list[int], low: int, high: int, bits: int, number: int, root_bits: int) -> Root:
    right = _sign(coefficients, high, bits)
    if right == 0:  # the root is the end point itself
        more = max(0, root_bits - high.bit_length() + 1)
        return Root(number, 1, (high << more) - 1, bits + more)
    while high - low > 1 or low.bit_length() <= root_bits:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        at = _sign(coefficients, middle, bits)
        if at == 0:
            return _refined(coefficients, low, middle, bits, number, root_bits)
        low, high = (low, middle) if at == right else (middle, high)
    return Root(number, 1, low, bits)


# --- components --------------------------------------------------------------------------------


def _eliminated(matrix: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Fixed-point LU with row exchanges, in place; a pivot of 0 counts as one unit."""
    order = []
    for k in range(len(matrix)):
        pivot = k + int(np.argmax(np.abs(matrix[k:, k])))
        order.append(pivot)
        matrix[[k, pivot]] = matrix[[pivot, k]]
        if matrix[k, k] == 0:
            matrix[k, k] = 1
        matrix[k + 1 :, k] = (matrix[k + 1 :, k] << FIXED_BITS) // matrix[k, k]
        matrix[k + 1 :, k + 1 :] -= np.outer(matrix[k + 1 :, k], matrix[k, k + 1 :]) >> FIXED_BITS
    return matrix, order


def _unit(vector: np.ndarray) -> np.ndarray:
    """The vector with length 1 (``2**FIXED_BITS``), whatever its size."""
    spare = max(int(abs(v)).bit_length() for v in vector) - FIXED_BITS
    vector = np.array([int(v) >> spare if spare > 0 else int(v) << -spare for v in vector], object)
    return (vector << FIXED_BITS) // isqrt(int(vector @ vector))


def null_vectors(matrix: np.ndarray, root: Root, steps: int = 3) -> np.ndarray:
    """Orthonormal null vectors of ``matrix - root``, as doubles: inverse iteration on ``many``
    vectors at once, made orthogonal after each step."""
    d = len(matrix)
    value = (2 * root.low + 1) << FIXED_BITS >> (root.bits + 1)
    lower, order = _eliminated((matrix << FIXED_BITS) - np.diag([value] * d).astype(object))
    rng = np.random.default_rng(d)
    vectors = [np.array([int(v) << (FIXED_BITS - 30) for v in rng.integers(-(1 << 30), 1 << 30, d)], object) for _ in range(root.many)]
    for _ in range(steps):
        done: list[np.ndarray] = []
        for vector in vectors:
            x = vector.copy()
            for k in range(d):
                x[[k, order[k]]] = x[[order[k], k]]
                x[k + 1 :] -= (lower[k + 1 :, k] * x[k]) >> FIXED_BITS
            for k in range(d - 1, -1, -1):
                x[k] = (int(x[k]) << FIXED_BITS) // int(lower[k, k])
                x[:k] -= (lower[:k, k] * x[k]) >> FIXED_BITS
            x = _unit(x)
            for _ in range(2):  # twice, as the parts taken away may leave little
                for other in done:
                    x = x - ((other * (int(x @ other) >> FIXED_BITS)) >> FIXED_BITS)
                x = _unit(x)
            done.append(x)
        vectors = done
    return np.array([[int(v) / (1 << FIXED_BITS) for v in vector] for vector in vectors])


@dataclass(frozen=True)
class Whitening:
    """``components[k]`` is a unit eigenvector of the covariance and ``values[k]`` its eigenvalue,
    by falling value; ``shares`` are the eigenvalues over the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    shares: np.ndarray

    @property
    def projection(self) -> np.ndarray:
        return (self.components / np.sqrt(self.values)[:, None]).T


def fit_whitening(fit: DataFrame, width: int, most: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct integer vectors ``y``; None if they do not differ."""
    spark = fit.sparkSession
    n, sums, matrix = scatter_matrix(fit, width)
    trace = int(np.trace(matrix)) if n else 0
    if not trace:
        return None
    roots = largest_roots(characteristic_polynomial(spark, matrix), most)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                root = Root(r["first"], r["many"], int(r["low"]), r["bits"])
                vectors = null_vectors(matrix, root)
                numbers = pa.array(range(root.first, root.first + root.many), pa.int32())
                yield pa.RecordBatch.from_arrays([numbers, pa.array(list(vectors))], names=["component", "vector"])

    rows = [(r.first, r.many, str(r.low), r.bits) for r in roots]
    told = spark.createDataFrame(rows, "first int, many int, low string, bits int").repartition(len(rows), "first")
    vectors = told.mapInArrow(solved, "component int, vector array<double>").toArrow().to_pylist()
    components = np.array([r["vector"] for r in sorted(vectors, key=lambda r: r["component"])][:most])
    # Python divides integers of any size with one rounding.
    exact = [(2 * r.low + 1, 1 << (r.bits + 1)) for r in roots for _ in range(r.many)][: len(components)]
    values = np.array([above / (below * n * n) for above, below in exact])
    return Whitening(n, sums, components, values, np.array([above / (below * trace) for above, below in exact]))


# --- whitened rows -----------------------------------------------------------------------------


def _centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * y - S``, as int64 where that is safe and else as Python integers."""
    most = n * int(np.abs(rows).max(initial=0)) + max(map(abs, sums))
    if most < 1 << 62:
        return n * rows - np.array(sums, np.int64)
    return n * rows.astype(object) - np.array(sums, object)


def _whitened(centred: np.ndarray, model: Whitening) -> np.ndarray:
    if centred.dtype == object:
        exact = np.array([[int(v) / model.n for v in row] for row in centred]).reshape(centred.shape)
    else:
        exact = centred / model.n
    return exact @ model.projection


def _deviations(centred: np.ndarray) -> pa.Array:
    width = max(1, centred.shape[1])
    if centred.dtype != object and int(np.abs(centred).max(initial=0)) < isqrt((1 << 63) // width):
        return pa.array((centred * centred).sum(axis=1))
    sums = (sum(int(v) ** 2 for v in row) for row in centred)
    return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())


def _covariance(batches: Iterator[pa.RecordBatch], width: int, model: Whitening) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened vectors and of their products over a task's rows; column 0 is ones."""
    m = len(model.values)
    total = np.zeros((m + 1, m + 1))
    for batch in batches:
        white = _whitened(_centred(_matrix(batch.column("y"), width), model.n, model.sums), model)
        white = np.hstack([np.ones((len(white), 1)), white])
        total += white.T @ white
    i, j = (side.astype(np.int32) for side in np.triu_indices(m + 1))
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "value"])


def identity_error(fit: DataFrame, width: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit vectors' covariance minus the identity."""
    parts = fit.select("y").mapInArrow(lambda b: _covariance(b, width, model), "i int, j int, value double")
    sums = {(r["i"], r["j"]): r["value"] for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow().to_pylist()}
    m, n = len(model.values), model.n
    worst = 0.0
    for i in range(1, m + 1):
        for j in range(i, m + 1):
            covariance = sums[i, j] / n - sums[0, i] / n * sums[0, j] / n
            worst = max(worst, abs(covariance - (i == j)))
    return worst


def whiten(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``vectors`` without dropped rows, with a column of structs (named ``white``, or the next free
    name like it), one per component: ``component, n, deviation, whitened, explained,
    identity_error``. Its name is the last of the result's columns."""
    spark = vectors.sparkSession
    y, out = fresh(vectors, "y"), fresh(vectors, "white")
    usable = vectors.withColumn(y, integers(F.col(f"`{column}`"))).filter(F.col(y).isNotNull())
    lengths = usable.groupBy(F.size(y).alias("width")).count().filter("width > 0")
    common = lengths.orderBy(F.desc("count"), "width").first()
    width = common["width"] if common else 0
    usable = usable.filter(F.size(y) == width) if width else usable.limit(0)
    fit = stored(usable.select(F.col(y).alias("y")).distinct(), "fit")
    model = fit_whitening(fit, width, most) if width else None
    kind = "array<struct<component:int,n:long,deviation:long,whitened:double,explained:double,identity_error:double>>"
    if model is None:
        return usable.drop(y).withColumn(out, F.lit(None).cast(kind)).limit(0)
    error = identity_error(fit, width, model)
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in usable.columns if c != y]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, EXACT_ROWS):
                part = batch.slice(at, EXACT_ROWS)
                centred = _centred(_matrix(part.column(y), width), model.n, model.sums)
                white = _whitened(centred, model)
                m, size = len(model.values), len(white)
                parts = [
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)),
                    pa.array(np.full(m * size, model.n, np.int64)),
                    _deviations(centred).take(pa.array(np.repeat(np.arange(size), m))),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.shares, size)),
                    pa.array(np.full(m * size, error)),
                ]
                structs = pa.StructArray.from_arrays(parts, ["component", "n", "deviation", "whitened", "explained", "identity_error"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * m), structs)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.schema if f.name != y)
    return usable.mapInArrow(rows, f"{fields}, `{out}` {kind}")
