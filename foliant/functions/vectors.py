"""Vector functions.

Column-only forms serve bounded inputs and tests; scoring a whole chunk table
against one query vector goes through an Arrow UDF, which multiplies a batch of
vectors at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12

# Calibration of cosine similarity.
COSINE_BASELINE = 0.42
COSINE_RANGE = 0.43


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def _cosine(a: Column, b: Column) -> Column:
    denominator = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(denominator < EPSILON, F.lit(0.0)).otherwise(_dot(a, b) / denominator)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def cosine_prefix(a: Column, b: Column) -> Column:
    """Cosine over the common prefix of two vectors, 0 when it is empty."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(clamp(_cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)), -1.0, 1.0))


def cosine_strict(a: Column, b: Column) -> Column:
    """Cosine that is 0 for vectors of unequal length; not clamped."""
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).otherwise(_cosine(a, b))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    # The norm travels as an array: captured by a lambda it would be computed per element.
    norm = F.sqrt(_dot(vector, vector))
    norms = F.array_repeat(F.when(norm > 0, norm).otherwise(1.0), F.size(vector))
    return F.zip_with(vector, norms, lambda x, n: x.cast("double") / n)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in a row, and the length of each list."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lengths


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each list's values."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    if len(lengths) and (lengths == lengths[0]).all() and lengths[0]:
        return values.reshape(len(lengths), -1).sum(axis=1)
    return total[_starts(lengths) + lengths] - total[_starts(lengths)]


def unit_vector(vector: Column) -> Column:
    """Unit vectors of a batch at once; a zero vector stays zero."""

    @F.arrow_udf("array<double>")
    def scale(column: pa.Array) -> pa.Array:
        values, lengths = _rows(column)
        norms = np.sqrt(_sums(values * values, lengths))
        scaled = values / np.repeat(np.where(norms > 0, norms, 1.0), lengths)
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(scaled))

    return scale(vector)


def units(column: pa.Array) -> np.ndarray:
    """Unit vectors of rows of one width as a matrix; a zero vector stays zero."""
    values, lengths = _rows(column)
    matrix = values.reshape(len(lengths), -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    return matrix / np.where(norms > 0, norms, 1.0)[:, None]


def unit_or_zero(vector: Sequence[float]) -> np.ndarray:
    own = np.asarray(vector, dtype=np.float64)
    norm = float(np.sqrt(own @ own))
    return own / norm if norm >= EPSILON else np.zeros(len(own))


def calibrate(cosine: Column) -> Column:
    """Spread the useful part of the cosine range over 0..1."""
    return clamp((cosine - COSINE_BASELINE) / COSINE_RANGE, 0.0, 1.0)


def relevance(rank: Column) -> Column:
    """``1 / (1 + |rank|)``.  Ranks are negative, so better hits get lower values."""
    return clamp(1.0 / (1.0 + F.abs(rank)), 0.0, 1.0)


def cosine_against(vector: Column, query: Sequence[float]) -> Column:
    """Cosine (common prefix) of every stored vector with one query vector."""
    q = np.asarray(query, dtype=np.float64)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        out = np.zeros(len(lengths))
        # One matrix product per distinct width; normally there is just one.
        for width in np.unique(lengths):
            n = min(int(width), len(q))
            if n == 0:
                continue
            rows = np.flatnonzero(lengths == width)
            if len(rows) == len(lengths):
                block = values.reshape(-1, width)[:, :n]
            else:
                block = values[starts[rows][:, None] + np.arange(n)]
            denominator = np.sqrt((block * block).sum(axis=1)) * np.sqrt((q[:n] * q[:n]).sum())
            safe = np.where(denominator < EPSILON, 1.0, denominator)
            out[rows] = np.where(denominator < EPSILON, 0.0, np.clip(block @ q[:n] / safe, -1.0, 1.0))
        return pa.array(out)

    return score(vector)


#: Bytes of stored vectors whose means one call finds.
LOT_BYTES = 4 << 20


def _partial_sums(vector: str, key: str, width: int):
    """Sums of a batch by key; a single vector stays as it is stored."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            values = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            coded = keys.dictionary_encode(null_encoding="encode")
            which = coded.indices.to_numpy()
            order = np.argsort(which, kind="stable")
            amount = np.bincount(which)
            starts = _starts(amount)
            sums = [v.tobytes() for v in values[order[starts]].astype(np.float32)]
            for i in np.flatnonzero(amount > 1).tolist():
                sums[i] = values[order[starts[i] : starts[i] + amount[i]]].astype(np.float64).sum(axis=0).tobytes()
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary, pa.array(amount.astype(np.int64)), pa.array(sums, pa.binary())], names=[key, "amount", "total"]
            )

    return run


def _means_of(key: str, width: int):
    """Unit means of a lot of keys out of partial sums."""

    def run(rows: pa.Table) -> pa.Table:
        coded = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        amount = rows.column("amount").to_numpy()
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        totals = rows.column("total").to_pylist()
        values = np.empty((len(amount), width))
        for kind, chosen in ((np.float32, amount == 1), (np.float64, amount > 1)):
            values[chosen] = np.frombuffer(b"".join(totals[i] for i in np.flatnonzero(chosen)), kind).reshape(-1, width)
        starts = _starts(np.bincount(coded.indices.to_numpy()))
        means = np.add.reduceat(values[order], starts) / np.add.reduceat(amount[order], starts)[:, None]
        norms = np.sqrt((means * means).sum(axis=1))
        means /= np.where(norms > 0, norms, 1.0)[:, None]
        offsets = pa.array((np.arange(len(means) + 1) * width).astype(np.int32))
        return pa.table([coded.dictionary, pa.ListArray.from_arrays(offsets, pa.array(means.ravel()))], names=[key, "mean_vector"])

    return run


def _means_of_width(df: DataFrame, vector: str, key: str, width: int) -> DataFrame:
    """``mean_vector`` of single floats of one width, in numpy.

    Vectors are shuffled as they are stored, those of one key within a batch
    as their sum, so that a key with very many vectors is no burden.
    """
    kind = df.schema[key].dataType.simpleString()
    lots = max(1, -(-df.count() * 4 * width // LOT_BYTES))
    sums = df.select(key, vector).mapInArrow(_partial_sums(vector, key, width), f"`{key}` {kind}, amount long, total binary")
    dealt = sums.withColumn("lot", F.pmod(F.xxhash64(key), F.lit(lots)))
    return dealt.groupBy("lot").applyInArrow(_means_of(key, width), f"`{key}` {kind}, mean_vector array<double>")


def mean_vector(df: DataFrame, vector: str, *keys: str, width: int | None = None) -> DataFrame:
    """Unit-length element-wise mean per key, as ``mean_vector``.

    The mean is combined on the map side, so one file with very many chunks
    costs one partial vector per task.  ``width`` says that ``keys`` is one
    and all vectors are single floats of that width, without nulls; many
    small keys then cost far less.
    """
    if width is not None:
        return _means_of_width(df, vector, *keys, width)
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    pooled = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(*keys).agg(l2_normalize(vector_to_array(pooled)).alias("mean_vector"))


def to_blob(vector: Column) -> Column:
    """Little-endian float32 bytes of a vector."""

    @F.arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False).astype("<f4")
        offsets = np.concatenate(([0], np.cumsum(lengths * 4))).astype(np.int32)
        buffers = [pa.array(column.is_valid()).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]
        return pa.Array.from_buffers(pa.binary(), len(column), buffers)

    return encode(vector)


def from_blob(blob: Column) -> Column:
    """Vector out of its bytes; a trailing partial element is dropped."""

    @F.arrow_udf("array<float>")
    def decode(column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_binary())
        if not len(column):
            return pa.array([], pa.list_(pa.float32()))
        _, places, data = column.buffers()
        places = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]] if data else np.zeros(0, dtype=np.uint8)
        sizes = np.diff(places)
        whole = sizes // 4 * 4
        if (whole != sizes).any():
            raw = raw[np.arange(len(raw)) - np.repeat(_starts(sizes), sizes) < np.repeat(whole, sizes)]
        offsets = np.concatenate(([0], np.cumsum(whole // 4))).astype(np.int32)
        values = pa.array(np.frombuffer(raw.tobytes(), dtype="<f4"), pa.float32())
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=column.is_null())

    return decode(blob)
