"""What the operators of this package share: input columns, worker set-up, words and their hashes.

Every operator takes the names of the columns it needs and renames them at once, so other columns of the input,
whatever their names, never meet the ones it makes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of text that a task turns into numpy arrays at once; a single longer document is taken alone.
SLICE_BYTES = 1 << 20
# Odd 64-bit multipliers for polynomial hashes and the splitmix64 finaliser.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the folder it was loaded from, and keep Arrow batches small."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (home, env.get("PYTHONPATH", "")) if p)
    # The allocator of the C library gives memory back that Arrow's own keeps for a worker's lifetime.
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    # Rows hold whole texts: a thousand of them, not the default ten, stay within some megabytes.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def schema_of(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    made = T.StructType()
    for name, kind in fields:
        made.add(name, kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind))
    return made


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser of unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(_MIX[0])
    h ^= h >> np.uint64(27)
    h *= np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(64, 1 << (n - 1).bit_length())
        made = np.full(size, base, dtype=np.uint64)
        made[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(made)
    return have[:n]


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole documents in groups of about ``SLICE_BYTES``: number of the first, their UTF-8 bytes, their offsets."""
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_BYTES, side="right")) - 1)
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of documents that lie one after another in ``data``.

    Returns lower-cased (A-Z) or unchanged bytes, start and end of each word, and per document the number of the
    first word (one more entry at the end).
    """
    if lower:
        data = _LOWER[data]
    inner = ~_SPACE[data]
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inner[edges]
    stops = inner.copy()
    stops[:-1] &= ~inner[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    stops[lasts] = inner[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def _values_at(places: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A pseudo-random value for each byte at its place in a word."""
    return mix(((places.astype(np.uint64) << np.uint64(8)) | data) * np.uint64(BASES[1]) + np.uint64(BASES[0]))


# The values of the first places, which nearly all words stay within.
_NEAR = 64
_NEAR_VALUES = _values_at(np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256, dtype=np.uint8), _NEAR))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each word: the sum of pseudo-random values of its bytes at their places, finished with its length.

    Unlike a polynomial modulo 2**64 it has no words that meet by their structure, whatever the letters repeat.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    places = np.arange(int(lengths.sum()), dtype=np.int64)
    heads = np.cumsum(lengths) - lengths
    inside = places - np.repeat(heads, lengths)
    own = data[inside + np.repeat(starts, lengths)]
    if int(lengths.max()) <= _NEAR:
        values = _NEAR_VALUES[(inside << 8) | own]
    else:
        values, far = np.empty(len(own), dtype=np.uint64), inside >= _NEAR
        values[~far] = _NEAR_VALUES[(inside[~far] << 8) | own[~far]]
        values[far] = _values_at(inside[far], own[far])
    return mix(np.add.reduceat(values, heads) * np.uint64(base) + lengths.astype(np.uint64) * np.uint64(BASES[2]))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values, by Horner's rule over shifted views."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = values[:n].copy()
    for k in range(1, width):
        total *= np.uint64(base)
        total += values[k : k + n]
    return mix(total)
