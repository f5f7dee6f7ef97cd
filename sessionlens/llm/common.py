"""Helpers of the text operators: table access, bounded Arrow slices, folds, character classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.operators import skew

#: Bits of a sieve at most (32 MB).
MOST_SIEVE_BITS = skew.MOST_SIEVE_BITS
#: Java and Python agree on this class: what a word is made of.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def sifted(df: DataFrame, key: Column, wanted: DataFrame, name: str = "_maybe") -> DataFrame:
    """``skew.sifted`` with a sieve of at most ``MOST_SIEVE_BITS``."""
    return skew.sifted(df, key, wanted, name, MOST_SIEVE_BITS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids give null."""
    return F.crc32(doc_id.cast("string")) % parts


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold about ``most_bytes`` (one longer text stands alone)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    text: str = "text",
    most_bytes: int = 1 << 20,
) -> DataFrame:
    """``df`` with the columns that ``make()`` computes from the texts; a column of the same name is replaced.

    ``make`` runs once per task and gives a function from the array of texts to one array per field.
    Slices are bounded in bytes, so a task holds one slice and its results.
    """
    names = {f.name for f in fields}
    kept = [f.name for f in df.schema.fields if f.name not in names]
    schema = T.StructType([f for f in df.schema.fields if f.name in kept] + fields)
    source = "__text" if text in names else text
    if source != text:
        df = df.withColumn(source, F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for piece in slices(batch, batch.schema.get_field_index(source), most_bytes):
                new = compute(piece.column(piece.schema.get_field_index(source)))
                old = [piece.column(piece.schema.get_field_index(n)) for n in kept]
                yield pa.RecordBatch.from_arrays([*old, *new], names=[*kept, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


_CLASSES: dict[str, np.ndarray] = {}


def characters(kind: str) -> np.ndarray:
    """A lookup over all code points, made from Python's own string methods: lower, alpha, upper, digit, space."""
    if not _CLASSES:
        every = [chr(i) for i in range(0x110000)]
        _CLASSES["lower"] = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in every], dtype=np.uint32)
        for name in ("alpha", "upper", "digit", "space"):
            _CLASSES[name] = np.fromiter((getattr(c, f"is{name}")() for c in every), dtype=bool, count=len(every))
    return _CLASSES[kind]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and where each text starts (one more entry for the end)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, dtype=np.uint32), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The pieces ``codes`` of ``flat`` one after the other; piece c is ``flat[starts[c] : starts[c] + sizes[c]]``."""
    long = sizes[codes]
    ends = np.cumsum(long)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[codes] - (ends - long), long) + np.arange(total)]
