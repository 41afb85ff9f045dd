"""Shared helpers: staged tables, Arrow text buffers, hashed words, fold rules.

A word is a longest run of bytes outside ASCII punctuation, space and control characters, after
lower-casing A-Z. Texts that are null count as empty.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.session import checkpoint_dir

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 500_000
#: Rows of an Arrow batch where the session keeps Spark's default of 10,000: texts are long rows.
BATCH_ROWS = "1000"

_CODES = np.arange(256)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
IS_WORD = (_CODES >= 128) | ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122))


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per Spark context, and makes Arrow batches short."""
    context = spark.sparkContext
    release_memory()  # of the driver: what fitting a model has left
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(context, "_offerlake_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "offerlake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(Path(package.name) / source.relative_to(package)))
    context.addPyFile(str(archive))
    context._offerlake_sent = True


def stage(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it back; the files go when the JVM ends.

    ``tidy`` asks the driver's JVM to collect its garbage, so that Spark's cleaner drops the shuffle
    files of the finished job before the next one writes its own.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{stage_folder(spark, name)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    if tidy:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir that Hadoop removes when the JVM ends."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def empty_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """The documents whose labels no model sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(name, kind) for name, kind in fields])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the n + 1 offsets of the rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    spans = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[spans[0] : spans[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, spans - spans[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Gives what this Python worker has freed back to the system, as idle workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM is not None:  # glibc only
        _MALLOC_TRIM(0)


def text_steps(column: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of each step of a text column."""
    data, offsets = text_buffers(column)
    for first, last in steps(offsets, size):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
    release_memory()


def packed(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary rows from bytes and offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets of the rows."""
    inside = IS_WORD[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    cut = offsets[offsets < len(data)]
    left = before[:-1].copy()
    left[cut] = False
    starts = np.flatnonzero(inside & ~left)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    after[cut] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ODD = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps_ = np.full(n, base, np.uint64)
            steps_[0] = 1
            _powers[i] = np.cumprod(steps_, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_ODD))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, equal for equal spans anywhere."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_LAST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def short_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, eight bytes at a time: made for many short spans."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = ends - starts
    out = mixed((eight[starts] & _LAST_BYTES[np.minimum(left, 8)]) + left.astype(np.uint64) * np.uint64(_ODD))
    longer, at = np.flatnonzero(left > 8), 8
    while len(longer):
        rest = left[longer] - at
        out[longer] = mixed((out[longer] * np.uint64(_ODD)) ^ (eight[starts[longer] + at] & _LAST_BYTES[np.minimum(rest, 8)]))
        longer, at = longer[rest > 8], at + 8
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(BYTE_VALUES[LOWER[data]], starts, ends)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, text: str = "text") -> DataFrame:
    """At most ``per_class`` labelled training texts of either class, in a fixed pseudo-random order.

    Held-out documents, null labels, ids without a row in ``docs`` and texts over ``max_chars``
    characters are left out before the sample is drawn; each class carries its weight (labelled ids
    that could be drawn per drawn id). Rows: label, weight, text.
    """
    short = docs.select("doc_id", empty_text(text).alias("text")).where(F.length("text") <= max_chars)
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .join(short.select("doc_id"), "doc_id", "left_semi")
        .withColumn("turn", F.xxhash64(F.col("doc_id").cast("string"), F.lit(label)))
    )
    known = stage(known, f"labelled-{label}")  # read three times
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = []
    for value in (0, 1):
        total = counts.get(value, 0)
        taken = min(total, per_class)
        parts.append(
            known.where(F.col("label") == value).orderBy("turn", "doc_id").limit(per_class)
            .select("doc_id", "label", F.lit(total / taken if taken else 1.0).alias("weight"))
        )
    # at most 2 * per_class ids, so the broadcast has a fixed bound
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    return short.join(chosen, "doc_id").select("label", "weight", "text").dropDuplicates()
