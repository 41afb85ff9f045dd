"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into phrases, each the shortest piece that is not yet in the
document's dictionary (LZ78 over code points). The phrases are hashed; the fingerprint is the sorted
list of the ``SLOTS`` smallest 32-bit hash values, as text in hexadecimal. The likeness of two
fingerprints is the share of common values among the ``SLOTS`` smallest of their union, an estimate of
the Jaccard similarity of the phrase sets, high where one text compresses well beside the other.

``with_next`` also edits every text: its last floor(n / 2) code points give way to the first as many
(or all) of the next document in falling order of doc_id; after the last comes the first. Texts are
dealt into ranges of doc_id, so neighbours meet in one task, and only the first and last document of a
range meet the next range through a small table.

Null texts count as empty: no phrases, fingerprint "", likeness 1 to another empty text and 0 to any
other. Documents with the same doc_id follow in the order of their text; null ids come last. A single
document is its own successor; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm.common import empty_text, mixed, span_hashes, stage

SLOTS = 64


def phrases(text: str, known: set[str], begun: str = "") -> tuple[list[str], str]:
    """New phrases of ``text`` after the dictionary ``known`` (extended in place), and what is unfinished."""
    found: list[str] = []
    add, keep, piece = known.add, found.append, begun
    for letter in text:
        piece += letter
        if piece not in known:
            add(piece)
            keep(piece)
            piece = ""
    return found, piece


def sketch(found: list[str]) -> np.ndarray:
    """The smallest 32-bit hash values of the phrases, sorted."""
    if not found:
        return np.empty(0, np.uint32)
    codes = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    starts = np.concatenate([[0], ends[:-1]])
    values = (span_hashes(mixed(codes + np.uint64(1)), starts, ends) >> np.uint64(32)).astype(np.uint32)
    if len(values) > 4 * SLOTS:
        values = np.partition(values, 2 * SLOTS)[: 2 * SLOTS + 1]
    return np.unique(values)[:SLOTS]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    if not len(a) and not len(b):
        return 1.0
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((counts[:SLOTS] == 2).mean())


def fingerprint(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def parsed(value: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(value), ">u4").astype(np.uint32)


def _both(text: str, insert: str) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of the text and of the text whose last half gives way to ``insert``; the common start is parsed once."""
    head = len(text) - len(text) // 2
    known: set[str] = set()
    begin, piece = phrases(text[:head], known)
    other = known.copy()
    rest, _ = phrases(text[head:], known, piece)
    edited, _ = phrases(insert, other, piece)
    return sketch(begin + rest), sketch(begin + edited)


def _sketch_of(text: str) -> np.ndarray:
    return sketch(phrases(text, set())[0])


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _edited(text: str, following: str) -> tuple[str, str]:
    insert = following[: len(text) // 2]
    return insert, hashlib.sha256((text[: len(text) - len(text) // 2] + insert).encode()).hexdigest()


def _finished(doc_id: int | None, text: str, own: np.ndarray, changed: np.ndarray, sha: str, after: np.ndarray) -> tuple:
    return doc_id, len(text), sha, fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, after)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a successor in their range are finished; the first and last text of a range go along."""
    part = TaskContext.get().partitionId()
    names, kinds = [*_NAMES, "part", "edge", "text"], [*_KINDS, pa.int32(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    held, rows, first = None, [], True
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held is not None:
                # the row before is finished as soon as this row's text and sketch are known
                insert, sha = _edited(held[1], text)
                own, changed = _both(held[1], insert)
                if waiting is not None:
                    rows.append((*_finished(*waiting, own), part, None, None))
                waiting = (held[0], held[1], own, changed, sha)
            else:
                waiting = None
            if first:
                rows.append((doc_id, None, None, None, None, None, None, part, "first", text))
                first = False
            held = (doc_id, text)
        if len(rows) >= 500:
            yield batch_of(rows)
            rows = []
    if held is not None:
        if waiting is not None:
            rows.append((*_finished(*waiting, _sketch_of(held[1])), part, None, None))
        rows.append((held[0], None, None, None, None, None, None, part, "last", held[1]))
    if rows:
        yield batch_of(rows)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            insert, sha = _edited(text, following)
            own, changed = _both(text, insert)
            rows.append(_finished(doc_id, text, own, changed, sha, _sketch_of(following)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    done = stage(ranged.mapInArrow(_ranges, ROW + ", part int, edge string, text string"), "lempelziv")
    edges = done.where(F.col("edge").isNotNull())
    first = edges.where(F.col("edge") == "first").select("part", F.col("text").alias("following"))
    last = edges.where(F.col("edge") == "last").select("part", "doc_id", "text")
    # one row per range; the last range meets the first
    ranges = first.select("part")
    after = ranges.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part"))).alias("next"))
    met = last.join(after, "part").join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")
    return done.where(F.col("edge").isNull()).select(*_NAMES).unionByName(met.mapInArrow(_meet, ROW))
