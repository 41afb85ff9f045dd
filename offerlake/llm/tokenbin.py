"""Token-id files: frequency-ranked ids in byte-aligned variable length with separate control bytes.

A file holds a run of documents in ascending order of doc_id:

    magic "OLTB", version, number of documents, number of ids,
    ids of all documents before the first                        (4 bytes, then 4 unsigned 64-bit)
    doc_id and id count of every document                        (signed / unsigned 64-bit arrays)
    control bytes                                                (two bits an id: its byte length - 1)
    data bytes                                                   (the id's rank, little-endian)

Ranks order all ids by how often the whole corpus has them, so frequent ids take one byte. ``ranks``
holds the ids by rank, in the same folder. A control byte is decoded by one lookup in a table of 256
rows of four lengths.

Texts are dealt into ranges of doc_id and cut at the definition's added tokens, then into words; each
distinct word of a block is looked up among the answers that the worker keeps, and the tokenizer encodes the
rest. Counts of all ids give the ranks. Documents with the same doc_id stand in the order of a hash of their
text, then of the text; one document has less than 2 GB of ids. Null ids come first, null texts count as empty
(one end id); an empty table gives no files and no rows; other columns are not read. Files are
written under a temporary name and renamed, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from offerlake.llm.bpe import class_table, pieces, spread
from offerlake.llm.common import empty_text, packed, release_memory, short_hashes, stage, text_buffers, text_steps

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

MAGIC = b"OLTB"
VERSION = 1
#: Ids in a file; a longer document has a file of its own.
FILE_IDS = 2_000_000
BLOCK_BYTES = 6_000_000
#: Words of one text of the tokenizer, and texts of one call; the cost of a word grows with the words of its text.
CALL_WORDS, CALLS = 200, 20
#: Words whose ids a worker keeps, and the bytes of the longest of them.
KEPT_WORDS, KEPT_LENGTH = 200_000, 40
NULL_ID = -(1 << 63)

#: Lengths of the four ids of every control byte.
LENGTHS = np.stack([((np.arange(256) >> (2 * k)) & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Control bytes, then data bytes."""
    ranks = np.ascontiguousarray(ranks, np.uint32)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes() + data[np.arange(4) < size[:, None]].tobytes()


def unpack_ranks(blob: np.ndarray, count: int) -> np.ndarray:
    n = -(-count // 4)
    size = LENGTHS[blob[:n]].ravel()[:count].astype(np.int64)
    ends = np.cumsum(size)
    data = np.concatenate([blob[n : n + (int(ends[-1]) if count else 0)], np.zeros(4, np.uint8)])
    at = ends - size
    wide = data[at].astype(np.uint32) | data[at + 1].astype(np.uint32) << 8 | data[np.minimum(at + 2, len(data) - 1)].astype(np.uint32) << 16 | data[np.minimum(at + 3, len(data) - 1)].astype(np.uint32) << 24
    return wide & _MASKS[size]


def file_bytes(doc_ids: np.ndarray, counts: np.ndarray, ranks: np.ndarray, start: int = 0) -> bytes:
    head = MAGIC + struct.pack("<QQQQ", VERSION, len(doc_ids), len(ranks), start)
    return head + np.asarray(doc_ids, "<i8").tobytes() + np.asarray(counts, "<u8").tobytes() + pack_ranks(ranks)


def read_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, counts and ranks of a file, and how many ids stand before it."""
    if content[:4] != MAGIC:
        raise ValueError("not a token-id file")
    version, docs, ids, start = struct.unpack_from("<QQQQ", content, 4)
    if version != VERSION:
        raise ValueError(f"version {version} of the token-id file is unknown")
    doc_ids = np.frombuffer(content, "<i8", docs, 36)
    counts = np.frombuffer(content, "<u8", docs, 36 + 8 * docs).astype(np.int64)
    return doc_ids, counts, unpack_ranks(np.frombuffer(content, np.uint8, offset=36 + 16 * docs), ids), start


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point as the tokenizers library has it."""
    return class_table(lambda pattern, text: "".join(part for part, _ in Split(Regex(f"(?!{pattern})[\\s\\S]"), "removed").pre_tokenize_str(text)))


@lru_cache(maxsize=2)
def added_tokens(definition: str) -> tuple[re.Pattern | None, dict[bytes, int]]:
    """What finds the definition's added tokens in a text (the longest at a place), and their ids."""
    tokens = json.loads(definition).get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens that take in or ask for neighbours are not supported")
    ids = {t["content"].encode(): t["id"] for t in tokens if t["content"]}
    longest = sorted(ids, key=lambda t: (-len(t), t))
    return re.compile(b"|".join(map(re.escape, longest))) if ids else None, ids


class Words:
    """Ids of words by the tokenizer. Answers are kept, and the older half goes when they are too many."""

    def __init__(self, definition: str):
        self.tokenizer, (self.special, self.special_ids) = Tokenizer.from_str(definition), added_tokens(definition)
        self.kept: dict[bytes, bytes] = {}
        self.mark = next(((t.decode(), i) for t, i in self.special_ids.items()), None)
        self.special_answers = {t: np.array([i], np.uint32).tobytes() for t, i in self.special_ids.items()}

    def ids(self, words: list[bytes], repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each word has; answers of the repeated ones are kept."""
        self.kept.update(self.special_answers)
        found = list(map(self.kept.get, words))
        missing = [i for i, answer in enumerate(found) if answer is None]
        for first in range(0, len(missing), CALL_WORDS * CALLS):
            parts = [missing[at : at + CALL_WORDS] for at in range(first, min(first + CALL_WORDS * CALLS, len(missing)), CALL_WORDS)]
            for part, (ids, ends) in zip(parts, self._encoded([[words[i].decode() for i in part] for part in parts]), strict=True):
                for i, a, b in zip(part, [0, *ends], ends, strict=False):
                    found[i] = ids[4 * a : 4 * b]
        fresh = [i for i in missing if repeated[i] and len(words[i]) <= KEPT_LENGTH]
        if len(self.kept) + len(fresh) > KEPT_WORDS:
            self.kept = dict(itertools.islice(self.kept.items(), len(self.kept) // 2, None))
        self.kept.update((words[i], found[i]) for i in fresh[: KEPT_WORDS - len(self.kept)])
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4


    def _encoded(self, parts: list[list[str]]) -> Iterator[tuple[bytes, list[int]]]:
        """Ids of each list of words end to end, and where each word's end."""
        if self.mark is None:
            for part in parts:
                call = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                yield np.array(call.ids, np.uint32).tobytes(), np.cumsum(np.bincount(np.array(call.word_ids, np.int64), minlength=len(part))).tolist()
            return
        # an added token between two words keeps them apart, and encodings need no offsets
        mark, number = self.mark
        for part, call in zip(parts, self.tokenizer.encode_batch_fast([mark.join(part) for part in parts], add_special_tokens=False), strict=True):
            ids = np.array(call.ids, np.uint32)
            cuts = np.flatnonzero(ids == number)
            ends = np.append(cuts, len(ids)) - np.arange(len(cuts) + 1)
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not keep words apart at its added token")
            yield ids[ids != number].tobytes(), ends.tolist()


@lru_cache(maxsize=1)
def _words(definition: str) -> Words:
    return Words(definition)


def cut_texts(words: Words, data: np.ndarray, raw: bytes, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and added tokens, and the rows' offsets among them."""
    hits = [m.span() for m in words.special.finditer(raw)] if words.special else []
    if hits and (offsets[np.searchsorted(offsets, [a for a, _ in hits], side="right")] < [b for _, b in hits]).any():  # over the end of a row
        rows = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        hits = [m.span() for a, b in rows for m in words.special.finditer(raw, a, b)]
    if not hits:
        starts, at = pieces(data, offsets, table)
        return starts, np.append(starts[1:], len(data)), at
    edges = np.unique(np.concatenate([offsets, np.array(hits).ravel()]))
    starts, _ = pieces(data, edges, table)
    first, last = np.array(hits).T
    inside = np.searchsorted(last, starts, side="right")  # the next token that ends behind this start
    drop = (inside < len(last)) & (starts > first[np.minimum(inside, len(last) - 1)])
    starts = starts[~drop]
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``BLOCK_BYTES``, as a longer block repeats more of its words."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _encode(definition: str, end_id: int, table: np.ndarray):
    names = ["part", "turn", "before", "doc_id", "n_tokens", "ids", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, turn, before = _words(definition), TaskContext.get().partitionId(), 0, 0
        for batch in _gathered(batches):
            for low, high, data, offsets in text_steps(batch.column(1), 2 * BLOCK_BYTES):
                raw = data.tobytes()
                starts, ends, at = cut_texts(words, data, raw, offsets, table)
                number, distinct = pd.factorize(short_hashes(data, starts, ends))
                index, times = np.empty(len(distinct), np.int64), np.bincount(number, minlength=len(distinct))
                index[number[::-1]] = np.arange(len(number))[::-1]  # the first place of each
                flat, lengths = words.ids([raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)], times > 1)
                # one more word stands for the end of a document
                del raw, data, starts, ends, index, distinct
                flat, lengths = np.append(flat, np.uint32(end_id)), np.append(lengths, 1)
                first = np.cumsum(lengths) - lengths
                which = np.insert(number, at[1:], len(lengths) - 1)
                sums = np.concatenate([[0], np.cumsum(lengths[which])])
                edges = sums[at + np.arange(len(at))]
                ids, n, counts = flat[spread(first[which], lengths[which])], high - low, np.diff(edges)
                # the first row of a step counts its ids, so that the corpus is not read again for their frequency
                times = np.bincount(ids)
                own = np.flatnonzero(times)
                seen = [np.stack([own, times[own]]).astype("<i8").tobytes(), *[None] * (n - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array(range(turn, turn + n), pa.int64()), pa.array(before + edges[:-1]), batch.column(0).slice(low, n), pa.array(counts), packed(ids.view(np.uint8), 4 * edges), pa.array(seen, pa.binary())],
                    names=names,
                )
                turn, before = turn + n, before + int(edges[-1])

    return run


def encode_in_order(docs: DataFrame, definition: str, end_id: int = 0, text: str = "text") -> DataFrame:
    """Ids of every document, staged; (part, turn) is the ascending order of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    return stage(ranged.mapInArrow(_encode(definition, end_id, classes()), "part int, turn long, before long, doc_id long, n_tokens long, ids binary, seen binary"), "token-ids", tidy=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for blob in batch.column(0):
            seen, times = np.frombuffer(blob.as_buffer(), "<i8").reshape(2, -1)
            if len(seen) and seen[-1] >= len(total):
                total = np.concatenate([total, np.zeros(int(seen[-1]) + 1 - len(total), np.int64)])
            total[seen] += times
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def frequency_order(encoded: DataFrame) -> np.ndarray:
    """Ids by falling frequency, ties by id. As many rows as the vocabulary has ids at most."""
    counts = encoded.where("seen IS NOT NULL").select("seen").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted(((-r["n"], r["id"]) for r in counts.collect()))
    return np.array([i for _, i in found], np.uint32)


def _put(store: fs.FileSystem, path: str, content: bytes) -> None:
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, path)


def _write(folder: str, rank_of: np.ndarray, base_of: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        key, size, start = None, 0, 0

        def flush() -> pa.RecordBatch:
            ids, counts, ranks = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"{key[0]:08d}-{key[1]:012d}.tok"
            _put(store, f"{base}/{name}", file_bytes(ids, counts, ranks, start))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)]), pa.array([len(ranks)])], names=["file", "docs", "ids"])

        for batch in batches:
            part, turn = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            before, doc_ids = batch.column(2).to_numpy(), batch.column(3).fill_null(NULL_ID).to_numpy()
            counts, (data, edges) = batch.column(4).to_numpy(), text_buffers(batch.column(5))
            first = 0
            while first < len(part):
                # a run of one part without gaps, up to the size of a file
                same = (part[first:] == part[first]) & (turn[first:] - turn[first] == np.arange(len(part) - first))
                end = first + (len(same) if same.all() else int(np.argmin(same)))
                end = min(end, max(first + 1, first + int(np.searchsorted(np.cumsum(counts[first:end]), FILE_IDS, side="right"))))
                follows = key is not None and key[0] == part[first] and key[2] == turn[first]
                if held and (not follows or size + int(counts[first:end].sum()) > FILE_IDS):
                    yield flush()
                    held, key, size = [], None, 0
                start = start if held else base_of[int(part[first])] + int(before[first])
                key = (int(part[first]), int(turn[first]) if key is None else key[1], int(turn[end - 1]) + 1)
                numbers = np.frombuffer(data[edges[first] : edges[end]].tobytes(), np.uint32)
                held.append((doc_ids[first:end], counts[first:end], rank_of[numbers]))
                size += len(numbers)
                first = end
        if held:
            yield flush()
        held = []
        release_memory()

    return run


def write_files(encoded: DataFrame, folder: str) -> DataFrame:
    """Writes the files of ``encoded`` and the id order; one row per file."""
    order = frequency_order(encoded)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    store, base = fs.FileSystem.from_uri(folder)
    _put(store, f"{base}/ranks", file_bytes(np.empty(0), np.empty(0), order))
    # one row per range, of which there are as many as shuffle partitions
    totals = sorted((r["part"], r["n"]) for r in encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base_of = dict(zip((p for p, _ in totals), itertools.accumulate((n for _, n in totals), initial=0), strict=False))
    rows = encoded.drop("seen").sortWithinPartitions("part", "turn").mapInArrow(_write(folder, rank_of, base_of), "file string, docs long, ids long")
    return stage(rows, "token-files")


def _read(order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                doc_ids, counts, ranks, start = read_file(content.as_buffer().to_pybytes())
                ids = order[ranks].astype("<u4")
                ends = np.cumsum(counts)
                for a in range(0, len(doc_ids), 1000):
                    b = min(a + 1000, len(doc_ids))
                    low = int(ends[a] - counts[a])
                    edges = np.concatenate([[0], 4 * (ends[a:b] - low)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[a:b], pa.int64(), mask=doc_ids[a:b] == NULL_ID), pa.array(start + ends[a:b] - counts[a:b]), pa.array(counts[a:b]), packed(ids[low : int(ends[b - 1])].view(np.uint8), edges)],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                del ids, ranks
        release_memory()

    return run


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files alone."""
    def found(pattern: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)

    head = found("ranks").select("content").first()
    if head is None:
        raise FileNotFoundError(f"no token-id files in {folder}")
    order = read_file(bytes(head["content"]))[2]
    return found("*.tok").select("content").mapInArrow(_read(order), "doc_id long, start long, n_tokens long, ids binary")
