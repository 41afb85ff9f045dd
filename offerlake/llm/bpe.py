"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Texts are cut into pre-tokens. Documents are gathered into blocks of about ``BLOCK_BYTES`` (a
   longer document is a block of its own); a block keeps, per document, the positions of its words as
   numbers of a block dictionary. Blocks are staged, so texts are cut once.
2. The dictionaries are dealt by a hash of the word into buckets, which are sorted and streamed; a bucket
   encodes each distinct word once (as long as its answers fit into a bounded table) and answers every block
   that asked for it. A word is asked for once per block at most, so the
   most frequent word weighs no more than any other.
3. A block meets its answers and is put together by position with numpy.

Decoding looks ids up in the token-byte table, a map-side join with a table bounded by the vocabulary.

Null texts count as empty and have no ids; repeated rows give repeated rows; an empty table stays
empty; other columns are not read.
"""

from __future__ import annotations

import base64
import itertools
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm.common import BYTE_VALUES, STEP_BYTES, empty_text, packed, release_memory, span_hashes, stage_folder, steps, text_buffers, with_fields

BLOCK_BYTES = 6_000_000
#: Words of a bucket whose ids are kept at once, and the characters of the longest of them.
KEPT_WORDS, KEPT_LENGTH = 200_000, 64


@dataclass(frozen=True)
class Ranks:
    """A vocabulary of byte strings with their ranks, and the pattern that cuts the text."""

    pattern: str
    tokens: tuple[tuple[bytes, int], ...]

    @staticmethod
    def load(path: str, pattern: str) -> Ranks:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return Ranks(pattern, tuple((base64.b64decode(token), int(rank)) for token, rank in pairs))


@lru_cache(maxsize=2)
def _encoding(ranks: Ranks) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=ranks.pattern, mergeable_ranks=dict(ranks.tokens), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """All token bytes end to end by id, and their offsets; a missing id has no bytes."""
    by_id = dict.fromkeys(range(max((i for _, i in ranks.tokens), default=-1) + 1), b"")
    by_id.update((i, token) for token, i in ranks.tokens)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in by_id.values()])]).astype(np.int64)
    return np.frombuffer(b"".join(by_id.values()), np.uint8), offsets


#: Classes of characters; the rest is 0.
LETTER, NUMBER, SPACE = 1, 2, 3
#: The pattern whose matches ``pieces`` finds, as public tokenizers of this kind use it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def class_table(members: Callable[[str, str], str]) -> np.ndarray:
    """The class of every code point, from ``members(pattern, text)``: the characters of text that match."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[np.frombuffer(members(name, every).encode("utf-32-le"), np.uint32)] = kind
    return out


def _members(pattern: str, text: str) -> str:
    library = tiktoken.Encoding("members", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return bytes(library.encode_ordinary(text)).decode()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point as the tiktoken library has it."""
    return class_table(_members)


def byte_classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the character of every byte of UTF-8."""
    out = table[np.minimum(data, 127)]
    leads = np.flatnonzero(data >= 0xC0)
    if len(leads):
        size = 2 + (data[leads] >= 0xE0) + (data[leads] >= 0xF0)
        code = (data[leads] & (0x7F >> size)).astype(np.int32)
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | (data[leads[more] + k] & 0x3F)
        kind = table[code]
        out[leads] = kind
        for k in (1, 2, 3):
            more = size > k
            out[leads[more] + k] = kind[more]
    return out


def pieces(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all matches of ``PATTERN`` (they follow without gaps), and the rows' match offsets."""
    n = len(data)
    kind = byte_classes(data, table)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    edge = begins[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(edge)
    last = np.append(first[1:], n)
    run = kind[first]
    ends_row = begins[last]
    cuts = edge.copy()
    # a run of spaces before something else gives its last space away
    spaces = np.flatnonzero((run == SPACE) & ~ends_row)
    tail = last[spaces] - 1
    while len(tail) and ((data[tail] & 0xC0) == 0x80).any():  # to the first byte of that character
        tail = np.where((data[tail] & 0xC0) == 0x80, tail - 1, tail)
    cuts[tail] = True
    blank = data[tail] == 32
    cuts[last[spaces][blank]] = False
    # a lone apostrophe that no blank precedes takes the letters of a contraction
    quote = np.flatnonzero((run == 0) & (last - first == 1) & ~ends_row & (data[first] == 39) & cuts[first])
    if len(quote):
        quote = quote[run[quote + 1] == LETTER]
        at = first[quote] + 1
        room = last[quote + 1] - at
        one, two = data[at], data[np.minimum(at + 1, n - 1)]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = (room > 1) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        taken = np.where(single, 1, np.where(double, 2, 0))
        hit = taken > 0
        cuts[at[hit]] = False
        after = (at + taken)[hit]
        cuts[after[(taken < room)[hit]]] = True
    starts = np.flatnonzero(cuts)
    return starts, np.searchsorted(starts, offsets)


def _strings_of(blob: bytes, count: int) -> list[str]:
    raw = zlib.decompress(blob)
    lengths = np.frombuffer(raw, np.uint32, count)
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), count, [None, pa.py_buffer(offsets), pa.py_buffer(raw[4 * count :])]).to_pylist()


BLOCKS = "block string, doc_ids array<long>, counts array<long>, bucket_of binary, positions binary, asked array<struct<bucket: int, size: int, words: binary>>"
_ASKED = pa.list_(pa.struct([("bucket", pa.int32()), ("size", pa.int32()), ("words", pa.binary())]))


def _blocks(buckets: int, table: np.ndarray, block_bytes: int):
    def block(ids: list[pa.Array], texts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        # step by step, since the hashes take eight bytes for each byte of text
        found, sizes, counts, hashes, base = [], [], [], [], 0
        for part, offsets in texts:
            starts, at = pieces(part, offsets, table)
            ends = np.append(starts[1:], len(part))
            hashes.append(span_hashes(BYTE_VALUES[part], starts, ends))
            found.append(starts + base)
            sizes.append((ends - starts).astype(np.uint32))
            counts.append(np.diff(at))
            base += len(part)
        data, starts, lengths = np.concatenate([d for d, _ in texts]), np.concatenate(found), np.concatenate(sizes)
        _, index, number, count = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True, return_counts=True)
        del hashes, found, sizes
        # words by falling frequency, so that the high bytes of the positions are nearly empty
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        first, size = starts[index[order]], lengths[index[order]].astype(np.int64)
        letters = data[spread(first, size)]
        edges = np.concatenate([[0], np.cumsum(size)])
        raw = letters.tobytes()
        bucket_of = np.fromiter((zlib.crc32(raw[a:b]) % buckets for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)), np.uint16, len(size))
        by_bucket = np.argsort(bucket_of, kind="stable")
        cut = np.flatnonzero(np.diff(bucket_of[by_bucket].astype(np.int64), prepend=-1))
        asked = []
        for a, b in zip(cut, np.append(cut, len(by_bucket))[1:], strict=True):
            these = by_bucket[a:b]
            words = size[these].astype(np.uint32).tobytes() + letters[spread(edges[these], size[these])].tobytes()
            asked.append({"bucket": int(bucket_of[these[0]]), "size": int(b - a), "words": zlib.compress(words, 1)})
        planes = rank[number].view(np.uint8).reshape(-1, 4).T.tobytes()
        doc_ids = pa.chunked_array(ids).combine_chunks().to_pylist()
        row = ([uuid.uuid4().hex], [doc_ids], [np.concatenate(counts).tolist()], [bucket_of.tobytes()], [zlib.compress(planes, 2)], [asked])
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), _ASKED)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["block", "doc_ids", "counts", "bucket_of", "positions", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in steps(offsets, STEP_BYTES):
                part = data[offsets[first] : offsets[last]]
                if ids and size + len(part) > block_bytes:
                    yield block(ids, texts)
                    release_memory()
                    ids, texts, size = [], [], 0
                ids.append(batch.column(0).slice(first, last - first))
                texts.append((part, offsets[first : last + 1] - offsets[first]))
                size += len(part)
        if ids:
            yield block(ids, texts)
        ids, texts = [], []
        release_memory()

    return run


ANSWERS = "block string, bucket int, lengths binary, ids binary"


def _answer(ranks: Ranks):
    """Answers rows as they come, one bucket after the other; the bucket's words are encoded once while they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kept, current = _encoding(ranks).encode_ordinary, {}, None
        for batch in batches:
            rows = []
            for block, bucket, size, words in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "size", "words")), strict=True):
                if bucket != current:
                    kept, current = {}, bucket
                own = _strings_of(words, size)
                found = list(map(kept.get, own))
                missing = [i for i, answer in enumerate(found) if answer is None]
                for i in missing:
                    found[i] = np.array(encode(own[i]), np.uint32).tobytes()
                if len(kept) + len(missing) > KEPT_WORDS:
                    kept = dict(itertools.islice(kept.items(), len(kept) // 2, None))
                kept.update((own[i], found[i]) for i in missing[: KEPT_WORDS - len(kept)] if len(own[i]) <= KEPT_LENGTH)
                lengths = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                planes = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 4).T.tobytes()
                rows.append((block, bucket, zlib.compress(lengths.astype(np.uint32).tobytes(), 1), zlib.compress(planes, 1)))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "bucket", "lengths", "ids"])
        kept = {}
        release_memory()

    return run


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every run, end to end."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _reassemble(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    answers = answers.sort_values("bucket")
    out = []
    for row in blocks.itertuples(index=False):
        counts = np.asarray(row.counts, np.int64)
        mine = answers[answers["block"] == row.block]
        # answers come by bucket, and inside a bucket in the order of the block's words
        lengths = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint32) for x in mine["lengths"]] or [np.empty(0, np.uint32)]).astype(np.int64)
        flat = np.concatenate([_planes(x) for x in mine["ids"]] or [np.empty(0, np.uint32)])
        order = np.argsort(np.frombuffer(row.bucket_of, np.uint16), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        which = place[_planes(row.positions)]
        edges = np.concatenate([[0], np.cumsum(counts)])
        sums = np.concatenate([[0], np.cumsum(lengths[which])])
        ids = flat[spread(starts[which], lengths[which])].tobytes()
        at = sums[edges]
        out.append(pd.DataFrame({"doc_id": pd.array(row.doc_ids, "Int64"), "n_tokens": np.diff(at), "ids": [ids[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)]}))
    return pd.concat(out) if out else pd.DataFrame({"doc_id": pd.array([], "Int64"), "n_tokens": pd.array([], "Int64"), "ids": []})


def encode(docs: DataFrame, ranks: Ranks, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row.

    Shorter blocks take less memory and ask for more words twice.
    """
    if ranks.pattern != PATTERN:
        raise ValueError("the cutter is made for one pattern")
    spark = docs.sparkSession
    buckets = min(65535, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text(text).alias("text"))
    # bucketed by block, so that the positions meet their answers without being shuffled
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    made = texts.mapInArrow(_blocks(buckets, classes(), block_bytes), BLOCKS).write.option("path", f"{stage_folder(spark, 'bpe-blocks')}/rows")
    made.bucketBy(buckets, "block").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files and this resolved reader stay
    asked = blocks.select("block", F.inline("asked"))
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer(ranks), ANSWERS)
    held = blocks.select("block", "doc_ids", "counts", "bucket_of", "positions")
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_reassemble, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: Ranks, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for."""
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offsets = _token_bytes(ranks)
        sizes = np.diff(offsets)
        for batch in batches:
            data, edges = text_buffers(batch.column(at))
            for first in range(0, len(edges) - 1, 256):
                last = min(first + 256, len(edges) - 1)
                numbers = np.frombuffer(data[edges[first] : edges[last]].tobytes(), np.uint32)
                lengths = sizes[numbers]
                sums = np.concatenate([[0], np.cumsum(lengths)])
                bytes_ = table[spread(offsets[numbers], lengths)]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, packed(bytes_, sums[(edges[first : last + 1] - edges[first]) // 4])], names=[*batch.schema.names, out])


    return encoded.mapInArrow(run, with_fields(encoded.schema, (out, T.BinaryType())))
