"""Audit of how far the sources of a language diverge, by an exact recount over minimal perfect hashes.

First pass: the documents of every (lang, term) are counted exactly; terms in at least ``LEAST_DOCS``
documents stay. The terms kept in any language are dealt to shards by hash, and each shard becomes a
minimal perfect hash with its keys stored in slot order. Second pass: shards are broadcast, every word looks
up its slot, the stored key is compared byte by byte, and a dense row of slots per (lang, source) is
incremented. Shards are sent in rounds of at most ``ROUND_BYTES`` (a single larger shard alone), each
over all documents, so what is broadcast never grows beyond that; the driver keeps one (number, size) per shard.

Counts leave a task in blocks of slots when its cells are full or it ends; Spark deals and sorts the blocks,
and equal ones are added up as they stream by. Probabilities and
divergences are integers throughout. Pairs of sources are compared in blocks of terms that are sized by
sources times terms; block sums are added up. A pair is a row of the result, so only rows of one language meet.

Null text, lang and source count as "". Repeated rows are documents of their own. Groups without terms stay:
all their terms have count 0. A language without kept terms has pairs of value 0. An empty table gives no
rows; other columns are not read. Very long texts are cut between words and counted in parts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm.common import BYTE_VALUES, STEP_BYTES, empty_text, mixed, release_memory, span_hashes, stage, steps, text_buffers, word_spans

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Terms and key bytes of a shard, on average.
SHARD_TERMS, SHARD_BYTES = 50_000, 1_000_000
#: Bytes of the hashes that are broadcast at once.
ROUND_BYTES = 32_000_000
#: Distinct terms, and their bytes, that a task of the first pass holds.
HELD_TERMS, HELD_BYTES = 200_000, 16_000_000
#: Counters that a task of the second pass holds.
HELD_CELLS = 12_000_000
#: Slots of a source that leave a task as one row.
BLOCK_SLOTS = 4096
#: Cells (sources times terms) of a block in which sources are compared.
BLOCK_CELLS = 100_000
#: Positions per key in a level of the perfect hash, and levels before keys are listed.
LOAD, LEVELS = 1.4, 40

#: Letters in lower case and all bytes beyond ASCII; other bytes separate terms.
TERM_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
_TRANSLATION = TERM_BYTES.tobytes()


def document_terms(text: str) -> set[bytes]:
    plain, found, at = text.encode().translate(_TRANSLATION), set(), 0
    while at < len(plain):
        end = plain.find(b" ", at + STEP_BYTES)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def _document_counts(batches: Iterator[pa.RecordBatch], most_terms: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)
    terms = size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            names, values = list(counts), list(counts.values())
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array(values[at : at + 50_000], pa.int64())], names=["lang", "term", "docs"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = held[lang]
            before, found = len(counts), document_terms(text.as_py())
            size += sum(len(t) for t in found if t not in counts)
            counts.update(found)
            terms += len(counts) - before
            if terms >= most_terms or size >= most_bytes:
                yield from flush()
                terms = size = 0
    yield from flush()
    release_memory()


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term) in at least LEAST_DOCS documents of the language; terms are UTF-8 bytes."""
    rows = docs.select(empty_text("lang").alias("lang"), empty_text().alias("text"))
    counts = rows.mapInArrow(partial(_document_counts, most_terms=HELD_TERMS, most_bytes=HELD_BYTES), "lang string, term binary, docs long")
    return stage(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs"), "divergence-kept", tidy=True)


def term_hashes(terms: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(terms)
    return span_hashes(BYTE_VALUES[data], offsets[:-1], offsets[1:])


def _place(hashes: np.ndarray, level: int, size) -> np.ndarray:
    return mixed(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.asarray(size, np.uint64)


class Hash:
    """A minimal perfect hash: levels of bits, each key at the first level where it stands alone."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.levels, self.slots, left, taken = [], np.full(n, -1, np.int64), np.arange(n), 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(8, int(LOAD * len(left)))
            places = _place(hashes[left], level, size)
            alone = np.bincount(places.astype(np.int64), minlength=size) == 1
            good = alone[places.astype(np.int64)]
            bits = np.zeros(size, bool)
            bits[places[good].astype(np.int64)] = True
            rank = np.cumsum(bits) - 1
            self.slots[left[good]] = taken + rank[places[good].astype(np.int64)]
            self.levels.append(bits)
            taken, left = taken + int(good.sum()), left[~good]
        # keys that no level parts, as those with equal hashes
        self.slots[left] = np.arange(taken, n)
        self.listed = left


def _build(table: pa.Table) -> pa.Table:
    """One row for a shard: its hash and its keys in slot order."""
    terms = table.column("term").combine_chunks()
    hashed = Hash(term_hashes(terms))
    order = np.argsort(hashed.slots)
    keys = terms.take(pa.array(order))
    data, offsets = text_buffers(keys)
    bits = [np.packbits(b).tobytes() for b in hashed.levels]
    columns = [
        pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([len(terms)], pa.int64()), pa.array([[len(b) for b in hashed.levels]], pa.list_(pa.int64())),
        pa.array([bits], pa.list_(pa.binary())), pa.array([data.tobytes()], pa.binary()), pa.array([np.diff(offsets).astype(np.int32).tobytes()], pa.binary()),
        pa.array([len(hashed.listed)], pa.int64()),
    ]
    return pa.table(columns, names=SHARD_NAMES)


SHARD_NAMES = ["shard", "n", "sizes", "bits", "keys", "lengths", "listed"]
SHARDS = "shard int, n long, sizes array<long>, bits array<binary>, keys binary, lengths binary, listed long"


def build_shards(kept: DataFrame) -> tuple[DataFrame, int]:
    """The perfect hashes of all distinct kept terms, and the number of shards."""
    terms = stage(kept.select("term").distinct(), "divergence-terms")
    size = terms.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    shards = max(1, -(-size["n"] // SHARD_TERMS), -(-(size["bytes"] or 0) // SHARD_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = (term_hashes(batch.column(0)) % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0)], names=["shard", "term"])

    dealt = terms.mapInArrow(deal, "shard int, term binary")
    return stage(dealt.groupBy("shard").applyInArrow(_build, SHARDS), "divergence-shards"), shards


class Round:
    """Shards of one round, ready for lookups; slots are numbered through."""

    def __init__(self, rows: list[dict], shards: int):
        self.shards = shards
        self.number = np.full(shards, -1, np.int64)
        depth = max((len(r["sizes"]) for r in rows), default=0)
        self.sizes = np.ones((len(rows), max(depth, 1)), np.uint64)
        self.starts = np.zeros((len(rows), max(depth, 1)), np.int64)
        tables, lengths, self.listed, filled, first = [np.full(1, -1, np.int32)], [], {}, 1, 0
        self.bases = []
        for i, row in enumerate(rows):
            self.number[row["shard"]] = i
            taken = 0
            for level, (size, packed) in enumerate(zip(row["sizes"], row["bits"], strict=True)):
                bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=size).astype(bool)
                tables.append(np.where(bits, first + taken + np.cumsum(bits) - 1, -1).astype(np.int32))
                self.sizes[i, level], self.starts[i, level] = size, filled
                filled, taken = filled + size, taken + int(bits.sum())
            own = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
            ends = np.cumsum(own)
            for slot in range(row["n"] - row["listed"], row["n"]):
                self.listed[bytes(row["keys"][ends[slot] - own[slot] : ends[slot]])] = first + slot
            lengths.append(own)
            self.bases.append((row["shard"], first, row["n"]))
            first += row["n"]
        self.table, self.n = np.concatenate(tables), first
        self.keys = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8)
        self.lengths = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of every word, -1 where the stored key is another one."""
        hashes = span_hashes(BYTE_VALUES[data], starts, ends)
        number = self.number[(hashes % np.uint64(self.shards)).astype(np.int64)]
        found, active = np.full(len(hashes), -1, np.int64), np.flatnonzero(number >= 0)
        for level in range(self.sizes.shape[1]):
            if not len(active):
                break
            own = number[active]
            at = self.starts[own, level] + _place(hashes[active], level, self.sizes[own, level]).astype(np.int64)
            got = np.where(self.starts[own, level] > 0, self.table[at], -1)
            found[active[got >= 0]] = got[got >= 0]
            active = active[got < 0]
        same = np.flatnonzero(found >= 0)
        size = ends[same] - starts[same]
        fits = size == self.lengths[found[same]]
        found[same[~fits]] = -1
        same, size = same[fits], size[fits]
        if len(same):
            before = np.cumsum(size) - size
            inner = np.arange(int(size.sum())) - np.repeat(before, size)
            differs = data[np.repeat(starts[same], size) + inner] != self.keys[np.repeat(self.offsets[found[same]], size) + inner]
            found[same[np.logical_or.reduceat(differs, before)]] = -1
        if self.listed:
            for i in np.flatnonzero(found < 0):
                found[i] = self.listed.get(data[starts[i] : ends[i]].tobytes(), -1)
        return found


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with long rows cut between words, and the row of each piece."""
    sizes = np.diff(offsets)
    if not len(sizes) or sizes.max() <= STEP_BYTES:
        return offsets, np.arange(len(sizes))
    cuts, rows = [0], []
    for row, (start, end) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        at = start
        while end - at > STEP_BYTES:
            gap = np.flatnonzero(data[at + STEP_BYTES : min(end, at + 2 * STEP_BYTES)] == 32)
            if not len(gap):  # a word of more than a step, or none near
                gap = np.flatnonzero(data[at + STEP_BYTES : end] == 32)[:1]
                if not len(gap):
                    break
            at = at + STEP_BYTES + int(gap[0])
            cuts.append(at)
            rows.append(row)
        cuts.append(end)
        rows.append(row)
    return np.array(cuts), np.array(rows)


class Cells:
    """Counters by language, source and slot: a dense row for each source, over the slots its language has met."""

    def __init__(self, slots: int):
        self.slots, self.size = slots, 0
        self.index: dict[str, np.ndarray] = {}
        self.met: dict[str, np.ndarray] = {}
        self.rows: dict[tuple[str, str], np.ndarray] = {}

    def add(self, lang: str, source: str, slots: np.ndarray) -> None:
        if lang not in self.index:
            self.index[lang], self.met[lang] = np.full(self.slots, -1, np.int32), np.empty(0, np.int64)
            self.size += self.slots // 2
        index = self.index[lang]
        fresh = np.unique(slots[index[slots] < 0])
        if len(fresh):
            index[fresh] = np.arange(len(self.met[lang]), len(self.met[lang]) + len(fresh))
            self.met[lang] = np.concatenate([self.met[lang], fresh])
        row = self.rows.get((lang, source))
        if row is None or len(row) < len(self.met[lang]):
            room = np.zeros(min(self.slots, len(self.met[lang]) + len(self.met[lang]) // 4 + 64), np.int64)
            if row is not None:
                room[: len(row)] = row
            self.size += len(room) - (0 if row is None else len(row))
            row = self.rows[lang, source] = room
        np.add.at(row, index[slots], 1)

    def counts(self) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
        for (lang, source), row in self.rows.items():
            own = np.flatnonzero(row)
            slots, n = self.met[lang][own], row[own]
            order = np.argsort(slots)
            yield lang, source, slots[order], n[order]


def _recount(sent, shards: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Round(sent.value, shards)
        edges = np.array([first for _, first, _ in hashed.bases])
        numbers = np.array([shard for shard, _, _ in hashed.bases], np.int32)

        def flush(cells: Cells) -> Iterator[pa.RecordBatch]:
            for lang, source, slots, n in cells.counts():
                if not len(slots):
                    continue
                shard = np.searchsorted(edges, slots, side="right") - 1
                local = slots - edges[shard]
                block = local // BLOCK_SLOTS
                cut = np.flatnonzero(np.diff(shard * (1 << 40) + block, prepend=-1))
                ends = np.append(cut[1:], len(slots))
                spans = list(zip(cut.tolist(), ends.tolist(), strict=True))
                names = [pa.repeat(pa.scalar(name, pa.string()), len(cut)) for name in (lang, source)]
                yield pa.RecordBatch.from_arrays([
                    *names, pa.array(numbers[shard[cut]]), pa.array(block[cut].astype(np.int32)),
                    pa.array([local[a:b].astype("<i4").tobytes() for a, b in spans], pa.binary()), pa.array([n[a:b].astype("<i8").tobytes() for a, b in spans], pa.binary()),
                ], names=["lang", "source", "shard", "block", "slots", "counts"])

        cells = Cells(hashed.n)
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw, offsets = text_buffers(batch.column(2))
            for a, b in steps(offsets):
                data = TERM_BYTES[raw[offsets[a] : offsets[b]]]
                cut, rows = _pieces(data, offsets[a : b + 1] - offsets[a])
                for c, d in steps(cut):
                    text = data[cut[c] : cut[d]]
                    starts, ends, at = word_spans(text, cut[c : d + 1] - cut[c])
                    slots = hashed.slots(text, starts, ends)
                    groups: dict[tuple[str, str], list[np.ndarray]] = {}
                    for i, row in enumerate(rows[c:d].tolist()):
                        groups.setdefault((langs[a + row], sources[a + row]), []).append(slots[at[i] : at[i + 1]])
                    for (lang, source), parts in groups.items():
                        own = np.concatenate(parts)
                        cells.add(lang, source, own[own >= 0])
                        if cells.size >= held:
                            yield from flush(cells)
                            cells = Cells(hashed.n)
            release_memory()
        yield from flush(cells)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal blocks, which stand next to each other; one block is held at a time."""
    current, total = None, np.zeros(BLOCK_SLOTS, np.int64)

    def done() -> pa.RecordBatch:
        lang, source, shard, block = current
        own = np.flatnonzero(total)
        names = [pa.repeat(pa.scalar(name, pa.string()), len(own)) for name in (lang, source)]
        return pa.RecordBatch.from_arrays([*names, pa.array(np.full(len(own), shard, np.int32)), pa.array((own + block * BLOCK_SLOTS).astype(np.int32)), pa.array(total[own])], names=["lang", "source", "shard", "slot", "n"])

    for batch in batches:
        for *key, slots, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "shard", "block", "slots", "counts")), strict=True):
            if current != tuple(key):
                if current is not None:
                    yield done()
                current = tuple(key)
                total.fill(0)
            total[np.frombuffer(slots, "<i4") - current[3] * BLOCK_SLOTS] += np.frombuffer(counts, "<i8")
    if current is not None:
        yield done()


def recount(docs: DataFrame, shards: DataFrame, total: int) -> DataFrame:
    """(lang, source, shard, slot, n) of all kept terms; n occurrences, at least one."""
    rows = docs.select(empty_text("lang").alias("lang"), empty_text("source").alias("source"), empty_text().alias("text"))
    sizes = shards.select("shard", (F.octet_length("keys") + F.col("n") * 16).alias("bytes")).orderBy("shard").collect()
    rounds, room = [], 0
    for shard, size in sizes:
        if not rounds or size > room:
            rounds.append([])
            room = ROUND_BYTES
        rounds[-1].append(shard)
        room -= size
    counted = None
    for own in rounds:
        parts = [r.asDict() for r in shards.where(F.col("shard").between(own[0], own[-1])).collect()]
        sent = docs.sparkSession.sparkContext.broadcast(parts)
        blocks = rows.mapInArrow(_recount(sent, total, HELD_CELLS), "lang string, source string, shard int, block int, slots binary, counts binary")
        place = ("lang", "source", "shard", "block")
        summed = blocks.repartition(*place).sortWithinPartitions(*place).mapInArrow(_added, "lang string, source string, shard int, slot int, n long")
        counts = stage(summed, "divergence-counts", tidy=True)
        counted = counts if counted is None else counted.unionByName(counts)
        sent.destroy()
    return counted if counted is not None else docs.sparkSession.createDataFrame([], "lang string, source string, shard int, slot int, n long")


def _slot_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.frombuffer(row["lengths"], np.int32)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            for at in range(0, len(lengths), 20_000):
                cut = offsets[at : at + 20_001]
                terms = [row["keys"][a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(terms), pa.int32()), pa.array(np.arange(at, at + len(terms), dtype=np.int32)), pa.array(terms, pa.binary())], names=["shard", "slot", "term"])


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), by decimals where a long is too short."""
    whole, more = total + terms, count + 1
    wide = F.call_function("div", more.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), whole.cast("decimal(20,0)"))
    return 1 + F.when(more < 9_000_000_000, F.call_function("div", more * SCALE, whole)).otherwise(wide)


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def scaled(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same probabilities; long division in steps of 1000, exact for totals below 2**53."""
    left, result = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, whole.shape), np.int64)
    for _ in range(3):
        left = left * 1000
        result = result * 1000 + left // whole
        left = left % whole
    return result + 1


def _compare(table: pa.Table) -> pa.Table:
    """Sums over one block of terms for every pair of the language's sources."""
    sources, totals, slots, counts = (table.column(c).to_numpy(zero_copy_only=False) for c in ("source", "total", "key", "n"))
    heads = np.flatnonzero(slots < 0)
    lang, terms = table.column("lang")[0].as_py(), int(table.column("terms")[int(heads[0])].as_py())
    names = sources[heads]
    order = np.argsort(names.astype(str), kind="stable")
    names, whole = names[order], totals[heads][order] + terms
    index = {name: i for i, name in enumerate(names)}
    rest = np.flatnonzero(slots >= 0)
    _, column = np.unique(slots[rest], return_inverse=True)
    cells = np.zeros((len(names), int(column.max(initial=-1)) + 1), np.int64)
    cells[np.array([index[s] for s in sources[rest]], np.int64), column] = counts[rest]
    p = scaled(cells, whole[:, None])
    sums = np.zeros((len(names), len(names)), np.int64)
    for i in range(len(names)):
        d = p[i] - p
        sums[i] = (d * d // p).sum(axis=1)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(sums[a, b])], names=["lang", "source", "item", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """Divergence of every source from every other one of its language, and the terms that it favours."""
    kept = kept_terms(docs)
    shards, total = build_shards(kept)
    counts = recount(docs, shards, total)
    key = F.col("shard").cast("long") * (1 << 32) + F.col("slot")
    slots = shards.select("shard", "keys", "lengths").mapInArrow(_slot_terms, "shard int, slot int, term binary").select(key.alias("key"), "term")
    own = stage(kept.join(slots, "term"), "divergence-slots")
    # a term kept in one language may occur in another that does not keep it
    cells = stage(counts.select("lang", "source", key.alias("key"), "n").join(own, ["lang", "key"]), "divergence-cells")

    groups = docs.select(empty_text("lang").alias("lang"), empty_text("source").alias("source")).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = own.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms")))
    groups = stage(groups, "divergence-groups")

    blocks = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.first("terms").alias("terms"), F.sum("total").alias("lang_total"))
    blocks = stage(blocks.withColumn("blocks", F.ceil(F.col("sources") * F.col("terms") / BLOCK_CELLS).cast("long")), "divergence-languages")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")
    heads = groups.join(blocks.where("terms > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")), "lang")
    dealt = cells.join(blocks.select("lang", "blocks"), "lang").select("lang", block, "source", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("terms"), "key", "n")
    heads = heads.select("lang", "block", "source", "total", "terms", F.lit(-1).cast("long").alias("key"), F.lit(0).cast("long").alias("n"))
    compared = heads.unionByName(dealt).groupBy("lang", "block").applyInArrow(_compare, "lang string, source string, item string, value long")
    idle = groups.where("terms = 0").select("lang", "source")
    idle = idle.join(idle.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = compared.unionByName(idle).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    overall = cells.groupBy("lang", "key").agg(F.sum("n").alias("lang_n"))
    favoured = (
        cells.join(overall, ["lang", "key"]).join(groups, ["lang", "source"]).join(blocks.select("lang", "lang_total"), "lang")
        .withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms")))
        .withColumn("q", probability(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
        .where("p > q").select("lang", "source", F.decode("term", "UTF-8").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = favoured.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(columns).unionByName(best.withColumn("part", F.lit("term")).select(columns))


def oracle() -> str:
    return r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), occ AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS t FROM docs
), kept AS MATERIALIZED (SELECT lang, t FROM occ GROUP BY lang, t HAVING count(DISTINCT r) >= %(least)d
), size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), own AS (SELECT DISTINCT lang, source FROM docs
), cnt AS MATERIALIZED (SELECT lang, source, t, count(*) AS c FROM occ JOIN kept USING (lang, t) GROUP BY ALL
), tot AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM own LEFT JOIN cnt USING (lang, source) GROUP BY ALL
), p AS MATERIALIZED (
  SELECT lang, source, t, coalesce(c, 0) AS c, 1 + (%(scale)d::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p
  FROM tot JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, t)
), q AS (
  SELECT lang, t, 1 + (%(scale)d::HUGEINT * (sum(c) + 1)) // (sum(sum(c)) OVER (PARTITION BY lang) + any_value(v)) AS q
  FROM p JOIN size USING (lang) GROUP BY lang, t
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
  SELECT lang, source, 'term', t, (p - q) * (p - q) // q FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= %(top)d
""" % {"least": LEAST_DOCS, "scale": SCALE, "top": TOP_TERMS}
