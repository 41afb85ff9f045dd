"""N-gram Jaccard join with Bayesian candidate pruning.

1. Texts become sets of hashed word n-grams (all words as one where there are fewer; the whole text
   where there is no word). Documents with equal sets are one group with its smallest id as the head.
2. Heads get ``BANDS * ROWS`` MinHash values. Heads with equal values in all rows of a band are
   candidates; a pair of similarity 0.8 has no common band with probability 5e-8.
3. Bayesian pruning: within a bucket, pairs compare their MinHash values ``STEP`` at a time and are
   dropped as soon as the posterior probability (uniform prior) of reaching the threshold falls below
   ``TOLERANCE``. What stays links candidates into classes. A pair whose ends are already linked by
   others of the bucket is not compared, so a group of n near copies costs about n pairs.
4. Every class is verified exactly: all its pairs are counted by products of 0/1 matrices of n-grams,
   which gives each document its number of links and cuts the class where no link holds it together.

Buckets and classes of any size are dealt into tiles of two blocks each, so no task holds a whole
group and no pair list is ever written: tiles return counts and one link per document at most.

Null texts count as empty; all texts without words are linked to texts equal to them only. Rows with
the same doc_id count as one document; where their texts differ, the set with the smallest name
stands for it. Rows with a null doc_id take no part. An empty table stays empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import empty_text, free_name, mixed, packed, release_memory, span_hashes, stage, text_steps, word_hashes, word_spans

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
STEP = 16
TOLERANCE = 1e-6
#: Members of a block; a tile compares two blocks.
BLOCK = 256
#: N-grams of a block, so that a tile's memory is bounded.
BLOCK_GRAMS = 2_000_000

_SIZE = BANDS * ROWS
_A = mixed(np.arange(1, _SIZE + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_B = mixed(np.arange(_SIZE + 1, 2 * _SIZE + 1, dtype=np.uint64)).astype(np.uint32)


def gram_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every document, sorted, and the n + 1 offsets."""
    starts, ends, at = word_spans(data, offsets)
    value, count = word_hashes(data, starts, ends), np.diff(at)
    spread = np.maximum(count - words + 1, 1)
    spread[count == 0] = 0
    first = np.repeat(at[:-1], spread) + np.arange(int(spread.sum())) - np.repeat(np.cumsum(spread) - spread, spread)
    last = np.minimum(first + words, np.repeat(at[1:], spread))
    grams = np.zeros(len(first), np.uint64)
    for k in range(words):
        inside = first + k < last
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, value[np.where(inside, first + k, 0)] if len(value) else 0, np.uint64(k + 1)).astype(np.uint64)
    grams = mixed(grams)
    doc = np.repeat(np.arange(len(count)), spread)
    none = np.flatnonzero(count == 0)
    if len(none):
        # the whole text stands for itself, apart from all n-grams
        whole = span_hashes(data.astype(np.uint64) + np.uint64(257), offsets[none], offsets[none + 1])
        grams, doc = np.concatenate([grams, mixed(whole ^ np.uint64(0x5BF03635))]), np.concatenate([doc, none])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    return grams, np.searchsorted(doc, np.arange(len(count) + 1))


def set_names(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums over every set, which name it by 128 bits."""
    return tuple(np.add.reduceat(mixed(grams ^ np.uint64(salt)), offsets[:-1]).view(np.int64) for salt in (0xA5A5A5A5, 0x1234567))


def minhashes(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (documents x ``BANDS * ROWS``) of non-empty sets."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, _SIZE), np.uint32)
    for k in range(_SIZE):
        x = low * _A[k] + _B[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(x, offsets[:-1])
    return out


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_steps(batch.column(1)):
                grams, at = gram_sets(data, offsets, words)
                a, b = set_names(grams, at)
                signature = minhashes(grams, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(a), pa.array(b), pa.array(np.diff(at)), packed(signature.view(np.uint8).ravel(), np.arange(last - first + 1) * 4 * _SIZE)],
                    names=["doc_id", "set_a", "set_b", "grams", "signature"],
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.zeros(data.shape[:2], np.uint64)
        for r in range(ROWS):
            key = mixed(key * np.uint64(31) + data[:, :, r] + np.uint64(1))
        key = mixed(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key.ravel())], names=["head", "bucket"])


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float, step: int = STEP, size: int = _SIZE) -> np.ndarray:
    """After step, 2 * step, ... values: the fewest matches whose posterior of reaching the threshold is at least the tolerance."""
    grid = (np.arange(4000) + 0.5) / 4000
    high = grid >= threshold
    fewest = []
    for n in range(step, size + 1, step):
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
        mass = np.exp(logs - logs.max(1, keepdims=True))
        enough = mass[:, high].sum(1) / mass.sum(1) >= tolerance
        fewest.append(int(np.argmax(enough)) if enough.any() else n + 1)
    return np.array(fewest)


def survives(left: np.ndarray, right: np.ndarray, fewest: np.ndarray, step: int = STEP) -> np.ndarray:
    """Which pairs of signatures no step of the comparison drops."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), int)
    for k, least in enumerate(fewest):
        part = slice(k * step, (k + 1) * step)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of every connected component of 0..n-1 under the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _prune(threshold: float, tolerance: float):
    fewest = least_matches(threshold, tolerance)

    def links(ids: np.ndarray, tile: np.ndarray, side: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of many tiles, each together: one link per row at most."""
        n, widest = len(ids), int(np.bincount(tile).max())
        root = np.arange(n)
        for gap in range(1, widest):
            a = np.flatnonzero(tile[:-gap] == tile[gap:])
            if not len(a):
                break
            # side 2 marks a tile of one block; else only pairs across the two blocks count
            a = a[(side[a] == 2) | (side[a] != side[a + gap])]
            a = a[root[a] != root[a + gap]]
            a = a[survives(signature[a], signature[a + gap], fewest)]
            if len(a):
                root = _roots(n, np.concatenate([np.arange(n), a]), np.concatenate([root, a + gap]))
        moved = np.flatnonzero(root != np.arange(n))
        return ids[moved], ids[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            names = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
            change = np.ones(rows.num_rows, bool)
            change[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in names])
            signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(-1, _SIZE)
            a, b = links(rows.column("head").to_numpy(), np.cumsum(change) - 1, rows.column("side").to_numpy(), signature)
            del signature
            release_memory()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 20_000:
                continue
            # the last tile may go on in the next batch
            rows = pa.Table.from_batches(held)
            names = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
            same = np.logical_and.reduce([x == x[-1] for x in names])
            cut = int(np.argmax(same[::-1] == False)) if not same.all() else len(same)  # noqa: E712
            cut = rows.num_rows - cut
            if cut:
                yield flush(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def tiles(rows: DataFrame, key: str, member: str, blocks: str) -> DataFrame:
    """Deals the members of every ``key`` into ``blocks`` blocks and every pair of blocks into a tile.

    Adds low and high (the tile's blocks) and side (0 or 1, or 2 in a tile of one block).
    """
    own = F.pmod(F.xxhash64(member, F.lit(11)), F.col(blocks)).cast("int")
    spread = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return (
        spread.withColumn("low", F.least("_own", "_other")).withColumn("high", F.greatest("_own", "_other"))
        .withColumn("side", F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1).cast("int"))
        .drop("_own", "_other")
    )


def components(links: DataFrame, name: str) -> DataFrame:
    """member and root (the smallest member of its component) of every end of a link (a, b).

    Rounds of large star (greater neighbours move to the smallest neighbour) and small star (smaller
    neighbours do) until nothing changes; every round is staged.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state or not now["n"]:
            return edges.select(F.col("a").alias("member"), F.col("b").alias("root"))
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), name)


def _grams(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_steps(batch.column(0)):
                grams, at = gram_sets(data, offsets, words)
                part = batch.slice(first, last - first)
                own = pa.array(set_names(grams, at)[0] == part.column(1).to_numpy())
                rows = pa.RecordBatch.from_arrays([*part.columns[2:], packed(grams.view(np.uint8), 8 * at)], names=[*batch.schema.names[2:], "set"])
                yield rows.filter(own)

    return run


def overlaps(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over chunks of n-grams."""
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    number = np.concatenate([[0], np.cumsum(grams[1:] != grams[:-1])])
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    edges = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + chunk, chunk))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        cells = np.zeros((len(sets), chunk), np.float32)
        cells[owner[a:b], number[a:b] - k * chunk] = 1
        out += cells @ cells.T
    return out.astype(np.int64)


def _verify(threshold: float):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.drop_duplicates("head")  # repeated rows
        sets = [np.frombuffer(s, np.uint64) for s in tile["set"]]
        ids, side, copies = tile["head"].to_numpy(), tile["side"].to_numpy(), tile["copies"].to_numpy()
        size, common = np.array([len(s) for s in sets]), overlaps(sets)
        linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        if side[0] == 2:
            np.fill_diagonal(linked, False)
        else:
            linked &= side[:, None] != side[None, :]
        a, b = np.nonzero(np.triu(linked))
        root = _roots(len(ids), a, b)
        del sets, common
        release_memory()
        return pd.DataFrame({"head": ids, "links": linked @ copies, "root": ids[root]})

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, tolerance: float = TOLERANCE, text: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest id it is linked to, over any number of links) and n_links.

    ``n_links`` counts the other documents of a similarity of at least ``threshold``, copies included.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), empty_text(text).alias("text"))
    sets = stage(texts.mapInArrow(_sets(words), "doc_id long, set_a long, set_b long, grams long, signature binary"), "jaccard-sets", tidy=True)
    named = sets.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("s")).select("doc_id", "s.set_a", "s.set_b")
    groups = stage(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")), "jaccard-groups")
    of_heads = sets.join(groups.withColumnRenamed("head", "doc_id"), ["doc_id", "set_a", "set_b"]).withColumnRenamed("doc_id", "head")
    heads = stage(of_heads.groupBy("head", "set_a", "set_b", "grams", "copies").agg(F.first("signature").alias("signature")), "jaccard-heads", tidy=True)

    dealt = heads.select("head", "signature").mapInArrow(_bands, "head long, bucket long")
    full = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    members = dealt.join(full, "bucket").join(heads.select("head", "signature"), "head")
    dealt_tiles = tiles(members, "bucket", "head", "blocks").select("bucket", "low", "high", "side", "head", "signature").repartition("bucket", "low", "high")
    pairs = dealt_tiles.sortWithinPartitions("bucket", "low", "high", "side", "head").mapInArrow(_prune(threshold, tolerance), "a long, b long")
    classes = components(stage(pairs, "jaccard-pairs", tidy=True), "jaccard-candidates")

    inside = classes.unionByName(classes.select(F.col("root").alias("member"), "root").distinct()).withColumnRenamed("member", "head")
    about = inside.join(heads.select("head", "set_a", "grams", "copies"), "head")
    sizes = about.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS)).alias("blocks"))
    placed = about.join(sizes, "root").select(F.col("head").alias("doc_id"), "set_a", F.col("head"), "root", "copies", "blocks")
    with_sets = texts.join(placed, "doc_id").select("text", "set_a", "head", "root", "copies", "blocks").mapInArrow(_grams(words), "head long, root long, copies long, blocks long, set binary")
    verified = tiles(with_sets, "root", "head", "blocks").groupBy("root", "low", "high").applyInPandas(_verify(threshold), "head long, links long, root long")
    found = stage(verified, "jaccard-links", tidy=True)

    links = found.groupBy("head").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("head").alias("a"), F.col("root").alias("b")), "jaccard-classes").withColumnRenamed("member", "head")
    result = (
        groups.join(tied, "head", "left").join(links, "head", "left")
        .select("set_a", "set_b", F.coalesce("root", "head").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return named.join(result, ["set_a", "set_b"]).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of every class the row with the smallest id.

    Every row is compared by its own text, whether its id is null, repeats or has other texts elsewhere. Rows
    without an id come last, and of rows with one id the first as read.
    """
    row = free_name(docs, "copy_row")
    # numbered once and written, as numbers given by a plan change with its columns
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows", tidy=True)
    classes = join(rows.select(F.col(row).alias("doc_id"), F.col(text).alias("text")), threshold)
    turn = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    placed = rows.select("doc_id", row).join(classes.select(F.col("doc_id").alias(row), "class_id"), row)
    kept = placed.groupBy("class_id").agg(F.min(turn)["row"].alias(row))
    return rows.join(kept.select(row), row, "left_semi").select(*docs.columns)
