import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from offerlake.llm import divergence, queries
from tests.oracle import compare, duck

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, value double, rank string"


def brute(rows):
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    found, groups = set(), defaultdict(Counter)
    frequency = Counter((lang, t) for lang, _, words in docs for t in set(words))
    for lang, source, words in docs:
        groups[lang, source].update(t for t in words if frequency[lang, t] >= 3)

    def ranked(lang, source, part, values, top=None):
        for rank, (item, value) in enumerate(sorted(values, key=lambda x: (-x[1], x[0].encode()))[:top], 1):
            found.add((lang, source, part, item, value, rank))

    for lang in {g[0] for g in groups}:
        kept = [t for (k, t), n in frequency.items() if k == lang and n >= 3]
        own = {source: counts for (k, source), counts in groups.items() if k == lang}
        total = sum(own.values(), Counter())

        def p(counts, t):
            return 1 + 10**9 * (counts[t] + 1) // (sum(counts.values()) + len(kept))

        tables = {source: {t: p(counts, t) for t in kept} for source, counts in own.items()}
        whole = {t: p(total, t) for t in kept}
        for source, counts in own.items():
            mine = tables[source]
            ranked(lang, source, "pair", [(o, sum((mine[t] - other[t]) ** 2 // other[t] for t in kept)) for o, other in tables.items() if o != source])
            ranked(lang, source, "term", [(t, (mine[t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[t] and mine[t] > whole[t]], 200)
    return found


def random_rows(rng, n):
    words = ["a", "Be", "sea", "été", "ÉTÉ", "日本", "x1y", "don't", "😀", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", "", None]), rng.choice(["s1", "s2", "S1", None, "é"])) for _ in range(n)]
    return rows + [(None, "en", "empty"), ("", "xx", "a"), ("one two", "xx", "b"), ("... 12 34", None, None), ("same same", "yy", "only")] + [("copy of a text", "en", "s1")] * 4


def query(spark, rows):
    frame = spark.createDataFrame([(i, *r, 1.0, "x") for i, r in enumerate(rows)], SCHEMA)
    return {tuple(r) for r in divergence.audit(frame).collect()}


def test_audit_equals_brute_force(llm, odd_docs, no_docs):
    rows = random_rows(random.Random(1), 200)
    assert query(llm, rows) == brute(rows)
    odd = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert {tuple(r) for r in divergence.audit(odd_docs).collect()} == brute(odd)
    assert divergence.audit(no_docs).count() == 0


def test_many_shards_rounds_and_blocks(llm, monkeypatch):
    for name, value in {"SHARD_TERMS": 20, "ROUND_BYTES": 3000, "HELD_TERMS": 30, "HELD_CELLS": 100, "BLOCK_CELLS": 200}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = random_rows(random.Random(2), 150) + [("lang " * 300 + "x" * 700 + " end", "en", "s2")] * 3
    assert query(llm, rows) == brute(rows)


def test_query_equals_its_sql(llm):
    folder = "/root/testdata/sf0.001"
    ok, message, rows, _ = compare(duck(folder), llm, folder, "op12", queries.QUERIES["op12_source_divergence"], queries.ORACLES["op12_source_divergence"])
    assert ok and rows, message


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "STEP_BYTES", 50)
    for text in ("lang " * 300, "x" * 700, "x" * 120 + " " + "y" * 300 + " z", "", "a b"):
        plain = np.frombuffer(text.encode(), np.uint8)
        offsets, rows = divergence._pieces(np.concatenate([plain, plain]), np.array([0, len(plain), 2 * len(plain)]))
        pieces = [bytes(np.concatenate([plain, plain])[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])]
        assert [w for piece, row in zip(pieces, rows) if row == 1 for w in piece.split()] == text.split()
        assert divergence.document_terms(text) == {w.encode() for w in text.split()}


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_perfect_hash(n, monkeypatch):
    terms = pa.array([f"t{i}é".encode() for i in range(n)], pa.binary())
    hashed = divergence.Hash(divergence.term_hashes(terms) if n else np.empty(0, np.uint64))
    assert sorted(hashed.slots.tolist()) == list(range(n)) and not len(hashed.listed)
    twice = divergence.Hash(np.array([5, 5, 9], np.uint64))
    assert sorted(twice.slots.tolist()) == [0, 1, 2] and len(twice.listed) == 2


def test_lookups_compare_stored_keys():
    """Words with the hash of a key, but other bytes, are told apart; keys with equal hashes as well."""
    terms = [f"k{i}".encode() for i in range(40)]
    table = pa.table({"shard": pa.array([0] * 40, pa.int32()), "term": pa.array(terms, pa.binary())})
    original = divergence.term_hashes
    divergence.term_hashes = lambda column: np.where(original(column) == original(pa.array([b"k7"]))[0], original(pa.array([b"k8"]))[0], original(column))
    try:
        row = divergence._build(table).to_pylist()[0]
    finally:
        divergence.term_hashes = original
    hashed = divergence.Round([row], 1)
    text = b" ".join([*terms, b"other", b"k", b"k99"])
    data = np.frombuffer(text, np.uint8)
    at = [(m.start(), m.end()) for m in re.finditer(rb"\S+", text)]
    slots = hashed.slots(data, np.array([a for a, _ in at]), np.array([b for _, b in at]))
    assert sorted(slots[:40].tolist()) == list(range(40)) and set(slots[40:].tolist()) == {-1}
    assert row["listed"] == 2


def test_probabilities_of_large_counts(llm):
    counts = np.array([0, 5, 9 * 10**9, 3 * 10**12, 2**52], np.int64)
    whole = np.array([[2**53 - 1], [10**13]], np.int64)
    want = [[1 + 10**9 * (c + 1) // w for c in counts.tolist()] for w in (2**53 - 1, 10**13)]
    assert divergence.scaled(counts, whole).tolist() == want
    frame = llm.createDataFrame([(int(c), w) for w in (2**53 - 1, 10**13) for c in counts], "c long, w long")
    from pyspark.sql import functions as F

    got = [r[0] for r in frame.select(divergence.probability(F.col("c"), F.col("w"), F.lit(0))).collect()]
    assert got == want[0] + want[1]
