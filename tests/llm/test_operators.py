import base64
import hashlib
import itertools
import random
import re
import time
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from offerlake.llm import bpe, jaccard, lempelziv, licenses, mixing, neighbours, quality, queries, tokenbin, toxicity, warc
from offerlake.llm.common import held_out, labelled_sample, short_hashes, stage_folder
from tests.oracle import compare, duck

FOLDER, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
RANKS = bpe.Ranks.load(queries.RANKS_FILE, public_tokenizers.PATTERN)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def reference_encoding():
    return tiktoken.Encoding("own", pat_str=RANKS.pattern, mergeable_ranks=dict(RANKS.tokens), special_tokens={})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(llm, name):
    ok, message, rows, _ = compare(duck(SMALL), llm, SMALL, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok and rows, message


def test_pieces_equal_the_pattern():
    rng, table, cutter = random.Random(5), bpe.classes(), regex.compile(public_tokenizers.PATTERN)
    letters = [*"ab'sstremvdl  \n\t0 19_!?.", "é", "²", "日", "😀", "́", "　", "\x1c", "\x85", "'re", "'ll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts, at = bpe.pieces(np.frombuffer(data, np.uint8), offsets, table)
    ends = np.append(starts[1:], len(data))
    for i, text in enumerate(texts):
        assert [data[a:b].decode() for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])] == [m.group() for m in cutter.finditer(text)]


def test_bpe_round_trip(llm, odd_docs, no_docs):
    encoding = reference_encoding()
    rows = bpe.decode(bpe.encode(odd_docs, RANKS), RANKS).collect()
    want = sorted((r.doc_id or -1, np.array(encoding.encode_ordinary(r.text or ""), np.uint32).tobytes(), (r.text or "").encode()) for r in odd_docs.collect())
    assert sorted((r.doc_id or -1, bytes(r.ids), bytes(r.decoded)) for r in rows) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    assert bpe.decode(bpe.encode(no_docs, RANKS), RANKS).count() == 0


def test_token_files_round_trip(llm, odd_docs, no_docs):
    definition = open(queries.TOKENIZER_FILE, encoding="utf-8").read()
    tokenizer = Tokenizer.from_str(definition)
    folder = stage_folder(llm, "test-tokens")
    tokenbin.write_files(tokenbin.encode_in_order(odd_docs, definition), folder)
    rows = sorted(tokenbin.read_files(llm, folder).collect(), key=lambda r: r.start)
    want = {(r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in odd_docs.collect()}
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, np.uint32))) for r in rows} == want and len(rows) == odd_docs.count()
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    assert [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:]) and rows[0].doc_id is None
    folder = stage_folder(llm, "test-tokens")
    assert tokenbin.write_files(tokenbin.encode_in_order(no_docs, definition), folder).count() == 0


SPECIAL_TEXTS = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|>  x", "<|endof", "text|>", "it<|endoftext|>'s 12<|endoftext|>", "\u0558's here", "<<|endoftext|>|endoftext|>"]


def test_added_tokens_as_the_library(llm):
    definition = open(queries.TOKENIZER_FILE, encoding="utf-8").read()
    docs, folder = llm.createDataFrame(list(enumerate(SPECIAL_TEXTS)), "doc_id long, text string"), stage_folder(llm, "test-tokens")
    tokenbin.write_files(tokenbin.encode_in_order(docs, definition), folder)
    library = Tokenizer.from_str(definition)
    found = {r.doc_id: np.frombuffer(r.ids, np.uint32).tolist() for r in tokenbin.read_files(llm, folder).collect()}
    assert found == {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(SPECIAL_TEXTS)}
    assert bytes(np.array(found[0], np.uint32)) == bytes(np.array([64, 50256, 65, 0], np.uint32))


def test_kept_answers_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokenbin, "KEPT_WORDS", 5)
    words = tokenbin.Words(open(queries.TOKENIZER_FILE, encoding="utf-8").read())
    rng = random.Random(6)
    for _ in range(30):
        some = [f"w{rng.randrange(20)}".encode() for _ in range(rng.randrange(30))] + [b"x" * 50]
        ids, lengths = words.ids(some, np.array([rng.random() < 0.7 for _ in some]))
        assert [ids[b - n : b].tolist() for n, b in zip(lengths, np.cumsum(lengths))] == [words.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in some]
        assert len(words.kept) <= 5


@pytest.mark.parametrize("table,ids", [
    (bpe.classes, lambda: reference_encoding().encode_ordinary),
    (tokenbin.classes, lambda: lambda t, library=Tokenizer.from_file(queries.TOKENIZER_FILE): library.encode(t, add_special_tokens=False).ids),
], ids=["tiktoken", "tokenizers"])
def test_classes_of_every_code_point(table, ids):
    """Each code point before 's, as a text of its own: the library's ids of the text are those of its pieces."""
    encode, found = ids(), table()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for first in range(0, len(points), 4000):
        texts = [f"{chr(c)}'s" for c in points[first : first + 4000]]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
        starts, at = bpe.pieces(data, offsets, found)
        for i, text in enumerate(texts):
            cut = starts[at[i] : at[i + 1]] - offsets[i]
            # of the three classes only a blank, a letter or a number, or another character cut otherwise
            assert len(cut) == (2 if text[0] != "'" else len(cut)), hex(ord(text[0]))
    rng = random.Random(8)
    odd = [c for c in points if not found[c] == {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3 if chr(c).isspace() else 0)]
    for c in [*odd[:3000], *rng.sample(points, 6000)]:
        for text in (f"a{chr(c)}'s 1{chr(c)}", f"{chr(c)}a{chr(c)}1 {chr(c)}!"):
            data = np.frombuffer(text.encode(), np.uint8)
            starts, _ = bpe.pieces(data, np.array([0, len(data)]), found)
            words = [data[a:b].tobytes().decode() for a, b in zip(starts, np.append(starts[1:], len(data)))]
            assert [i for w in words for i in encode(w)] == list(encode(text)), hex(c)


def test_short_hashes_tell_spans_apart():
    rng = random.Random(3)
    spans = [bytes(rng.randrange(3) for _ in range(rng.randrange(30))) for _ in range(4000)] + [b"", b"\0", b"\0" * 8, b"\0" * 9, b"x" * 100_000]
    ends = np.cumsum([len(s) for s in spans])
    found = short_hashes(np.frombuffer(b"".join(spans), np.uint8), ends - [len(s) for s in spans], ends)
    by_hash = {}
    for span, value in zip(spans, found.tolist()):
        assert by_hash.setdefault(value, span) == span
    assert len(by_hash) == len(set(spans))


def test_byte_aligned_coding():
    ranks = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(ranks) + 1):
        assert (tokenbin.unpack_ranks(np.frombuffer(tokenbin.pack_ranks(ranks[:n]), np.uint8), n) == ranks[:n]).all()


def brute_classes(rows, words=5, threshold=0.8):
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall(lower(text))
        sets[doc_id] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else {("", text or "")}
    root, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a], links[b] = links[a] + 1, links[b] + 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(d, find(d), links[d]) for d in sets}


def test_jaccard_join(llm, odd_docs, no_docs, monkeypatch):
    rng = random.Random(3)
    base = [str(rng.randrange(10**6)) for _ in range(60)]
    rows = []
    for i in range(90):  # a large group of near copies, each another text
        words = base.copy()
        words[rng.randrange(60)] = f"x{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None and r.doc_id != 9]
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # many tiles
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard.join(docs).collect()} == brute_classes(dict(rows).items())
    kept = jaccard.keep_one(odd_docs)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5, 6, 8, 9, 10] and kept.columns == odd_docs.columns
    assert jaccard.join(no_docs).count() == 0


def test_keep_one_compares_every_row(llm):
    """Ids that repeat with other texts, and rows without an id, in a table with clashing names."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " more"), (3, c), (None, c + " end"), (None, "lonely text"), (None, "lonely text"), (4, a), (5, None), (None, ""), (1, a)]
    docs = llm.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, copy_row int, class_id string")
    kept = sorted(((r.doc_id or 0, r.text or "") for r in jaccard.keep_one(docs).collect()))
    assert kept == sorted([(1, a), (1, b), (3, c), (0, "lonely text"), (5, "")])


def test_components_of_hubs_chains_and_repeats(llm):
    hub, chain = [(5, i) for i in range(6, 300)], [(i, i + 1) for i in range(1000, 1060)]
    found = jaccard.components(llm.createDataFrame([*hub, *chain, *hub[:9], (7, 7), (300, 5)], "a long, b long"), "test-components")
    assert {tuple(r) for r in found.collect()} == {(i, 5) for i in range(6, 301)} | {(i, 1000) for i in range(1001, 1061)}
    assert jaccard.components(llm.createDataFrame([], "a long, b long"), "test-components").count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = jaccard.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 32, (5000, 128), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.8, left, left + np.uint32(1))
    assert jaccard.survives(left, right, fewest).mean() > 0.9999 and not jaccard.survives(left, left + np.uint32(1), fewest).any()


def test_lempel_ziv(llm, odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in lempelziv.with_next(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for doc_id, after in zip(order, [*order[1:], order[0]]):
        own, following, half = texts[doc_id], texts[after], len(texts[doc_id]) // 2
        edited = own[: len(own) - half] + following[:half]
        a, b, c = (lempelziv.sketch(lempelziv.phrases(t, set())[0]) for t in (own, edited, following))
        want = (len(own), hashlib.sha256(edited.encode()).hexdigest(), lempelziv.fingerprint(a), lempelziv.fingerprint(b), lempelziv.likeness(a, b), lempelziv.likeness(a, c))
        assert tuple(rows[doc_id])[1:] == want
    assert rows[1].fingerprint == rows[11].fingerprint and lempelziv.with_next(odd_docs).count() == odd_docs.count()
    assert lempelziv.with_next(no_docs).count() == 0 and lempelziv.with_next(docs.limit(1)).count() == 1


def test_warc_round_trip(llm):
    pages = [(1, "http://www.b.example/x?b=1&a=2", "<p>é</p>"), (2, "https://a.example/", ""), (3, None, None), (4, "http://b.example/x?a=2&b=1", "<p>é</p>"), (5, "::bad", "<p>é</p>"), (None, "http://c.example", "z")]
    found = {r.page_id: r for r in warc.captures(llm.createDataFrame(pages, "page_id long, url string, html string"), stage_folder(llm, "test-warc")).collect()}
    for page_id, _, html in pages:
        payload = (html or "").encode()
        first = min(p for p, _, h in pages if (h or "").encode() == payload and p is not None) if page_id is not None else None
        r = found[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == page_id else ("revisit", first))
    assert found[1].url_key == found[4].url_key == "example,b)/x?a=2&b=1"
    merged = sorted(found.values(), key=lambda r: (r.range, r.turn))
    assert [(r.url_key, r.date) for r in merged] == sorted((r.url_key, r.date) for r in merged)
    empty = llm.createDataFrame([], "page_id long, url string, html string")
    assert warc.captures(empty, stage_folder(llm, "test-warc")).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    for k in range(8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(map(iter, runs))) == sorted(itertools.chain(*runs))


def test_neighbours(llm):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x[300:600] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [float("nan")]), (903, [1.0] * 7 + [None]), (904, [1.0]), (None, [1.0] * 8), (7, x[7].tolist())]
    found = neighbours.nearest(llm.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=20).collect()
    for query in range(0, 900, 50):
        scores = np.einsum("qd,rd->qr", x[[query]], x, optimize=False)[0]
        want = sorted((i for i in range(900) if i != query), key=lambda i: (-scores[i], i))[:20]
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)] == want
    assert neighbours.nearest(llm.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [1e200, 1e-200, 3e154, 1.0])
def test_neighbours_of_any_magnitude(llm, size):
    x = np.random.default_rng(9).normal(size=(130, 6)) * size
    found = neighbours.nearest(llm.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string"), F.col("vec_id") % 20 == 0).collect()
    with np.errstate(all="ignore"):
        for query in range(0, 130, 20):
            scores = np.einsum("qd,rd->qr", x[[query]], x, optimize=False)[0]
            want = sorted((i for i in range(130) if i != query), key=lambda i: (not np.isnan(scores[i]), -scores[i], i))[:20]
            got = sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)
            assert [r.vec_id for r in got] == want and all(r.score == scores[r.vec_id] or np.isnan(scores[r.vec_id]) for r in got)


def test_a_larger_factor_visits_less_and_finds_most(monkeypatch):
    rng = np.random.default_rng(12)
    x, counted = rng.normal(size=(6000, 4)), []
    norm = float(np.sqrt((x**2).sum(1)).max())
    tree, asked = neighbours.build(x, np.arange(6000), norm, 20), np.arange(0, 6000, 60)
    found = {}
    for factor in (1.0, 1.5, 3.0):
        einsum, seen = np.einsum, 0

        def counting(*a, **k):
            nonlocal seen
            seen += len(a[1]) * len(a[2])
            return einsum(*a, **k)

        monkeypatch.setattr(np, "einsum", counting)
        row, ids, scores = neighbours.search(tree, x[asked], asked, 20, factor)
        monkeypatch.setattr(np, "einsum", einsum)
        best = {}
        for r, i, s in zip(row.tolist(), ids.tolist(), scores.tolist()):
            best.setdefault(r, []).append((-s, i))
        found[factor] = {(r, i) for r, v in best.items() for _, i in sorted(v)[:20]}
        counted.append(seen)
    exact = {(r, i) for r, q in enumerate(asked) for i in sorted((j for j in range(6000) if j != q), key=lambda j: (-(x[q] @ x[j]), j))[:20]}
    assert found[1.0] == exact and counted[0] > counted[1] > counted[2]
    assert len(found[1.5] & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("page_id", [0, -1, 2**53, 10**12, 2**62, 2**63 - 1, -(2**63)])
def test_warc_dates_of_any_id(llm, page_id):
    other = page_id + 1 if page_id < 2**62 else page_id - 1
    rows = [(page_id, "http://a.example/", "x", "clash", 7), (other, "http://a.example/", "x", "clash", 7), (page_id, "http://a.example/", "x", "clash", 7), (None, "http://a.example/", "y" * 200_000, "", 0)]
    found = warc.captures(llm.createDataFrame(rows, "page_id long, url string, html string, page string, range int"), stage_folder(llm, "test-warc")).collect()
    assert all(re.fullmatch(r"[12]\d{3}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{9}Z", r.date) for r in found) and len(found) == 4
    order = [r.page_id for r in sorted(found, key=lambda r: (r.range, r.turn))]
    assert order == [*sorted([page_id, other, page_id]), None]
    assert {(r.page_id, r.record_type, r.refers_to) for r in found if r.page_id is not None} == {(min(page_id, other), "response", None), (max(page_id, other), "revisit", min(page_id, other))}


def test_long_archives_are_read_in_linear_time():
    content = b"".join(warc.member(bytes(str(i), "ascii") * 50) for i in range(30_000))
    assert [plain for _, _, plain in warc.members(content)] == [bytes(str(i), "ascii") * 50 for i in range(30_000)]


def test_suppression_equals_all_pairs_and_is_not_quadratic():
    rng = random.Random(4)
    parts = ["gnu general public license", "version 3", "or later", "licensed under the", "mit license", "apache license 2 0", "spdx license identifier mit", "cc by", "4 0", "word", "all rights reserved", "gpl", "copyright 2020 x"]
    for _ in range(200):
        words = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))).encode()
        places = [(m.start(), m.end(), rule) for keys, group in licenses._compiled() if any(k in words for k in keys) for rule, pattern in group for m in pattern.finditer(words)]
        places.sort(key=lambda p: (p[2].priority, p[0] - p[1], p[0], p[2].label))
        kept = []
        for first, end, rule in places:
            if not any(a <= first and end <= b for a, b, _ in kept):
                kept.append((first, end, rule))
        assert licenses.detections(words) == sorted(kept, key=lambda p: (p[0], p[1]))
    times = []
    for n in (20_000, 80_000):
        start = time.process_time()
        licenses.detections(b"licensed under the mit license and apache license 2 0 " * n)
        times.append(time.process_time() - start)
    assert times[1] < 8 * times[0] + 1


def test_licenses(llm, odd_docs, no_docs):
    rows = {r.doc_id: r for r in licenses.scan_licenses(odd_docs).collect()}
    for r in odd_docs.collect():
        words, places, labels = WORD.findall(lower(r.text)), [], set()
        for phrase, label in licenses.BASE_PHRASES:
            hits = [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
            places, labels = places + hits, labels | ({label} if hits else set())
        got = rows[r.doc_id]
        assert (got.n_words, got.n_base, got.first_word, got.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert got.base_labels == ",".join(sorted(labels)) and labels <= set(got.labels.split(",")) and 0 <= got.score <= 1
    assert len(licenses.rules()) > 300 and licenses.scan_licenses(no_docs).count() == 0


def samples(tree, rng, every):
    """Texts that a parsed pattern matches: each choice of each alternative, or one random text."""
    found = [""]
    for kind, value in tree:
        name = str(kind)
        if name == "BRANCH":
            parts = [t for branch in value[1] for t in samples(branch, rng, every)]
        elif name == "SUBPATTERN":
            parts = samples(value[3], rng, every)
        elif name == "MAX_REPEAT":
            least, _, inner = value
            parts = [*([""] if least == 0 else []), *(t * max(least, 1) for t in samples(inner, rng, every))]
        elif name == "IN":
            parts = [chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])]
        elif name == "LITERAL":
            parts = [chr(value)]
        else:
            parts = [""]  # looks around
        found = [a + b for a in found for b in (parts if every else [rng.choice(parts)])]
    return found


def scanned(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return [row for out in licenses._scan(iter([batch])) for row in out.to_pylist()]


def test_license_gates_lose_no_place(monkeypatch):
    rng, texts = random.Random(6), []
    for rule in licenses.rules():
        tree = re._parser.parse(rule.pattern)
        texts += samples(tree, rng, True) if rule.priority in (4, 5) else [samples(tree, rng, False)[0] for _ in range(3)]
    texts = sorted({separated for t in texts for separated in (t, t.replace(" ", "\n "), t.replace(" ", "--"))})
    gated = scanned(texts)
    everything = [pair for _, group in licenses._compiled() for pair in group]
    monkeypatch.setattr(licenses, "_compiled", lambda: [((b"",), everything)])
    monkeypatch.setattr(licenses, "_ROOTS", (b"",))
    lost = [a["labels"] + " | " + t for t, a, b in zip(texts, gated, scanned(texts)) if a != b]
    assert not lost and all(row["spans"] for row in gated), lost


def test_longer_license_place_wins():
    found = licenses.detections(b"licensed under the apache license version 2 0 and the mit license")
    assert [rule.label for _, _, rule in found] == ["apache", "mit"] and found[0][:2] == (0, 45)


@pytest.mark.parametrize(("text", "labels"), [
    ("licensed under the Apache License, Version 2.0", "apache,apache-2.0"), ("licensed under cc by nc 4.0", "cc-by,cc-by-nc-4.0"),
    ("released under the GNU GPL v3 or later", "gpl-3"), ("distributed under the GNU GPL 3.0", "gpl-3"), ("licensed under the MIT License 2020", "mit"),
    ("licensed under the Apache License 2019", "apache"), ("available under the Blue Oak Model License 1.0.0", "blueoak-1.0.0"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
    ("SPDX-License-Identifier: LPPL-1.3c", "lppl-1.3c"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("SPDX-License-Identifier: MIT", "mit"),
    ("Copyright © 2020 A", "copyright-notice"), ("Copyright ©2020-2021 A", "copyright-notice"), ("Copyright (c) 2020 A", "copyright-notice"),
])
def test_license_versions_and_copyright_sign(text, labels):
    row, = scanned([text])
    assert row["labels"] == labels and len(row["spans"]) == 1


def test_license_grants_name_the_version_of_the_bare_name():
    for rule in licenses.rules():
        if rule.priority == 3:
            for name in samples(re._parser.parse(rule.pattern), random.Random(1), True):
                bare, grant = scanned([name, f"licensed under the {name}"])
                assert grant["labels"] == bare["labels"] and len(grant["spans"]) == len(bare["spans"]), name


def test_sample_is_drawn_from_eligible_texts(llm):
    docs = llm.createDataFrame([(i, "x" * (50 if i % 3 == 0 else 5) + str(i)) for i in range(400)], "doc_id long, text string").where("doc_id % 5 > 0")
    known = llm.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    ids = {r.doc_id for r in known.where(~held_out()).collect()}
    eligible = {v: {i for i in ids if i % 2 == v and i % 3 and i % 5} for v in (0, 1)}
    rows = labelled_sample(docs, known, "quality", 20, 20).collect()
    for value, able in eligible.items():
        drawn = [r for r in rows if r.label == value]
        assert len(drawn) == 20 and {int(r.text.strip("x")) for r in drawn} <= able
        assert {r.weight for r in drawn} == {len(able) / 20}


@pytest.mark.parametrize(("module", "label", "threshold", "least"), [(quality, "quality", 0.7, 0.97), (toxicity, "toxic", 0.3, 0.9)])
def test_held_out_accuracy(llm, module, label, threshold, least):
    docs, labels = (llm.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.score(docs.select("doc_id", "text"), module.fit(docs, labels)).join(labels, "doc_id").where(held_out()).collect()
    assert np.mean([(r.score >= threshold) == bool(r[label]) for r in rows]) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_odd_documents(llm, module, odd_docs, no_docs, labels):
    docs, known = (llm.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, known)
    plain = odd_docs.drop("score", "spans")
    scored = module.score(plain, model).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.text == "a b"}) == 1
    assert module.score(no_docs.drop("score", "spans"), model).count() == 0
    assert all(0 <= r.score <= 1 for r in module.score(plain, module.fit(odd_docs, labels)).collect())
    keep = (quality.keep_good if module is quality else toxicity.keep_clean)(odd_docs, labels, 0.5)
    assert keep.columns == odd_docs.columns


def test_toxic_offsets(llm):
    docs, labels = (llm.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    text = "ééé the idiot and moron, of it"
    row = toxicity.score(llm.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [text[s["start"] : s["end"]] for s in row.spans] == ["idiot", "moron"]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, move, at = rng.normal(size=9), rng.normal(size=5), np.array([0, 4, 4, 9])
    got = toxicity.forward_backward(emit, at, move)[0]
    for a, b in ((0, 4), (4, 9)):
        total, hot = 0.0, np.zeros(b - a)
        for states in itertools.product((0, 1), repeat=b - a):
            score = sum(e for e, s in zip(emit[a:b], states) if s) + (move[4] if states[0] else 0) + sum(move[2 * x + y] for x, y in zip(states, states[1:]))
            total += np.exp(score)
            hot += np.exp(score) * np.array(states)
        assert np.allclose(got[a:b], hot / total)


def test_mixing_meets_its_targets(llm, odd_docs, no_docs):
    docs = llm.read.parquet(f"{FOLDER}/documents.parquet")
    cells = mixing.probabilities(docs, share=0.3).toPandas()
    for name, power in mixing.FLATTENING.items():
        tokens = cells.groupby(name)["tokens"].sum()
        wanted = tokens.astype(float) ** power / (tokens.astype(float) ** power).sum()
        assert np.allclose(cells.groupby(name)["weight"].sum()[wanted.index], wanted, atol=5e-3)
    assert abs((cells["tokens"] * cells["probability"]).sum() / cells["tokens"].sum() - 0.3) < 1e-6
    kept = mixing.sample(odd_docs, 1.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() and mixing.sample(no_docs).count() == 0
    clashing = odd_docs.selectExpr("*", "1 AS _mix", "2 AS _cell", "3 AS _own", "4 AS topic", "5 AS weight", "6 AS row")
    assert mixing.sample(clashing, 1.0).columns == clashing.columns and mixing.sample(clashing, 1.0).count() == odd_docs.count()


def test_raking_by_factors_and_by_tables_agree(llm, monkeypatch):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    target = llm.createDataFrame([("en", 0.7), ("nowhere", 0.3)], "lang string, target double")
    found = []
    for limit in (200, 1):
        monkeypatch.setattr(mixing, "FACTOR_VALUES", limit)
        cells = mixing.probabilities(docs, targets={"lang": target}).collect()
        found.append({(r.source, r.lang, r.topic): (r.weight, r.probability) for r in cells})
    assert found[0].keys() == found[1].keys() and len(found[0]) > 10
    assert all(np.allclose(found[0][k], found[1][k], rtol=1e-9) for k in found[0])


def test_pipeline_stages_take_effect(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    for (name, function), check in zip(corpus_pipeline.STAGES[:4], (True, True, True, True)):
        out = function(llm, docs, SMALL)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(corpus_pipeline.STAGES[4][1](llm, docs, SMALL).columns)


def brute_topic(text):
    if " | " in text:
        return "table"
    if re.search("(?i)licen[cs]ed?|copyright|rights reserved", text):
        return "legal"
    if re.search(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+|[0-9]{3}[-) ]+[0-9]{3}", text):
        return "contact"
    return "long" if len(text) >= 4000 else "short"


def test_pipeline_keeps_what_plain_python_keeps(llm, tmp_path, monkeypatch):
    given = llm.read.parquet(f"{SMALL}/documents.parquet")
    labels = llm.read.parquet(f"{SMALL}/labels.parquet")
    near = given.orderBy(F.length("text").desc()).limit(12).withColumns({"doc_id": F.col("doc_id") + 10**9, "text": F.concat("text", F.lit(" and more"))})
    odd = given.orderBy("doc_id").limit(2)
    docs = given.unionByName(near).unionByName(odd).unionByName(odd.withColumn("doc_id", F.lit(None).cast(given.schema["doc_id"].dataType)))
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    results, write = [llm.read.parquet(f"{tmp_path}/documents.parquet")], corpus_pipeline.stage
    monkeypatch.setattr(corpus_pipeline, "stage", lambda df, name: results.append(write(df, name)) or results[-1])
    corpus_pipeline.run(llm, str(tmp_path))

    def pairs(rows):
        return sorted((r.doc_id or -1, r.text or "") for r in rows)

    for i, (module, threshold, above) in enumerate(((toxicity, queries.TOXIC_THRESHOLD, False), (quality, queries.QUALITY_THRESHOLD, True))):
        scored = module.score(results[i].select("doc_id", "text"), module.fit(results[i], labels)).collect()
        assert pairs(results[i + 1].collect()) == pairs(r for r in scored if (r.score >= threshold) is above), module.__name__
    # every row is compared by its own text; of a class the smallest id stays, rows without one come last
    rows = sorted(results[2].collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    heads = [i for i, c, _ in brute_classes(enumerate(r.text for r in rows)) if c == i]
    assert pairs(results[3].collect()) == pairs(rows[i] for i in heads) and len(heads) < len(rows)
    cells = {(r.source, r.lang, r.topic): r.probability for r in mixing.probabilities(results[3]).collect()}
    drawn = []
    for r in results[3].collect():
        number = int(hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        if number < cells[r.source or "", r.lang or "", brute_topic(r.text or "")]:
            drawn.append(r)
    assert pairs(results[4].collect()) == pairs(drawn) and 0 < len(drawn) < len(rows)
    encoding = reference_encoding()
    want = sorted((r.doc_id or -1, np.array(encoding.encode_ordinary(r.text or ""), np.uint32).tobytes()) for r in drawn)
    assert sorted((r.doc_id or -1, bytes(r.ids)) for r in results[5].collect()) == want


def test_neighbour_search_meets_each_node_once_a_block(monkeypatch):
    """A block of queries is not cut into ever smaller groups on its way down a tree."""
    rng = np.random.default_rng(5)
    vectors, ids = rng.normal(size=(3000, 24)), rng.permutation(3000)
    vectors[50:90] = vectors[50]
    exponent = int(np.frexp(np.abs(vectors).max())[1])
    tree = neighbours.build(vectors, ids, float(np.sqrt((np.ldexp(vectors, -exponent) ** 2).sum(1)).max()), 20, exponent=exponent)
    calls, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a, **k: calls.append(1) or einsum(*a, **k))
    asked = ids % 5 == 0
    row, found, scores = neighbours.search(tree, vectors[asked], ids[asked], 20)
    assert len(calls) <= 2 * len(tree["nodes"])
    monkeypatch.undo()
    true = einsum("qd,rd->qr", vectors[asked], vectors, optimize=False)
    for q, own in enumerate(ids[asked]):
        true[q, ids == own] = -np.inf
        best = np.lexsort((ids, -true[q]))[:20]
        mine = row == q
        order = np.lexsort((found[mine], -scores[mine]))[:20]
        assert (found[mine][order] == ids[best]).all() and (scores[mine][order] == true[q, best]).all()
