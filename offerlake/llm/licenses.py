"""License scan: ordered signature rules with a keyword gate, priorities and containment.

The text is lower-cased (A-Z) and cut into words; rules are regular expressions over the words
joined by one blank. A rule runs only where one of its keywords stands in the text; each of its
alternatives contains one of them. Of the places found, one
that lies inside a place of higher priority (or inside a longer one of the same priority) goes.
A grant or an SPDX tag that names a version of its license carries the versioned label.
Base phrases are found by themselves, at every place, and are never suppressed.

Null and empty texts have no words, no labels (empty strings), null positions and score 0. Equal
places of the same label count once in ``labels``; repeated rows give repeated rows; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import LOWER, empty_text, text_steps, word_spans

# fixed values: phrases and labels of the contract
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# (identifier, keywords of the gate, names as word patterns, versions)
FAMILIES = (
    ("gpl", "gnu", "gnu general public licen[cs]e|gnu gpl", ("1", "2", "3")),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public licen[cs]e|gnu lgpl", ("2", "2 1", "3")),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", ("1", "3")),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache (?:software )?licen[cs]e|apache licensed", ("1 0", "1 1", "2", "2 0")),
    ("mit", "mit", "(?:the )?mit licen[cs]e|mit licensed", ()),
    ("x11", "x11", "x11 licen[cs]e", ()),
    ("isc", "isc", "isc licen[cs]e", ()),
    ("0bsd", "0bsd zero", "0bsd|zero clause bsd(?: licen[cs]e)?", ()),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|freebsd|2 clause bsd|bsd 2 clause)(?: licen[cs]e)?", ()),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause)(?: licen[cs]e)?", ()),
    ("bsd-4-clause", "bsd", "(?:original bsd|4 clause bsd|bsd 4 clause)(?: licen[cs]e)?", ()),
    ("bsd", "bsd", "bsd (?:style )?licen[cs]e|bsd licensed", ()),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ("1 0", "1 1", "2", "2 0")),
    ("epl", "eclipse", "eclipse public licen[cs]e", ("1 0", "2 0")),
    ("edl", "eclipse", "eclipse distribution licen[cs]e", ("1 0",)),
    ("cddl", "distribution", "common development and distribution licen[cs]e", ("1 0", "1 1")),
    ("cpl", "public", "common public licen[cs]e", ("1 0",)),
    ("ipl", "ibm", "ibm public licen[cs]e", ("1 0",)),
    ("eupl", "european", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("cecill", "cecill", "cecill(?: free software)?(?: licen[cs]e)?", ("1", "2", "2 1")),
    ("artistic", "artistic", "(?:perl )?artistic licen[cs]e", ("1 0", "2 0")),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", ()),
    ("libpng", "libpng", "libpng licen[cs]e", ("2 0",)),
    ("bsl", "boost", "boost software licen[cs]e", ("1 0",)),
    ("busl", "business", "business source licen[cs]e", ("1 1",)),
    ("sspl", "server", "server side public licen[cs]e", ("1",)),
    ("elastic", "elastic", "elastic licen[cs]e", ("1", "2", "2 0")),
    ("psf", "python psf", "(?:python software foundation|psf) licen[cs]e", ("2",)),
    ("php", "php", "php licen[cs]e", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby licen[cs]e", ()),
    ("unlicense", "unlicense", "(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl fuck", "wtfpl|do what the fuck you want to public licen[cs]e", ("1", "2")),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", ()),
    ("osl", "open", "open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic", "academic free licen[cs]e", ("1 1", "2 0", "2 1", "3 0")),
    ("ofl", "font", "(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
    ("odbl", "database odbl", "open (?:data commons open )?database licen[cs]e|odbl", ("1 0",)),
    ("odc-by", "commons", "open data commons attribution licen[cs]e", ("1 0",)),
    ("pddl", "dedication", "public domain dedication and licen[cs]e", ("1 0",)),
    ("cdla-permissive", "community", "community data licen[cs]e agreement permissive", ("1 0", "2 0")),
    ("cdla-sharing", "community", "community data licen[cs]e agreement sharing", ("1 0",)),
    ("ogl", "government", "open government licen[cs]e", ("1 0", "2 0", "3 0")),
    ("etalab", "etalab", "(?:licence ouverte )?etalab", ("1 0", "2 0")),
    ("openrail", "openrail", "(?:creativeml |bigcode |bigscience )?openrail(?: m)?(?: licen[cs]e)?", ()),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", ()),
    ("vim", "vim", "vim licen[cs]e", ()),
    ("postgresql", "postgresql", "postgresql licen[cs]e", ()),
    ("openssl", "openssl", "openssl licen[cs]e", ()),
    ("curl", "curl", "curl licen[cs]e", ()),
    ("icu", "icu", "icu licen[cs]e", ()),
    ("unicode", "unicode", "unicode licen[cs]e", ("3",)),
    ("w3c", "w3c", "w3c software(?: notice and)? licen[cs]e", ()),
    ("zpl", "zope", "zope public licen[cs]e", ("1 1", "2 0", "2 1")),
    ("qpl", "public", "q public licen[cs]e", ("1 0",)),
    ("lppl", "latex", "latex project public licen[cs]e", ("1 2", "1 3", "1 3c")),
    ("upl", "universal", "universal permissive licen[cs]e", ("1 0",)),
    ("blueoak", "blue", "blue oak model licen[cs]e", ("1 0 0",)),
    ("mulan", "mulan", "mulan (?:permissive software|psl)(?: licen[cs]e)?", ("1", "2")),
    ("cc0", "cc0", "cc0(?: universal)?", ("1 0",)),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", "cc by nc", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", "cc by nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc", "cc by sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc", "cc by", ("2 0", "2 5", "3 0", "4 0")),
)

#: Elements of the long Creative Commons names, in their fixed order.
CC_ELEMENTS = (("noncommercial", "nc"), ("noderivatives", "nd"), ("sharealike", "sa"))

NOTICES = (
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("copyright-notice", "copyright", "copyright (?:c |© ?)?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("public-domain", "domain", "(?:in|into|to) the public domain|public domain dedication"),
    ("proprietary", "proprietary", "proprietary and confidential|proprietary licen[cs]e"),
    ("no-warranty", "warrant provided", "without warranty of any kind|provided as is without"),
    ("permissive-grant", "permission", "permission is hereby granted free of charge"),
    ("redistribution", "redistribution", "redistribution and use in source and binary forms"),
)

GRANT = "(?:licensed|released|distributed|available|published|provided) (?:to you )?under (?:the (?:terms|conditions) of )?(?:an? |the )?"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: str


def _number(versions: tuple[str, ...]) -> str:
    """A pattern of version numbers; its group ``version`` has the longest of ``versions`` that the number begins with."""
    known = "|".join(sorted(versions, key=len, reverse=True))
    return rf"(?:(?P<version>{known})(?: 0)?(?![^ ])|[0-9]+(?: [0-9]+)?)" if known else "[0-9]+(?: [0-9]+)?"


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: tags, grants, named versions, bare names, notices."""
    found: list[Rule] = []
    families = list(FAMILIES)
    for bits in range(1 << len(CC_ELEMENTS)):
        used = [e for i, e in enumerate(CC_ELEMENTS) if bits >> i & 1]
        long_name = " ".join(["creative commons attribution", *(name for name, _ in used)])
        families.append(("-".join(["cc-by", *(short for _, short in used)]), "commons", long_name, ("2 0", "2 5", "3 0", "4 0")))
    for label, gate, names, versions in families:
        plain, keywords = label.replace("-", " "), tuple(gate.split())
        number = _number(versions)
        found.append(Rule(label, 1, 0.99, ("spdx",), rf"spdx license identifier {plain}(?: {number})?(?: only| or later)?"))
        found.append(Rule(label, 2, 0.97, keywords, rf"{GRANT}(?:{names})(?: (?:international )?(?:(?:version|v) ?)?{number}(?: or (?:any )?later(?: version)?)?)?"))
        for version in versions:
            found.append(Rule(f"{label}-{version.replace(' ', '.')}", 3, 0.95, keywords, rf"(?:{names}) (?:international )?(?:(?:version|v) ?)?{version}(?: or (?:any )?later(?: version)?)?"))
        found.append(Rule(label, 4, 0.8, keywords, f"(?:{names})"))
    for label, gate, pattern in NOTICES:
        found.append(Rule(label, 5, 0.4, tuple(gate.split()), pattern))
    return tuple(found)


@lru_cache(maxsize=None)
def _whole_words(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ]){pattern}(?![^ ])".encode())


@lru_cache(maxsize=1)
def _compiled() -> list[tuple[tuple[bytes, ...], list[tuple[Rule, re.Pattern]]]]:
    by_keywords: dict[tuple[str, ...], list[tuple[Rule, re.Pattern]]] = {}
    for rule in rules():
        by_keywords.setdefault(rule.keywords, []).append((rule, _whole_words(rule.pattern)))
    return [(tuple(k.encode() for k in keywords), v) for keywords, v in by_keywords.items()]


_BREAK = rb"[^0-9a-z\x80-\xff]"
_BASE = [
    (label, phrase.split()[0].encode(), re.compile(rb"(?<![0-9a-z\x80-\xff])" + (_BREAK + b"+").join(phrase.encode().split()) + rb"(?![0-9a-z\x80-\xff])"))
    for phrase, label in BASE_PHRASES
]
_RUN = re.compile(_BREAK + b"+")
#: A text without any of these has no place of any rule. Each is part of one word, as the raw text is searched.
_ROOTS = tuple(sorted({k.encode() for k in ("licen", "gnu", "spdx", "copyright", "reserved", "cc", "commons", "domain", "warrant", "provided", "permission", "redistribution", "proprietary", "openrail", "cecill", "etalab", "bsd", "odbl", "wtfpl", "ncsa", "mulan", "apache")}))


def _spaced(text: bytes) -> bytes:
    return _RUN.sub(b" ", text).strip(b" ")


def detections(words: bytes) -> list[tuple[int, int, Rule]]:
    """Places (first byte, end byte, rule) in words joined by blanks, after suppression."""
    places = [
        (m.start(), m.end(), rule)
        for keywords, group in _compiled() if any(k in words for k in keywords)
        for rule, pattern in group for m in pattern.finditer(words)
    ]
    # a place goes if one of higher priority, or an earlier one of its own, contains it; what contains that one contains this
    kept: list[tuple[int, int, Rule]] = []
    starts, reach = np.empty(0, np.int64), np.empty(0, np.int64)  # of all places of higher priority: starts, furthest end up to each
    for priority in sorted({p[2].priority for p in places}):
        own = sorted((p for p in places if p[2].priority == priority), key=lambda p: (p[0], -p[1], p[2].label))
        first, end = np.array([p[0] for p in own]), np.array([p[1] for p in own])
        before = np.concatenate([[-1], np.maximum.accumulate(end)[:-1]])
        above = np.concatenate([[-1], reach])[np.searchsorted(starts, first, side="right")]
        kept += [own[i] for i in np.flatnonzero((before < end) & (above < end))]
        ends = np.concatenate([reach, end])
        order = np.argsort(np.concatenate([starts, first]), kind="stable")
        starts, reach = np.concatenate([starts, first])[order], np.maximum.accumulate(ends[order])
    return sorted(kept, key=lambda p: (p[0], p[1]))


def label_of(words: bytes, first: int, end: int, rule: Rule) -> str:
    """The label of a place that ``rule`` has found, with the version that a grant or a tag names."""
    place = _whole_words(rule.pattern).match(words, first, end)
    version = place.groupdict().get("version") if place else None
    return f"{rule.label}-{version.decode().replace(' ', '.')}" if version else rule.label


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        out: dict[str, list] = {name: [] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for first, last, data, offsets in text_steps(texts):
            starts, _, at = word_spans(data, offsets)
            low = LOWER[data].tobytes()
            out["n_words"].extend(np.diff(at).tolist())
            for row in range(last - first):
                text = low[offsets[row] : offsets[row + 1]]
                base, firsts, spans, chance = set(), [], [], 1.0
                if any(root in text for root in _ROOTS):
                    for label, root, pattern in _BASE:
                        if root in text:
                            hits = [m.start() for m in pattern.finditer(text)]
                            if hits:
                                base.add(label)
                                firsts += hits
                    words = _spaced(text)
                    blanks = np.concatenate([[0], np.cumsum(np.frombuffer(words, np.uint8) == 32)])
                    for a, b, rule in detections(words):
                        spans.append({"label": label_of(words, a, b, rule), "first_word": int(blanks[a]), "last_word": int(blanks[b]), "priority": rule.priority})
                        chance *= 1.0 - rule.weight
                if firsts:
                    chance *= 0.1
                    place = np.searchsorted(starts, np.array([min(firsts), max(firsts)]) + offsets[row]) - at[row]
                out["n_base"].append(len(firsts))
                out["first_word"].append(int(place[0]) if firsts else None)
                out["last_word"].append(int(place[1]) if firsts else None)
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {s["label"] for s in spans})))
                out["score"].append(1.0 - chance)
                out["spans"].append(spans)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("priority", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, first_word: long, last_word: long, priority: int>>"
)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: word and place counts, labels, score and the places kept."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text(text).alias("text")).mapInArrow(_scan, SCHEMA)
