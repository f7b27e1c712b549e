"""License notices in text: exact phrase places and fuzzy short-notice search.

Fuzzy search takes a notice of k allowed edits, splits it into k + 1 pieces (pigeonhole:
any place within k edits holds one piece unchanged), finds the pieces with an
Aho-Corasick automaton and verifies each place with the ``regex`` library's bounded
error matching, which also gives the span.  Edits may not touch the short words that tell
notices apart (TELLING): a place counts only if it has those of the notice and no others.

Defined cases: null text counts as empty; no words gives n_words 0, null positions,
empty labels and score 0; rows are independent; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice, product

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship

# Base phrases and labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Short notices in canonical words, their label.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("gnu general public license", "gpl"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("creative commons zero", "cc0"),
    ("cc0 1 0 universal", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("boost software license version 1 0", "bsl"),
    ("european union public licence", "eupl"),
    ("common development and distribution license", "cddl"),
    ("python software foundation license", "psf"),
    ("sil open font license", "ofl"),
    ("open database license", "odbl"),
    ("artistic license 2 0", "artistic"),
    ("gnu free documentation license", "gfdl"),
)
# Identifiers behind "spdx license identifier", their label.
SPDX = (
    ("mit", "mit"), ("apache 2 0", "apache"), ("gpl 2 0", "gpl"), ("gpl 3 0", "gpl"), ("lgpl 2 1", "lgpl"), ("lgpl 3 0", "lgpl"), ("agpl 3 0", "agpl"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"),
    ("mpl 2 0", "mpl"), ("epl 2 0", "epl"), ("isc", "isc"), ("cc0 1 0", "cc0"), ("unlicense", "unlicense"),
)
# The terms of a Creative Commons licence, short and as their names are written.
CC_TERMS = {
    "nc": ("noncommercial", "non commercial"),
    "nd": ("noderivatives", "no derivatives", "noderivs", "no derivs", "no derivative works"),
    "sa": ("sharealike", "share alike"),
}
CC_KINDS = ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd"))
# Short words that make one notice another.
TELLING = frozenset("sa nc nd mit bsd isc mpl epl gpl lgpl agpl cc0".split())


def cc_notices() -> Iterator[tuple[str, str]]:
    """The short and long names of the Creative Commons licences, in every spelling of their terms."""
    for kind in CC_KINDS:
        label = "-".join(("cc-by", *kind))
        short = " ".join(("cc by", *kind))
        yield f"licensed under {short} 4 0", label
        yield f"spdx license identifier {short} 4 0", label
        if kind:
            yield f"{short} 4 0", label
        for names in product(*(CC_TERMS[t] for t in kind)):
            yield " ".join(("creative commons attribution", *names)), label


#: All notices of a scan.
EVERY = (*NOTICES, *((f"spdx license identifier {x}", label) for x, label in SPDX), *cc_notices())
#: What goes on a name: a shorter name before it is not meant.
_GOES_ON = re.compile(r" (?:sa|nc|nd|non ?commercial|share ?alike|no ?deriv\w*)(?![^ ])")
_LOWER = {c: c + 32 for c in range(65, 91)}
_SEP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_WORDS = re.compile(f"[^{_SEP}]+")


def edits_for(notice: str, rate: float) -> int:
    """How many edits a notice may have; short ones get none beyond one per 12 characters."""
    return max(1, int(len(notice) * rate))


def pieces_of(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces: (offset, piece)."""
    n, out = len(notice), []
    for i in range(k + 1):
        a, b = n * i // (k + 1), n * (i + 1) // (k + 1)
        out.append((a, notice[a:b]))
    return out


def telling(span: str) -> list[str]:
    """The words of a span that tell notices apart."""
    return sorted(w for w in span.split(" ") if w in TELLING)


@functools.lru_cache(maxsize=4)
def _compiled(notices: tuple, rate: float):
    import ahocorasick
    import regex

    auto, pats = ahocorasick.Automaton(), []
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, label) in enumerate(notices):
        k = edits_for(notice, rate)
        pats.append((label, len(notice), k, regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(notice)}){{e<={k}}}(?![^ ])", regex.V1), telling(notice)))
        for off, piece in pieces_of(notice, k):
            seeds.setdefault(piece, []).append((i, off))
    for piece, where in seeds.items():
        auto.add_word(piece, where)
    auto.make_automaton()
    return auto, pats


def fuzzy_spans(canonical: str, notices: tuple = EVERY, rate: float = 0.08) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of notices in text whose words are joined by one space.

    Of overlapping places of one notice, the first with the fewest edits is reported;
    notices of one label that hold at one span report it once.  Where places of different
    labels overlap, the longest notice wins: a name that another one goes on from is not meant.
    """
    auto, pats = _compiled(notices, rate)
    windows: dict[int, list[list[int]]] = {}
    for end, where in auto.iter(canonical):
        for i, off in where:
            _, n, k, _, _ = pats[i]
            size = len(pieces_cache(notices[i][0], k)[off])
            start = end - size + 1 - off
            lo, hi = max(0, start - k), min(len(canonical), start + n + k)
            w = windows.setdefault(i, [])
            if w and lo <= w[-1][1]:
                w[-1][1] = max(w[-1][1], hi)
                w[-1][0] = min(w[-1][0], lo)
            else:
                w.append([lo, hi])
    out = []
    for i, spans in windows.items():
        label, n, k, pat, own = pats[i]
        for lo, hi in spans:
            for m in pat.finditer(canonical, lo, hi):
                if telling(m[0]) == own and not (label.startswith("cc-") and _GOES_ON.match(canonical, m.end())):
                    out.append((n, label, m.start(), m.end(), sum(m.fuzzy_counts)))
    return longest(out)


def longest(found: list[tuple[int, str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of places (length of the notice, ...) that no longer notice of another label overlaps."""
    found = sorted(set(found), key=lambda x: (x[2], x[3], x[1]))
    reach = max((x[3] - x[2] for x in found), default=0)
    out, first = {}, 0
    for n, label, start, end, edits in found:
        while found[first][2] + reach < start:
            first += 1
        beaten = False
        for m, other, a, b, _ in islice(found, first, None):
            if a >= end:
                break
            beaten = beaten or (b > start and other != label and m > n)
        if not beaten:
            out[label, start, end] = min(edits, out.get((label, start, end), edits))
    return sorted(((*k, e) for k, e in out.items()), key=lambda x: (x[1], x[2], x[0]))


@functools.lru_cache(maxsize=256)
def pieces_cache(notice: str, k: int) -> dict[int, str]:
    return dict(pieces_of(notice, k))


def scan_text(text: str | None, notices: tuple = EVERY, rate: float = 0.08) -> dict:
    """Words, base places, labels, score and fuzzy spans (in words) of one text."""
    low = (text or "").translate(_LOWER)
    words = _WORDS.findall(low)
    canonical = " ".join(words)
    starts: list[int] = []
    base: set[str] = set()
    padded = f" {canonical} "
    for phrase, label in BASE:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            starts.append(at)
            base.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    spans = fuzzy_spans(canonical, notices, rate) if words else []
    labels = base | {s[0] for s in spans}
    best = max((1 - e / max(1, b - a) for _, a, b, e in spans), default=0.0)
    score = 1.0 if base else min(1.0, max(0.0, best))
    ends = list(accumulate(len(w) + 1 for w in words)) if starts or spans else []
    word_at = lambda i: bisect_right(ends, i)
    return {
        "n_words": len(words),
        "n_base": len(starts),
        # in padded, a place begins with the space before its first word
        "first_word": word_at(min(starts)) if starts else None,
        "last_word": word_at(max(starts)) if starts else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": float(score),
        "spans": [{"label": s[0], "first_word": word_at(s[1]), "end_word": word_at(s[2] - 1) + 1, "edits": s[3]} for s in spans],
    }


SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:bigint,end_word:bigint,edits:bigint>>"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple = EVERY, rate: float = 0.08) -> DataFrame:
    """One row per document: id and the fields of scan_text()."""
    ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())]))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan_text(x, notices, rate) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], t) for k, t in kinds.items())], names=["doc_id", *kinds])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
