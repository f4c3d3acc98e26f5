"""Secret scan: sliding-window Shannon entropy over candidate strings, per character class, with an allow-list.

Base spans come from three fixed patterns: an assignment to a cue word, an access key, a run of lower-case hex digits. The
method adds spans of kind ``entropy``: candidates are runs of token letters, a window slides over a candidate's runs of each class
(``CLASSES``), and those windows count whose entropy reaches the class's least one. The counts of the window's letters change
by one letter in and one out, and the sum of c log2 c with them (whole numbers in units of 2^-32, so nothing drifts). Windows that
touch are one span, over all classes, and a span holds letters and digits. The allow-list drops candidates that it knows by their text (``ALLOWED``: sample keys,
identifiers) or by what stands before them (``ALLOWED_BEFORE``: labels of digests, embedded images, addresses), and spans that are names made
of words or alphabets. Spans inside a base span are dropped too. Base spans always stay.

One narrow pass, no shuffle. Runs of token letters are found in a whole slice of texts at once; the patterns and windows
look at those runs only, or at texts that hold a cue word. Time is linear in the text, memory one slice of rows (see ``common.slices``).

Null text counts as empty and has no spans; texts of any length are read whole; repeated rows give equal rows; null doc_ids are kept; an
empty table gives an empty result. Columns besides ``doc_id`` and ``text`` are ignored by ``report`` and kept by ``redact``, whatever
their names. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veriframe.llm.common import slices, texts_of

#: Fixed patterns, on UTF-8 bytes, where only ASCII letters have two cases. Each has a test of its matches.
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
LEAST_ACCESS = 18
#: Parts of cue words: a text without any has no assignment.
_CUES = (b"passw", b"secret", b"token", b"api_key", b"apikey")
KINDS = ("assign", "access", "hex", "entropy")

#: Letters of a class, window, least entropy of a window in bits. Random strings of a class reach it nearly always.
CLASSES = (
    ("hex", rb"[0-9a-f]+|[0-9A-F]+", 20, 2.9),
    ("base32", rb"[A-Z0-9]+", 20, 3.4),
    ("base64", rb"[A-Za-z0-9+/_-]+", 20, 3.6),
)
#: Shortest run of token letters that is looked at: base hex runs have 16.
LEAST_RUN = 16
#: Bytes before a candidate that the allow-list may see.
CONTEXT = 200

#: What the allow-list knows by its own text, and by the text before it.
ALLOWED = (
    rb"(?i)example|placeholder|changeme|change_me|dummy|sample|redacted|x{6}|0{8}|1234567|abcdefg|qwerty",
    rb"^(?i:md5|sha-?(?:1|224|256|384|512))[_-]",
    rb"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
ALLOWED_BEFORE = (
    rb"(?i)(?:\b(?:md5|sha-?(?:1|224|256|384|512)?|sum|digest|checksum|integrity|etag|commit|revision|rev|fingerprint)[\"']?[\x20:=(@-]*[\"']?)$",
    rb"(?i)(?:;base64,|data:[a-z]+/[a-z0-9.+-]+,)$",
    rb"(?i)(?:https?://|www\.)[^\x00-\x20\"'<>]*$",
)
#: What reads as a word in a name: capitalised or long ones, and whole pieces between signs.
WORDS = rb"[A-Z][a-z]{2,}|[a-z]{8,}|[A-Z]{14,}|(?<![A-Za-z0-9])(?:[a-z]{2,}|[A-Z]{2,})(?![A-Za-z0-9])|(?<![A-Za-z0-9])[a-z]{2,}(?=[A-Z])"
#: A name is made of words: this share of its letters stands in some.
WORDY = 0.7

_TOKEN = np.zeros(256, np.bool_)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_UNIT = 1 << 32
_CLASSES = [(re.compile(p), w, least) for _, p, w, least in CLASSES]
_OWN = [re.compile(p) for p in ALLOWED]
_BEFORE = [re.compile(p) for p in ALLOWED_BEFORE]
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{16,}")
_WORDS = re.compile(WORDS)
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")


def _weights(window: int) -> list[int]:
    """c log2 c of each count."""
    return [round(c * log2(c) * _UNIT) if c else 0 for c in range(window + 1)]


def dense(s: bytes, window: int, least: float) -> list[tuple[int, int]]:
    """Where windows of s have the least entropy or more; windows that touch are one span."""
    if len(s) < window:
        return []
    weight = _weights(window)
    rise = [b - a for a, b in zip(weight, weight[1:])]
    most = int(window * (log2(window) - least) * _UNIT)  # entropy = log2(window) - sum(c log2 c) / window
    count, total, out = [0] * 256, 0, []
    for i, x in enumerate(s):
        if i >= window:
            y = s[i - window]
            count[y] -= 1
            total -= rise[count[y]]
        total += rise[count[x]]
        count[x] += 1
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if out and out[-1][1] >= start:
                out[-1][1] = i + 1
            else:
                out.append([start, i + 1])
    return [(a, b) for a, b in out]


def known(s: bytes, before: bytes) -> bool:
    """Whether the allow-list knows a candidate by its text or by what stands before it."""
    return any(p.search(s) for p in _OWN) or any(p.search(before) for p in _BEFORE)


def plain(s: bytes) -> bool:
    """Whether a span lacks letters or digits, is a name made of words, or runs through an alphabet."""
    letters = sum(map(len, _LETTER.findall(s)))
    if not letters or not _DIGIT.search(s) or sum(map(len, _WORDS.findall(s))) >= WORDY * letters:
        return True
    return 2 * sum(b - a in (0, 1) for a, b in zip(s, s[1:])) >= len(s)


def added(text: bytes, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of high entropy within one run of token letters."""
    out: list[tuple[int, int]] = []
    for candidate in _CANDIDATE.finditer(text, start, end):
        s, at = candidate.group(), candidate.start()
        if not (_DIGIT.search(s) and _LETTER.search(s)) or known(s, text[max(at - CONTEXT, 0) : at]):
            continue
        found = [(m.start() + a, m.start() + b) for p, window, least in _CLASSES for m in p.finditer(s) for a, b in dense(m.group(), window, least)]
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(at + a, at + b) for a, b in merged if not plain(s[a:b])]
    return out


def _runs(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each text its runs of token letters, LEAST_RUN long or longer."""
    inside = _TOKEN[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[::2], edge[1::2]
    long = end - start >= LEAST_RUN
    start, end = start[long], end[long]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    base = np.cumsum(size) - size
    first = np.searchsorted(start, np.append(base, base[-1] + size[-1] if len(base) else 0)).tolist()
    return [list(zip((start[a:b] - o).tolist(), (end[a:b] - o).tolist())) for a, b, o in zip(first, first[1:], base.tolist())]


def _spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, in order."""
    lower, base = text.lower(), []
    if any(c in lower for c in _CUES):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGNED]
    if b"AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    more = []
    for start, end in runs:
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text, start, end)]
        more += added(text, start, end)
    base.sort()
    return sorted(base + [(a, 3, b) for a, b in _outside(more, base)])


def _outside(more: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans of more (in order) that no span of base (in order of starts) holds."""
    out, at, reach = [], 0, 0
    for a, b in more:
        while at < len(base) and base[at][0] <= a:
            reach = max(reach, base[at][2])
            at += 1
        if b > reach:
            out.append((a, b))
    return out


def find(texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
    """kind, start and end (code points) of all spans of each text, by start, then kind."""
    out = []
    for text, runs in zip(texts, _runs(texts), strict=True):
        spans = _spans(text, runs)
        if spans and not text.isascii():
            raw = np.frombuffer(text, np.uint8)
            points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            spans = [(int(points[a]), k, int(points[b])) for a, k, b in spans]
        out.append([(KINDS[k], a, b) for a, k, b in spans])
    return out


_NAMES = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")
_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def report(docs: DataFrame) -> DataFrame:
    """Counts, hash of the base spans and all spans for each row of docs (doc_id, text)."""

    def digest(spans: list[tuple[str, int, int]]) -> tuple:
        kinds = [k for k, _, _ in spans]
        joined = lambda keep: ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in keep)
        base = hashlib.sha256(joined(KINDS[:3]).encode()).hexdigest()
        return (*[kinds.count(k) for k in KINDS[:3]], base, joined(KINDS), kinds.count("entropy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        for b in slices(batches):
            columns = zip(*map(digest, find(texts_of(b))), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], list(_NAMES))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, _SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of every text replaced by a mark; spans that overlap are one. Null texts stay null."""

    def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
        if not spans:
            return text
        parts, at = [], 0
        for _, a, b in spans:
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            k = b.schema.get_field_index("text")
            texts = [masked(t, s) for t, s in zip(b.column(k).to_pylist(), find(texts_of(b)), strict=True)]
            yield b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
