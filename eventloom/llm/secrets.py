"""Secret scans: fixed patterns, and guess-cost dynamic programming for values in credential contexts.

A value that follows a credential word (also one that the patterns do not know) is cut
into words, dates, repeats, sequences, keyboard walks and brute-force runs so that the
product of the parts' guess counts, with a factor for the number of parts, is least;
repeats, sequences and walks are taken as far as they reach from their start.
Values that cost ``MIN_LOG10`` or more to guess become spans of kind ``guess``.

Defined results: a null text is empty and has no spans; rows with a null doc_id are left
out; of rows with one doc_id the greatest text counts; an empty table gives no rows;
other columns are ignored.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, keyed

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10 = 10.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(r"""(?:\b|(?<=_)|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?|bearer|credentials?|login)["']?(?:\x20{0,3}(?:[:=]|=>|->)\x20{0,3}|\x20(?:is|was)\x20)["']?(?:(?:bearer|basic)\x20+)?["']?([!-~]{6,})""", re.I | re.A)
_HINTS = ("pass", "pwd", "pin", "secret", "token", "api", "key", "auth", "bearer", "credential", "login")

#: Common words of passwords, most frequent first (fixed values).
WORDS = (
    "password pass admin welcome login letmein monkey dragon master sunshine princess football baseball shadow "
    "superman michael jordan secret summer winter spring autumn hello freedom whatever love test user root guest "
    "change default server system access token key private public example sample demo temp abc qwerty asdf zxcv "
    "the and for you that with this from have not are was his her they will would there their what about which "
    "when make can like time just him know take people into year your good some could them see other than then "
    "now look only come its over think also back after use two how our work first well way even new want because "
    "any these give day most house world company group number street water money night light black white green blue"
).split()
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_LEET = str.maketrans("4@31!05$7", "aaeiiosst")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEXT: dict[str, set[str]] = {}
for _y, _r in enumerate(_ROWS):
    for _x, _c in enumerate(_r):
        near = {(_y, _x - 1), (_y, _x + 1), (_y - 1, _x), (_y - 1, _x + 1), (_y + 1, _x), (_y + 1, _x - 1)}
        _NEXT[_c] = {_ROWS[b][a] for b, a in near if 0 <= b < len(_ROWS) and 0 <= a < len(_ROWS[b])}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")


def _extents(v: str, low: str) -> tuple[list[list[int]], list[int], list[int], list[int]]:
    """By start: how far characters equal those 1 to 4 later, ends of walks, ends of sequences; and keys outside the top letter row before."""
    n = len(v)
    equal = [[0] * (n + 1) for _ in range(4)]
    walk, seq, outer = [n] * (n + 1), [n] * (n + 1), [0] * (n + 1)
    for i in range(n - 2, -1, -1):
        for size in range(1, 5):
            if i + size < n and v[i] == v[i + size]:
                equal[size - 1][i] = equal[size - 1][i + 1] + 1
        walk[i] = walk[i + 1] if low[i + 1 : i + 2] in _NEXT.get(low[i], ()) else i + 1
        step = ord(v[i + 1]) - ord(v[i])
        seq[i] = seq[i + 1] if i + 2 < n and ord(v[i + 2]) - ord(v[i + 1]) == step else i + 2
    for i in range(n):
        outer[i + 1] = outer[i] + (low[i] not in _ROWS[1])
    return equal, walk, seq, outer


def _parts(v: str, low: str, plain: str, ext: tuple, i: int):
    """(end, log10 of guesses) of the known parts that start at i; low and plain are v in lower case and without leet."""
    n, (equal, walk, seq, outer) = len(v), ext
    for j in range(i + 2, min(n, i + _LONGEST) + 1):
        for form, factor in ((low[i:j], 1), (plain[i:j], 4)):
            if form in _RANK:
                yield j, math.log10(_RANK[form] * factor * (1 if v[i:j] == low[i:j] else 2 if v[i:j].istitle() or v[i:j].isupper() else 2 ** (j - i)))
                break
    if m := _DATE.match(v, i):
        yield m.end(), math.log10(365 * 120 * (4 if re.search(r"[-/.]", m[0]) else 1) if m.end() - i > 4 else 120)
    for size in range(1, 5):
        if more := equal[size - 1][i] // size:
            yield i + (more + 1) * size, size * math.log10(12) + math.log10(more + 1)
    if (j := walk[i]) - i >= 3:
        yield j, math.log10(47 * 4.6 * (j - i)) + (outer[j] - outer[i]) * math.log10(2)
    if i + 2 < n and ord(v[i + 1]) - ord(v[i]) in (1, -1) and (j := seq[i]) - i >= 3:
        yield j, math.log10(20.0 * (j - i))


def log10_guesses(value: str, enough: float = math.inf) -> float:
    """Least log10 cost over all segmentations into such parts; each further part multiplies the cost by its number.

    Places keep the least cost for each number of parts, unless fewer parts cost no more.
    A cost of ``enough`` or more may be given as infinite.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # some letters are two in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    ext = _extents(value, low)
    states: list[dict[int, float]] = [{0: 0.0}] + [{} for _ in range(n)]
    for i, c in enumerate(value):
        front, best = [], math.inf
        for k, have in sorted(states[i].items()):
            if have < best:
                best = have
                front.append((k, have))
        if i:
            states[i] = {}
        if not front:
            continue
        steps = [(i + 1, 1.0 if c.isdigit() else 1.4 if c.islower() or c.isupper() else 1.5, True)]
        steps += [(j, cost, False) for j, cost in _parts(value, low, plain, ext, i)]
        for j, cost, brute in steps:
            to = states[j]
            for k, have in front:
                k2 = k if brute and i else k + 1
                total = have + cost + (0.0 if brute else math.log10(k2))
                if total < enough and total < to.get(k2, math.inf):
                    to[k2] = total
    return min(states[n].values(), default=math.inf)


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start and kind."""
    out = []
    low = text.lower()
    if any(x in low for x in ("password", "passwd", "secret", "token", "api")):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if any(x in low for x in _HINTS):
        base = sorted((a, b) for _, a, b in out)
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?\"')]}>")
            a, b = m.start(1), m.start(1) + len(value)
            if b - a >= 6 and not any(x < b and a < y for x, y in base) and log10_guesses(value, MIN_LOG10) >= MIN_LOG10:
                out.append(("guess", a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_OUT_PA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
_SCAN_PA = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = ([], [], [], [], [])
        for text in batch.column(1).to_pylist():
            found = spans(text or "")
            base = [s for s in found if s[0] != "guess"]
            for col, kind in zip(cols, KINDS[:3], strict=False):
                col.append(sum(s[0] == kind for s in base))
            cols[3].append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
            cols[4].append(",".join(f"{k}:{a}:{b}" for k, a, b in found))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t.type) for c, t in zip(cols, list(_OUT_PA)[1:], strict=True))], schema=_OUT_PA)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, k, a, b, log10_guesses(t[a:b])) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for k, a, b in spans(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _SCAN_PA, strict=True)], schema=_SCAN_PA)


def digests(docs: DataFrame) -> DataFrame:
    return arrow(keyed(docs), _digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, log10_guesses: one row per span."""
    return arrow(keyed(docs), _scan, "doc_id long, kind string, start long, end long, log10_guesses double")
