"""Secret scans: fixed patterns, and values in credential contexts that are costly to guess."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.llm.arrow_text import slices, texts
from frameledger.llm.common_words import COMMON

# The contract's patterns, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: Names before a value, and what joins them to it: a separator, "is" or an arrow.
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|secret|encryption)[_\x20-]?key)["'`]?(\x20*(?:[:=]|=>|->)\x20*|\x20+is\x20+(?=["'`])|\x20+is:?\x20+)["'`]?([^\s"'`,;]+)""", re.I | re.A)
USERINFO = re.compile(r"://[^\s/:@]*:([^\s/:@]{4,})@")
_HINT = re.compile(rb"pass|pwd|pin|secret|token|credential|auth|bearer|key|akia", re.I)

#: Common words and passwords, most common first: the rank is the number of guesses.
WORDS = ("password the admin welcome login letmein qwerty secret monkey dragon master shadow love summer winter spring autumn hello test user root "
         "guest pass changeme default football baseball sunshine princess superman batman iloveyou trustno access mustang michael jordan hunter "
         "killer soccer pepper ginger flower orange banana cookie freedom whatever computer internet server example sample token key value "
         "none null true false string your here insert redacted placeholder and for with that this from are was not you").split()
_RANK = {w: i + 1 for i, w in enumerate([*WORDS, *COMMON])}
_LONGEST = max(map(len, _RANK))
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_KEY = {c: (r, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_REACH = 24


def _beside(a: str, b: str) -> bool:
    """Whether two characters are the same key or neighbours on the keyboard."""
    p, q = _KEY.get(a), _KEY.get(b)
    return bool(p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of a value takes.

    Segments: a listed word (its rank, more for capitals), a date (the days of two centuries, or its years), a repeat of
    a unit (the unit's guesses times the count), a walk over neighbouring keys (keys, directions, length), or a
    brute-force span (the alphabet of its characters to the power of its length). Segments multiply, and s of them can
    stand in s! orders (up to 12). A walk has at most 24 keys; a repeat goes on as long as it can.
    """
    n, low = len(value), value.lower()
    if not n:
        return 0.0
    size = {"d": 10, "l": 26, "u": 26, "o": 33}
    kind = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in value]
    # same[u][i]: how many characters from i on equal the ones u further.
    same = {u: [0] * (n + 1) for u in range(1, min(9, n))}
    for u, again in same.items():
        for i in range(n - u - 1, -1, -1):
            again[i] = again[i + 1] + 1 if value[i] == value[i + u] else 0
    # best[i]: for the first i characters, by number of segments, the least sum of logarithms.
    single = [math.log10(size[k]) for k in kind]
    best: list[dict[int, float]] = [{0: 0.0}] + [{} for _ in range(n)]
    brute: list[dict[int, float]] = [{} for _ in range(n + 1)]      # the same, with an open brute-force span at the end
    for i in range(n):
        if not best[i] and not brute[i]:
            continue

        def put(end: int, cost: float, i: int = i) -> None:
            for s, c in best[i].items():
                if s < 12 and c + cost < best[end].get(s + 1, math.inf):
                    best[end][s + 1] = c + cost

        for s, c in best[i].items():
            if s < 12 and c + single[i] < brute[i + 1].get(s + 1, math.inf):
                brute[i + 1][s + 1] = c + single[i]
        for s, c in brute[i].items():
            if c + single[i] < brute[i + 1].get(s, math.inf):
                brute[i + 1][s] = c + single[i]
        for end in range(i + 3, min(n, i + _LONGEST) + 1):
            if rank := _RANK.get(low[i:end]):
                put(end, math.log10(rank + 1) + (0.3 * (1 + (not value[i:end].istitle())) if value[i:end] != low[i:end] else 0))
        if kind[i] == "d" and (m := _DATE.match(value, i)):
            put(m.end(), math.log10(200 if m.end() - i == 4 else 73_000))
        for unit, again in same.items():
            k = again[i] // unit + 1
            if k > 1 and k * unit >= 3:
                put(i + k * unit, sum(single[i : i + unit]) + math.log10(k))
        end = i + 1
        while end < min(n, i + _REACH) and _beside(low[end - 1], low[end]):
            end += 1
            if end - i >= 3:
                put(end, math.log10(47 * 8) + 0.3 * (end - i))
        for s, c in brute[i + 1].items():
            if c < best[i + 1].get(s, math.inf):
                best[i + 1][s] = c
    return min(c + math.log10(math.factorial(s)) for s, c in best[n].items())


def scan(text: str, least_guesses: float = 8.0, least_length: int = 8) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, start of the secret itself) of every finding, by start and kind; positions in code points.

    The pattern kinds are each leftmost and non-overlapping. `guess` adds values after a credential name, or in a
    URL's user part, that take 10 ** least_guesses guesses or more and lie in no other finding.
    """
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            found.append((0, m.start(), m.end(), m.start(2)))
    found += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    taken = [(a, b) for _, a, b, _ in found]
    for pattern, group in ((CONTEXT, 2), (USERINFO, 1)):
        for m in pattern.finditer(text):
            a, value = m.start(group), m[group].rstrip(".!?)")
            b = a + len(value)
            if len(value) >= least_length and not any(x < b and a < y for x, y in taken) and guess_cost(value) >= least_guesses:
                found.append((3, a, b, a))
                taken.append((a, b))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _may_hold(text: bytes) -> bool:
    return bool(_HINT.search(text)) or b"://" in text


def findings(raw: bytes) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The decoded text and its findings. Texts without a hint of any other kind are searched for long hex runs only."""
    text = raw.decode("utf-8", "replace")
    if _may_hold(raw):
        return text, scan(text)
    return text, [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]


def _joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in found)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess.

    base_sha256 covers the pattern kinds, spans lists every finding. Null texts are empty: no finding, the digest of
    the empty string. Repeated rows are kept, an empty table gives no rows, further columns are not carried.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for t in texts(part.column("text")):
                    found = findings(t)[1]
                    base = [x for x in found if x[0] < 3]
                    counts = [sum(x[0] == k for x in found) for k in range(4)]
                    rows.append((*counts[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), counts[3]))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                                 names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint")


def redact_text(raw: bytes, mark: str = "[SECRET]") -> str | None:
    """The text with every secret replaced by the mark; None if it has none. Overlapping secrets become one mark."""
    text, found = findings(raw)
    if not found:
        return None
    spans: list[list[int]] = []
    for a, b in sorted((s, e) for _, _, e, s in found):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
