r"""Secret scans with multipart credential linking.

Strong patterns stand on their own: assignments of passwords and keys, access key identifiers and long hex
runs.  Weak parts mean nothing alone: account identifiers (`user=...`), opaque secrets (tokens of 20 characters
or more that look random) and endpoints (URLs, host names with a port).  Weak parts of a text are interval-joined
within scopes: a part's scope is the other lines of its paragraph (between two blank lines, as of a section of a
configuration file), and `reach` code points on either side of the part, in long lines and beyond the paragraph.
Parts sorted by start are matched by binary search with those that meet their scope.  A weak secret is reported when an identifier or
an endpoint is in its scope, and an identifier or endpoint when a secret, weak or strong, is; otherwise nothing
is reported.

All patterns take time in proportion to the text: a host name is looked for once in each run of its
characters, a scheme has at most 16 characters.

Edge cases: null text is empty; empty text has no spans; a span of a weak part that overlaps a strong span is
not reported twice; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.common import doc_texts

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Cheap signs that an assignment may be there, to be looked for in the lower-cased text.
SIGNS = ("passw", "secret", "token", "apikey", "api_key")
IDENT = re.compile(r"""\b(?:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
#: A URL, or a whole run of the characters of host names with a port behind it.
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?<![A-Za-z0-9.-])(?P<host>[A-Za-z0-9.-]++):\d{2,5}\b""")
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")
REACH = 200
#: Bits a character of tokens that look random: those of 20 characters or more have about 3.7 or more.
ENTROPY = 3.5
#: Changes between letters and digits in a token that looks random.
SWITCHES = 3

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The strong patterns, each kind leftmost and non-overlapping, as (start, end, kind)."""
    spans: list[Span] = []
    low = text.lower()
    if any(sign in low for sign in SIGNS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def looks_random(token: str) -> bool:
    """Digits, capitals and small letters together, or letters and digits that change often and hardly repeat."""
    digits = [c.isdigit() for c in token]
    if not any(digits):
        return False
    if any(map(str.isupper, token)) and any(map(str.islower, token)):
        return True
    if sum(a != b for a, b in zip(digits, digits[1:], strict=False)) < SWITCHES:
        return False
    shares = [n / len(token) for n in Counter(token).values()]
    return -sum(p * math.log2(p) for p in shares) >= ENTROPY


def endpoints(text: str) -> list[Span]:
    """URLs, and host names of at least two labels with a port."""
    found: list[Span] = []
    for m in ENDPOINT.finditer(text):
        start = m.start()
        if (host := m["host"]) is not None:
            # The name is what follows the last empty label.
            start += host.rfind("..") + 2 if ".." in host else 0
            while start < m.end("host") and text[start] in ".-":
                start += 1
            name = text[start : m.end("host")]
            if "." not in name or name.endswith("."):
                continue
        found.append((start, m.end(), "endpoint"))
    return found


def scopes(text: str, parts: list[Span], reach: int) -> list[tuple[Span, Span, Span]]:
    """The scope of each part as intervals: earlier lines of its paragraph, `reach` code points around it, later lines."""
    if not parts:
        return []
    breaks = [m.span() for m in BLANK_LINE.finditer(text)]
    ends, starts = [a for a, _ in breaks] + [len(text)], [0] + [b for _, b in breaks]
    lines = [m.start() for m in re.finditer("\n", text)]
    found = []
    for begin, end, kind in parts:
        low, high = starts[max(0, bisect_right(starts, begin) - 1)], ends[min(len(ends) - 1, bisect_left(ends, end))]
        before, after = bisect_left(lines, begin), bisect_left(lines, end)
        earlier = (low, lines[before - 1], kind) if before and lines[before - 1] >= low else (begin, begin, kind)
        later = (lines[after] + 1, high, kind) if after < len(lines) and lines[after] < high else (end, end, kind)
        found.append((earlier, (begin - reach, end + reach, kind), later))
    return found


def in_reach(part: Span, others: list[Span], starts: list[int], ends: list[int], reach: int) -> bool:
    """Whether one of `others` (sorted by start; `ends` are their running maxima) begins or ends within reach of part."""
    last = bisect_right(starts, part[1] + reach)
    return last > bisect_left(ends, part[0] - reach, 0, last)


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """The weak parts that complete a credential."""
    parts: dict[str, list[Span]] = {"ident": [], "secret": [], "endpoint": []}
    if "://" in text or ":" in text or "=" in text:
        parts["ident"] = [(*m.span(), "ident") for m in IDENT.finditer(text)]
        parts["endpoint"] = endpoints(text)
    secrets = sorted(x for x in base if x[2] != "access")
    names = sorted([x for x in base if x[2] == "access"] + parts["ident"] + parts["endpoint"])
    if not names and not secrets:
        return []
    if names:
        parts["secret"] = [(*m.span(), "secret") for m in WEAK.finditer(text) if looks_random(m[0])]
    free = lambda x: not covered(x, base, base_starts, base_ends)
    base_starts, base_ends = sweep(base)
    parts = {kind: [x for x in found if free(x)] for kind, found in parts.items()}
    names = sorted([x for x in base if x[2] == "access"] + parts["ident"] + parts["endpoint"])
    secrets = sorted(secrets + parts["secret"])
    found = []
    for wanted, mine in ((names, parts["secret"]), (secrets, parts["ident"] + parts["endpoint"])):
        starts, ends = sweep(wanted)
        found += [x for x, scope in zip(mine, scopes(text, mine, reach), strict=True) if any(in_reach(part, wanted, starts, ends, 0) for part in scope)]
    return found


def sweep(spans: list[Span]) -> tuple[list[int], list[int]]:
    """The starts of sorted spans, and the largest end so far."""
    ends, most = [], -1
    for _, end, _ in spans:
        most = max(most, end)
        ends.append(most)
    return [x[0] for x in spans], ends


def covered(part: Span, spans: list[Span], starts: list[int], ends: list[int]) -> bool:
    """Whether part overlaps one of the sorted spans."""
    last = bisect_left(starts, part[1])
    return last > 0 and ends[last - 1] > part[0]


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """One row a document: (doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for value in batch.column("text"):
                text = value.as_py()
                base = base_spans(text)
                linked = linked_spans(text, base, reach)
                kinds = [x[2] for x in base]
                row = (*(kinds.count(k) for k in KINDS[:3]), len(linked), hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(base + linked))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:4]), *(pa.array(x, pa.string()) for x in out[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"])

    return doc_texts(documents).mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string")
