"""Secrets in texts: three fixed patterns, and literals assigned to names that promise a secret.

`lexing` reads source and configuration syntax into pairs of a name and its literals or other names. Constants are
carried on to the names built from them, before or behind their use, and a literal is scored by the words of the names it
ends in and by its own form. Values are summed up by their characters, so no literal, name or chain is too long.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._ids import slices
from .lexing import Assignment, assignments

# The three kinds as they are asked for, in their order, and the kind that lexing adds
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?a)(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need not be matched
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Words of names, with how much they promise; pairs stand for neighbouring words
STRONG = {"password", "passwd", "pwd", "passphrase", "secret", "secrets", "token", "apikey", "credential", "credentials", "privatekey", "accesskey", "secretkey", "authtoken"}
PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("auth", "key"), ("signing", "key"), ("encryption", "key"), ("account", "key"), ("client", "key"), ("master", "key")}
WEAK = {"auth": 0.6, "bearer": 0.6, "pass": 0.6, "cred": 0.6, "creds": 0.6, "key": 0.4, "salt": 0.4}
HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "salt")
EXAMPLES = re.compile(r"(?i)^(?:change_?me|example|sample|dummy|placeholder|none|null|true|false|your|todo|test|xxx|\*+|\.\.\.|<|\$\{|\{\{|%\(|\[secret\])")

def words_of_name(name: str) -> list[str]:
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return [w.lower() for w in re.split(r"[_.\-]+", parts) if w]


def name_score(name: str) -> float:
    words = words_of_name(name)
    if STRONG.intersection(words) or PAIRS.intersection(zip(words, words[1:])):
        return 1.0
    return max((WEAK.get(w, 0.0) for w in words), default=0.0)


KINDS_OF_CHARACTERS = (str.isspace, str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())


@dataclass(frozen=True)
class Form:
    """What a score needs of a value: counts of its characters, their kinds, its beginning. Forms of parts add up.

    Characters count by the last byte of their code point, so a form is small whatever the value is.
    """

    counts: Counter
    kinds: tuple[bool, ...]
    head: str

    def __add__(self, other: Form) -> Form:
        return Form(self.counts + other.counts, tuple(map(max, self.kinds, other.kinds)), (self.head + other.head)[:16])


def form_of(value: str) -> Form:
    exact, counts = Counter(value), Counter()
    for c, n in exact.items():
        counts[ord(c) & 255] += n
    return Form(counts, tuple(any(map(f, exact)) for f in KINDS_OF_CHARACTERS), value[:16])


def literal_score(form: Form) -> float:
    """0 for short, blank-holding or example values; else up to 1 with kinds of characters and entropy."""
    counts, size = form.counts, form.counts.total()
    if size < 8 or len(counts) == 1 or EXAMPLES.search(form.head) or form.kinds[0]:
        return 0.0
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    return min(1.0, 0.25 * (sum(form.kinds) - 1) + 0.15 * max(0.0, entropy - 1))


def solve(text: str, assigned: list[Assignment], threshold: float) -> set[tuple[int, int]]:
    """Spans of the literals that end in a name of enough promise, through any number of names between.

    A name means what was last assigned to it before, or else what is first assigned to it later; of several values it
    means the longest, the first of equals. Names in a circle add nothing where the circle closes.
    """
    places: dict[str, list[int]] = {}
    for i, a in enumerate(assigned):
        places.setdefault(a.name, []).append(i)

    def meant(name: str, i: int) -> int | None:
        where = places.get(name, [])
        at = bisect_left(where, i)
        return where[at - 1] if at else where[0] if where and assigned[i].name != name else None

    def opened(i: int) -> list[list[tuple | int]]:
        """Values of an assignment as spans and numbers of other assignments."""
        own = meant(assigned[i].name, i) if assigned[i].adds else None
        rows = []
        for value in assigned[i].values:
            row: list[tuple | int] = [] if own is None else [own]
            for part in value:
                names = [part[1]] if part[0] == "name" else text[part[1] : part[2]].split("+") if part[0] == "bare" else []
                known = [meant(n.lstrip("$"), i) for n in names]
                if part[0] != "name" and (None in known or not known):
                    row.append((part[1], part[2]))
                else:
                    row += [k for k in known if k is not None]
            rows.append(row)
        return rows

    rows = [opened(i) for i in range(len(assigned))]
    forms: list[list[Form] | None] = [None] * len(assigned)
    best = [0] * len(assigned)
    nothing = form_of("")
    begun: set[int] = set()
    for first in range(len(assigned)):
        stack = [first]
        while stack:
            i = stack[-1]
            if forms[i] is not None:
                stack.pop()
                continue
            if i not in begun:
                begun.add(i)
                stack += [p for row in rows[i] for p in row if isinstance(p, int) and p not in begun]
                continue
            forms[i] = []
            for row in rows[i]:
                total = nothing
                for p in row:
                    total += (forms[p][best[p]] if forms[p] else nothing) if isinstance(p, int) else form_of(text[slice(*p)])
                forms[i].append(total)
            best[i] = max(range(len(rows[i])), key=lambda k: forms[i][k].counts.total())
            stack.pop()

    reached = [(i, k) for i, a in enumerate(assigned) if (promise := name_score(a.name)) for k, form in enumerate(forms[i]) if promise * literal_score(form) >= threshold]
    seen, found = set(reached), set()
    while reached:
        i, k = reached.pop()
        for p in rows[i][k]:
            if not isinstance(p, int):
                found.add(p)
            elif (p, best[p]) not in seen:
                seen.add((p, best[p]))
                reached.append((p, best[p]))
    return found


def lexed_spans(text: str, threshold: float = 0.4) -> list[tuple[int, int]]:
    """Spans of literals that reach a name of enough promise; comments are read apart from the code."""
    low = text.lower()
    if not any(s in text for s in ("=", ":", "</", "define")) or not any(h in low for h in HINTS):
        return []
    return sorted(set().union(*(solve(text, assigned, threshold) for assigned in assignments(text))))


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) in order; the fixed kinds as they are, then literals."""
    low = text.lower()
    spans = []
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        spans += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    spans += [(*m.span(), 2) for m in HEX.finditer(text)]
    spans += [(*s, 3) for s in lexed_spans(text)]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """`text` with each stretch of overlapping or touching spans replaced."""
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a > end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:a])
            at = a
        end = max(end, b)
    if end >= 0:
        out.append(mark)
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, in order of start, then kind. Null and empty texts have none;
    repeated rows get equal answers, null ids stay. Texts, names and literals of any length are read whole, one text in memory
    at a time; of equal spans of several kinds each stays, in the order of kinds. Only doc_id and text are looked at, so
    other columns may have any name.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = find_spans(text or "")
                counts = Counter(k for _, _, k in spans)
                base = joined([s for s in spans if s[2] < 3])
                rows.append((doc, counts[0], counts[1], counts[2], counts[3], hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5]), pa.array(columns[6])], ["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, schema)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with secrets in `text` replaced by `[secret]`; other columns and all rows stay, null texts too."""
    names = docs.columns
    where = names.index("text")

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t if t is None else redacted(t, find_spans(t)) for t in b.column(where).to_pylist()]
            columns = [pa.array(texts, c.type) if i == where else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(change, docs.schema)
