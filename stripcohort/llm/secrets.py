"""Secret scan: known key forms, and windows of high Shannon entropy per character class."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed forms, kind by kind in this order; group 2 of assign and the whole of the others must have so many characters.
KINDS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]+", 24),
)
#: Character classes of entropy spans: kind, candidate, window, least entropy of a window in bits per character.
CLASSES = (
    ("entropy_hex", r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])", 20, 3.0),
    ("entropy_alnum", r"(?<![0-9A-Za-z])(?=[A-Za-z]*[0-9])(?=[0-9A-Fa-f]*[G-Zg-z])[0-9A-Za-z]{20,}(?![0-9A-Za-z])", 20, 3.6),
    ("entropy_base64", r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[0-9A-Za-z+/_-]{32,}={0,2}", 32, 4.2),
    # without a digit: both cases, mixed beyond a capital at the start
    ("entropy_letters", r"(?<![0-9A-Za-z])(?=[A-Za-z][a-z]*[A-Z])(?=[A-Z]*[a-z])[A-Za-z]{20,}(?![0-9A-Za-z])", 20, 3.7),
    ("entropy_letters64", r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z]*[+/_-])(?=[A-Za-z+/_-][a-z+/_-]*[A-Z])(?=[A-Z+/_-]*[a-z])[A-Za-z+/_-]{32,}(?![0-9A-Za-z+/_-])={0,2}", 32, 4.25),
)
#: Candidates that look random as a whole and are none: identifiers in the form of a UUID.
ALLOWED = (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",)
#: Parts of values of examples: windows that meet such a word, or hold so many equal characters in a row, don't count; the rest does.
WORDS = r"(?i)example|placeholder|dummy|sample|0123456789|abcdefghij"
EQUAL = 8


def entropy_spans(text: str, start: int, end: int, window: int, least: float, harmless: list[tuple[int, int]] = ()) -> tuple[int, int] | None:
    """The part of text[start:end] that windows of at least so many bits a character cover, from the first to the last.

    Windows that begin before hi and end after lo of a harmless (lo, hi), sorted by lo, don't count.
    Counts change by one character in and one out as the window slides, and so does the sum of c * log2(c).
    """
    counts: dict[str, int] = {}
    total, first, last, at, clear = 0.0, -1, -1, 0, start
    for i in range(start, end):
        c = counts.get(text[i], 0)
        counts[text[i]] = c + 1
        total += (c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)
        if i - start >= window:
            c = counts[text[i - window]]
            counts[text[i - window]] = c - 1
            total += ((c - 1) * math.log2(c - 1) if c > 1 else 0.0) - c * math.log2(c)
        while at < len(harmless) and harmless[at][0] <= i:
            clear = max(clear, harmless[at][1])
            at += 1
        if i - start >= window - 1 and i - window + 1 >= clear and math.log2(window) - total / window >= least - 1e-9:
            first = i - window + 1 if first < 0 else first
            last = i + 1
    return (first, last) if first >= 0 else None


def scanner(kinds: tuple = KINDS, classes: tuple = CLASSES, allowed: tuple = ALLOWED, words: str = WORDS, equal: int = EQUAL) -> object:
    """text -> (base spans, spans of the entropy method), each (start, order of its kind, kind, end)."""
    any_case = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = kinds[0][1].replace("password|passwd|secret|token|api_?key", any_case + "|[aA][pP][iI]_?[kK][eE][yY]")
    base = [(i, kind, re.compile(f"(?=[pPsStTaA]){assign}" if kind == "assign" else form), 2 if kind == "assign" else 0, least) for i, (kind, form, least) in enumerate(kinds)]
    # runs below the least length can't hold a match, so long runs are looked for at once
    base = [(i, kind, re.compile(r"[0-9a-f]{%d,}" % least) if kind == "hex" else r, g, least) for i, kind, r, g, least in base]
    more = [(len(kinds) + i, kind, re.compile(form), window, least) for i, (kind, form, window, least) in enumerate(classes)]
    candidate = re.compile(r"[0-9A-Za-z+/_-]{20,}={0,2}")
    allow = [re.compile(a) for a in allowed]
    word_form, equal_form = re.compile(words), re.compile(r"(.)\1{%d,}" % (equal - 1))

    def harmless(text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Words as they stand; rows of equal characters narrowed, so that only windows that hold enough of them meet them."""
        met = [m.span() for m in word_form.finditer(text, start, end)]
        return sorted(met + [(m.start() + equal - 1, m.end() - equal + 1) for m in equal_form.finditer(text, start, end)])

    def scan(text: str) -> tuple[list[tuple], list[tuple]]:
        known = [(m.start(), i, kind, m.end()) for i, kind, form, group, least in base for m in form.finditer(text) if len(m[group]) >= least]
        found = []
        for run in candidate.finditer(text):
            word = run[0]
            if word.isalpha() and (word[1:].islower() or word.isupper()):
                continue
            for i, kind, form, window, least in more:
                for m in form.finditer(text, run.start(), run.end()):
                    if any(a.fullmatch(m[0]) for a in allow):
                        continue
                    span = entropy_spans(text, m.start(), m.end(), window, least, harmless(text, m.start(), m.end()))
                    if span:
                        found.append((span[0], i, kind, span[1]))
        return sorted(known), sorted(found)

    return scan


def scan_secrets(docs: DataFrame, kinds: tuple = KINDS, classes: tuple = CLASSES, allowed: tuple = ALLOWED) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Spans are kind:start:end in code points, end exclusive, by start and then kind in the order
    listed. Base spans are the fixed forms; the entropy method adds its own, never on strings of the
    allow-list and on windows without words of examples, which don't touch base spans. A null text counts as empty: no spans, and the
    digest of the empty string. Repeated rows and null ids come back as they are; other columns of docs are left out.
    """
    kind = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(kinds, classes, allowed)
        write = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                known, found = scan(text.as_py() or "")
                n = [sum(x[1] == i for x in known) for i in range(3)]
                rows.append((*n, hashlib.sha256(write(known).encode()).hexdigest(), write(sorted(known + found)), len(found)))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            # ids stay in Arrow: as pandas numbers, those beside a null would lose their low digits
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]], [x.split()[0] for x in kind.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)
