"""Public tokenizers inside tasks: their files travel as broadcast bytes, and a text is encoded by its distinct words.

A word is encoded once for many texts. That is right only where no token can reach across the cut, which each caller
states for its cuts and checks against the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Runs of Latin letters; each is one unit to the tokenizers used here.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def file_bytes(path: str) -> bytes:
    """A vocabulary file; a path with a scheme may be on any store that pyarrow reaches."""
    from pyarrow import fs

    if "://" in path:
        system, at = fs.FileSystem.from_uri(path)
    else:
        system, at = fs.LocalFileSystem(), path
    with system.open_input_stream(at) as f:
        return f.read()


def loaded(data: bytes, plain_specials: bool = False):
    """A tokenizer of the library `tokenizers`; with plain_specials, its special strings in a text are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(data)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


def slices(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of about this many bytes, one text at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, to - at
        at = to


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i] : offsets[i + 1]]; 0 for an empty run."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def word_ids(tokenizer, words: list[str], unit: str, glue: str, edge: np.ndarray, at_start: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of every word: (flat, starts, sizes), word i having flat[starts[i] : starts[i] + sizes[i]].

    Words that match unit are encoded a thousand at a time with glue between them: each is one unit of the tokenizer,
    whose first (at_start) or last token has edge[id] true and no other token has. Should the edges not fit the words,
    they are encoded one by one, as all others are.
    """
    match = re.compile(unit).fullmatch
    is_unit = np.fromiter((match(w) is not None for w in words), bool, len(words))
    units, rest = np.flatnonzero(is_unit), np.flatnonzero(~is_unit)
    flats, sizes_of, order, single = [np.zeros(0, np.int32)], [], [], [rest]
    for i in range(0, len(units), 1000):
        at = units[i : i + 1000]
        ids = np.array(tokenizer.encode_batch_fast([glue.join([words[k] for k in at])], add_special_tokens=False)[0].ids, np.int32)
        marks = np.flatnonzero(edge[ids])
        if len(marks) != len(at):
            single.append(at)
            continue
        flats.append(ids)
        sizes_of.append(np.diff(np.append(marks, len(ids))) if at_start else np.diff(np.concatenate([[-1], marks])))
        order.append(at)
    rest = np.concatenate(single)
    for i in range(0, len(rest), 1000):
        found = [e.ids for e in tokenizer.encode_batch_fast([words[k] for k in rest[i : i + 1000]], add_special_tokens=False)]
        flats.append(np.array([x for ids in found for x in ids], np.int32))
        sizes_of.append(np.array([len(ids) for ids in found]))
    order.append(rest)
    where, n = np.concatenate(order).astype(np.int64), np.concatenate([*sizes_of, np.zeros(0, np.int64)]).astype(np.int64)
    starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    sizes[where] = n
    starts[where] = np.cumsum(n) - n
    return np.concatenate(flats), starts, sizes


def in_batches(work: Callable, columns: list[str]) -> Callable:
    """For mapInArrow: work gets, and may keep state over, all batches of a task as tuples of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(tuple(b.column(b.schema.get_field_index(c)) for c in columns) for b in batches)

    return run
