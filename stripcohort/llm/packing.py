"""Sum-of-squares packing of token sequences into windows of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripcohort.llm import tokens

#: Open windows that a task may hold; beyond it they are filled up from each other.
MOST_OPEN = 4096
#: Bytes of text whose distinct words are encoded together.
SLICE = 16 << 20
LETTER_STOP = r"([a-zA-Z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,;:!?])"


class Words:
    """A tokenizer that drops white space and closes each unit with `</w>`, in a task."""

    def __init__(self, data: bytes, end_id: int) -> None:
        import json

        self.tokenizer, self.end_id = tokens.loaded(data), end_id
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        kind = json.loads(data)
        self.specials = [x["content"] for x in kind["added_tokens"]]
        # words stand alone if white space only separates, and small and capital letters are one
        names = [x.get("type") for x in (kind["normalizer"] or {}).get("normalizers", [])]
        split = ((kind["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.alone = names == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and "[^\\s\\p{L}\\p{N}]+" in str(split.get("pattern", {}).get("Regex"))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets), each text's ids followed by the end id.

        Texts are cut at single spaces, at line ends and before a stop that follows a Latin letter, none of which changes
        the units, and each distinct word is encoded once. Texts that hold what may be a special token stay whole.
        """
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool) if self.alone else np.ones(len(texts), bool)
        for s in self.specials:
            whole |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        apart = pc.replace_substring_regex(texts.filter(pa.array(~whole)), LETTER_STOP, r"\1 \2")
        parts = pc.split_pattern(pc.replace_substring(pc.ascii_lower(apart), "\n", " "), " ")
        known = parts.flatten().dictionary_encode()
        sizes = np.ones(len(texts), np.int64)
        sizes[~whole] = np.diff(parts.offsets.to_numpy())
        flat, starts, counts = tokens.word_ids(self.tokenizer, [*known.dictionary.to_pylist(), *texts.filter(pa.array(whole)).to_pylist()], "[a-zß-öø-ÿ]+", " ", self.closes, at_start=False)
        end = len(starts)
        flat, starts, counts = np.append(flat, self.end_id), np.append(starts, len(flat)), np.append(counts, 1)
        # words of every text, then the end
        numbers = np.full(int(sizes.sum()) + len(sizes), end, np.int64)
        at = np.arange(len(numbers) - len(sizes)) + np.repeat(np.arange(len(sizes)), sizes)
        own = np.repeat(whole, sizes)
        numbers[at[~own]] = known.indices.to_numpy(zero_copy_only=False)
        numbers[at[own]] = len(known.dictionary) + np.arange(int(whole.sum()))
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        return tokens.gathered(flat, starts[numbers], counts[numbers]).astype("<u4"), np.concatenate([[0], np.cumsum(counts[numbers])])[offsets]


class Packer:
    """Windows of one task. A piece is (ids, document, start); level[h] counts the open windows that hold h tokens."""

    def __init__(self, length: int) -> None:
        self.length, self.level = length, np.zeros(length + 1)
        self.level[length] = -0.5  # a full window leaves the sum: then the change is 0.5 - level[h], else level[h + n] - level[h] + 1
        self.open: list[list] = [[] for _ in range(length)]
        self.held = 0

    def place(self, piece: tuple) -> Iterator[list]:
        """Puts a piece shorter than a window where the sum of squared counts grows least, of equals into the fullest; gives windows that became full."""
        n, level = len(piece[0]), self.level
        change = level[n + 1 :] - level[1 : self.length - n + 1] + 1  # of levels 1, 2, ...
        change = np.where(level[1 : self.length - n + 1] > 0, change, np.inf)[::-1]
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] <= level[n] + 0.5:
            h = self.length - n - best
            window = self.open[h].pop()
            level[h] -= 1
        else:
            h, window = 0, []
            self.held += 1
        window.append(piece)
        if h + n == self.length:
            self.held -= 1
            yield window
            return
        self.open[h + n].append(window)
        level[h + n] += 1
        if self.held > MOST_OPEN:
            rest: list = []
            yield from fill_up(self.taken(), self.length, rest)
            for window in rest:
                h = sum(len(p[0]) for p in window)
                self.open[h].append(window)
                level[h] += 1
                self.held += 1

    def taken(self) -> list[list]:
        """All open windows, the fullest first; none stays open."""
        out = [w for h in range(self.length - 1, 0, -1) for w in self.open[h]]
        self.open, self.held = [[] for _ in range(self.length)], 0
        self.level[: self.length] = 0
        return out

    def last(self) -> Iterator[list]:
        """The end: windows that hold a power of two of tokens need no padding, the others are filled up from each other, and what is left in the end is cut into powers of two."""
        open_, rest = [], []
        for window in self.taken():
            n = sum(len(p[0]) for p in window)
            if n & (n - 1):
                open_.append(window)
            else:
                yield window
        yield from fill_up(open_, self.length, rest)
        for window in rest:
            while window:
                n = sum(len(p[0]) for p in window)
                out, window = cut(window, n - (1 << (n.bit_length() - 1)))[::-1]
                yield out


def cut(window: list, keep: int) -> tuple[list, list]:
    """A window's first tokens, and the others; a piece that lies across is cut."""
    first, rest = [], []
    for ids, doc, start in window:
        n = min(len(ids), max(0, keep))
        keep -= len(ids)
        if n:
            first.append((ids[:n], doc, start))
        if n < len(ids):
            rest.append((ids[n:], doc, start + n))
    return first, rest


def fill_up(windows: list[list], length: int, rest: list) -> Iterator[list]:
    """Fills the fullest windows from the emptiest; gives full ones and leaves one at most, in rest."""
    windows = [(w, sum(len(p[0]) for p in w)) for w in windows]
    i, j = 0, len(windows) - 1
    while i < j:
        window, n = windows[i]
        last, m = windows[j]
        move = min(length - n, m)
        kept, moved = cut(last, m - move)
        windows[i], windows[j] = ([*window, *moved], n + move), (kept, m - move)
        if n + move == length:
            yield windows[i][0]
            i += 1
        if m == move:
            j -= 1
    if i == j and windows[i][0]:
        rest.append(windows[i][0])


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids, doc_tokens, sequence_id, offset: a row for each piece of a document in a sequence of at most `length` tokens.

    A document is its text's ids (special tokens not added; a null text is empty) and the end id, so every row has one
    token at least; null and repeated ids stay, a document for each row. ids are little-endian unsigned 32-bit numbers.
    Documents of a window or more fill windows of their own first; what is left of each goes, as it comes, to the open
    window for which the sum of squared counts of partly filled windows grows least. At the end of a task windows are
    filled up from each other by cutting, and what is then left in one is cut into powers of two, which need no padding.

    A task packs its own rows, so nothing is shuffled and a lost task is packed again alike; what it holds is bounded by
    MOST_OPEN windows. An empty table gives no rows; other columns aren't read.
    """
    data = docs.sparkSession.sparkContext.broadcast(tokens.file_bytes(tokenizer_path))  # as large as the vocabulary
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, packer, id_type = Words(data.value, end_id), Packer(length), None
        number = TaskContext.get().partitionId() << 33
        out: list[tuple] = []

        def told(window: list) -> None:
            nonlocal number
            at = 0
            for ids, (doc, n), start in window:
                out.append((doc, start, len(ids), ids.tobytes(), n, number, at))
                at += len(ids)
            number += 1

        def batch() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], NAMES)
            out.clear()
            return made

        for ids, texts in batches:
            id_type = ids.type
            for at, n in tokens.slices(texts, SLICE):
                flat, offsets = words.ids(texts.slice(at, n))
                for k, doc in enumerate(ids.slice(at, n).to_pylist()):
                    lo, size = int(offsets[k]), int(offsets[k + 1] - offsets[k])
                    start = size - size % length
                    for s in range(0, start, length):
                        told([(flat[lo + s : lo + s + length], (doc, size), s)])
                    if start < size:
                        for window in packer.place((flat[lo + start : lo + size].copy(), (doc, size), start)):
                            told(window)
                    if len(out) >= 2000:
                        yield batch()
        for window in packer.last():
            told(window)
        if out:
            yield batch()

    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    only = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return only.mapInArrow(tokens.in_batches(work, ["id", "text"]), schema).withColumnRenamed("id", id_col)


NAMES = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
