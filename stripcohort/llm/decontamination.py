"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are covered with their longest common runs of words, longest
first and without overlap, whatever their order in the document; the share of the item's words
under tiles is its coverage. Runs are found from windows of ``shortest`` words with equal
Karp-Rabin fingerprints. The benchmark is a table of blocks of a bounded size in the shared folder;
tasks read them, so neither the driver nor a plan holds any of it, no document is shuffled, and one
document is one small piece of work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripcohort.llm.common import fresh
from stripcohort.llm.wordhash import PUNCTUATION, U, line_firsts, rolling, slices, texts, word_hashes

#: Text of the benchmark that a task holds at a time.
BLOCK_BYTES = 32 << 20
#: Documents' text that is held against one block before the next is read, where there are several.
CHUNK_BYTES = 128 << 20
#: Pairs of equal windows of a document and an item that are laid out at once; beyond, tiles are looked for length by length.
PAIRS = 1 << 20


def tiles(doc_at: np.ndarray, item_at: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(place in the item, place in the document, words) of the tiles, from the places of equal windows.

    The longest free run is always next; of equals the first in the item, then in the document.
    """
    order = np.lexsort((item_at, doc_at - item_at))
    i, j = item_at[order], doc_at[order]
    breaks = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    starts = np.concatenate([[0], breaks])
    ends = np.concatenate([breaks, [len(i)]])
    runs = [(-(int(e - s) + shortest - 1), int(i[s]), int(j[s])) for s, e in zip(starts, ends, strict=True)]
    heapq.heapify(runs)
    item_used: set[int] = set()
    doc_used: set[int] = set()
    out = []
    while runs:
        n, a, b = heapq.heappop(runs)
        free = [a + k not in item_used and b + k not in doc_used for k in range(-n)]
        if all(free):
            out.append((a, b, -n))
            item_used.update(range(a, a - n))
            doc_used.update(range(b, b - n))
            continue
        k = 0
        while k < -n:  # what is left of a run waits for its turn by length
            m = k
            while m < -n and free[m]:
                m += 1
            if m - k >= shortest:
                heapq.heappush(runs, (-(m - k), a + k, b + k))
            k = m + 1
    return sorted(out)


def tiles_by_length(doc: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """The same tiles from the words themselves, in memory of the order of both texts, however often their windows repeat.

    The longest common run of free words is found by halving over its length, and all tiles of that length are marked.
    """
    doc_used, item_used = np.zeros(len(doc) + 1, np.int64), np.zeros(len(item) + 1, np.int64)
    out, longest = [], min(len(doc), len(item))

    def windows(words: np.ndarray, used: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and places of the free windows of n words."""
        taken = np.concatenate([[0], np.cumsum(used[:-1])])
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return rolling(words, n)[at], at

    def common(n: int) -> bool:
        return bool(np.isin(windows(item, item_used, n)[0], windows(doc, doc_used, n)[0]).any())

    while longest >= shortest and common(shortest):
        lo, hi = shortest, longest  # common(lo) holds
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if common(mid) else (lo, mid - 1)
        longest = lo
        prints, places = windows(doc, doc_used, longest)
        order = np.argsort(prints, kind="stable")
        prints, places = prints[order], places[order]
        mine, at = windows(item, item_used, longest)
        left, right = np.searchsorted(prints, mine, "left"), np.searchsorted(prints, mine, "right")
        next_of: dict[int, int] = {}
        for a, first, last in zip(at, left, right, strict=True):
            if first == last or item_used[a : a + longest].any():
                continue
            k = next_of.get(first, first)  # places that were used once stay used
            while k < last and doc_used[places[k] : places[k] + longest].any():
                k += 1
            next_of[first] = k
            if k < last:
                b = int(places[k])
                out.append((int(a), b, longest))
                item_used[a : a + longest] = 1
                doc_used[b : b + longest] = 1
        longest -= 1
    return sorted(out)


class Benchmark:
    """A block of items, for lookups by fingerprint; items shorter than the shortest tile are windows of their own length, on whole lines."""

    def __init__(self, items: list[tuple[int | None, str]], shortest: int) -> None:
        self.ids, self.words, self.tables, self.shortest = [i for i, _ in items], [], [], shortest
        if not items:
            return
        data, bounds = texts(pa.array([t for _, t in items], pa.large_string()))
        words, at = word_hashes(data, bounds, PUNCTUATION)
        self.words = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        size = np.diff(at)
        for n in range(1, shortest + 1):
            of = np.flatnonzero((size == n) if n < shortest else (size >= n))
            if not len(of):
                continue
            parts = [rolling(self.words[i], n) for i in of]
            prints = np.concatenate(parts)
            order = np.argsort(prints, kind="stable")
            item = np.repeat(of, [len(p) for p in parts])[order]
            place = np.concatenate([np.arange(len(p)) for p in parts])[order]
            maybe = np.zeros(1 << 22, bool)
            maybe[(prints & U((1 << 22) - 1)).astype(np.int64)] = True
            self.tables.append((n, prints[order], item, place, maybe))

    @property
    def by_line(self) -> bool:
        """Whether covers() needs to know where lines begin."""
        return any(n < self.shortest for n, *_ in self.tables)

    def covers(self, words: np.ndarray, least: float, firsts: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int]]:
        """item's number, its words, words covered and tiles, of every item that this text covers by at least ``least``.

        firsts tells of each word whether a line begins with it; without it the text is one line.
        """
        for n, prints, item, place, maybe in self.tables:
            mine = rolling(words, n)
            hit = np.flatnonzero(maybe[(mine & U((1 << 22) - 1)).astype(np.int64)])
            if n < self.shortest and len(hit):
                edge = np.zeros(len(words) + 1, bool) if firsts is None else np.append(firsts, True)
                edge[[0, -1]] = True
                hit = hit[edge[hit] & edge[hit + n]]
            kinds, which, times = np.unique(mine[hit], return_inverse=True, return_counts=True)
            lo, hi = np.searchsorted(prints, kinds, "left"), np.searchsorted(prints, kinds, "right")
            if not (hi > lo).any():
                continue
            # each kind of window once against the block: at most the block's own windows
            k = np.repeat(np.arange(len(kinds)), hi - lo)
            spot = np.arange(len(k)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            order = np.lexsort((place[spot], item[spot]))
            k, spot = k[order], spot[order]
            found, start = np.unique(item[spot], return_index=True)
            places = np.split(hit[np.argsort(which, kind="stable")], np.cumsum(times)[:-1])
            for i, a, b in zip(found, start, [*start[1:], len(k)], strict=True):
                at, own = place[spot[a:b]], self.words[i]
                # words under windows are the most that tiles can cover
                most = int(np.minimum(np.diff(np.append(at, at[-1] + n)), n).sum())
                if most < least * len(own):
                    continue
                if times[k[a:b]].sum() <= PAIRS:
                    doc_at = np.concatenate([places[x] for x in k[a:b]])
                    made = tiles(doc_at, np.repeat(at, times[k[a:b]]), n)
                else:
                    made = tiles_by_length(words, own, n)
                covered = sum(t[2] for t in made)
                if covered >= least * len(own):
                    yield int(i), len(own), covered, len(made)


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[str, int]:
    """Writes the items (item_id, text) as files of about block_bytes of text each; the folder, and how many blocks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("length(text) > 0").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    folder = fresh(benchmark.sparkSession)
    if n:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        dealt.repartition(n, "block").write.partitionBy("block").parquet(folder)
    return (folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"), n


def _read(folder: str, block: int, shortest: int) -> Benchmark:
    system, path = fs.FileSystem.from_uri(f"{folder}/block={block}")
    items = []
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                items += [(r["item_id"], r["text"]) for r in pq.read_table(f, columns=["item_id", "text"]).to_pylist()]
    return Benchmark(sorted(items, key=lambda x: (x[0] is None, x[0], x[1])), shortest)


def _against(batches: Iterator[pa.RecordBatch], folder: str, n: int, shortest: int) -> Iterator[tuple[pa.RecordBatch, Iterator[Benchmark]]]:
    """Each batch with the blocks one after the other. A single block is read once per task, several once per CHUNK_BYTES of documents."""
    if n == 1:
        block = None
        for batch in batches:
            block = block or _read(folder, 0, shortest)
            yield [batch], iter([block])
        return
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield held, (_read(folder, b, shortest) for b in range(n))
            held, size = [], 0
    if held:
        yield held, (_read(folder, b, shortest) for b in range(n))


def overlaps(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, shortest: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_words, covered, n_tiles, coverage of every document and item with a coverage of at least ``least``.

    Words are runs of letters and digits, A-Z lowered. The shortest tile of an item is ``shortest`` words. An item of fewer
    words, which may be common ones, is covered only where it stands as the whole of a line, or of several lines or the text.
    Texts without words match nothing, nor does an empty benchmark. Items with a null id count like others;
    items that are repeated count once. Rows of documents that are repeated, and those of null ids, each give their rows.
    """
    kind = "doc_id long, item_id long, item_words long, covered long, n_tiles long, coverage double"
    folder, n = _blocks(benchmark, block_bytes)
    if not n:
        return docs.sparkSession.createDataFrame([], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in kind.split(", ")]
        types = [pa.int64()] * 5 + [pa.float64()]
        for held, blocks in _against(batches, folder, n, shortest):
            for block in blocks:
                for batch in held:
                    rows, ids = [], batch.column(0)
                    for r, *text in _texts(batch.column(1), block.by_line):
                        found = block.covers(text[0], least, text[1])
                        rows += [(ids[r].as_py(), block.ids[k], size, covered, made, covered / size) for k, size, covered, made in found]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate(types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def _texts(column: pa.Array, by_line: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Each row's number, the hashes of its words and, by_line, which of them begin a line."""
    data, bounds = texts(column)
    for lo, hi in slices(bounds):
        words, at = word_hashes(data, bounds[lo : hi + 1], PUNCTUATION)
        firsts = line_firsts(data, bounds[lo : hi + 1], PUNCTUATION) if by_line else None
        for r in range(hi - lo):
            yield lo + r, words[at[r] : at[r + 1]], None if firsts is None else firsts[at[r] : at[r + 1]]


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, shortest: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, whole, that cover no item of the benchmark by ``least`` or more, as overlaps() counts. Null and empty texts stay."""
    where = docs.columns.index("text")
    folder, n = _blocks(benchmark, block_bytes)
    if not n:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, blocks in _against(batches, folder, n, shortest):
            keep = [np.ones(len(batch), bool) for batch in held]
            for block in blocks:
                for batch, stays in zip(held, keep, strict=True):
                    for r, words, firsts in _texts(batch.column(where), block.by_line):
                        if stays[r] and any(True for _ in block.covers(words, least, firsts)):
                            stays[r] = False
            for batch, stays in zip(held, keep, strict=True):
                yield batch.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
