"""Alignment of two tokenizers over the same bytes, and how often their tokens meet.

Every byte has an owner among A's tokens and one among B's (np.repeat of token indices over token bytes). Where the pair
of owners changes, an overlap (link) begins; where both owners change at once, both tokenizers cut, and a group ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripcohort.llm import tokens
from stripcohort.llm.common import BROADCAST_ROWS, durable, sized

#: What \\s means to either tokenizer, and more: two of these together are never cut between.
SPACES = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def byte_table() -> dict[str, int]:
    """Byte-level BPE's letters for bytes: printable ones stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers in a task, with the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes) -> None:
        import json

        import sentencepiece

        self.a, table = tokens.loaded(a, plain_specials=True), byte_table()
        at = {i: bytes(table[c] for c in s) if all(c in table for c in s) else s.encode() for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [at.get(i, b"") for i in range(max(at) + 1)]
        self.b = sp = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.starts = np.array([x[:1] == b" " for x in self.a_bytes])
        # A cuts before white space that follows something else, by its pattern; B does if no piece goes on from a letter to a space or holds a line's end
        kind = json.loads(a)
        del kind["model"]
        plain = kind["normalizer"] is None and kind["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.prefix = sp.encode("\n")[:1]
        self.cuts = plain and not any(re.search("[^▁]▁", p) or "\n" in p for p in pieces) and [pieces[i] for i in self.prefix] == ["▁"] and sp.encode("a b") == sp.encode("a") + sp.encode("b")
        self.says = [f"{i}{c}" for c, t in ((",", self.a_bytes), ("|", self.a_bytes), (",", self.b_bytes), (";", self.b_bytes)) for i in range(len(t))]

    def chunks(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct chunks, their numbers in the order of the texts, offsets of the texts): space + text, cut before single white space."""
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, f"^{SPACES}|{SPACES}$|{SPACES}{SPACES}").to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        even = texts.filter(pa.array(~odd))
        parts = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
        known = parts.flatten().dictionary_encode()
        found = [x if x[0] == "\n" else f" {x}" for x in known.dictionary.to_pylist()]
        sizes, numbers = np.zeros(len(texts), np.int64), known.indices.to_numpy(zero_copy_only=False)
        sizes[~odd] = np.diff(parts.offsets.to_numpy())
        if odd.any():
            at = {x: i for i, x in enumerate(found)}
            lists = [[at.setdefault(c, len(at)) for c in (CUT.split(f" {x}") if self.cuts else [f" {x}"])] for x in texts.filter(pa.array(odd)).to_pylist()]
            found, sizes[odd] = list(at), [len(x) for x in lists]
            own = np.repeat(odd, sizes)
            both = np.zeros(int(sizes.sum()), np.int64)
            both[~own], both[own] = numbers, [i for x in lists for i in x]
            numbers = both
        return found, numbers.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])

    def owned(self, chunks: list[str]) -> dict[str, np.ndarray]:
        """Of every chunk: ok, numbers of tokens, groups and links, its groups as text, its links' id pairs and its groups' bytes."""
        raw = [c.encode() for c in chunks]
        size = np.array([len(x) for x in raw], np.int64)
        a_ids, a_at, a_n = tokens.word_ids(self.a, chunks, f" [{tokens.LETTERS}]+", "", self.starts, at_start=True)
        b_n, b_flat = np.zeros(len(chunks), np.int64), [np.zeros(0, np.int32)]
        for i in range(0, len(chunks), 5000):  # lists of a few chunks at a time
            some = chunks[i : i + 5000]
            pieces = [p if c[0] == " " else p[1:] for c, p in zip(some, self.b.encode([c[1:] if c[0] == " " else c for c in some], num_threads=1), strict=True)]
            b_n[i : i + 5000] = [len(p) for p in pieces]
            b_flat.append(np.array([x for p in pieces for x in p], np.int32))
        b_ids = np.concatenate(b_flat)
        b_at = np.cumsum(b_n) - b_n
        a_ids = tokens.gathered(a_ids, a_at, a_n)
        a_at = np.cumsum(a_n) - a_n
        every = lambda n: np.concatenate([[0], np.cumsum(n)])
        ok = (tokens.summed(self.a_size[a_ids], every(a_n)) == size) & (tokens.summed(self.b_size[b_ids], every(b_n)) == size)
        for ids, at, n, table in ((a_ids, a_at, a_n, self.a_bytes), (b_ids, b_at, b_n, self.b_bytes)):
            of = np.flatnonzero(ok)
            if b"".join(map(table.__getitem__, tokens.gathered(ids, at[of], n[of]).tolist())) != b"".join([raw[i] for i in of]):
                ok[of] = [b"".join(map(table.__getitem__, ids[at[i] : at[i] + n[i]].tolist())) == raw[i] for i in of]
        del raw
        a_ids, b_ids = (tokens.gathered(x, at[ok], n[ok]) for x, at, n in ((a_ids, a_at, a_n), (b_ids, b_at, b_n)))
        a_n, b_n, size = a_n * ok, b_n * ok, size * ok
        own_a, own_b = np.repeat(np.arange(len(a_ids), dtype=np.int32), self.a_size[a_ids]), np.repeat(np.arange(len(b_ids), dtype=np.int32), self.b_size[b_ids])
        new_a, new_b = (np.diff(x, prepend=np.int32(-1)) != 0 for x in (own_a, own_b))
        link, cut = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
        chunk_of = np.repeat(np.arange(len(chunks), dtype=np.int32), size)
        groups, links = (np.bincount(chunk_of[x], minlength=len(chunks)) for x in (cut, link))
        # the text of the groups: A's tokens of a group stand before B's
        a_from, b_from = own_a[cut], own_b[cut]
        a_in, b_in = np.diff(np.append(a_from, len(a_ids))), np.diff(np.append(b_from, len(b_ids)))
        say = np.zeros(len(a_ids) + len(b_ids), np.int64)
        k, n = len(self.a_bytes), len(self.b_bytes)
        last_a, last_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        last_a[a_from + a_in - 1], last_b[b_from + b_in - 1] = 1, 1
        say[np.arange(len(a_ids)) + np.repeat(b_from, a_in)] = a_ids + k * last_a
        say[np.arange(len(b_ids)) + np.repeat(a_from + a_in, b_in)] = 2 * k + b_ids + n * last_b
        ends = [0, *np.cumsum(a_n + b_n).tolist()]
        texts = ["".join([self.says[x] for x in say[i:j].tolist()]) for i, j in pairwise(ends)]
        return {
            "ok": ok, "n_a": a_n, "n_b": b_n, "n_groups": groups, "n_links": links, "groups": texts,
            "pairs": a_ids[own_a[link]].astype(np.int64) << 32 | b_ids[own_b[link]], "pairs_at": np.cumsum(links) - links,
            "bytes": np.diff(np.append(cut, len(own_a))), "bytes_at": np.cumsum(groups) - groups,
        }


def _rows(pair: Pair, ids: pa.Array, texts: pa.Array, spans: bool) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    chunks, numbers, offsets = pair.chunks(texts.filter(pa.array(full)))
    of = pair.owned(chunks)
    place = np.cumsum(full) - full  # of a text among those that have words
    for at in range(0, len(texts), 250):
        to = min(len(texts), at + 250)
        mine = full[at:to]
        lo, hi = int(place[at]), int(place[at] + mine.sum())
        words = numbers[offsets[lo] : offsets[hi]]
        cuts = offsets[lo : hi + 1] - offsets[lo]
        ok = tokens.summed(~of["ok"][words], cuts) == 0
        put = lambda values: _spread(values * ok, mine)
        out = {"id": ids.slice(at, to - at)} | {c: pa.array(put(tokens.summed(of[c][words], cuts)), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
        said = [of["groups"][i] for i in words.tolist()]
        whole = ["".join(said[i:j])[:-1] if good else "" for i, j, good in zip(cuts[:-1].tolist(), cuts[1:].tolist(), ok.tolist(), strict=True)]
        text_of = iter(whole)
        out["groups"] = pa.array([next(text_of) if x else "" for x in mine.tolist()], pa.string())
        good = np.repeat(ok, np.diff(cuts))
        sizes = of["n_links"][words] * good
        doc = np.repeat(np.repeat(np.flatnonzero(mine), np.diff(cuts)), sizes)
        pairs = tokens.gathered(of["pairs"], of["pairs_at"][words], sizes)
        order = np.lexsort((pairs, doc))
        doc, pairs = doc[order], pairs[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pairs[1:] != pairs[:-1])])[: len(doc)])
        met = [pairs[first] >> 32, pairs[first] & 0xFFFFFFFF, np.diff(np.append(first, len(doc)))]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=to - at))]).astype(np.int32))
        out["links"] = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in met], ["a", "b", "n"]))
        if spans:
            sizes = of["n_groups"][words] * good
            upto = np.cumsum(tokens.gathered(of["bytes"], of["bytes_at"][words], sizes))
            n = tokens.summed(sizes, cuts)
            before = np.concatenate([[0], upto])[np.cumsum(n) - n]
            ends = pa.array(np.concatenate([[0], np.cumsum(_spread(n, mine))]).astype(np.int32))
            out["ends"] = pa.ListArray.from_arrays(ends, pa.array(upto - np.repeat(before, n)))
        yield pa.RecordBatch.from_pydict(out)


def _spread(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """values at the places of mask, 0 elsewhere."""
    out = np.zeros(len(mask), np.int64)
    out[mask] = values
    return out


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups, links, and with spans ends, for every row: space + text by a byte-level BPE (A), text by a
    sentencepiece model that adds the space (B), neither with special tokens.

    groups is `a1,a2|b1;a3|b2,b3`, decimal ids of A and B between places where both end; ends are those places as byte
    offsets in space + text; links are the distinct id pairs (a, b) of tokens that overlap, each with its n links. A text
    that is null or empty, or whose tokens don't give space + text back byte for byte, has no tokens: zeros, an empty
    text and empty arrays. Null and repeated ids stay, a row each; other columns aren't read; an empty table gives none.

    Neither tokenizer has a token that goes on from another character to a space or a line's end (checked as the
    vocabularies are loaded; else texts stay whole). So texts are cut before single spaces and line ends, each distinct
    chunk of a batch is encoded and aligned once, and no text is looked at whole but very unusual ones.
    """
    context = docs.sparkSession.sparkContext
    a, b = (context.broadcast(tokens.file_bytes(p)) for p in (a_path, b_path))  # a few MB: the size of the vocabularies

    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
        pair = None
        for ids, texts in batches:
            pair = pair or Pair(a.value, b.value)
            for at, n in tokens.slices(texts):
                yield from _rows(pair, ids.slice(at, n), texts.slice(at, n), spans)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a: int, b: int, n: int>>" + (", ends array<long>" if spans else "")
    only = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return only.mapInArrow(tokens.in_batches(work, ["id", "text"]), schema).withColumnRenamed("id", id_col)


def with_counts(aligned: DataFrame) -> DataFrame:
    """Adds n_best and count_sum to align()'s rows, without their groups and links: over a text's links, how many have a pair whose count is
    the highest of its B id, ties included, and the sum of counts. A pair's count is its number of links over all rows.

    Of pairs, those with at least one in 200,000 of all links are at most 200,000, so these are broadcast; the others
    meet their counts by a shuffle in which, for the same reason, no pair is hot.
    """
    kept = durable(aligned.withColumn("_row", F.monotonically_increasing_id()))
    each = kept.select("_row", F.inline("links"))
    counts = durable(each.groupBy("a", "b").agg(F.sum("n").alias("count")))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))  # a row per token of B
    scored = durable(counts.join(sized(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best")))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = F.col("count") * BROADCAST_ROWS > total
    near = sized(scored.filter(often).withColumn("near", F.lit(True)))
    met = each.join(near, ["a", "b"], "left")
    rare = met.filter("near is null").select("_row", "a", "b", "n").join(scored.filter(~often), ["a", "b"])
    sums = (F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("n")).alias("count_sum"))
    of = met.filter("near").select("_row", "n", "count", "best").unionByName(rare.select("_row", "n", "count", "best")).groupBy("_row").agg(*sums)
    out = kept.drop("links", "groups").join(of, "_row", "left").drop("_row")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
