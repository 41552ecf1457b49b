"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over token positions; ignored positions may differ. The hashes of all masked windows of the
benchmark are joined with those of every document's windows; each hit lays an item beside a document along a diagonal,
and the words along it are compared.

A document leaks an item if, along a diagonal, a run of at least OVERLAP words (the whole item if it is shorter) has
at least SIMILARITY of its words equal. The masks miss none: any such run holds a window that one of LONG_MASKS finds, whichever of its
words differ, and SHORT_MASKS do so for items of fewer words than OVERLAP (tests try all patterns).

Of hits that follow each other along a diagonal only the first is made, so that words or phrases that repeat give a
hit for each diagonal at most. Diagonals are verified many at a time; of those of one document and item the longest come first, and what
cannot be longer or better than a whole equal item is left out.

Plan: the benchmark is a stated query set against all rows. It is taken in blocks of BLOCK_WORDS words; each block's
sorted hashes, of that proven size, are broadcast and joined by binary search within each task, a block at a time for a group of
texts. There is no shuffle of documents, and one pass over them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidy, with_columns_from

LONG_MASKS = ("11010011", "11001011", "11011")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
OVERLAP = 13
SIMILARITY = 0.8
#: Items of fewer words are too short to tell a leak from chance, and match nothing.
LEAST_WORDS = 5
#: Words of one broadcast block of the benchmark (about 150 bytes each on every executor).
BLOCK_WORDS = 1_000_000
#: Characters of texts that are compared together with a block, and the same where there are several, as each is loaded anew for every group.
GROUP_CHARS, SEVERAL_CHARS = 3_000_000, 16_000_000
#: Aligned words, or hits, that are handled together.
STEP = 1 << 21
_BITS = 23
_WORD = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)

SCHEMA = "doc_id long, item_id long, overlap int, identical int, doc_start int, item_start int"


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in a row, and the offset of each text's first."""
    words, counts = [], [0]
    for t in texts:
        found = _WORD.findall((t or "").lower())
        counts.append(len(found))
        words += found
    if not words:
        return np.empty(0, np.uint64), np.cumsum(counts)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1 for w in distinct), np.uint64, len(distinct))
    return h[codes], np.cumsum(counts)


def seeds(h: np.ndarray, offsets: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the masked windows that lie within one text, and where they start."""
    on, n = [i for i, c in enumerate(mask) if c == "1"], len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    x = np.full(n, len(mask), np.uint64)
    for k, i in enumerate(on):
        x ^= (h[i : i + n] ^ (x >> np.uint64(29))) * _ODD[k % len(_ODD)]
        x = (x << np.uint64(7)) | (x >> np.uint64(57))
    x ^= x >> np.uint64(31)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = text[:n] == text[len(mask) - 1 :]
    at = np.nonzero(whole)[0]
    return x[at], at


def _before(x: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The hash of the window one word earlier in the same text, where there is one, else a number that differs from window to window."""
    out = np.arange(len(x), dtype=np.uint64)
    if len(x) > 1:
        follows = np.nonzero((at[1:] == at[:-1] + 1) & (text[1:] == text[:-1]))[0]
        out[follows + 1] = x[follows]
    return out


def best_runs(same: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the segments between cuts the start and end, counted from its first word, of the longest run of which SIMILARITY at least is equal.

    A run begins and ends with an equal word; of several as long the first counts; a segment without an equal word has an empty one.
    """
    k = len(cuts) - 1
    lens = np.diff(cuts)
    good = round(100 * SIMILARITY)
    # equal words weigh 1 - s, others -s; a run's sum is not negative if its share is at least s
    weights = np.where(same, 100 - good, -good).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(weights)])
    # sums before each word and after the last one of every segment, each segment far below the one before it
    of = np.repeat(np.arange(k), lens + 1)
    at = np.arange(len(of)) - np.repeat(cuts[:-1] + np.arange(k), lens + 1)
    far = 200 * (int(lens.max(initial=0)) + 1)
    level = sums[np.repeat(cuts[:-1], lens + 1) + at] - sums[cuts[:-1]][of] - of * far
    low = np.minimum.accumulate(level)
    ends = np.nonzero(same)[0]
    seg = np.searchsorted(cuts, ends, side="right") - 1
    first = np.searchsorted(-low, -level[ends + seg + 1])  # the first place from which the sum up to the end is not negative
    word = first - seg  # as a word of same
    after = np.searchsorted(ends, word)
    word = ends[np.minimum(after, len(ends) - 1)] if len(ends) else word
    length = ends + 1 - word
    start, end = np.zeros(k, np.int64), np.zeros(k, np.int64)
    ok = length > 0
    order = np.lexsort((ends[ok], -length[ok], seg[ok]))
    which, pick = np.unique(seg[ok][order], return_index=True)
    start[which] = word[ok][order][pick] - cuts[which]
    end[which] = ends[ok][order][pick] + 1 - cuts[which]
    return start, end


class Block:
    """A block of benchmark items, ready for the join."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.h, self.offsets = word_hashes([t for _, t in items])
        lens = np.diff(self.offsets)
        self.parts = []
        for masks, least, most in ((LONG_MASKS, OVERLAP, None), (SHORT_MASKS, LEAST_WORDS, OVERLAP)):
            for mask in masks:
                x, at = seeds(self.h, self.offsets, mask)
                item = np.searchsorted(self.offsets, at, side="right") - 1
                before = _before(x, at, item)
                ok = (lens[item] >= least) & (lens[item] < (most or np.inf))
                x, at, item, before = x[ok], at[ok], item[ok], before[ok]
                distinct, group = np.unique(x, return_inverse=True)
                earlier, rank = np.unique(before, return_inverse=True)
                key = group * (len(earlier) + 1) + rank
                order = np.argsort(key, kind="stable")
                bits = np.zeros(1 << _BITS, bool)
                bits[x >> np.uint64(64 - _BITS)] = True
                self.parts.append((mask, distinct, earlier, key[order], at[order], item[order], np.packbits(bits)))

    def _diagonals(self, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, text, where the item's first word would lie) of all diagonals with a hit, each once, in that order."""
        texts, reach = len(offsets) - 1, len(h) + len(self.h) + 1
        codes = [np.empty(0, np.int64)]
        for mask, distinct, earlier, keys, at, item, packed in self.parts:
            x, p = seeds(h, offsets, mask)
            if not len(keys) or not len(x):
                continue
            text = np.searchsorted(offsets, p, side="right") - 1
            before = _before(x, p, text)
            top = (x >> np.uint64(64 - _BITS)).astype(np.int64)
            likely = np.nonzero((packed[top >> 3] >> (7 - (top & 7)).astype(np.uint8)) & 1)[0]
            x, p, text, before = x[likely], p[likely], text[likely], before[likely]
            g = np.minimum(np.searchsorted(distinct, x), len(distinct) - 1)
            ok = distinct[g] == x
            g, p, text, before = g[ok], p[ok], text[ok], before[ok]
            r = np.minimum(np.searchsorted(earlier, before), len(earlier) - 1)
            # small numbers stand for windows without one before them, so they never count as equal
            known = (earlier[r] == before) & (before >= len(h) + len(self.h))
            wide = len(earlier) + 1
            a, b = np.searchsorted(keys, g * wide), np.searchsorted(keys, (g + 1) * wide)
            c = np.where(known, np.searchsorted(keys, g * wide + r, "left"), b)
            d = np.where(known, np.searchsorted(keys, g * wide + r, "right"), b)
            lo, hi, p, text = np.concatenate([a, d]), np.concatenate([c, b]), np.tile(p, 2), np.tile(text, 2)
            ends = np.cumsum(hi - lo)
            z = 0
            while z < len(ends):
                y, z = z, max(z + 1, int(np.searchsorted(ends, (ends[z - 1] if z else 0) + STEP, "right")))
                n = hi[y:z] - lo[y:z]
                k = np.repeat(lo[y:z] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                start = np.repeat(p[y:z], n) - at[k] + self.offsets[item[k]]
                codes.append(np.unique((item[k] * texts + np.repeat(text[y:z], n)) * reach + start + len(self.h)))
        pair, start = np.divmod(np.unique(np.concatenate(codes)), reach)
        return pair // texts, pair % texts, start - len(self.h)

    def _verified(self, h: np.ndarray, offsets: np.ndarray, item: np.ndarray, text: np.ndarray, start: np.ndarray, out: dict[tuple[int, int], tuple]) -> None:
        """Puts in out the best run of each text and item along these diagonals that is a leak and better than what is there."""
        a, z = self.offsets[item], self.offsets[item + 1]
        lo, hi = np.maximum(start, offsets[text]), np.minimum(start + z - a, offsets[text + 1])
        cuts = np.concatenate([[0], np.cumsum(hi - lo)])
        within = np.arange(cuts[-1]) - np.repeat(cuts[:-1], hi - lo)
        same = h[np.repeat(lo, hi - lo) + within] == self.h[np.repeat(a + lo - start, hi - lo) + within]
        whole = np.diff(np.concatenate([[0], np.cumsum(same)])[cuts])
        # left out: too few equal words for a leak; shorter, or no more equal ones than the best so far if that covers the item, as it begins earlier
        best = np.array([out.get(x, (0, 0, 0, 0))[2:4] for x in zip(text.tolist(), item.tolist(), strict=True)], np.int64).reshape(-1, 2)
        ok = (whole >= SIMILARITY * np.minimum(OVERLAP, z - a)) & ((hi - lo >= best[:, 0]) & ((best[:, 0] < z - a) | (whole > best[:, 1])))
        same = same[np.repeat(ok, hi - lo)]
        item, text, start, a, z, lo, hi, whole = (x[ok] for x in (item, text, start, a, z, lo, hi, whole))
        cuts = np.concatenate([[0], np.cumsum(hi - lo)])
        s, e = best_runs(same, cuts)
        equal = np.concatenate([[0], np.cumsum(same)])
        equal = equal[cuts[:-1] + e] - equal[cuts[:-1] + s]
        ok = (e > s) & ((e - s >= np.minimum(OVERLAP, z - a)) | (whole >= SIMILARITY * (z - a)))
        for j in np.nonzero(ok)[0].tolist():
            row = (int(text[j]), int(item[j]), int(e[j] - s[j]), int(equal[j]), int(lo[j] + s[j] - offsets[text[j]]), int(lo[j] - start[j] + s[j]))
            old = out.get(row[:2])
            if old is None or (row[2], row[3], -row[4], -row[5]) > (old[2], old[3], -old[4], -old[5]):
                out[row[:2]] = row

    def find(self, h: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item_id, overlap, identical, doc_start, item_start) of the longest verified run of every leaked item of every text (word_hashes)."""
        out: dict[tuple[int, int], tuple] = {}
        if not len(h) or not len(self.h):
            return []
        item, text, start = self._diagonals(h, offsets)
        words = np.minimum(start + np.diff(self.offsets)[item], offsets[text + 1]) - np.maximum(start, offsets[text])
        # longest first, then from the text's start: once an item is found whole, none of its later diagonals is better
        order = np.lexsort((start, -words, text, item))
        item, text, start, words = item[order], text[order], start[order], words[order]
        left = np.arange(len(item))
        while len(left):
            # of each text and item as many diagonals as make STEP words in all, one at least of the first
            n = min(len(left), max(1, int(np.searchsorted(np.cumsum(words[left]), STEP))))
            now, left = left[:n], left[n:]
            self._verified(h, offsets, item[now], text[now], start[now], out)
            if len(left):
                j, i = int(text[left[0]]), int(item[left[0]])
                best, whole = out.get((j, i)), int(self.offsets[i + 1] - self.offsets[i])
                own = (text[left] == j) & (item[left] == i)
                if best and best[2] == best[3] == whole:
                    left = left[~own]
                elif best:
                    left = left[~own | (words[left] >= best[2])]
        return [(t, int(self.ids[i]), *rest) for (t, i), (_, _, *rest) in out.items()]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in order of item_id, in blocks of at most BLOCK_WORDS words (or one item)."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = sum(1 for _ in _WORD.finditer(r.text))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block


def _shared(benchmark: DataFrame) -> list[Broadcast]:
    """A broadcast for each block; the driver holds one block at a time."""
    out = []
    for items in _blocks(benchmark):
        out.append(benchmark.sparkSession.sparkContext.broadcast(Block(items)))
        out[-1].__dict__.pop("_value", None)
    return out


def _found(batches: Iterator[pa.RecordBatch], text: int, blocks: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Parts of the batches with the rows that blocks find in them, counted from each part's first row; text is the column's place."""
    limit = GROUP_CHARS if len(blocks) == 1 else SEVERAL_CHARS

    def done(group: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        h, offsets = word_hashes([t for b in group for t in b.column(text).to_pylist()])
        rows: list[tuple] = []
        for shared in blocks:
            rows += shared.value.find(h, offsets)
            if len(blocks) > 1:  # the next group loads it again
                shared.__dict__.pop("_value", None)
        at = 0
        for b in group:
            yield b, [(r[0] - at, *r[1:]) for r in rows if at <= r[0] < at + b.num_rows]
            at += b.num_rows

    group, size = [], 0
    for batch in batches:
        lens = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
        a = 0
        for z, n in enumerate(lens):
            if size and size + n > limit:
                if z > a:
                    group.append(batch.slice(a, z - a))
                yield from done(group)
                group, size, a = [], 0, z
            size += n
        group.append(batch.slice(a))
    if group:
        yield from done(group)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap, identical, doc_start, item_start): a row for each document row and item that it leaks.

    overlap: words of the longest verified run, identical: those of them that are equal; the starts count words from 0. Null
    and empty texts, items without an id and items of fewer than LEAST_WORDS words leak nothing. Rows with a null
    doc_id come back with it; repeated rows and repeated items each count. Other columns are not read. An empty
    benchmark or table gives an empty result.
    """
    spark = docs.sparkSession
    blocks = _shared(benchmark)
    if not blocks:
        return spark.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _found(batches, 1, blocks):
            if rows:
                cols = list(zip(*rows, strict=True))
                ids = b.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], names=names)

    names = ["doc_id", "item_id", "overlap", "identical", "doc_start", "item_start"]
    small_batches(spark)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose own text leaks an item; all columns stay, whatever their names. Rows of one doc_id are judged apart; null texts stay.

    The rows are judged where they are read: nothing is joined or shuffled.
    """
    blocks = _shared(benchmark)
    if not blocks:
        return docs
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _found(batches, text, blocks):
            stays = np.ones(b.num_rows, bool)
            stays[[r[0] for r in rows]] = False
            yield b.filter(pa.array(stays))

    return with_columns_from(docs, tidy(run), {})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
