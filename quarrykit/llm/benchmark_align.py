"""Benchmark decontamination: n-gram seeds that no alignment lacks, then Smith-Waterman alignment."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import release, sliced

MATCH, MISMATCH, GAP = 2, -1, -2
_PLAIN = bytes.maketrans(
    (string.ascii_uppercase + string.punctuation).encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation)
)


def plain_bytes(text: str | None) -> bytes:
    """UTF-8 of the text, lower-cased where that keeps its length, with ASCII punctuation blanked."""
    text = text or ""
    low = text.lower()
    return (low if len(low) == len(text) else text).encode("utf-8", "surrogatepass").translate(_PLAIN)


def align(item: list[bytes], window: list[bytes]) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of two word sequences; ``window[start:end]`` takes part."""
    score, end = _local(item, window)
    if not score:
        return 0, 0, 0
    _, length = _local(item[::-1], window[:end][::-1], score)
    return score, end - length, end


def _local(item: list[bytes], window: list[bytes], stop: int | None = None) -> tuple[int, int]:
    """Best score and where it ends in ``window``: the least such end."""
    ids: dict[bytes, int] = {}
    a = [ids.setdefault(w, len(ids)) for w in item]
    b = np.array([ids.get(w, -1) for w in window], np.int32)
    ramp = GAP * np.arange(len(b) + 1, dtype=np.int32)
    before = np.zeros(len(b) + 1, np.int32)
    best, end = 0, 0
    for x in a:
        row = np.zeros(len(b) + 1, np.int32)
        np.maximum(before[:-1] + np.where(b == x, np.int32(MATCH), np.int32(MISMATCH)), before[1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row - ramp) + ramp
        k = int(row.argmax())
        if row[k] > best or (row[k] == best and best and k < end):
            best, end = int(row[k]), k
        before = row
    return best, end


def seeds_needed(m: int, gram: int, min_score: float) -> tuple[int, int]:
    """(n, hits): every alignment of ``m`` words that reaches ``min_score`` holds at least ``hits`` of the item's n-word places.

    k matches parted by x mismatches and y inserted words (a dropped item word costs as
    much as an inserted one and uses up a word) score 2k - x - 2y, with k + x <= m, in
    x + y + 1 runs at most, so at least k - (n - 1)(x + y + 1) places lie within runs. n is
    the greatest up to ``gram`` that leaves a place in every such alignment.
    """
    need = min_score * MATCH * m
    for n in range(min(gram, m), 1, -1):
        hits = m
        for x in range(m):
            k = m - x  # a match more pays for an inserted word more, so no smaller k leaves fewer places
            y = int((MATCH * k + MISMATCH * x - need + 1e-9) // -GAP)
            if y < 0:
                break
            hits = min(hits, k - (n - 1) * (x + y + 1))
        if hits > 0:
            return n, hits
    return 1, max(1, int(np.ceil(need / MATCH - 1e-9)))


class Matcher:
    """Finds items of one block in a text: ``items`` are (id, words); every place of an item is a seed."""

    def __init__(self, items: list[tuple[object, list[bytes]]], gram: int, min_score: float):
        self.items, self.min_score = items, min_score
        sizes = {m: seeds_needed(m, gram, min_score) for m in {len(w) for _, w in items}}
        self.least = np.array([sizes[len(w)][1] for _, w in items], np.int64)
        seeds: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for k, (_, words) in enumerate(items):
            n = sizes[len(words)][0]
            own = seeds.setdefault(n, {})
            for q, g in enumerate(_grams(words, n)):
                own.setdefault(g, []).append((k, q))
        self.seeds = {n: {g: np.array(x, np.int64) for g, x in own.items()} for n, own in seeds.items()}

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, score, seeds, start, end) per aligned passage, start and end in code points."""
        raw = plain_bytes(text)
        words = raw.split()
        out, places = [], None
        for item, n, p, q in self._hits(words):
            own_id, own = self.items[item]
            m, least = len(own), self.least[item]
            slack = max(0, int((1 - self.min_score) * m + 1e-9))
            low = p - q - slack
            ends = p - q + m + slack
            dense = np.searchsorted(p, ends) - np.searchsorted(p, low) >= least
            spans: list[list[int]] = []
            for a, b in sorted(zip(np.maximum(low[dense], 0).tolist(), np.minimum(ends[dense], len(words)).tolist())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            while spans:
                a, b = spans.pop()
                if np.searchsorted(p, b - n + 1) - np.searchsorted(p, a) < least:
                    continue
                score, s, e = align(own, words[a:b])
                if score < self.min_score * MATCH * m:
                    continue
                if places is None:
                    places = [x.span() for x in re.finditer(rb"\S+", raw, re.ASCII)]
                start, end = (len(raw[:x].decode("utf-8", "surrogatepass")) for x in (places[a + s][0], places[a + e - 1][1]))
                hits = int(np.searchsorted(p, a + e - n + 1) - np.searchsorted(p, a + s))
                out.append((own_id, score / (MATCH * m), hits, start, end))
                spans += [[a, a + s], [a + e, b]]
        return out

    def _hits(self, words: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(item, n, places in the text, places in the item) of each item that may align, by place in the text."""
        for n, seeds in self.seeds.items():
            found = seeds.keys() & set(_grams(words, n))
            if not found:
                continue
            every = np.concatenate([seeds[g] for g in found])
            counts = np.bincount(every[:, 0], minlength=len(self.items))
            likely = (counts >= self.least) & (counts > 0)
            if not likely.any():
                continue
            at, own = [], []
            for p, g in enumerate(_grams(words, n)):
                if g in found:
                    x = seeds[g]
                    x = x[likely[x[:, 0]]]
                    at.append(np.full(len(x), p, np.int64))
                    own.append(x)
            p, own = np.concatenate(at), np.concatenate(own)
            order = np.argsort(own[:, 0], kind="stable")
            p, own = p[order], own[order]
            cuts = np.flatnonzero(np.diff(own[:, 0])) + 1
            for x, y in zip(np.split(p, cuts), np.split(own, cuts)):
                yield int(y[0, 0]), n, x, y[:, 1]


def _grams(words: list[bytes], n: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*[words[k:] for k in range(n)]))


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with words, in blocks of about ``block_bytes`` of text; a partition at a time reaches the driver."""
    block, held = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("string").alias("t")).filter("i IS NOT NULL").toLocalIterator():
        raw = plain_bytes(r.t)
        if block and held + len(raw) > block_bytes:
            yield block
            block, held = [], 0
        if words := raw.split():
            block.append((r.i, words))
            held += len(raw)
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gram: int = 3, min_score: float = 0.4, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per passage of ``docs`` that aligns with a benchmark item.

    Words are cut at white space after lower-casing and blanking ASCII punctuation.
    Every place of an item is a seed, of the most words, ``gram`` at most, of which any
    alignment at ``min_score`` must hold one whole (see :func:`seeds_needed`: 2 words at
    0.4 from 6 words on). Where a row holds as many seeds as such an alignment needs, it
    is aligned with the item around them by Smith-Waterman over words; passages with
    ``min_score`` of the item's full score are kept. Columns: id, item_id, score (0 to 1),
    n_seeds, start, end (code points).

    The benchmark is sent in blocks of about ``block_bytes`` of text, each compared with
    all rows in one scan; documents are never shuffled.
    Null or empty texts and items match nothing, items without an id are left out, a null
    row id stays null; repeated rows and items give rows of their own; of equal alignments
    the one that ends first stands; texts of any length are read whole; extra columns may
    have any names; an empty table on either side gives an empty result.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kinds[0]}, item_id {kinds[1]}, score double, n_seeds int, start bigint, end bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Matcher(items, gram, min_score))
        item_type = to_arrow_type(benchmark.schema[item_col].dataType)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, "t"):
                found = [(k, *m) for k, t in enumerate(b.column("t").to_pylist()) for m in sent.value.matches(t)]
                cols = list(zip(*found)) if found else [()] * 6
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(cols[0], pa.int32())), *[pa.array(c, k) for c, k in zip(cols[1:], (item_type, pa.float64(), pa.int32(), pa.int64(), pa.int64()))]], ["id", "item_id", "score", "n_seeds", "start", "end"])

        out = out.unionByName(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema))
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gram: int = 3, min_score: float = 0.4, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` without the rows in which :func:`find_contamination` finds a passage; nothing is shuffled.

    Rows with a null or empty text stay, null ids too; repeated rows go or stay together;
    columns may have any names; an empty table stays empty, and an empty benchmark takes
    nothing away.
    """
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Matcher(items, gram, min_score))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, text_col):
                yield b.filter(pa.array([not sent.value.matches(t.as_py()) for t in b.column(at)], pa.bool_()))
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
