"""Packing documents into fixed token windows: exact-complement hashing, then best fit."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release, sliced

#: Words that one task remembers, about 200 bytes each.
REMEMBERED = 200_000


class Encoder:
    """Byte-level BPE ids as packed little-endian 32-bit integers, equal to those of ``tokenizers``.

    Between single blanks (or line ends) the pre-tokenizer never looks across, so words
    are encoded once and remembered; unknown words of a batch are encoded together.
    Words with unusual characters, long words and texts with runs of white space go
    through the tokenizer itself. Texts that hold the string of a special
    token, which the tokenizer reads as that token, go to it whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.quick = None
        if all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(pairs)):  # ids are merge ranks
            back = _byte_alphabet()
            ranks = {bytes(map(back.__getitem__, t)): i for t, i in vocab.items() if i < 256 + len(pairs)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(len(vocab) + 1, np.int64)
            for t, i in ranks.items():
                self.width[i] = len(t)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of unknown words; a word that starts with a line end has no blank before it."""
        out, plain, sizes = {}, [], []
        for w in words:
            s = w if w[0] == "\n" else " " + w
            n = len(s)
            if not s.isascii():
                if max(s) > "\u024f":
                    out[w] = self.whole(s)
                    continue
                n = len(s.encode())
            if n > 200 or self.quick is None:
                out[w] = self.whole(s)
            else:
                plain.append(s)
                sizes.append(n)
        if plain:
            ids = np.asarray(self.quick.encode_ordinary("".join(plain)), "<u4")
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes))
            packed, a = ids.tobytes(), 0
            for s, b in zip(plain, (4 * ends + 4).tolist()):
                out[s if s[0] == "\n" else s[1:]] = packed[a:b]
                a = b
        return out

    def batch(self, texts: list[str | None]) -> list[bytes]:
        known, held, fresh = self.known, [], {}
        for t in texts:
            if not t:
                held.append(b"")
                continue
            if any(x in t for x in self.special):
                held.append(self.whole(t))
                continue
            words = t.replace("\n", " \n").split(" ")
            first = words.pop(0)
            if not first or "" in words or "\n" in words or first.strip() != first:
                held.append(self.whole(t))
                continue
            got = list(map(known.get, words))
            if None in got:
                missing = [w for w, g in zip(words, got) if g is None]
                if any((w[1:] if w[0] == "\n" else w).strip() != (w[1:] if w[0] == "\n" else w) for w in missing):
                    held.append(self.whole(t))
                    continue
                fresh.update(dict.fromkeys(missing))
            held.append((first, words, got))
        if fresh:
            fresh = self._words(list(fresh))
            if len(known) < REMEMBERED:
                known.update(fresh)
        out = []
        for h in held:
            if isinstance(h, tuple):
                first, words, got = h
                if None in got:
                    got = [g if g is not None else fresh[w] for w, g in zip(words, got)]
                h = self.whole(first) + b"".join(got)
            out.append(h)
        return out


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE vocabularies, mapped back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) for each piece of each row's ids, ``end_id`` appended."""
    kind = docs.schema[id_col].dataType.simpleString()
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).batch
        for b in sliced(batches, "t", 1 << 20):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode(b.column("t").to_pylist())):
                ids += tail
                n = len(ids) // 4
                cut = (n - 1) % window + 1
                at, k = 0, 0
                while at < n:
                    rows.append(i), piece.append(k), start.append(at), length.append(cut - at), crc.append(crc32(ids[4 * at : 4 * cut]))
                    at, cut, k = cut, cut + window, k + 1
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])
        _encoder(tokenizer).known.clear()
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan_packing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """How pieces fill windows, from the number of pieces of each length alone.

    Returns runs (length, first rank, how many, first sequence, offset): the r-th piece
    of a length, counted from the first rank, goes to the r-th sequence of the run.
    Longest first, each length looks up its exact complement among single lengths, sums
    of two and sums of three, and consumes as many combinations as the counts allow; what
    is left goes, longest first, to the open sequence with the least sufficient gap.
    Work depends on the number of distinct lengths, not on that of pieces.
    """
    left = np.zeros(window + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    filled: list[tuple[tuple[int, ...], int]] = []

    def consume(parts: tuple[int, ...]) -> None:
        need = {p: parts.count(p) for p in parts}
        n = min(int(left[p]) // k for p, k in need.items())
        for p, k in need.items():
            left[p] -= n * k
        filled.append((parts, n))

    def enough(*parts: int) -> bool:
        return all(left[p] >= parts.count(p) for p in parts)

    def complement(n: int) -> tuple[int, ...] | None:
        gap = window - n
        if gap == 0:
            return ()
        if enough(n, gap):
            return (gap,)
        free = left > 0
        a = np.arange((gap + 1) // 2, gap)
        for x in a[free[a] & free[gap - a]][::-1].tolist():
            if enough(n, x, gap - x):
                return (x, gap - x)
        for x in np.flatnonzero(free[:gap])[::-1].tolist():
            rest = gap - x
            if 3 * x < gap:
                break
            b = np.arange((rest + 1) // 2, min(x + 1, rest))
            for y in b[free[b] & free[rest - b]][::-1].tolist():
                if enough(n, x, y, rest - y):
                    return (x, y, rest - y)
        return None

    for n in range(window, 0, -1):
        while left[n] > 0 and (rest := complement(n)) is not None:
            consume((n, *rest))
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(window, 0, -1):
        while left[n] > 0:
            c = int(left[n])
            best = min((g for g, open_ in gaps.items() if g >= n and open_), default=None)
            if best is None:
                each = window // n
                whole, rest = divmod(c, each)
                for parts, k in (((n,) * each, whole), ((n,) * rest, 1)):
                    if parts and k:
                        gaps.setdefault(window - n * len(parts), []).append((parts, k))
                left[n] = 0
                continue
            parts, k = gaps[best].pop()
            used = min(c, k)
            if used < k:
                gaps[best].append((parts, k - used))
            gaps.setdefault(best - n, []).append(((*parts, n), used))
            left[n] -= used
    filled += [x for open_ in gaps.values() for x in open_]
    runs, rank, first = [], dict.fromkeys(counts, 0), 0
    for parts, n in filled:
        at = 0
        for p in parts:
            runs.append((p, rank[p], n, first, at))
            rank[p] += n
            at += p
        first += n
    return runs


def pack(pieces: DataFrame, window: int = 1024, order: tuple[str, ...] = ("id", "piece"), slice_rows: int = 50_000) -> DataFrame:
    """``pieces`` (with ``length``) plus sequence_id and offset.

    Only the counts of the at most ``window`` lengths reach the driver; the runs that
    come back are a bounded broadcast. A piece finds its run by its rank among pieces of
    its length. Ranks are made without gathering a length in one task: rows of a length
    are salted into slices of about ``slice_rows``, numbered inside each slice, and
    shifted by the sizes of the slices before it.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan_packing(counts, window))
    slices = max(1, -(-sum(counts.values()) // slice_rows))
    salted = pieces.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    w = "OVER (PARTITION BY length, slice ORDER BY {})".format(", ".join(order))
    ranked = salted.withColumn("rank", F.expr(f"row_number() {w}").cast("bigint") - 1)
    if slices > 1:
        sizes = salted.groupBy("length", "slice").agg(F.count("*").alias("n"))
        before = sizes.select("length", "slice", (F.expr("sum(n) OVER (PARTITION BY length ORDER BY slice)") - F.col("n")).alias("before"))
        ranked = ranked.join(before, ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    table = np.array(runs, np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(((table[:, 0] << 48) + table[:, 1], table[:, 1], table[:, 3], table[:, 4]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, start, first, at = sent.value
        for b in batches:
            n, r = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(keys, (n << 48) + r, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(first[k] + r - start[k]), pa.array(at[k])], [*b.schema.names[:-1], "sequence_id", "offset"])

    kept = [c for c in pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return ranked.select(*kept, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A row's ids are those of ``tokenizer`` (a byte-level BPE file of ``tokenizers``)
    without special tokens, then ``end_id``; a null or empty text is ``end_id`` alone.
    Only rows longer than ``window`` are cut: full pieces from the end, so that the first
    piece may be shorter. Every piece is placed once, at gapless offsets from 0. Repeated
    rows are packed each; an empty table gives an empty result. Other columns of ``docs``
    are left aside whatever their names.
    """
    pieces = checkpointed(token_pieces(docs, tokenizer, window, end_id, id_col, text_col))
    return pack(pieces, window).withColumnRenamed("id", id_col)
