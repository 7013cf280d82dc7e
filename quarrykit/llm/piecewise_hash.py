"""Context-triggered piecewise hashing and the likeness of its signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, input_partitions, sliced

WINDOW, LONGEST, SMALLEST = 7, 64, 3
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
CODES = np.zeros(128, np.uint8)
CODES[[ord(c) for c in SYMBOLS]] = np.arange(64, dtype=np.uint8)


def _rolling(b: np.ndarray) -> np.ndarray:
    """For each byte, 1 + a 32-bit hash of the last 7 bytes: their sum, weighted sum and shifted XOR."""
    n = len(b)
    p = np.zeros(n + WINDOW - 1, np.uint32)
    p[WINDOW - 1 :] = b
    x = p[:n] << np.uint32(30)
    s = p[:n].copy()
    for k in range(1, WINDOW):  # k = 6 is the byte itself
        q = p[k : k + n]
        s += np.uint32(k + 2) * q
        x ^= q << np.uint32(5 * (WINDOW - 1 - k))
    return s + x + np.uint32(1)


def fingerprint(text: str | None) -> str:
    """``block:signature:signature at twice the block`` of one text, over its UTF-8 bytes.

    A boundary lies where 1 + the rolling hash is a multiple of the block size 3 * 2^k;
    every chunk gives one of 64 symbols by its CRC-32. The block size is the least that
    allows 64 chunks on average, halved while the signature has fewer than 32 symbols.
    A null or empty text gives ``3::``.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return f"{SMALLEST}::"
    v = _rolling(np.frombuffer(raw, np.uint8))
    k = 0
    while SMALLEST << k < n / LONGEST:
        k += 1
    while True:
        at = np.flatnonzero((v & np.uint32((1 << k) - 1)) == 0)
        w = v[at]
        at = at[(w % np.uint32(3) == 0) & (w != 0)]
        if k == 0 or len(at) >= LONGEST // 2:
            break
        k -= 1
    twice = at[(v[at] & np.uint32((2 << k) - 1)) == 0]
    return f"{SMALLEST << k}:{_signature(raw, at, LONGEST)}:{_signature(raw, twice, LONGEST // 2)}"


def _signature(raw: bytes, at: np.ndarray, most: int) -> str:
    cuts = (at[: most - 1] + 1).tolist()
    if not cuts or cuts[-1] < len(raw):
        cuts.append(len(raw))
    out, a, view = [], 0, memoryview(raw)
    for b in cuts:
        out.append(SYMBOLS[crc32(view[a:b]) >> 26])
        a = b
    return "".join(out)


def _lcs(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of signatures, bit-parallel over 64 symbols."""
    n = len(a)
    table = np.zeros((n, 64), np.uint64)
    rows = np.arange(n)
    size_a, size_b = (np.array([len(x) for x in s]) for s in (a, b))
    grid_a, grid_b = (CODES[np.frombuffer("".join(x.ljust(LONGEST, "A") for x in s).encode(), np.uint8)].reshape(n, LONGEST) for s in (a, b))
    for i in range(int(size_a.max(initial=0))):
        live = rows[size_a > i]
        table[live, grid_a[live, i]] |= np.uint64(1 << i)
    v = np.full(n, ~np.uint64(0))
    for j in range(int(size_b.max(initial=0))):
        u = v & np.where(size_b > j, table[rows, grid_b[:, j]], np.uint64(0))
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def _shares_run(a: str, b: str) -> bool:
    short = min(len(a), len(b))
    n = min(WINDOW, short, max(2, short // 2))
    return n > 0 and not {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1))


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints.

    Signatures are compared at equal block sizes only, that is, where one block size is
    the other's or twice it. Edit distance d counts insertions and deletions (a change
    is both); likeness is 1 - d / (sum of lengths), the best of the comparable
    signatures, and 0 where they share no run of 7 symbols (of half the shorter signature, if
    that is less).
    Equal fingerprints have likeness 1.
    """
    out = np.zeros(len(pairs))
    who, left, right = [], [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1
            continue
        (p, a1, a2), (q, b1, b2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        for s, t in ((a1, b1), (a2, b2)) if p == q else ((a1, b2),) if p == 2 * q else ((a2, b1),) if q == 2 * p else ():
            if s and t and _shares_run(s, t):
                who.append(i), left.append(s), right.append(t)
    if who:
        score = 2 * _lcs(left, right) / np.array([len(s) + len(t) for s, t in zip(left, right)])
        np.maximum.at(out, who, score)
    return out


FIELDS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _digests(rows: list[tuple], follow: list[tuple]) -> list[list]:
    """Columns of FIELDS for rows (id, text, fingerprint), each with the row that follows it."""
    out: list[list] = [[] for _ in FIELDS]
    own, edits, nexts = [], [], []
    for (i, t, fp), (_, after, next_fp) in zip(rows, follow):
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        own.append(fp), edits.append(fingerprint(edited)), nexts.append(next_fp)
        out[0].append(i), out[1].append(len(t)), out[2].append(hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
    both = likeness([*zip(own, edits), *zip(own, nexts)])
    out[3], out[4], out[5], out[6] = own, edits, both[: len(own)].tolist(), both[len(own) :].tolist()
    return out


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row's whole text and of its edited text, with their likeness.

    The edited text has its last floor(n / 4) code points replaced by the first as many
    (or all) of the next row, in ascending id; the first row follows the last. Null texts
    are empty, null ids come first, rows with equal ids are ordered by text; a single row
    follows itself; texts of any length are hashed whole; other columns are ignored,
    whatever their names; an empty table gives an empty result.

    The texts are range-partitioned once and read in order, one row ahead. Only the first
    and last row of each partition are joined across partitions afterwards. A hot id (null,
    say) is parted by how its texts begin.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = {"n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def arrays(cols: list[list], ids: pa.DataType) -> list[pa.Array]:
        return [pa.array(c, ids if f == "id" else types.get(f, pa.string())) for f, c in zip(FIELDS, cols)]

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, None
        names = [*FIELDS, "part", "role", "t"]
        for b in sliced(batches, "t", 2 << 20):
            ids = b.schema.field("id").type
            rows = [(i, t, fingerprint(t)) for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist())]
            if held is None:
                first = rows[0]
            else:
                rows.insert(0, held)
            held = rows[-1]
            n = len(rows) - 1
            if n:
                yield pa.RecordBatch.from_arrays([*arrays(_digests(rows[:-1], rows[1:]), ids), pa.array([part] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())], names)
        if held is not None:
            ends = [(2, first), (1, held)]
            cols = [[r[0] for _, r in ends], [None] * 2, [None] * 2, [r[2] for _, r in ends], [None] * 2, [None] * 2, [None] * 2]
            yield pa.RecordBatch.from_arrays([*arrays(cols, ids), pa.array([part] * 2, pa.int32()), pa.array([x for x, _ in ends], pa.int32()), pa.array([r[1] for _, r in ends])], names)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            rows, follow = [*zip(c["id"], c["t"], c["fp"])], [*zip(c["id"], c["next_t"], c["next_fp"])]
            yield pa.RecordBatch.from_arrays(arrays(_digests(rows, follow), b.schema.field("id").type), FIELDS)

    read = checkpointed(plain.repartitionByRange(input_partitions(spark), "id", F.substring("t", 1, 64)).sortWithinPartitions("id", "t").mapInArrow(ordered, f"{schema}, part int, role int, t string"))
    parts = sorted(r["part"] for r in read.filter("role = 2").select("part").collect())  # as many as partitions at most
    turn = spark.createDataFrame([*zip(parts, [*parts[1:], *parts[:1]])], "part int, after int")
    heads = read.filter("role = 2").select(F.col("part").alias("after"), F.col("t").alias("next_t"), F.col("fingerprint").alias("next_fp"))
    lasts = read.filter("role = 1").select("id", "t", F.col("fingerprint").alias("fp"), "part").join(turn, "part").join(heads, "after")
    ends = lasts.select("id", "t", "fp", "next_t", "next_fp").mapInArrow(across, schema)
    return read.filter("role = 0").select(*FIELDS).unionByName(ends).withColumnRenamed("id", id_col)
