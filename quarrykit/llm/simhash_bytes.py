"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, collision_pairs, components, input_partitions, release, sliced

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of one text; 0 for a null or wordless text."""
    return int(_bits(_hashes(text, words)))


def _hashes(text: str | None, words: int) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    grams = map(b" ".join, zip(*[w[k:] for k in range(words)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(w) - words + 1)


def _bits(h: np.ndarray) -> np.int64:
    """Majority bits: a bit is 1 if set in over half of the hashes."""
    n = len(h)
    if not n:
        return np.int64(0)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 16384):
        part = np.unpackbits(h[i : i + 16384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(part, axis=0, dtype=np.uint16 if len(part) < 65536 else np.int64).astype(np.int64)
    return np.packbits(ones * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of each row's whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "t"):
            fp = [int(_bits(_hashes(t, words))) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp, pa.int64())], ["id", "fp"])
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def near_pairs(classes: DataFrame, distance: int = 3, subset: int = 4, limit: int = 2000) -> DataFrame:
    """All pairs (id_a, id_b) of distinct fingerprints (column ``id``) at ``distance`` bits or fewer.

    Bits that differ touch at most ``distance`` of the 8 bytes, so linked fingerprints
    agree in 8 - distance byte positions at least. A list of one byte value would hold one
    fingerprint in 256, so the index posts each fingerprint under its bytes at every
    ``subset`` of the 8 positions, which makes lists shorter by 256^subset. Pairs that
    agree in b positions meet in comb(b, subset) lists: how often a pair meets is tallied
    over the lists, pairs below comb(8 - distance, subset) meetings, the guaranteed
    minimum, are left, and what remains is verified by bit count.
    """
    if not 1 <= subset <= 8 - distance:
        raise ValueError(f"subsets of 1 to {8 - distance} positions can be guaranteed at {distance} bits")
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("id").bitwiseAND(F.lit(_mask(c))).alias("b")) for k, c in enumerate(combinations(range(8), subset))])
    spread = classes.select("id").repartition(input_partitions(classes.sparkSession), "id")  # small rows, many posts each
    posts = spread.select("id", F.explode(keys).alias("p")).select(F.xxhash64("p.k", "p.b").alias("key"), "id")
    met = collision_pairs(posts, [], lambda a, b: F.lit(True), limit).groupBy("id_a", "id_b").agg(F.count("*").alias("met"))
    enough = met.filter(F.col("met") >= comb(8 - distance, subset))
    return enough.filter(F.bit_count(F.col("id_a").bitwiseXOR(F.col("id_b"))) <= distance).select("id_a", "id_b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, subset: int | None = None) -> DataFrame:
    """One row per input row: id, fingerprint, n_near, component_id.

    Texts are lower-cased (A-Z), cut at ASCII white space into words and into shingles
    of ``words`` words, repeats included; a shorter text is one shingle. A null, empty
    or blank text has fingerprint zero, which links like any other. Rows with equal
    fingerprints form one class: links are sought between classes only and counted with
    the classes' sizes, so thousands of copies cost one posting. ``n_near`` counts the
    other rows linked directly and ``component_id`` is the least id that links reach.
    Repeated ids count as rows of their own; an empty table gives an empty result.
    ``subset``, the byte positions of a key, is 4 (70 keys a class), and 5 (56 keys, lists
    shorter by 256) from 2^28 classes on; any choice gives the same links. Very long texts
    are hashed whole; ties can't arise; extra columns may have any names.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, words))
    classes = checkpointed(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumnRenamed("fp", "id"))
    if subset is None:
        subset = 4 if classes.count() < 1 << 28 else 5
    pairs = checkpointed(near_pairs(classes, distance, subset))
    both = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    links = both.join(classes.select(F.col("id").alias("id_b"), "n"), "id_b").groupBy(F.col("id_a").alias("id")).agg(F.sum("n").alias("links"))
    roots = components(pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
    rooted = classes.join(roots.withColumnRenamed("node", "id"), "id")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    linked = rooted.select("id", "root").join(lowest, "root").join(links, "id").select("id", "component", "links")
    known = classes.join(linked, "id", "left").select(
        F.col("id").alias("fp"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_near"),
        F.coalesce("component", "least").alias("component_id"),
    )
    return fps.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")
