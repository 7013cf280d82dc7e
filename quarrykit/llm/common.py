"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder, its lineage cut.

    The folder is the one named in ``spark.checkpoint.dir``. Where a session names none, a
    folder of this machine is set if the session is local, as in tests; a cluster's fails.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="qk-ckpt-"))
    return df.checkpoint(eager=True)


def forget(spark: SparkSession) -> None:
    """Delete the shuffle and checkpoint files of frames that nothing names any more.

    Spark deletes them as the driver's heap is collected, which may be long after: until then
    the shuffles of all earlier steps stand on disk together. It does so on a thread of its
    own, so those of the last step may stay until the next call.
    """
    for _ in range(2):  # what a first round frees may hold the last hand on a shuffle
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def input_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the string ``column`` of each piece holds about ``most_bytes`` (one row at least)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sizes = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, s in enumerate(sizes):
            if i > start and (held + s > most_bytes or i - start >= most_rows):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += int(s)
        yield b.slice(start, n - start)


def heavy_keys(keys: DataFrame, limit: int) -> DataFrame:
    """Keys (column ``key``) that more than ``limit`` rows share, with the number of blocks to cut each into."""
    return keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("key", F.ceil(F.col("n") / limit).cast("int").alias("blocks"))


def collision_pairs(rows: DataFrame, payload: list[str], condition, limit: int = 2000) -> DataFrame:
    """Pairs of rows with equal ``key``, each unordered pair once per shared key, ``id`` of ``a`` below that of ``b``.

    ``rows`` has ``key``, ``id`` (orderable, unique within a key) and the ``payload``
    columns; the output has them with the suffixes ``_a`` and ``_b``. ``condition``
    takes two functions that map a column name to the column of either side; pairs
    that fail it never leave the join. A key shared by more than ``limit`` rows is cut
    into blocks and each pair of blocks joins on its own, so that no task meets a
    whole hot key. Keys below the limit join as they are. Neither side is ever broadcast:
    rows that ``explode`` makes count as one in Spark's estimate, so it would send all posts
    of a table through the driver.
    """
    heavy = checkpointed(heavy_keys(rows, limit))
    names = ["id", *payload]
    left = lambda c: F.col(f"{c}_a")
    right = lambda c: F.col(f"{c}_b")

    def side(df: DataFrame, suffix: str, extra: list[str]) -> DataFrame:
        return df.select("key", *extra, *[F.col(c).alias(c + suffix) for c in names])

    def out(df: DataFrame) -> DataFrame:
        return df.filter(condition(left, right)).select(*[f"{c}_a" for c in names], *[f"{c}_b" for c in names])

    light = out(side(rows, "_a", []).join(side(rows, "_b", []).hint("merge"), "key").filter(left("id") < right("id")))
    if heavy.isEmpty():
        return light
    cool = rows.join(heavy.select("key"), "key", "left_anti")
    hot = rows.join(heavy, "key").withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    one = side(hot.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1))), "_a", ["i", "j"])
    two = side(hot.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block")))), "_b", ["i", "j"])
    met = one.join(two.hint("merge"), ["key", "i", "j"]).filter((F.col("i") < F.col("j")) | (left("id") < right("id")))
    swap = left("id") > right("id")
    for c in names:
        met = met.withColumn(f"{c}_x", F.when(swap, right(c)).otherwise(left(c))).withColumn(f"{c}_y", F.when(swap, left(c)).otherwise(right(c)))
    met = met.select(*[F.col(f"{c}_x").alias(f"{c}_a") for c in names], *[F.col(f"{c}_y").alias(f"{c}_b") for c in names])
    cool = out(side(cool, "_a", []).join(side(cool, "_b", []).hint("merge"), "key").filter(left("id") < right("id")))
    return cool.unionByName(out(met))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (src, dst): one row (node, root) per node, root the least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges
    stay the same; each round is written to the checkpoint folder. The least
    neighbour of a node is found with a map-side combining aggregate and joined back,
    so a hub's neighbours are never gathered in one task: adaptive execution can split
    the join's hot key.
    """
    now = checkpointed(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = checkpointed(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def with_row_key(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``df`` with a column ``name`` that orders by id, null ids last, and parts rows of one id by a 128-bit hash of the text.

    Rows share a key only if id and text are equal, a null text counting as empty.
    """
    said = text_or_empty(text_col)
    kind = df.schema[id_col].dataType
    return df.withColumn(name, F.struct(
        F.col(id_col).isNull().alias("absent"), F.coalesce(F.col(id_col), F.lit(0).cast(kind)).alias("id"),
        F.xxhash64(said).alias("h"), F.xxhash64(F.lit(1), said).alias("k"),
    ))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def release() -> None:
    """Hand memory that Python has freed back to the system, so that a worker that Spark keeps stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def buckets(df: DataFrame, most_bytes: int = 256 << 20) -> int:
    """Partitions such that each stands for about ``most_bytes`` of the input's files, no fewer than the session asks for."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(input_partitions(df.sparkSession), min(1 << 20, -(-size // most_bytes) if size < 1 << 60 else 0))


def packed(keys: np.ndarray, records: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """``records`` (one row of bytes per key) as one blob per part, the part being key mod ``parts``."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, records = part[order], np.ascontiguousarray(records[order])
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(part)]):
        yield int(part[a]), records[a:b].tobytes()


def six_bytes(keys: np.ndarray) -> np.ndarray:
    """The low 48 bits of each key as six bytes."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def twice_at_most(keys: np.ndarray) -> np.ndarray:
    """``keys`` sorted, those that repeat standing twice: all that is needed to tell repeated keys from others."""
    keys = np.sort(keys)
    third = np.zeros(len(keys), bool)
    third[2:] = (keys[2:] == keys[1:-1]) & (keys[1:-1] == keys[:-2])
    return keys[~third]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Those keys that occur more than once, each once."""
    keys = np.sort(keys)
    again = keys[1:] == keys[:-1]
    found = keys[1:][again]
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


class Bitmap:
    """A set of hashed keys of bounded size: no false negatives, so it may only drop rows that a later join would drop."""

    def __init__(self, keys: DataFrame, column: str, bits: int | None = None):
        """Build from a long ``column``; 2^bits bits reach the driver and the workers.

        By default there are 16 to 32 bits a row up to 2^27 in all; beyond that the set only
        passes more rows on to the join.
        """
        if bits is None:
            bits = min(27, max(16, (16 * keys.count()).bit_length()))
        slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        words = keys.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        found = words.toArrow()
        table = np.zeros(1 << bits - 6, np.int64)
        table[found.column("w").to_numpy()] = found.column("b").to_numpy()
        self.mask = (1 << bits) - 1
        self.sent = keys.sparkSession.sparkContext.broadcast(table)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Boolean per 64-bit key; False means surely absent."""
        slot = keys.astype(np.int64) & self.mask
        return (self.sent.value[slot >> 6] >> (slot & 63)) & 1 == 1


def parted(df: DataFrame, key: Column, marked: Bitmap) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose long ``key`` may be in the bitmap, and rows whose key is surely absent (a null key among them)."""
    name = fresh_names(df, 1)[0]
    keyed = df.withColumn(name, F.coalesce(key, F.lit(0)))

    def only(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = marked.hits(b.column(b.num_columns - 1).to_numpy())
                b = b.filter(pa.array(own if wanted else ~own))
                if b.num_rows:
                    yield b
            release()

        return run

    return tuple(keyed.mapInArrow(only(x), keyed.schema).drop(name) for x in (True, False))


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of ``df`` has, upper and lower case being one."""
    taken = {c.lower() for c in df.columns}
    return [x for k in range(len(taken) + n) if (x := f"own_{k}") not in taken][:n]
