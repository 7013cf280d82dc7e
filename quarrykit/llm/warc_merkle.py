"""Merkle fixity audit of WARC replicas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, input_partitions


def record(id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Column:
    """A WARC response record of a page as one string."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def digests(rows: DataFrame, record_col: Column, id_col: str) -> DataFrame:
    """(id, length, digest): byte length and SHA-256 of each record; repeated ids are told apart by digest."""
    made = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), record_col.alias("r"))
    return made.select("id", F.octet_length("r").cast("bigint").alias("length"), F.sha2("r", 256).alias("digest"))


def _manifest(rows: DataFrame) -> tuple[DataFrame, int]:
    """Records by ascending id with their index and byte offset, and their number.

    Rows are range-partitioned and numbered in place; the partitions' totals, one row
    each, give where every partition starts.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, at = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            size = b.column("length").to_numpy()
            ends = at + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(n + np.arange(len(size))), pa.array(ends - size)], [*b.schema.names, "part", "idx", "offset"])
            n, at = n + len(size), int(ends[-1]) if len(size) else at

    placed = checkpointed(rows.repartitionByRange(input_partitions(rows.sparkSession), "id").sortWithinPartitions("id", "digest", "copy").mapInArrow(number, f"id {kind}, length bigint, digest string, copy int, part int, idx bigint, offset bigint"))
    totals = sorted((r.part, r.n, r.size) for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("size")).collect())
    base, n, at = [], 0, 0
    for part, k, size in totals:
        base.append((part, n, at))
        n, at = n + k, at + size
    starts = rows.sparkSession.createDataFrame(base, "part int, first bigint, begin bigint")
    return placed.join(starts, "part").select("id", "copy", "length", "digest", (F.col("idx") + F.col("first")).alias("idx"), (F.col("offset") + F.col("begin")).alias("offset")), n


def bucket_digests(rows: DataFrame, parts: int) -> DataFrame:
    """(bucket, n, w0..w3): one 256-bit digest per hash range of ids, a replica's tree below its root.

    A bucket's digest is the XOR of the SHA-256 of its records' id, copy and digest, so that
    it is combined before the shuffle and no bucket is gathered; records are told apart by
    copy, hence none cancels another.
    """
    h = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.col("copy").cast("string"), F.col("digest")), 256)
    made = rows.select(bucket_of(parts).alias("bucket"), h.alias("h"))
    words = [F.expr(f"bit_xor(cast(conv(substr(h, {16 * k + 1}, 16), 16, -10) AS bigint))").alias(f"w{k}") for k in range(4)]
    return made.groupBy("bucket").agg(F.count("*").alias("n"), *words)


def bucket_of(parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(parts))


def audit(original: DataFrame, replica: DataFrame, fanout: int = 16, bucket_rows: int = 1024) -> DataFrame:
    """Nodes at which two replicas differ, from the root down to the records.

    Both inputs have id, length and digest (see :func:`digests`). The original's records,
    by ascending id, are the leaves; a node spans ``fanout`` nodes of the level below and
    its digest is SHA-256 over theirs in order. The replica's tree takes its records by
    id, with an empty digest for one that is missing.

    First either replica gets its own digests of hash ranges of ids, about ``bucket_rows``
    records each, without regard to the other. Where all agree, so do the roots, and no
    record is compared. Records are joined in the differing ranges only; elsewhere the
    replica's leaves are known to be the original's. Then roots are compared, and only
    children of differing nodes are looked at further.

    Returns level (0: record), node, first_id and last_id, offset and length of its bytes
    in the original, digest_a, digest_b, status (``range``, ``altered``, ``missing``), and
    for records only the replica has, ``extra`` with node and offset null. Equal replicas
    give no row, as do empty ones. Records without an id are left out; repeats of an id
    are matched in order of their digests, equal ones being alike; a null body counts as
    empty, long ones are hashed whole, and other columns never matter.
    """

    def told(df: DataFrame) -> DataFrame:
        counted = df.groupBy("id", "digest", "length").agg(F.count("*").alias("n"))  # equal copies first, so that a repeated record is no group
        rest = counted.select("id", "length", "digest", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
        return rest.withColumn("copy", F.expr("row_number() OVER (PARTITION BY id ORDER BY digest, k)").cast("int")).drop("k")

    leaves, n = _manifest(told(original))
    other = checkpointed(told(replica))
    parts = max(1, -(-n // bucket_rows))
    words = ["n", "w0", "w1", "w2", "w3"]
    one, two = (bucket_digests(x, parts).select("bucket", F.struct(*words).alias(s)) for x, s in ((leaves, "a"), (other, "b")))
    differing = checkpointed(one.join(two, "bucket", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("bucket"))
    schema = f"level int, node bigint, first_id {(kind := original.schema['id'].dataType.simpleString())}, last_id {kind}, offset bigint, length bigint, digest_a string, digest_b string, status string"
    if differing.isEmpty():
        return original.sparkSession.createDataFrame([], schema)
    leaves, other = (x.withColumn("bucket", bucket_of(parts)) for x in (leaves, other))
    other = other.join(differing, "bucket", "left_semi").select("id", "copy", F.col("digest").alias("digest_b"), F.col("length").alias("length_b"))
    met = checkpointed(leaves.join(differing, "bucket", "left_semi").drop("bucket").join(other, ["id", "copy"], "full"))
    same = leaves.join(differing, "bucket", "left_anti").drop("bucket").withColumn("digest_b", F.col("digest")).withColumn("length_b", F.col("length"))
    level = met.filter("idx IS NOT NULL").unionByName(same).select(F.col("idx").alias("node"), F.col("id").alias("first_id"), F.col("id").alias("last_id"), "offset", "length", F.col("digest").alias("digest_a"), F.coalesce("digest_b", F.lit("")).alias("digest_b"))
    levels = [level]
    while n > 1:
        n = -(-n // fanout)
        parent = levels[-1].withColumn("kid", F.struct("node", "digest_a", "digest_b")).groupBy(F.expr(f"node div {fanout}").alias("node")).agg(
            F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.min("offset").alias("offset"), F.sum("length").alias("length"),
            F.array_sort(F.collect_list("kid")).alias("kids"),  # at most fanout children
        )
        levels.append(checkpointed(parent.select("node", "first_id", "last_id", "offset", "length", *[F.sha2(F.concat_ws("", F.col(f"kids.digest_{s}")), 256).alias(f"digest_{s}") for s in "ab"])))
    out, above = [], None
    for k in range(len(levels) - 1, -1, -1):
        differ = levels[k].filter("digest_a <> digest_b")
        if above is not None:
            differ = differ.join(above.select(F.col("node").alias("up")), F.expr(f"node div {fanout}") == F.col("up"), "left_semi")
        status = F.when(F.lit(k > 0), "range").when(F.col("digest_b") == "", "missing").otherwise("altered")
        out.append(differ.select(F.lit(k).alias("level"), "*", status.alias("status")))
        above = differ
    extra = met.filter("idx IS NULL").select(F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("node"), F.col("id").alias("first_id"), F.col("id").alias("last_id"), F.lit(None).cast("bigint").alias("offset"), F.col("length_b").alias("length"), F.lit("").alias("digest_a"), "digest_b", F.lit("extra").alias("status"))
    for x in out:
        extra = extra.unionByName(x)
    return extra


def damaged_copy(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A replica with known faults: the 100th character overwritten where id mod 97 is 5, records lost where id mod 389 is 11."""
    flip = F.concat(F.substring(html_col, 1, 99), F.lit("~"), F.expr(f"substr(`{html_col}`, 101)"))
    html = F.when(F.pmod(id_col, F.lit(97)) == 5, flip).otherwise(F.col(html_col))
    return pages.filter(F.pmod(id_col, F.lit(389)) != 11).withColumn(html_col, html)


def query_sql(fanout: int = 16, most_levels: int = 7) -> str:
    """DuckDB SQL of the audit of ``pages`` against :func:`damaged_copy`, for ids without repeats."""
    rec = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(h, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(h, '') || chr(13) || chr(10) || chr(13) || chr(10)"
    parts = [
        f"a AS (SELECT page_id AS id, {rec} AS r FROM (SELECT *, html AS h FROM pages))",
        f"b AS (SELECT page_id AS id, sha256({rec}) AS d FROM (SELECT *, CASE WHEN page_id % 97 = 5 THEN substr(html, 1, 99) || '~' || substr(html, 101) ELSE html END AS h FROM pages WHERE page_id % 389 <> 11))",
        'l0 AS (SELECT row_number() OVER (ORDER BY a.id) - 1 AS node, a.id AS first_id, a.id AS last_id, sum(strlen(r)) OVER (ORDER BY a.id) - strlen(r) AS "offset", strlen(r) AS length, sha256(r) AS digest_a, coalesce(d, \'\') AS digest_b FROM a LEFT JOIN b USING (id))',
    ]
    for k in range(1, most_levels):
        parts.append(f'l{k} AS (SELECT node // {fanout} AS node, min(first_id) AS first_id, max(last_id) AS last_id, min("offset") AS "offset", sum(length) AS length, sha256(string_agg(digest_a, \'\' ORDER BY node)) AS digest_a, sha256(string_agg(digest_b, \'\' ORDER BY node)) AS digest_b FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) > 1 GROUP BY 1)')
    status = "CASE WHEN digest_b = '' THEN 'missing' ELSE 'altered' END"
    rows = " UNION ALL ".join(
        f'SELECT CAST({k} AS INTEGER) AS level, CAST(node AS BIGINT) AS node, first_id, last_id, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, digest_a, digest_b, {status if k == 0 else "'range'"} AS status FROM l{k} WHERE digest_a <> digest_b'
        for k in range(most_levels)
    )
    return f"WITH {', '.join(parts)} {rows}"
