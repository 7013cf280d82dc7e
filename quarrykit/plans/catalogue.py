"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contractions, patterns, spelling, text
from ..functions.gibberish import ACCEPTED, GibberishDetector
from ..ml import harness
from ..operators import cluster, columns, correlate, dedup, encode, matrix, outliers, profile, reshape, sampling, scoring, stats
from ..sources import tabular
from .lineage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle SQL, if SQL can express it."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


r6 = lambda c: F.round(c, 6)


def half_away6(name: str) -> Column:
    """A column rounded to six digits by arithmetic, as the oracle's engine does: a tenth of the time of ``round``, for results with a row per pair."""
    x = F.abs(name) * 1e6
    whole = F.floor(x)
    return F.when(x < 2.0**52, F.signum(name) * (whole + (x - whole >= 0.5).cast("int")) / 1e6).otherwise(F.col(name)) + 0.0


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def gappy_lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with nulls where discount or tax is zero."""
    return table(spark, d, "lineitem").withColumns({c: F.nullif(c, F.lit(0.0)) for c in ("l_discount", "l_tax")})


GAPPY = "(SELECT * REPLACE (nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax) FROM lineitem)"
LINE_COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@query("missingness_pct", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS pct FROM {GAPPY}" for c in LINE_COLUMNS))
def missingness_pct(spark, d):
    return profile.missingness_pct(gappy_lines(spark, d))


@query("missingness_counts", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM {GAPPY}" for c in LINE_COLUMNS) + ") WHERE n_null > 0")
def missingness_counts(spark, d):
    return profile.missingness(gappy_lines(spark, d))


@query("missingness_patterns", f"SELECT l_discount IS NULL AS l_discount, l_tax IS NULL AS l_tax, count(*) AS n FROM {GAPPY} GROUP BY 1, 2")
def missingness_patterns(spark, d):
    return profile.missingness_patterns(gappy_lines(spark, d).select("l_discount", "l_tax"))


@query("missingness_cells", "SELECT event_id, c AS \"column\", v AS is_null FROM (SELECT event_id, user_id IS NULL AS user_id, nullif(event_type, 'view') IS NULL AS event_type FROM events) UNPIVOT INCLUDE NULLS (v FOR c IN (user_id, event_type))")
def missingness_cells(spark, d):
    return profile.missingness_cells(table(spark, d, "events").select("event_id", "user_id", F.nullif("event_type", F.lit("view")).alias("event_type")), "event_id")


@query("na_indicators", f"SELECT l_orderkey, l_linenumber, l_discount, l_discount IS NULL AS \"l_discount_NA\", l_tax, l_tax IS NULL AS \"l_tax_NA\" FROM {GAPPY}")
def na_indicators(spark, d):
    return columns.na_indicators(gappy_lines(spark, d).select("l_orderkey", "l_linenumber", "l_discount", "l_tax"))


@query("value_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "events").select("event_type"))


@query("value_counts_norm", "SELECT l_returnflag, l_linestatus, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM lineitem GROUP BY 1, 2")
def value_counts_norm(spark, d):
    return profile.value_counts(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"), normalize=True)


@query("top_k_categories", """WITH t AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN r <= 5 THEN p_brand ELSE 'Other' END AS p_brand FROM part JOIN t USING (p_brand)""")
def top_k_categories(spark, d):
    return encode.keep_top_categories(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 5)


def _profile_sql(t: str, cols: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", min({c})::VARCHAR AS min, max({c})::VARCHAR AS max FROM {t}" for c, k in cols.items())


@query("column_profile", _profile_sql("part", {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int"}))
def column_profile(spark, d):
    return columns.column_profile(table(spark, d, "part").drop("p_retailprice"))


def _narrow_sql() -> str:
    ints = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"}
    fits = "CASE WHEN min({0}) >= -128 AND max({0}) < 128 THEN 'tinyint' WHEN min({0}) >= -32768 AND max({0}) < 32768 THEN 'smallint' WHEN min({0}) >= -2147483648 AND max({0}) < 2147483648 THEN 'int' ELSE 'bigint' END"
    rows = [f"SELECT '{c}' AS \"column\", '{k}' AS dtype, {fits.format(c)} AS proposal FROM lineitem" for c, k in ints.items()]
    rows += [f"SELECT '{c}', 'string', CASE WHEN count(DISTINCT {c}) < 0.5 * count({c}) THEN 'categorical' ELSE 'string' END FROM lineitem" for c in ("l_returnflag", "l_linestatus")]
    return " UNION ALL ".join(rows)


@query("narrow_types_report", _narrow_sql())
def narrow_types_report(spark, d):
    return columns.narrow_types(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"), exact=True)[1]


@query("memory_usage", "SELECT 'bigint' AS dtype, 1 AS n_cols, 8 * count(*) AS bytes FROM customer UNION ALL SELECT 'double', 1, 8 * count(*) FROM customer UNION ALL SELECT 'int', 1, 4 * count(*) FROM customer UNION ALL SELECT 'string', 2, CAST(sum(strlen(c_name)) + sum(strlen(c_mktsegment)) AS BIGINT) FROM customer")
def memory_usage(spark, d):
    return columns.memory_usage(table(spark, d, "customer"))


@query("drop_constant_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def drop_constant_columns(spark, d):
    return columns.drop_constant_columns(table(spark, d, "orders").select("o_orderkey", F.lit(1).alias("one"), "o_orderstatus", F.when(F.col("o_orderkey") > 5, "x").alias("only")))


@query("filter_reorder_insert", "SELECT n_regionkey, n_nationkey, n_nationkey + n_regionkey AS both, n_name FROM nation")
def filter_reorder_insert(spark, d):
    own = columns.filter_columns(table(spark, d, "nation"), drop=["n_name", "absent"], keep=["n_name", "n_nationkey", "n_regionkey"])
    return columns.insert_column(columns.reorder_columns(own, 2, 0), "both", F.col("n_nationkey") + F.col("n_regionkey"), after="n_nationkey")


@query("column_selector", "SELECT s_suppkey, s_acctbal FROM supplier")
def column_selector(spark, d):
    own = table(spark, d, "supplier").withColumn("k", F.lit(1)).withColumn("empty", F.lit(None).cast("string"))
    return columns.ColumnSelector(columns=["s_suppkey", "s_acctbal", "k", "empty"]).fit(own).transform(own)


@query("apply_rows", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def apply_rows(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return columns.map_rows(own, lambda p: p[["l_orderkey", "l_linenumber"]].assign(net=p.l_extendedprice * (1 - p.l_discount)), "l_orderkey bigint, l_linenumber int, net double")


@query("apply_columns", "SELECT upper(r_name) AS r_name, r_regionkey FROM region")
def apply_columns(spark, d):
    return columns.map_columns(table(spark, d, "region"), F.upper, ["r_name"])


@query("melt_lineitem", f"SELECT l_orderkey, l_linenumber, variable, value FROM {GAPPY} UNPIVOT INCLUDE NULLS (value FOR variable IN (l_quantity, l_discount, l_tax))")
def melt_lineitem(spark, d):
    return reshape.melt(gappy_lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


def order_lists(spark: SparkSession, d: str) -> DataFrame:
    """Per order its parts and quantities by line number, empty where an order has no line (as the orders of status P here)."""
    s = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))  # an order has few lines
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(s.alias("s"))
    got = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    full = F.col("s").isNotNull() & (F.col("o_orderstatus") != "P")
    return got.select("o_orderkey", F.when(full, F.col("s.l_partkey")).otherwise(F.array().cast("array<bigint>")).alias("parts"), F.when(full, F.col("s.l_quantity")).otherwise(F.array().cast("array<double>")).alias("quantities"))


LISTS = """lists AS (SELECT o_orderkey, l_partkey AS element1, l_quantity AS element2, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P')"""


@query("explode_parallel", f"WITH {LISTS} SELECT o_orderkey, element1, element2 FROM lists")
def explode_parallel(spark, d):
    return reshape.explode_parallel(order_lists(spark, d), "parts", "quantities").drop("parts", "quantities")


@query("explode_parallel_outer", f"WITH {LISTS} SELECT orders.o_orderkey, coalesce(element1, 0) AS parts, coalesce(element2, 0) AS quantities FROM orders LEFT JOIN lists USING (o_orderkey)")
def explode_parallel_outer(spark, d):
    return reshape.explode_parallel_outer(order_lists(spark, d), ["parts", "quantities"], fill=0)


@query("list_to_columns", "SELECT r_name, chr(65 + r_regionkey) AS l_0, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS l_1 FROM region")
def list_to_columns(spark, d):
    own = table(spark, d, "region").select("r_name", F.when(F.col("r_regionkey") % 2 == 0, F.array(F.chr(F.col("r_regionkey") + 65), F.col("r_name"))).otherwise(F.array(F.chr(F.col("r_regionkey") + 65))).alias("l"))
    return reshape.list_to_columns(own, "l").drop("l")


@query("multi_hot", "SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer GROUP BY 1")
def multi_hot(spark, d):
    own = table(spark, d, "customer").select("c_nationkey", F.array("c_mktsegment").alias("items"))
    return reshape.multi_hot(own, "c_nationkey", "items", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("one_hot_flags", "SELECT l_orderkey, l_linenumber, l_returnflag, " + ", ".join(f"(l_returnflag = '{v}')::INTEGER AS flag_{v}" for v in "ANR") + " FROM lineitem")
def one_hot_flags(spark, d):
    return reshape.one_hot(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", "flag")[0]


@query("one_hot_levels", "SELECT l_orderkey, l_linenumber, l_linestatus, " + ", ".join(f"(l_returnflag = '{v}')::INTEGER AS \"l_returnflag_{v}\"" for v in "NR") + " FROM lineitem")
def one_hot_levels(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    return reshape.LevelEncoder(columns=["l_returnflag", "l_linestatus"], dropFirst=True).fit(own).transform(own)


@query("label_encode", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS o_orderpriority FROM orders")
def label_encode(spark, d):
    return encode.encode_labels(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("minmax_scale", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def minmax_scale(spark, d):
    return encode.scale(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).withColumn("p_retailprice", r6("p_retailprice"))


@query("zscore_scale", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity FROM lineitem")
def zscore_scale(spark, d):
    return encode.scale(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], "zscore").withColumn("l_quantity", r6("l_quantity"))


@query("age_years", "SELECT o_orderkey, round_even((epoch(TIMESTAMP '2024-06-01') - epoch(o_orderdate)) / 31556952.0, 0)::INTEGER AS age FROM orders")
def age_years(spark, d):
    return table(spark, d, "orders").select("o_orderkey", columns.years_since(F.col("o_orderdate"), F.to_timestamp(F.lit("2024-06-01"))).alias("age"))


for _name, _unit in columns.SLOTS.items():

    def _slot(spark, d, _name=_name):
        return table(spark, d, "events").groupBy(columns.time_slot(F.col("ts"), _name).cast("timestamp_ntz").alias("slot")).agg(F.count("*").alias("n"))

    query(f"time_slots_{_unit}", f"SELECT date_trunc('{_unit}', ts)::TIMESTAMP AS slot, count(*) AS n FROM events GROUP BY 1")(_slot)


@query("dedup_unordered", "SELECT l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY list_sort([l_suppkey::VARCHAR, l_linenumber::VARCHAR]) ORDER BY l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def dedup_unordered(spark, d):
    return dedup.drop_unordered_duplicates(table(spark, d, "lineitem").select("l_suppkey", "l_linenumber"), order_by=["l_suppkey", "l_linenumber"])


PAIRS = "SELECT [l_suppkey % 7, l_linenumber::BIGINT, (l_quantity % 5)::BIGINT] AS a FROM lineitem"


def row_arrays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.array(F.expr("l_suppkey % 7"), F.expr("cast(l_linenumber as bigint)"), F.expr("cast(l_quantity % 5 as bigint)")).alias("a"))


def flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) if dict(df.dtypes)[c].startswith("array") else F.col(c) for c in df.columns])


@query("distinct_rows", f"SELECT DISTINCT array_to_string(a, ',') AS a FROM ({PAIRS})")
def distinct_rows(spark, d):
    return flat(dedup.drop_duplicate_rows(row_arrays(spark, d), "a"))


@query("distinct_rows_unordered", f"SELECT DISTINCT array_to_string(list_sort(a), ',') AS a FROM ({PAIRS})")
def distinct_rows_unordered(spark, d):
    return flat(dedup.drop_duplicate_rows(row_arrays(spark, d), "a", ignore_order=True))


@query("unique_only_rows", f"SELECT array_to_string(a, ',') AS a FROM ({PAIRS}) WHERE len(list_distinct(a)) = len(a)")
def unique_only_rows(spark, d):
    return flat(row_arrays(spark, d).filter(dedup.all_distinct(F.col("a"))))


@query("per_row_counts", f"SELECT array_to_string(list_transform(a, lambda x, i: CASE WHEN list_position(a, x) = i THEN len(list_filter(a, lambda y: y = x)) ELSE 0 END), ',') AS a FROM ({PAIRS})")
def per_row_counts(spark, d):
    return flat(row_arrays(spark, d).select(dedup.counts_per_row(F.col("a")).alias("a")))


@query("balanced_sample_sizes", "SELECT quality, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS n FROM labels GROUP BY 1")
def balanced_sample_sizes(spark, d):
    return sampling.balanced_sample(table(spark, d, "labels"), "quality", "doc_id", frac=1.0).groupBy("quality").agg(F.count("*").alias("n"))


@query("stratified_fold_sizes", "SELECT toxic, fold, count(*) AS n FROM (SELECT toxic, ((row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1) % 5)::INTEGER AS fold FROM labels) GROUP BY 1, 2")
def stratified_fold_sizes(spark, d):
    return sampling.stratified_folds(table(spark, d, "labels"), "toxic", "doc_id").groupBy("toxic", "fold").agg(F.count("*").alias("n"))


@query("hist_by_class", """WITH m AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 10 AS w FROM lineitem)
SELECT l_returnflag AS by, least(floor((l_quantity - lo) / w)::INTEGER, 9) AS bin, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi, count(*) AS n FROM lineitem, m GROUP BY l_returnflag, bin, m.lo, w""".replace("round(lo + bin * w, 6) AS lo", "round(m.lo + bin * w, 6) AS lo").replace("round(lo + (bin + 1)", "round(m.lo + (bin + 1)").replace("(l_quantity - lo)", "(l_quantity - m.lo)"))
def hist_by_class(spark, d):
    return profile.histogram(table(spark, d, "lineitem"), "l_quantity", 10, "l_returnflag").withColumns({"lo": r6("lo"), "hi": r6("hi")})


@query("box_stats", """WITH q AS (SELECT l_returnflag AS "by", quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT "by", round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, count(*) AS n, min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (NOT l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem JOIN q ON l_returnflag = "by" GROUP BY "by", q1, median, q3""")
def box_stats(spark, d):
    return profile.box_stats(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag").withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("log_odds", "SELECT lang AS value, count(*) FILTER (quality = 0) AS n0, count(*) FILTER (quality = 1) AS n1, round(ln(1 + n1 / nullif(n0, 0)), 6) AS log_odds FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def log_odds(spark, d):
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return profile.log_odds(own, "lang", "quality").withColumn("log_odds", r6("log_odds"))


@query("log_odds_all", "SELECT c AS \"column\", v AS value, count(*) FILTER (quality = 0) AS n0, count(*) FILTER (quality = 1) AS n1, round(ln(1 + n1 / nullif(n0, 0)), 6) AS log_odds FROM (SELECT quality, lang, source FROM labels JOIN documents USING (doc_id)) UNPIVOT (v FOR c IN (lang, source)) GROUP BY 1, 2")
def log_odds_all(spark, d):
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return profile.log_odds_all(own, "quality", ["lang", "source"]).withColumn("log_odds", r6("log_odds"))


@query("interaction_means", "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1, 2")
def interaction_means(spark, d):
    return profile.interaction_means(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_linestatus").withColumn("mean", F.round("mean", 4))


@query("pair_density", """WITH m AS (SELECT min(l_quantity) AS a, (max(l_quantity) - min(l_quantity)) / 25 AS w, min(l_discount) AS b, (max(l_discount) - min(l_discount)) / 25 AS v FROM lineitem)
SELECT least(floor((l_quantity - a) / w)::INTEGER, 24) AS x_bin, least(floor((l_discount - b) / v)::INTEGER, 24) AS y_bin, l_returnflag AS by, count(*) AS n FROM lineitem, m GROUP BY 1, 2, 3""")
def pair_density(spark, d):
    return profile.pair_density(table(spark, d, "lineitem"), "l_quantity", "l_discount", by="l_returnflag")


def _rank_sql(t: str, x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


@query("correlations_to_column", "WITH r AS (SELECT *, " + ", ".join(f"{_rank_sql('', c)} AS r_{c}" for c in LINE_NUMBERS) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS pearson, round(corr(r_{c}, r_l_extendedprice), 6) AS spearman FROM r" for c in LINE_NUMBERS if c != "l_extendedprice"))
def correlations_to_column(spark, d):
    return correlate.correlations_to(table(spark, d, "lineitem"), "l_extendedprice", LINE_NUMBERS).withColumns({"pearson": r6("pearson"), "spearman": r6("spearman")})


@query("corr_matrix_pearson", " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 6) AS value FROM lineitem" for a in LINE_NUMBERS for b in LINE_NUMBERS))
def corr_matrix_pearson(spark, d):
    return correlate.correlation_matrix(table(spark, d, "lineitem"), LINE_NUMBERS).withColumn("value", r6("value"))


@query("corr_matrix_spearman", "WITH r AS (SELECT " + ", ".join(f"{_rank_sql('', c)} AS {c}" for c in LINE_NUMBERS) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 6) AS value FROM r" for a in LINE_NUMBERS for b in LINE_NUMBERS))
def corr_matrix_spearman(spark, d):
    return correlate.correlation_matrix(table(spark, d, "lineitem"), LINE_NUMBERS, "spearman").withColumn("value", r6("value"))


@query("corr_feature_select")
def corr_feature_select(spark, d):
    own = table(spark, d, "lineitem").select(*LINE_NUMBERS, (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("l_price_tax"))
    return correlate.select_uncorrelated(own)[1]


@query("nullity_corr", f"WITH n AS (SELECT l_quantity, coalesce(l_discount, -1) AS l_discount, coalesce(l_tax, -1) AS l_tax, (l_discount IS NULL)::INT AS a, (l_tax IS NULL)::INT AS b FROM {GAPPY}) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col1, '{t}_NA' AS col2, round(corr({x}, {y}), 6) AS value FROM n" for c, x, t, y in (("l_quantity", "l_quantity", "l_discount", "a"), ("l_quantity", "l_quantity", "l_tax", "b"), ("l_discount", "l_discount", "l_tax", "b"), ("l_tax", "l_tax", "l_discount", "a"), ("l_discount_NA", "a", "l_tax", "b"))) + ")")
def nullity_corr(spark, d):
    return correlate.nullity_correlation(gappy_lines(spark, d), "pearson", columns=["l_quantity", "l_discount", "l_tax"]).withColumn("value", r6("value"))


SCORED = "(SELECT quality AS y, 1 / (1 + exp(-(ln(n_chars + 1) - 7))) AS p FROM labels JOIN documents USING (doc_id))"


def scored(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return own.select("doc_id", F.col("quality").alias("y"), (1 / (1 + F.exp(-(F.ln(F.col("n_chars") + 1) - 7)))).alias("p"))


@query("tjur_r2", f"SELECT round(avg(p) FILTER (y = 1) - avg(p) FILTER (y = 0), 6) AS tjur_r2 FROM {SCORED}")
def tjur_r2(spark, d):
    return scoring.tjur_r2(scored(spark, d), "y", "p").select(r6("tjur_r2").alias("tjur_r2"))


@query("pearson_r", f"WITH s AS (SELECT *, avg(y) OVER () AS pi FROM {SCORED}) SELECT round((sum(p * y) - count(*) * any_value(pi) ** 2) / sqrt(count(*) * any_value(pi) * (1 - any_value(pi)) * sum((p - pi) ** 2)), 6) AS pearson_r FROM s")
def pearson_r(spark, d):
    return scoring.pearson_r(scored(spark, d), "y", "p").select(r6("pearson_r").alias("pearson_r"))


@query("ss_r2", f"SELECT round((2 * sum(p * y) - sum(p * p) - count(*) * avg(y) ** 2) / (count(*) * avg(y) * (1 - avg(y))), 6) AS ss_r2 FROM {SCORED}")
def ss_r2(spark, d):
    return scoring.sum_of_squares_r2(scored(spark, d), "y", "p").select(r6("ss_r2").alias("ss_r2"))


@query("brier", f"SELECT round(avg(((1 - p) - (y = 0)::INT) ** 2 + (p - (y = 1)::INT) ** 2), 6) AS brier FROM {SCORED}")
def brier(spark, d):
    own = scored(spark, d).withColumn("probs", F.array(1 - F.col("p"), F.col("p")))
    return scoring.brier(own, "y", "probs").select(r6("brier").alias("brier"))


@query("binary_report", f"SELECT count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y = 0 AND p <= 0.5) AS tn, count(*) FILTER (y = 0 AND p > 0.5) AS fp, count(*) FILTER (y = 1 AND p <= 0.5) AS fn, round((tp + tn) / count(*), 6) AS accuracy, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM {SCORED}")
def binary_report(spark, d):
    own = scored(spark, d).withColumn("prediction", (F.col("p") > 0.5).cast("int"))
    return scoring.binary_report(own, "y").withColumns({c: r6(c) for c in ("accuracy", "recall", "precision")})


@query("confusion", f"SELECT y AS label, (p > 0.5)::INT AS prediction, count(*) AS n FROM {SCORED} GROUP BY 1, 2")
def confusion(spark, d):
    return scoring.confusion(scored(spark, d).withColumn("z", (F.col("p") > 0.5).cast("int")), "y", "z")


@query("multiclass_report", "WITH s AS (SELECT lang AS y, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS z FROM documents), c AS (SELECT y AS label, count(*) AS n, count(*) FILTER (y = z) AS hit FROM s GROUP BY 1), q AS (SELECT z AS label, count(*) AS said FROM s GROUP BY 1) SELECT label, n, round(coalesce(hit / said, 0), 6) AS precision, round(hit / n, 6) AS recall, round(coalesce(2 * (hit / said) * (hit / n) / nullif(hit / said + hit / n, 0), 0), 6) AS f1 FROM c LEFT JOIN q USING (label)")
def multiclass_report(spark, d):
    own = table(spark, d, "documents").select(F.col("lang").alias("y"), F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")).alias("z"))
    return scoring.multiclass_report(own, "y", "z").withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("roc_auc", f"SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM (SELECT y, {_rank_sql('', 'p')} AS r FROM {SCORED})")
def roc_auc(spark, d):
    return scoring.roc_auc(scored(spark, d), "y", "p").select(r6("auc").alias("auc"))


@query("roc_points", f"SELECT round(p, 6) AS score, tp, fp FROM (SELECT DISTINCT p, (count(*) FILTER (y = 1) OVER (ORDER BY p DESC))::BIGINT AS tp, (count(*) FILTER (y = 0) OVER (ORDER BY p DESC))::BIGINT AS fp FROM {SCORED})")
def roc_points(spark, d):
    return scoring.roc_points(scored(spark, d), "y", "p").select(r6("score").alias("score"), "tp", "fp")


@query("regression_report", "SELECT round(avg((l_extendedprice - 1000 * l_quantity) ** 2), 2) AS mse, round(sqrt(avg((l_extendedprice - 1000 * l_quantity) ** 2)), 4) AS rmse, round(avg(abs(l_extendedprice - 1000 * l_quantity)), 4) AS mae, round(1 - avg((l_extendedprice - 1000 * l_quantity) ** 2) / var_pop(l_extendedprice), 6) AS r2 FROM lineitem")
def regression_report(spark, d):
    own = table(spark, d, "lineitem").withColumn("z", F.col("l_quantity") * 1000)
    return scoring.regression_report(own, "l_extendedprice", "z").select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), r6("r2").alias("r2"))


@query("apk_map", """WITH t AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS truth FROM orders GROUP BY 1),
p AS (SELECT k, truth, [x[1:1] || x[2:] FOR x IN ['1-URGENT', '3-MEDIUM', '1-URGENT', '5-LOW']] AS pred FROM t),
h AS (SELECT k, len(truth) AS n, u.i, u.x, list_contains(truth, u.x) AND list_position(pred, u.x) = u.i AS hit FROM p, (SELECT unnest(generate_series(1, 3)) AS i, unnest(['1-URGENT', '3-MEDIUM', '1-URGENT']) AS x) u),
c AS (SELECT k, n, i, hit, count(*) FILTER (hit) OVER (PARTITION BY k ORDER BY i) AS hits FROM h)
SELECT round(avg(ap), 6) AS map FROM (SELECT k, coalesce(sum(hits / i) FILTER (hit), 0) / least(any_value(n), 3) AS ap FROM c GROUP BY k)""")
def apk_map(spark, d):
    own = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("truth"))
    own = own.withColumn("pred", F.array(*map(F.lit, ["1-URGENT", "3-MEDIUM", "1-URGENT", "5-LOW"])))
    return scoring.mean_average_precision(own, "truth", "pred", 3).select(r6("map").alias("map"))


@query("hamming_pairs", "SELECT a.n_nationkey AS i, b.n_nationkey AS j, (a.n_regionkey <> b.n_regionkey)::BIGINT + (a.n_nationkey % 3 <> b.n_nationkey % 3)::BIGINT AS v FROM nation a, nation b")
def hamming_pairs(spark, d):
    return matrix.hamming_pairs(table(spark, d, "nation").withColumn("a", F.array("n_regionkey", F.expr("n_nationkey % 3"))), "n_nationkey", "a")


@query("cosine_rows", "SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS v FROM embeddings a, embeddings b")
def cosine_rows(spark, d):
    return matrix.cosine_rows(table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("v", half_away6("v"))


@query("cosine_columns", " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})), 6) AS v FROM lineitem" for a in LINE_NUMBERS for b in LINE_NUMBERS))
def cosine_columns(spark, d):
    return matrix.cosine_columns(table(spark, d, "lineitem"), LINE_NUMBERS).withColumn("v", r6("v"))


@query("pairwise_difference", "SELECT a.s_suppkey AS i, b.s_suppkey AS j, round(b.s_acctbal - a.s_acctbal, 6) AS v FROM supplier a, supplier b")
def pairwise_difference(spark, d):
    return matrix.pairwise_difference(table(spark, d, "supplier"), "s_suppkey", "s_acctbal").withColumn("v", half_away6("v"))


@query("upper_matrix", "WITH t AS (SELECT [r_regionkey + 1, 2, 3, 4, 5, 6] AS a, r_regionkey AS k FROM region), c AS (SELECT k, i, j, CASE WHEN j >= i THEN a[i * 3 - i * (i - 1) // 2 + j - i + 1] ELSE 0 END AS v FROM t, range(3) x(i), range(3) y(j)) SELECT i::INT AS i, j::INT AS j, sum(v)::BIGINT AS v FROM c GROUP BY 1, 2")
def upper_matrix(spark, d):
    own = table(spark, d, "region").select(F.array(F.col("r_regionkey") + 1, *map(F.lit, (2, 3, 4, 5, 6))).alias("a"))
    return matrix.upper_matrix(own, "a").groupBy("i", "j").agg(F.sum("v").alias("v"))


@query("symmetrize", "WITH m AS (SELECT n_regionkey AS i, n_nationkey % 5 AS j, n_nationkey AS v FROM nation) SELECT i, j, sum(v)::BIGINT AS v FROM (SELECT * FROM m UNION ALL SELECT j, i, v FROM m WHERE i <> j) GROUP BY 1, 2")
def symmetrize(spark, d):
    return matrix.symmetrize(table(spark, d, "nation").select(F.col("n_regionkey").alias("i"), F.expr("n_nationkey % 5").alias("j"), F.col("n_nationkey").alias("v")))


def _names(spark, d):
    return [table(spark, d, "region").select("r_name"), table(spark, d, "region").select("r_name")]


@query("product_k2", "SELECT a.r_name AS x0, b.r_name AS x1 FROM region a, region b")
def product_k2(spark, d):
    return matrix.product(_names(spark, d))


@query("permutations_k2", "SELECT a.r_name AS x0, b.r_name AS x1 FROM region a, region b WHERE a.r_name <> b.r_name")
def permutations_k2(spark, d):
    return matrix.permutations(_names(spark, d))


@query("combinations_k2", "SELECT a.r_name AS x0, b.r_name AS x1 FROM region a, region b WHERE a.r_name < b.r_name")
def combinations_k2(spark, d):
    return matrix.combinations(_names(spark, d), ignore_order=True)


@query("combinations_repl_k2", "SELECT a.r_name AS x0, b.r_name AS x1 FROM region a, region b WHERE a.r_name <= b.r_name")
def combinations_repl_k2(spark, d):
    return matrix.combinations_with_replacement(_names(spark, d), ignore_order=True)


@query("ultrametric", """WITH d AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, abs(a.n_nationkey - b.n_nationkey) % 11 + abs(a.n_regionkey - b.n_regionkey) * 1.5::DOUBLE AS v FROM nation a, nation b)
SELECT d.i, d.j, CASE WHEN d.i = d.j THEN 1.0::DOUBLE ELSE least(any_value(d.v), min(greatest(p.v, q.v))) END AS v FROM d JOIN d p ON p.i = d.i JOIN d q ON q.i = d.j AND q.j = p.j GROUP BY d.i, d.j""")
def ultrametric(spark, d):
    n = table(spark, d, "nation")
    pairs = matrix.in_blocks(n.select("n_nationkey", "n_regionkey"), "n_nationkey", 2, lambda p: p.select(F.col("n_nationkey_a").alias("i"), F.col("n_nationkey_b").alias("j"), (F.abs(F.col("n_nationkey_a") - F.col("n_nationkey_b")) % 11 + F.abs(F.col("n_regionkey_a") - F.col("n_regionkey_b")) * 1.5).alias("v")))
    return matrix.to_ultrametric(pairs)


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("word_counts", f"SELECT word, count(*) AS count FROM (SELECT unnest({TOKENS}) AS word FROM documents) GROUP BY 1")
def word_counts(spark, d):
    return text.count_words(table(spark, d, "documents"), "text")


@query("line_word_counts", r"SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1")
def line_word_counts(spark, d):
    return text.count_words(table(spark, d, "conversations"), "text", lines=True)


@query("bigram_context_w3", f"WITH t AS (SELECT row_number() OVER () AS d, {TOKENS} AS w FROM documents), u AS (SELECT d, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM t) SELECT a.w AS w1, b.w AS w2, count(*) AS count FROM u a JOIN u b ON a.d = b.d AND b.k - a.k BETWEEN 1 AND 2 GROUP BY 1, 2")
def bigram_context_w3(spark, d):
    own = table(spark, d, "documents").select(text.words(F.col("text")).alias("w"))
    return text.bigram_context(own, "w", 3)


@query("bigram_context_unique", f"WITH t AS (SELECT row_number() OVER () AS d, {TOKENS} AS w FROM conversations), u AS (SELECT d, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM t) SELECT least(a.w, b.w) AS w1, greatest(a.w, b.w) AS w2, count(*) AS count FROM u a JOIN u b ON a.d = b.d AND b.k - a.k = 1 GROUP BY 1, 2")
def bigram_context_unique(spark, d):
    own = table(spark, d, "conversations").select(text.words(F.col("text")).alias("w"))
    return text.bigram_context(own, "w", 2, unique=True)


def _tfidf_sql(where: str) -> str:
    return f"SELECT term, sum(k)::BIGINT AS tf, count(*) AS df, (1 + ln(sum(k))) * ln((SELECT count(*) FROM documents WHERE {where}) / (1 + count(*))) AS weight FROM (SELECT doc_id, term, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents WHERE {where}) GROUP BY 1, 2) GROUP BY 1"


@query("corpus_tfidf", f"SELECT term, tf, df, round(weight, 6) AS weight FROM ({_tfidf_sql('true')})")
def corpus_tfidf(spark, d):
    return text.corpus_tfidf(table(spark, d, "documents"), "text").withColumn("weight", r6("weight"))


@query("ziegler_keywords", f"""WITH f AS ({_tfidf_sql("lang = 'de'")}), b AS ({_tfidf_sql("lang <> 'de'")})
SELECT f.term, round(CASE WHEN coalesce(b.weight, 0) = 0 THEN f.weight WHEN f.weight + b.weight > 0 THEN f.weight / b.weight * ln(f.weight + b.weight) END, 5) AS score FROM f LEFT JOIN b USING (term)""")
def ziegler_keywords(spark, d):
    docs = table(spark, d, "documents")
    return text.ziegler_keywords(docs.filter("lang = 'de'"), docs.filter("lang <> 'de'"), "text").withColumn("score", F.round("score", 5))


@query("knn_names", """WITH a AS (SELECT p_partkey AS id, unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]{2,}')) AS term FROM part), b AS (SELECT s_suppkey AS id, unnest(regexp_extract_all(lower(s_name || ' part ' || s_nationkey), '[\\p{L}\\p{N}_]{2,}')) AS term FROM supplier),
ta AS (SELECT id, term, count(*) AS tf FROM a GROUP BY 1, 2), tb AS (SELECT id, term, count(*) AS tf FROM b GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))) + 1 AS idf FROM ta GROUP BY 1),
wa AS (SELECT id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w FROM ta JOIN idf USING (term)), wb AS (SELECT id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w FROM tb JOIN idf USING (term)),
s AS (SELECT wa.id AS a, wb.id AS b, round(sum(wa.w * wb.w), 12) AS sim FROM wa JOIN wb USING (term) GROUP BY 1, 2), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY sim DESC, a) AS r FROM s) WHERE r = 1)
SELECT s_suppkey AS b_id, coalesce(m.a, (SELECT min(p_partkey) FROM part)) AS a_id, round(sqrt(greatest(2 - 2 * coalesce(sim, 0), 0)), 5) AS distance FROM supplier LEFT JOIN m ON b = s_suppkey""")
def knn_names(spark, d):
    own = table(spark, d, "supplier").withColumn("n", F.concat("s_name", F.lit(" part "), F.col("s_nationkey").cast("string")))
    return text.match_names(table(spark, d, "part"), own, "p_partkey", "p_name", "s_suppkey", "n").withColumn("distance", F.round("distance", 5))


ASCII_WORDS = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)"


def ascii_words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


@query("edit_distance_pairs", f"SELECT a.w AS w1, b.w AS w2 FROM {ASCII_WORDS} a JOIN {ASCII_WORDS} b ON a.w < b.w AND abs(length(a.w) - length(b.w)) <= 2 AND levenshtein(a.w, b.w) = 2")
def edit_distance_pairs(spark, d):
    return spelling.edit_distance_pairs(ascii_words(table(spark, d, "benchmark")), "word", 2)


@query("edit_distance_clusters", f"SELECT a.w AS word, string_agg(b.w, ',' ORDER BY b.w) AS near FROM {ASCII_WORDS} a JOIN {ASCII_WORDS} b ON a.w < b.w AND abs(length(a.w) - length(b.w)) <= 1 AND levenshtein(a.w, b.w) = 1 GROUP BY 1")
def edit_distance_clusters(spark, d):
    return flat(spelling.cluster_by_edit_distance(ascii_words(table(spark, d, "benchmark")), "word", 1))


@query("spell_correct", """WITH dict AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) GROUP BY 1), q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations),
m AS (SELECT q.w, dict.w AS c, row_number() OVER (PARTITION BY q.w ORDER BY n DESC, levenshtein(q.w, dict.w), dict.w) AS r FROM q JOIN dict ON abs(length(q.w) - length(dict.w)) <= 1 AND levenshtein(q.w, dict.w) <= 1)
SELECT q.w AS word, coalesce(c, q.w) AS corrected FROM q LEFT JOIN (SELECT * FROM m WHERE r = 1) m ON m.w = q.w""")
def spell_correct(spark, d):
    dictionary = ascii_words(table(spark, d, "benchmark")).groupBy("word").agg(F.count("*").alias("count"))
    return spelling.corrections(ascii_words(table(spark, d, "conversations")), dictionary, 1)


@query("strip_non_ascii", r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS t FROM documents")
def strip_non_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_non_ascii(F.col("text")).alias("t"))


#: The patterns once more, written for the oracle's engine without a look at :mod:`patterns`.
PLAIN_PATTERNS = {
    "linebreak": "\\r+|\\n+", "spaces": "[ \\t\\n\\r\\f\\v][ \\t\\n\\r\\f\\v]+", "number": "\\b[0-9]+([.,][0-9]+)?\\b", "email": "\\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+[.][a-zA-Z0-9.-]+\\b", "postcode_nl": "\\b[0-9][0-9][0-9][0-9][ \\t\\n\\r\\f\\v]?[a-zA-Z][a-zA-Z]\\b",
    "time_of_day": "(2[0-3]|[01]?[0-9]):[0-5][0-9]([ \\t\\n\\r\\f\\v]?[aApP][.]?[mM][.]?)?", "non_ascii": "[^\\x{00}-\\x{7f}]", "url": "((http|https)://(www[.])?)?[a-z0-9]+([.-][a-z0-9]+)*[.][a-z][a-z][a-z]?[a-z]?[a-z]?(:[0-9]{1,5})?(/[^\\n]*)?", "special": "[`!@#*+{}:;'|,<>/\"\\[\\]\\\\]",
    "ordinal": "[0-9]+(th|rd|nd|st)", "version": "\\b([0-9]+[.])?([0-9]+[.])?([*]|[0-9]+)\\b", "copyright": "[(]c[)]|[©®™]", "apostrophe_word": "[a-zA-Z0-9_]+'[a-zA-Z0-9_]+('[a-zA-Z0-9_]+)?", "md5": "[0-9a-fA-F]{32}", "html_tag": "<[^>\\n]*>",
    "repeated_letter": "|".join(f"{x}{{3,}}" for x in "abcdefghijklmnopqrstuvwxyz"),
}


def _regex_query(name: str, t: str, key: str, column: str, oracle: bool = True) -> None:
    body = PLAIN_PATTERNS.get(name, "").replace("'", "''")

    def run(spark, d):
        return table(spark, d, t).select(key, F.concat_ws("|", patterns.extract(F.col(column), name)).alias("found"))

    query(f"regex_{name}", f"SELECT {key}, array_to_string(regexp_extract_all({column}, '{body}'), '|') AS found FROM {t}" if oracle else None)(run)


for _p, _t, _k, _c, _o in (
    ("linebreak", "documents", "doc_id", "text", True), ("spaces", "documents", "doc_id", "text", True), ("number", "pages", "page_id", "url", True), ("email", "documents", "doc_id", "text", True),
    ("postcode_nl", "documents", "doc_id", "text", True), ("single_character", "documents", "doc_id", "text", False), ("time_of_day", "events", "event_id", "props", True), ("non_ascii", "documents", "doc_id", "text", True),
    ("url", "pages", "page_id", "url", True), ("special", "documents", "doc_id", "text", True), ("ordinal", "documents", "doc_id", "text", True), ("version", "documents", "doc_id", "text", True),
    ("copyright", "documents", "doc_id", "text", True), ("repeated_letter", "documents", "doc_id", "text", True), ("repeated_any", "documents", "doc_id", "text", False), ("apostrophe_word", "documents", "doc_id", "text", True),
    ("md5", "documents", "doc_id", "text", True), ("query_keywords", "pages", "page_id", "url", False), ("html_tag", "pages", "page_id", "html", True),
):
    _regex_query(_p, _t, _k, _c, _o)


@query("contraction_expand", "SELECT conv_id, turn, replace(replace(replace(lower(text || ' I can''t go; they''re here, isn''t it'), 'can''t', 'cannot'), 'they''re', 'they are'), 'isn''t', 'is not') AS t FROM conversations")
def contraction_expand(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", contractions.expand(F.concat("text", F.lit(" I can't go; they're here, isn't it"))).alias("t"))


_OWN = "[^abcdefghijklmnopqrstuvwxyz ]"


@query("gibberish_score", f"""WITH c AS (SELECT unnest(list_transform(list_zip(x[:-2], x[2:]), lambda p: p[1] || p[2])) AS b FROM (SELECT string_split(regexp_replace(lower(text), '{_OWN}', '', 'g'), '') AS x FROM documents WHERE lang = 'en')),
g AS (SELECT substr('{ACCEPTED}', i, 1) AS x, substr('{ACCEPTED}', j, 1) AS y FROM range(1, 28) a(i), range(1, 28) b(j)), n AS (SELECT b, count(*) AS n FROM c GROUP BY 1),
l AS (SELECT x || y AS b, ln((coalesce(n, 0) + 10) / sum(coalesce(n, 0) + 10) OVER (PARTITION BY x)) AS l FROM g LEFT JOIN n ON n.b = x || y),
s AS (SELECT item_id, unnest(list_transform(list_zip(x[:-2], x[2:]), lambda p: p[1] || p[2])) AS b FROM (SELECT item_id, string_split(regexp_replace(lower(text), '{_OWN}', '', 'g'), '') AS x FROM benchmark))
SELECT item_id, round(coalesce(exp(avg(l)), 1), 6) AS probability FROM benchmark LEFT JOIN s USING (item_id) LEFT JOIN l USING (b) GROUP BY 1""")
def gibberish_score(spark, d):
    model = GibberishDetector().fit(table(spark, d, "documents").filter("lang = 'en'"))
    return model.transform(table(spark, d, "benchmark")).select("item_id", r6("probability").alias("probability"))


RARE = "WITH t AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS k FROM documents GROUP BY 1), b AS (SELECT *, count(*) FILTER (n > 0.05 * (SELECT count(*) FROM documents)) OVER () AS kept FROM t)"


@query("rare_category_index", f"{RARE} SELECT doc_id, least(k, kept)::DOUBLE AS ix FROM documents JOIN b USING (source)")
def rare_category_index(spark, d):
    own = table(spark, d, "documents").select("doc_id", "source")
    return encode.RareCategoryIndexer(inputCols=["source"], outputCols=["ix"], threshold=0.05, dropInputCols=True).fit(own).transform(own)


@query("rare_category_group", f"{RARE} SELECT doc_id, CASE WHEN k < kept THEN source ELSE 'other' END AS grouped FROM documents JOIN b USING (source)")
def rare_category_group(spark, d):
    own = table(spark, d, "documents").select("doc_id", "source")
    return encode.RareCategoryIndexer(inputCols=["source"], outputCols=["grouped"], threshold=0.05, returnIndexed=False, dropInputCols=True).fit(own).transform(own)


@query("url_clusters", r"""WITH p AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '\d+', '\\d+', 'g'), '(/[^/]+)/[\p{L}][\p{L}_-]*', '\1/[^/]+', 'g') AS pattern FROM pages), n AS (SELECT pattern, count(*) AS n FROM p GROUP BY 1)
SELECT url, CASE WHEN n >= 10 THEN pattern ELSE url END AS pattern, (n < 10)::INTEGER AS unclustered FROM p JOIN n USING (pattern)""")
def url_clusters(spark, d):
    return text.cluster_urls(table(spark, d, "pages"), "url")


@query("compounding_decisions", r"""WITH d AS (SELECT doc_id AS d, string_split(text, ' ') AS t FROM documents), dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark),
p AS (SELECT d, unnest(list_zip(t[:-2], t[2:])) AS p FROM d WHERE len(t) > 1), bi AS (SELECT p[1] AS l, p[2] AS r, count(DISTINCT d) AS n_bigram FROM p GROUP BY 1, 2),
w AS (SELECT d, unnest(t) AS w FROM d), uni AS (SELECT replace(w, '-', '') AS joined, count(DISTINCT d) AS n_joined FROM w GROUP BY 1 HAVING bool_or(w = replace(w, '-', ''))),
c AS (SELECT l, r, l || r AS joined, n_bigram, n_joined, l || r IN (SELECT w FROM dict) AS whole, l IN (SELECT w FROM dict) AND r IN (SELECT w FROM dict) AS both_ FROM bi JOIN uni ON l || r = joined)
SELECT l || ' ' || r AS bigram, joined, n_bigram, n_joined, CASE WHEN abs(n_bigram - n_joined) < 3 THEN NOT whole OR both_ ELSE both_ AND (n_joined <= n_bigram OR NOT whole) END AS make_bigram FROM c""")
def compounding_decisions(spark, d):
    docs = table(spark, d, "documents")
    dictionary = text.count_words(table(spark, d, "benchmark"), "text")
    return text.compounding_decisions(docs, "text", dictionary)


@query("shared_phrases")
def shared_phrases(spark, d):
    return text.extract_phrases(table(spark, d, "conversations"), "conv_id", "turn", "text", 12)


@query("fuzzy_spell_matches")
def fuzzy_spell_matches(spark, d):
    return spelling.fuzzy_matches(ascii_words(table(spark, d, "conversations")), ascii_words(table(spark, d, "benchmark")).distinct(), 90)


@query("topic_words")
def topic_words(spark, d):
    own = table(spark, d, "benchmark").select(text.words(F.col("text")).alias("w"))
    return text.topics(own, "w", 3, 5).select("topic", F.array_join("words", " ").alias("words"))


@query("ols_table", "SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem UNION ALL SELECT '(intercept)', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem")
def ols_table(spark, d):
    return stats.fit_linear(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", True)[1].select("term", F.round("coefficient", 4).alias("coefficient"))


@query("ols_summary")
def ols_summary(spark, d):
    return stats.coefficient_table(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@query("logit_table")
def logit_table(spark, d):
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("kilochars")), "doc_id")
    return stats.coefficient_table(own, ["kilochars"], "quality", "logit")


@query("logit_fit_measures")
def logit_fit_measures(spark, d):
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("kilochars")), "doc_id")
    return stats.logit_summary(own, ["kilochars"], "quality")


@query("regression_diagnostics", """WITH s AS (SELECT *, regr_slope(p_retailprice, p_size) OVER () AS b, regr_intercept(p_retailprice, p_size) OVER () AS a, avg(p_size) OVER () AS m, sum(p_size * p_size) OVER () - count(*) OVER () * avg(p_size) OVER () ** 2 AS sxx, count(*) OVER () AS n FROM part),
e AS (SELECT *, a + b * p_size AS fitted, p_retailprice - a - b * p_size AS residual, 1 / n + (p_size - m) ** 2 / sxx AS leverage FROM s)
SELECT p_partkey AS id, round(fitted, 3) AS fitted, round(residual, 3) AS residual, round(leverage, 6) AS leverage, round(residual / sqrt((sum(residual ** 2) OVER () / (n - 2)) * (1 - leverage)), 4) AS studentized FROM e""")
def regression_diagnostics(spark, d):
    return stats.diagnostics(table(spark, d, "part"), ["p_size"], "p_retailprice", "p_partkey").select("id", F.round("fitted", 3).alias("fitted"), F.round("residual", 3).alias("residual"), r6("leverage").alias("leverage"), F.round("studentized", 4).alias("studentized"))


@query("nullity_corr_spearman", f"WITH n AS (SELECT {_rank_sql('', 'l_quantity')} AS q, (l_discount IS NULL)::INT AS a, (l_tax IS NULL)::INT AS b FROM {GAPPY}) SELECT 'l_quantity' AS col1, 'l_discount_NA' AS col2, round(corr(q, a), 6) AS value FROM n UNION ALL SELECT 'l_quantity', 'l_tax_NA', round(corr(q, b), 6) FROM n UNION ALL SELECT 'l_discount_NA', 'l_tax_NA', round(corr(a, b), 6) FROM n")
def nullity_corr_spearman(spark, d):
    own = correlate.nullity_correlation(gappy_lines(spark, d), "spearman", columns=["l_quantity", "l_discount", "l_tax"])
    return own.filter("col1 IN ('l_quantity', 'l_discount_NA') AND col2 IN ('l_discount_NA', 'l_tax_NA') AND col1 <> col2").withColumn("value", r6("value"))


@query("symmetric_matrix", "WITH t AS (SELECT [r_regionkey + 1, 2, 3, 4, 5, 6] AS a FROM region), c AS (SELECT i, j, a[least(i, j) * 3 - least(i, j) * (least(i, j) - 1) // 2 + greatest(i, j) - least(i, j) + 1] AS v FROM t, range(3) x(i), range(3) y(j)) SELECT i::INT AS i, j::INT AS j, sum(v)::BIGINT AS v FROM c GROUP BY 1, 2")
def symmetric_matrix(spark, d):
    own = table(spark, d, "region").select(F.array(F.col("r_regionkey") + 1, *map(F.lit, (2, 3, 4, 5, 6))).alias("a"))
    return matrix.symmetric_matrix(own, "a").select("i", "j", F.col("v").cast("bigint").alias("v"))


@query("edit_candidates", """WITH w AS (SELECT lower(r_name) AS w FROM region), p AS (SELECT w, i, left(w, i::INT) AS a, substr(w, i::INT + 1) AS b FROM w, range(0, 40) t(i) WHERE i <= length(w)), l AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS c),
e AS (SELECT w, a || substr(b, 2) AS e FROM p WHERE b <> '' UNION SELECT w, a || substr(b, 2, 1) || substr(b, 1, 1) || substr(b, 3) FROM p WHERE length(b) > 1 UNION SELECT w, a || c || substr(b, 2) FROM p, l WHERE b <> '' UNION SELECT w, a || c || b FROM p, l)
SELECT w AS word, e AS candidate FROM e""")
def edit_candidates(spark, d):
    return table(spark, d, "region").select(F.lower("r_name").alias("word")).select("word", F.explode(spelling.edits_1(F.col("word"))).alias("candidate"))


@query("joined_bigrams", "SELECT conv_id, turn, text AS sentence FROM conversations WHERE len(string_split(text, ' ')) > 1")
def joined_bigrams(spark, d):
    own = table(spark, d, "conversations").withColumn("t", F.split("text", " ")).filter(F.size("t") > 1)
    return own.select("conv_id", "turn", text.join_bigrams(text.neighbours(F.col("t"))).alias("sentence"))


@query("roc_fold_curves", f"""WITH s AS (SELECT doc_id % 3 AS fold, quality AS y, 1 / (1 + exp(-(ln(n_chars + 1) - 7))) AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT fold, p, count(*) FILTER (y = 1) AS cp, count(*) FILTER (y = 0) AS cq FROM s GROUP BY 1, 2),
r AS (SELECT fold, cp, cq, sum(cp) OVER w AS tp, sum(cq) OVER w AS fp, sum(cp) OVER (PARTITION BY fold) AS np, sum(cq) OVER (PARTITION BY fold) AS nq FROM c WINDOW w AS (PARTITION BY fold ORDER BY p DESC)),
g AS (SELECT fold, (fp - cq) / nq AS x0, fp / nq AS x1, (tp - cp) / np AS y0, tp / np AS y1 FROM r),
k AS (SELECT fold, k, max(CASE WHEN x1 = x0 THEN y1 ELSE y0 + (y1 - y0) * (k / 99 - x0) / (x1 - x0) END) AS tpr FROM g, range(100) t(k) WHERE k BETWEEN ceil(x0 * 99 - 1e-9) AND floor(x1 * 99 + 1e-9) GROUP BY 1, 2)
SELECT fold::VARCHAR AS fold, round(k / 99, 6) AS fpr, round(tpr, 6) AS tpr FROM k UNION ALL SELECT 'mean', round(k / 99, 6), round(CASE k WHEN 0 THEN 0 WHEN 99 THEN 1 ELSE avg(tpr) END, 6) FROM k GROUP BY k""")
def roc_fold_curves(spark, d):
    own = scored(spark, d).withColumn("fold", F.col("doc_id") % 3)
    return scoring.roc_curves(own, "y", "p", "fold").select(F.coalesce(F.col("fold").cast("string"), F.lit("mean")).alias("fold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("multiclass_metrics", """WITH s AS (SELECT lang AS y, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS z FROM documents), c AS (SELECT y, count(*) AS n, count(*) FILTER (y = z) AS hit FROM s GROUP BY 1), q AS (SELECT z, count(*) AS said FROM s GROUP BY 1)
SELECT 'accuracy' AS name, round((SELECT avg((y = z)::INT) FROM s), 6) AS value UNION ALL SELECT 'weightedPrecision', round(sum(n * coalesce(hit / said, 0)) / sum(n), 6) FROM c LEFT JOIN q ON y = z UNION ALL SELECT 'weightedRecall', round(sum(hit) / sum(n), 6) FROM c
UNION ALL SELECT 'weightedFMeasure', round(sum(n * coalesce(2 * hit / (n + said), 0)) / sum(n), 6) FROM c LEFT JOIN q ON y = z""")
def multiclass_metrics(spark, d):
    own = table(spark, d, "documents").select(F.col("lang").alias("label"), F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")).alias("prediction")).cache()
    names = ("accuracy", "weightedPrecision", "weightedRecall", "weightedFMeasure")
    return spark.createDataFrame([(x, round(scoring.MulticlassEvaluator(x).evaluate(own), 6)) for x in names], "name string, value double")


@query("ingest_narrowed", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def ingest_narrowed(spark, d):
    path = f"{shared_folder(spark)}/ingest-{uuid4().hex}"
    tabular.write_tsv(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    own = tabular.ingest_tsv(spark, path)
    return own.select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), F.col("o_orderstatus").cast("string"))


@query("mahalanobis_classical_distance", """WITH z AS (SELECT p_partkey AS id, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS x, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS y FROM part), m AS (SELECT avg(x * y) AS r FROM z)
SELECT id, round((x * x - 2 * r * x * y + y * y) / (1 - r * r), 5) AS distance FROM z, m""")
def mahalanobis_classical_distance(spark, d):
    return outliers.mahalanobis_outliers(table(spark, d, "part"), ["p_size", "p_retailprice"], "p_partkey", robust=False).select("id", F.round("distance", 5).alias("distance"))


@query("qq_points")
def qq_points(spark, d):
    return stats.qq_points(table(spark, d, "supplier"), "s_acctbal")


@query("mahalanobis_outliers")
def mahalanobis_outliers(spark, d):
    return outliers.mahalanobis_outliers(table(spark, d, "part"), ["p_size", "p_retailprice"], "p_partkey")


@query("mahalanobis_classical")
def mahalanobis_classical(spark, d):
    return outliers.mahalanobis_outliers(table(spark, d, "part"), ["p_size", "p_retailprice"], "p_partkey", robust=False)


@query("jaccard_similarities", """WITH x AS (SELECT c_nationkey AS id, list_distinct(list(c_mktsegment)) AS x FROM customer GROUP BY 1)
SELECT a.id AS i, b.id AS j, round(CASE WHEN a.id = b.id THEN 1.0::DOUBLE ELSE len(list_intersect(a.x, b.x)) / len(list_distinct(a.x || b.x)) - 1 END, 6) AS v FROM x a, x b""")
def jaccard_similarities(spark, d):
    own = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("x"))
    return cluster.jaccard_similarities(own, "c_nationkey", "x").withColumn("v", r6("v"))


def _nation_points(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return matrix.in_blocks(n, "n_nationkey", 2, lambda p: p.select(F.col("n_nationkey_a").alias("i"), F.col("n_nationkey_b").alias("j"), (F.abs(F.col("n_nationkey_a") - F.col("n_nationkey_b")) * 0.1 + F.abs(F.col("n_regionkey_a") - F.col("n_regionkey_b")) * 3.0).alias("v")))


@query("affinity_clusters")
def affinity_clusters(spark, d):
    return cluster.affinity_propagation(_nation_points(spark, d).withColumn("v", -F.col("v")), rounds=15)


@query("hdbscan_clusters")
def hdbscan_clusters(spark, d):
    return cluster.hdbscan(_nation_points(spark, d), 3)


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    return cluster.partition_clusters(table(spark, d, "part"), ["p_size", "p_retailprice"], 4)


@query("random_forest_cv")
def random_forest_cv(spark, d):
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").drop("toxic", "doc_id")
    model = harness.RandomForestBinary({"maxDepth": [2, 4], "numTrees": [5]}, label="quality")
    model.train(own, folds=3)
    return model.importance_frame()


@query("boosted_regression")
def boosted_regression(spark, d):
    model = harness.BoostedRegressor({"maxDepth": [3], "maxIter": [5]}, label="p_retailprice")
    own = table(spark, d, "part").select("p_size", "p_brand", "p_retailprice")
    model.train(own, folds=2)
    return spark.createDataFrame([(k, float(v)) for k, v in model.test(own)[1]["report"].items()], "measure string, value double")


@query("tsv_round_trip", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority, o_totalprice FROM orders")
def tsv_round_trip(spark, d):
    path = f"{shared_folder(spark)}/tsv-{uuid4().hex}"
    own = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("o_orderpriority"), "o_totalprice")
    tabular.write_tsv(own, path)
    return tabular.read_tsv(spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double")


@query("partition_counts", "SELECT count(*) AS n FROM orders")
def partition_counts(spark, d):
    return profile.partition_counts(table(spark, d, "orders")).agg(F.sum("n").alias("n"))
