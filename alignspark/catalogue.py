"""The registered queries of the loading engine and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .capture import active_time_columns, freshness
from .functions import casting, coerce, text
from .operators import dml, outliers, predicates, profile
from .operators.dml import ORDER
from .plans import analyze as planning
from .plans import ddl, fingerprint, mapping
from .plans.model import ColumnSpec, Family, Policies, TableSpec, spec_of
from .streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders")


def _ordered(df: DataFrame, key: str) -> DataFrame:
    """A source whose order column follows a key."""
    return df.withColumn(ORDER, F.col(key).cast("long"))


# --- DML -------------------------------------------------------------------

_CHANGES = """src AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 100 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 = 0
    UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 100 = 1)"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    repriced = o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 100)
    return repriced.unionByName(o.where("o_orderkey % 100 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 1000000))


@query(f"WITH {_CHANGES} SELECT * FROM src UNION ALL SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)")
def upsert_orders(spark: SparkSession, sf: str) -> DataFrame:
    return dml.upsert(_orders(spark, sf), _changes(spark, sf), ["o_orderkey"], [["o_orderkey"]])


@query("""WITH s AS (SELECT o_orderkey // 2 AS k, max(o_orderkey) AS last FROM orders GROUP BY 1), src AS (SELECT k AS o_orderkey, o.o_totalprice FROM s JOIN orders o ON o.o_orderkey = s.last)
    SELECT o.o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN o.o_totalprice ELSE s.o_totalprice END AS o_totalprice FROM orders o LEFT JOIN src s USING (o_orderkey)
    UNION ALL SELECT o_orderkey, o_totalprice FROM src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).select("o_orderkey", "o_totalprice")
    src = _ordered(o, "o_orderkey").withColumn("o_orderkey", F.floor(F.col("o_orderkey") / 2))
    return dml.upsert(o, src, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def upsert_partial_cols(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return dml.upsert(o, o.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("Z").alias("o_orderstatus")), ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_null_overwrites(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).select("o_orderkey", "o_orderstatus")
    return dml.upsert(o, o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit(None).cast("string")), ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT NULL, o_totalprice FROM orders WHERE o_orderkey % 50 = 0")
def upsert_null_key(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).select("o_orderkey", "o_totalprice")
    return dml.upsert(o, o.where("o_orderkey % 50 = 0").withColumn("o_orderkey", F.lit(None).cast("long")), ["o_orderkey"])


@query("""SELECT c_custkey, c_nationkey, max(n) AS n FROM (SELECT c_custkey, c_nationkey, 0 AS n FROM customer UNION ALL SELECT c_custkey, c_nationkey, 1 FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, c_nationkey + 100, 1 FROM customer WHERE c_custkey % 3 = 1) GROUP BY ALL""")
def upsert_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", "c_nationkey", F.lit(0).alias("n"))
    src = c.where("c_custkey % 3 < 2").withColumn("n", F.lit(1)).withColumn("c_nationkey", F.expr("c_nationkey + if(c_custkey % 3 = 1, 100, 0)"))
    return dml.upsert(c, src, ["c_nationkey", "c_custkey"], [["c_custkey", "c_nationkey"]])


@query("SELECT * FROM orders UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 7 = 0")
def insert_append(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    return dml.insert(o, o.where("o_orderkey % 7 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1000000))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, NULL, NULL FROM supplier")
def insert_missing_cols(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "supplier")
    return dml.insert(s, s.select((F.col("s_suppkey") + 1000000).alias("S_SUPPKEY"), "s_name"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice) AS rn FROM lineitem) WHERE rn > 1 OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) AND l_linenumber = 1 GROUP BY ALL")
def insert_pk_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    target = _orders(spark, sf).where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    src = dml.with_order(_t(spark, sf, "lineitem").select(*keys))
    return dml.key_conflicts(target, src, keys).groupBy(*keys).agg(F.count("*").alias("n"))


_ISOLATE = """r AS (SELECT event_id, event_id // 1000 AS chunk, value > 200 AS bad FROM events),
    w AS (SELECT *, sum(CAST(bad AS INT)) OVER (PARTITION BY chunk ORDER BY event_id) AS run FROM r)"""


@query(f"WITH {_ISOLATE} SELECT event_id FROM w WHERE run < 5 AND NOT bad")
def isolation_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    e = _ordered(_t(spark, sf, "events").select("event_id", "value"), "event_id")
    return dml.isolate(e, F.col("value") <= 200, 1000, 5).good.select("event_id")


@query(f"""WITH {_ISOLATE} SELECT chunk, count(*) AS total, CAST(count_if(run < 5 AND NOT bad) AS BIGINT) AS success, CAST(count_if(bad AND run <= 5) AS BIGINT) AS failed,
    CAST(count_if(NOT (run < 5 AND NOT bad) AND NOT (bad AND run <= 5)) AS BIGINT) AS unprocessed FROM w GROUP BY chunk""")
def isolation_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = _ordered(_t(spark, sf, "events").select("event_id", "value"), "event_id")
    return dml.isolate(e, F.col("value") <= 200, 1000, 5).summary.withColumnRenamed("_chunk", "chunk")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 'debt' ELSE c_name END AS c_name, c_acctbal FROM customer")
def update_literal(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer")
    src = spark.createDataFrame([("debt",)], "c_name string")
    return dml.update(c, src, [("c_mktsegment", "=", "BUILDING"), "c_acctbal < 0"]).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def update_placeholder(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).select("o_orderkey", "o_totalprice", "o_orderstatus")
    return dml.update(o, o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")), ["o_orderkey = ?"])


@query("SELECT p_partkey, CASE WHEN p_retailprice BETWEEN 1000 AND 1200 THEN 'mid' ELSE p_brand END AS p_brand FROM part")
def update_between(spark: SparkSession, sf: str) -> DataFrame:
    return dml.update(_t(spark, sf, "part"), spark.createDataFrame([("mid",)], "p_brand string"), [("p_retailprice", "BETWEEN", (1000.0, 1200.0))]).select("p_partkey", "p_brand")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 9000 AND c_nationkey <= 20 THEN 3 WHEN c_acctbal >= 5000 THEN 2 WHEN c_acctbal >= 1000 THEN 1 ELSE 0 END AS tier FROM customer")
def update_range_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", F.lit(0).alias("tier"), F.lit(0.0).alias("least"), F.lit(99).alias("most"))
    c = c.withColumn("least", F.col("c_acctbal")).withColumn("most", F.col("c_nationkey"))
    src = spark.createDataFrame([(1000.0, 99, 1, 1), (5000.0, 99, 2, 2), (9000.0, 20, 3, 3)], f"least double, most int, tier int, {ORDER} long")
    out = c
    for r in (1, 2, 3):  # rows that set the columns they test go one at a time
        out = dml.update(out.withColumn("least", F.col("c_acctbal")).withColumn("most", F.col("c_nationkey")), src.where(F.col("tier") == r), [("least", ">=", "?"), ("most", "<=", "?")])
    return out.select("c_custkey", "tier")


@query("SELECT count(*) AS updated FROM lineitem l JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0) s ON l.l_orderkey = s.o_orderkey")
def update_rowcount(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).select(F.col("o_orderkey").alias("l_orderkey"))
    src = o.where("l_orderkey % 5 = 0").unionByName(o.where("l_orderkey % 10 = 0"))
    return dml.update_count(_t(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), src, ["l_orderkey = ?"])


@query("SELECT * FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 20 = 0)")
def track_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    return dml.snapshot(o, o.where("o_custkey % 20 = 0"), ["o_orderkey"])


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 200 = 0) AND c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey % 200 = 0)")
def track_composite_superset(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return dml.snapshot(c, c.where("c_custkey % 200 = 0"), ["c_nationkey", "c_mktsegment"])


@query("SELECT c_custkey FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE c_custkey % 200 = 0)")
def track_composite_exact(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return dml.snapshot(c, c.where("c_custkey % 200 = 0"), ["c_nationkey", "c_mktsegment"], exact=True).select("c_custkey")


@query("SELECT s_suppkey, s_name, s_acctbal, TIMESTAMP '2024-01-02 03:04:05' AS track_inserted_at FROM supplier WHERE s_suppkey % 9 = 0")
def tracker_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return dml.tracker_rows(s, s.where("s_suppkey % 9 = 0"), ["s_suppkey"], F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))


@query("SELECT c_custkey, c_name, coalesce(CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 'NEW' END, c_mktsegment) AS c_mktsegment FROM customer")
def coalesce_update(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    src = c.where("c_custkey % 4 = 0").select("c_custkey", F.expr("if(c_custkey % 8 <> 0, 'NEW', NULL)").alias("c_mktsegment"))
    return profile.coalesce_update(c, src, ["c_custkey"])


# --- predicates ------------------------------------------------------------


def _where(name: str, sql: str, table: str, items, expression: str | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return predicates.select(_t(spark, sf, table), items, expression)

    run.__name__ = name
    query(f"SELECT * FROM {table} WHERE {sql}")(run)


_where("where_eq", "o_orderstatus = 'F'", "orders", ["o_orderstatus = 'F'"])
_where("where_ne", "o_orderstatus <> 'F'", "orders", [("o_orderstatus", "!=", "F")])
_where("where_gt", "o_totalprice > 200000", "orders", ["o_totalprice > 200000"])
_where("where_ge", "p_size >= 40", "part", [{"field": "P_SIZE", "operator": ">=", "value": 40}])
_where("where_lt", "c_acctbal < 0", "customer", [("c_acctbal", "<", 0)])
_where("where_le", "p_size <= 3", "part", ["p_size <= 3"])
_where("where_between", "o_totalprice BETWEEN 50000 AND 60000", "orders", ["o_totalprice BETWEEN '50000' and '60000'"])
_where("where_in", "c_mktsegment IN ('BUILDING', 'MACHINERY')", "customer", [("c_mktsegment", "IN", "('BUILDING','MACHINERY')")])
_where("where_in_empty", "c_acctbal < 0", "customer", [("c_mktsegment", "IN", []), ("c_acctbal", "<", 0)], "1 OR 2")
_where("where_like", "contains(c_name, '99')", "customer", [("c_name", "LIKE", "99")])
_where("where_null", "o_orderstatus = NULL OR o_orderpriority = '1-URGENT'", "orders", [("o_orderstatus", "=", None), ("o_orderpriority", "=", "1-URGENT")], "1 OR 2")
_where("where_expression", "o_orderstatus = 'F' AND (o_totalprice > 300000 OR o_orderpriority = '1-URGENT') AND NOT o_custkey <= 100", "orders", ["o_orderstatus = 'F'", "o_totalprice > 300000", ("o_orderpriority", "=", "1-URGENT"), "o_custkey <= 100"], "1 AND (2 OR 3) AND NOT 4")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey >= 2")
def where_join(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation").withColumnRenamed("n_regionkey", "rk")
    r = _t(spark, sf, "region").withColumnRenamed("r_regionkey", "rk")
    return n.join(r, predicates.where(n, ["rk = ?"], None, r)).where(r["rk"] >= 2).select("n_name", "r_name")


@query("SELECT p_partkey, name FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a_1%b' WHEN 1 THEN 'ax1%b' WHEN 2 THEN 'a_1xb' ELSE p_name END AS name FROM part) WHERE contains(name, '_1%')")
def where_like_escape(spark: SparkSession, sf: str) -> DataFrame:
    """Names that differ only where a wild card would match."""
    kind = F.col("p_partkey") % 4
    names = _t(spark, sf, "part").select("p_partkey", F.when(kind == 0, "a_1%b").when(kind == 1, "ax1%b").when(kind == 2, "a_1xb").otherwise(F.col("p_name")).alias("name"))
    return predicates.select(names, [("name", "LIKE", "_1%")])


# --- outliers --------------------------------------------------------------

_Q = "b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM events), lim AS (SELECT a - 1.5 * (c - a) AS lo, c + 1.5 * (c - a) AS hi FROM b)"
_BAD = "(value < lo OR value > hi)"


@query(f"WITH {_Q} SELECT event_id, value FROM events, lim WHERE NOT {_BAD}")
def outlier_iqr_drop(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.treat(_t(spark, sf, "events").select("event_id", "value"), ["value"], "drop")


@query(f"WITH {_Q} SELECT event_id, CASE WHEN {_BAD} THEN NULL ELSE value END AS value FROM events, lim")
def outlier_iqr_nullify(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.treat(_t(spark, sf, "events").select("event_id", "value"), ["value"], "nullify")


@query(f"WITH {_Q} SELECT event_id, round(greatest(least(value, hi), lo), 6) AS value FROM events, lim")
def outlier_iqr_clip(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.treat(_t(spark, sf, "events").select("event_id", "value"), ["value"], "clip").withColumn("value", F.round("value", 6))


@query("SELECT event_id, abs(0.6745 * (value - m) / d) > 3 AS flagged FROM events, (SELECT median(value) AS m, mad(value) AS d FROM events)")
def outlier_mad(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.flag(_t(spark, sf, "events"), ["value"], "mad").select("event_id", F.col(outliers.FLAG).alias("flagged"))


@query("SELECT event_id, abs((value - m) / d) > 3 AS flagged FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)")
def outlier_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.flag(_t(spark, sf, "events"), ["value"], "zscore").select("event_id", F.col(outliers.FLAG).alias("flagged"))


@query(f"WITH {_Q}, u AS (SELECT quantile_cont(user_id, 0.25) AS a, quantile_cont(user_id, 0.75) AS c FROM events) SELECT event_id FROM events, lim, u WHERE {_BAD} AND (user_id < a - 0.2 * (c - a) OR user_id > c + 0.2 * (c - a)) AND (value < lo OR value > hi)")
def outlier_all_rule(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    limits = outliers.bounds(e, ["value"]) | outliers.bounds(e, ["user_id"], factor=0.2)
    return outliers.flag(e, ["value", "user_id"], rule="all", limits=limits).where(outliers.FLAG).select("event_id")


@query(f"WITH {_Q} SELECT count(*) AS total_rows, CAST(count_if({_BAD}) AS BIGINT) AS outlier_rows, count_if({_BAD}) / count(*) <= 0.05 AS within_cap FROM events, lim")
def outlier_cap(spark: SparkSession, sf: str) -> DataFrame:
    ok, s = outliers.within_cap(_t(spark, sf, "events").select("value"), ["value"])
    return spark.createDataFrame([(s.total_rows, s.outlier_rows, ok)], "total_rows long, outlier_rows long, within_cap boolean")


@query("WITH b AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS c FROM documents) SELECT doc_id, CASE WHEN n_chars < a - 1.5 * (c - a) OR n_chars > c + 1.5 * (c - a) THEN 0.0 ELSE n_chars END AS n_chars FROM documents, b")
def outlier_zero(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.zero_outliers(_t(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("string")), "n_chars")


# --- aggregates, profiles, keys --------------------------------------------


def _describe_sql(table: str, columns: list[str]) -> str:
    one = "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {t}"
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


@query(_describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def describe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    d = profile.describe(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return d.select("column", "count", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", *(F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")), "max")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", max(length({c})) AS max_length, min(length({c})) AS min_length, round(avg(length({c})), 6) AS avg_length FROM documents" for c in ("text", "lang", "source")))
def string_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return profile.string_lengths(_t(spark, sf, "documents"), ["text", "lang", "source"]).withColumn("avg_length", F.round("avg_length", 6))


def _profile_sql(table: str, columns: dict[str, bool]) -> str:
    one = "SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count, count(DISTINCT {c}) / count({c}) <= 0.1 AS is_categorical, count(DISTINCT {c}) = count({c}) AS all_unique, {d} AS is_datetime FROM {t}"
    return " UNION ALL ".join(one.format(c=c, t=table, d=str(d).lower()) for c, d in columns.items())


def _profiled(df: DataFrame) -> DataFrame:
    return profile.profile(df).select("column", "null_count", "non_null", "distinct_count", "is_categorical", "all_unique", "is_datetime")


@query(_profile_sql("orders", {"o_orderkey": False, "o_custkey": False, "o_orderstatus": False, "o_totalprice": False, "o_orderdate": True, "o_orderpriority": False}))
def profile_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _profiled(_orders(spark, sf))


@query(_profile_sql("(SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, nullif(event_type, 'click') AS kind FROM events)", {"event_id": False, "day": True, "kind": False}))
def profile_events(spark: SparkSession, sf: str) -> DataFrame:
    return _profiled(_t(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.nullif("event_type", F.lit("click")).alias("kind")))


@query("SELECT 'o_orderkey' AS name, true AS is_unique")
def pk_infer_orders(spark: SparkSession, sf: str) -> DataFrame:
    k = profile.infer_key(_orders(spark, sf))
    return spark.createDataFrame([(k.name, k.unique)], "name string, is_unique boolean")


@query()
def pk_infer_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    k = profile.infer_key(_t(spark, sf, "lineitem"))
    return spark.createDataFrame([(",".join(k.columns), k.unique, len(k.tested))], "columns string, is_unique boolean, tested int")


@query("""SELECT 'conv_id,turn' AS columns, count(*) = 0 AS is_unique FROM (SELECT conv_id, turn FROM conversations GROUP BY ALL HAVING count(*) > 1)""")
def pk_composite(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.minimal_keys(_t(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn", "role"])
    return spark.createDataFrame([(",".join(c), True) for c in found], "columns string, is_unique boolean")


@query("SELECT c_custkey, replace(replace(c_name, '\\', '\\\\'), '|', '\\|') || '|' || CAST(c_custkey AS VARCHAR) || '|' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'None') AS pk FROM customer")
def pk_composite_value(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return profile.add_key(c, ["c_name", "c_custkey", "seg"]).select("c_custkey", "pk")


@query("SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def dup_key_count(spark: SparkSession, sf: str) -> DataFrame:
    return profile.duplicate_count(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT CAST(count_if(o_orderkey % 13 = 0) AS BIGINT) AS k, 0 AS o_custkey FROM orders")
def pk_null_count(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_counts(_orders(spark, sf).select(F.expr("if(o_orderkey % 13 = 0, NULL, o_orderkey)").alias("k"), "o_custkey"), ["k", "o_custkey"])


@query("SELECT count(*) AS orphans FROM orders WHERE o_custkey % 2 = 0")
def fk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return profile.orphan_count(_orders(spark, sf), _t(spark, sf, "customer").where("c_custkey % 2 = 1").unionByName(_t(spark, sf, "customer").where("false")), ["o_custkey"], ["c_custkey"])


_HT = "n AS (SELECT greatest(1, CAST(floor(count(*) * 10 / 200) AS BIGINT)) AS k, count(*) AS n FROM orders)"


@query(f"WITH {_HT} SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders), n WHERE rn <= k OR rn > n - k")
def sample_head_tail(spark: SparkSession, sf: str) -> DataFrame:
    return profile.head_tail(_orders(spark, sf), ["o_orderkey"], 10.0).select("o_orderkey", "o_totalprice")


# --- cleaning --------------------------------------------------------------

@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'NULL' ELSE c_name END AS name FROM customer")
def clean_tokens_trim(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.when(F.col("c_custkey") % 5 == 0, "null").when(F.col("c_custkey") % 5 == 1, " NULL ").otherwise(F.concat(F.lit("\t "), "c_name", F.lit("\n ")))
    return _t(spark, sf, "customer").select("c_custkey", text.clean_text(dirty, text.CleaningConfig(normalize_unicode=None)).alias("name"))


@query("SELECT p_partkey, concat('\"', p_name, '\"-A... ok') AS name FROM part")
def clean_smart_chars(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.concat(F.lit("“​"), "p_name", F.lit("”—А… ok"))
    return _t(spark, sf, "part").select("p_partkey", text.clean_text(dirty).alias("name"))


@query("SELECT s_suppkey, s_name AS name FROM supplier")
def clean_control_chars(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "supplier").select("s_suppkey", text.clean_text(F.concat(F.lit("\x01\x1f"), "s_name", F.lit("\x7f\x85"))).alias("name"))


@query("SELECT doc_id, regexp_replace(lang, '[^\\w\\s]', '', 'g') AS lang, length(trim(regexp_replace(source, '[0-9]', '', 'g'))) AS n FROM documents")
def clean_special(spark: SparkSession, sf: str) -> DataFrame:
    config = text.CleaningConfig(remove_special_chars=True)
    return _t(spark, sf, "documents").select("doc_id", text.clean_text(F.concat(F.lit("#"), "lang", F.lit("!")), config).alias("lang"), F.length(F.regexp_replace("source", "[0-9]", "")).alias("n"))


@query()
def clean_unicode(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", text.normalize_text("text").alias("text"))


@query("SELECT * FROM (VALUES ('Total ($)', 'Total'), ('a  b', 'a_b'), ('a-b', 'a_b_1'), ('__x__', 'x'), ('!!', 'col_5')) AS t(before, after)")
def clean_header_names(spark: SparkSession, sf: str) -> DataFrame:
    names = ["Total ($)", "a  b", "a-b", "__x__", "!!"]
    return spark.createDataFrame(list(zip(names, text.clean_headers(names), strict=True)), "before string, after string")


@query("SELECT * FROM (VALUES ('ORDER', 'order_'), ('User Name', 'user name'), ('123Col', '_col_1'), ('_Hidden', 'hidden'), ('x.y', 'x_y'), ('x/y', 'x_y_1')) AS t(before, after)")
def sanitize_headers(spark: SparkSession, sf: str) -> DataFrame:
    names = ["ORDER", "User Name", "123Col", "_Hidden", "x.y", "x/y"]
    return spark.createDataFrame(list(zip(names, text.sanitize_names(names), strict=True)), "before string, after string")


# --- casting ---------------------------------------------------------------


@query("SELECT p_partkey, round(p_retailprice, 2) AS price FROM part")
def cast_numeric_currency(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.concat(F.lit("$ "), F.format_number("p_retailprice", 2))
    return casting.cast_frame(_t(spark, sf, "part").select("p_partkey", dirty.alias("price")))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' ELSE NULL END AS active FROM customer")
def cast_bool_tokens(spark: SparkSession, sf: str) -> DataFrame:
    token = F.element_at(F.array(F.lit("Yes"), F.lit("off"), F.lit("T"), F.lit("maybe")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return _t(spark, sf, "customer").select("c_custkey", casting.cast_to(token, "boolean").cast("string").alias("active"))


@query("SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS order_date FROM orders")
def cast_dates(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = casting.cast_frame(_orders(spark, sf).select("o_orderkey", shown.alias("order_date")))
    return out.withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'n/k' ELSE CAST(p_size AS VARCHAR) END AS size FROM part")
def cast_guard_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return casting.cast_frame(_t(spark, sf, "part").select("p_partkey", F.expr("if(p_partkey % 4 = 0, 'n/k', cast(p_size as string))").alias("size")))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'date' WHEN 2 THEN 'boolean' WHEN 3 THEN 'integer' ELSE 'float' END AS kind FROM orders) GROUP BY kind")
def cast_value_kinds(spark: SparkSession, sf: str) -> DataFrame:
    v = F.expr("CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 2 THEN 'Yes' WHEN 3 THEN cast(o_orderkey as string) ELSE concat(o_orderkey, '.5') END")
    return _orders(spark, sf).groupBy(casting.value_kind(v).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT 'a' AS name, 'bigint' AS kind UNION ALL SELECT 'b', 'double' UNION ALL SELECT 'c', 'boolean' UNION ALL SELECT 'd', 'timestamp'")
def cast_segment(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select(F.col("p_size").cast("string").alias("a"), F.concat(F.col("p_size"), F.lit(".25")).alias("b"), F.expr("if(p_size > 20, 'yes', 'no')").alias("c"), F.lit("2024-02-03 04:05:06").alias("d"), "p_name")
    return spark.createDataFrame(sorted(casting.infer_types(p, casting.CastConfig(mode="segment")).items()), "name string, kind string")


@query("SELECT event_id, json_valid(props) AS is_json FROM events")
def json_validity(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", casting.is_json(F.col("props")).alias("is_json"))


# --- coercion --------------------------------------------------------------


def _coerced(df: DataFrame, column: str, spec: ColumnSpec, policies: Policies | None = None):
    return coerce.coerce(F.col(column), df.schema[column].dataType, spec, policies)


@query("SELECT doc_id, substr(text, 1, 40) AS text FROM documents")
def coerce_truncate(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    return d.select("doc_id", _coerced(d, "text", ColumnSpec("text", Family.STRING, max_length=40)).alias("text"))


@query("SELECT p_partkey, CAST(round_even(p_size / 2, 0) AS BIGINT) AS half FROM part")
def coerce_round_half_even(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") / 2).alias("half"))
    return p.select("p_partkey", _coerced(p, "half", ColumnSpec("half", Family.INTEGER)).alias("half"))


@query("SELECT o_orderkey, CAST(greatest(least(o_totalprice, 99999.99), -99999.99) AS DOUBLE) AS price FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice FROM orders)")
def coerce_precision_clip(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return o.select("o_orderkey", _coerced(o, "price", ColumnSpec("price", Family.DECIMAL, precision=7, scale=2)).cast("double").alias("price"))


@query("SELECT event_id, CAST(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC' AS TIMESTAMP) AS at FROM events")
def coerce_epoch(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", (F.col("event_id") + 1700000000).alias("at"))
    zoned = ColumnSpec("at", Family.DATETIME, zone=True)
    return e.select("event_id", F.convert_timezone(F.current_timezone(), F.lit("UTC"), _coerced(e, "at", zoned).cast("timestamp_ntz")).alias("at"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE '"' || event_type || ' \\"x\\""' END AS props FROM events""")
def coerce_json(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", F.expr("""if(event_id % 2 = 0, props, concat(event_type, ' "x"'))""").alias("props"))
    return e.select("event_id", _coerced(e, "props", ColumnSpec("props", Family.JSON)).alias("props"))


@query("SELECT doc_id, least(octet_length(encode(text)), 25) AS n FROM documents")
def coerce_binary_len(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.octet_length(_coerced(d, "text", ColumnSpec("text", Family.BINARY, max_length=25))).alias("n"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE NULL END AS flag FROM customer")
def coerce_boolean(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", F.element_at(F.array(F.lit("ON"), F.lit("n"), F.lit("?")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("flag"))
    return c.select("c_custkey", _coerced(c, "flag", ColumnSpec("flag", Family.BOOLEAN)).cast("string").alias("flag"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS c_name FROM customer")
def coerce_fill_not_null(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", F.expr("if(c_custkey % 2 = 0, NULL, c_nationkey)").alias("c_nationkey"), F.expr("if(c_custkey % 2 = 0, NULL, c_name)").alias("c_name"))
    p = Policies()
    p.columns.fill_not_null = True
    spec = TableSpec("c", {"c_custkey": ColumnSpec("c_custkey", Family.INTEGER), "c_nationkey": ColumnSpec("c_nationkey", Family.INTEGER, False), "c_name": ColumnSpec("c_name", Family.STRING, False)})
    return coerce.coerce_frame(c, spec, p)[0]


# --- alignment, schema -----------------------------------------------------


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def align_columns(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "supplier")
    spec = spec_of(s.select("s_suppkey", "s_name", "s_acctbal").schema, "supplier")
    frame = s.select(F.col("s_name").alias("S_NAME"), F.col("s_suppkey").alias("s_SuppKey"), F.col("s_acctbal").alias("s_acctbal_"), F.lit(1).alias("ghost"))
    found, _, _ = mapping.match_columns(frame.columns, list(spec.columns), 0.5)
    return coerce.coerce_frame(frame, spec, rename={m.source: m.target for m in found})[0].select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT n_nationkey, n_name FROM nation")
def drop_extra_cols(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    return coerce.coerce_frame(n.withColumn("ghost", F.lit(1)), spec_of(n.select("n_nationkey", "n_name").schema, "nation"))[0]


@query("SELECT 'COLUMN_LENGTH_OVERFLOW' AS code, 'text' AS column_name, 'warning' AS severity UNION ALL SELECT 'EXTRA_DF_COLUMN', 'n_chars', 'info' UNION ALL SELECT 'MISSING_DB_COLUMN', 'title', 'warning' UNION ALL SELECT 'COLUMN_TYPE_MISMATCH', 'lang', 'warning'")
def analyze_issues(spark: SparkSession, sf: str) -> DataFrame:
    spec = TableSpec("d", {"doc_id": ColumnSpec("doc_id", Family.INTEGER), "text": ColumnSpec("text", Family.STRING, max_length=5), "lang": ColumnSpec("lang", Family.INTEGER), "source": ColumnSpec("source", Family.STRING), "title": ColumnSpec("title", Family.STRING)})
    found = planning.analyze(_t(spark, sf, "documents"), spec)
    return spark.createDataFrame([(i.code.value, i.column, i.severity.value) for i in found.issues], "code string, column_name string, severity string")


@query("SELECT 'ADD_COLUMN' AS kind, 'n_chars' AS column_name, true AS safe UNION ALL SELECT 'WIDEN_COLUMN', 'text', true")
def ddl_plan_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    spec = spec_of(docs.drop("n_chars").schema, "documents")
    spec.columns["text"].max_length = 5
    changes = planning.plan_changes(docs, planning.analyze(docs, spec))
    return spark.createDataFrame([(c.kind, c.column, c.safe) for c in changes], "kind string, column_name string, safe boolean")


@query()
def ddl_text(spark: SparkSession, sf: str) -> DataFrame:
    spec = spec_of(_orders(spark, sf).schema, "orders")
    return spark.createDataFrame([(d, s) for d in ddl.DIALECTS for s in ddl.create_table(spec, d)], "dialect string, sql string")


@query()
def fingerprint_tables(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(t, fingerprint.fingerprint(spec_of(_t(spark, sf, t).schema, t)).digest) for t in ("orders", "lineitem", "customer", "events")]
    return spark.createDataFrame(rows, "table_name string, digest string")


@query("SELECT 'price' AS added, 'o_orderpriority' AS removed, 'o_custkey' AS modified")
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    after = o.drop("o_orderpriority").withColumn("price", F.lit(1.0)).withColumn("o_custkey", F.col("o_custkey").cast("string"))
    d = fingerprint.diff(fingerprint.fingerprint(spec_of(o.schema, "o")), fingerprint.fingerprint(spec_of(after.schema, "o")))
    return spark.createDataFrame([(",".join(d.added), ",".join(d.removed), ",".join(d.modified))], "added string, removed string, modified string")


@query()
def data_digest(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.data_digest(_t(spark, sf, "lineitem"))


# --- verification ----------------------------------------------------------

_SLICES = "n AS (SELECT count(*) AS n FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS o FROM part)"


@query(f"WITH {_SLICES} SELECT p_partkey, o < floor(n * 0.6) AS in_insert, o >= floor(n * 0.3) AND o < floor(n * 0.8) AS in_upsert, o IN (0, floor(n * 0.4), floor(n * 0.7)) AS in_update FROM r, n")
def harness_slices(spark: SparkSession, sf: str) -> DataFrame:
    p = dml.with_order(_t(spark, sf, "part"), ["p_partkey"])
    return profile.harness_slices(p, p.count()).select("p_partkey", "in_insert", "in_upsert", "in_update")


@query("SELECT o_orderkey, o_custkey + 1 AS o_custkey, o_orderstatus || '_upd' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate + INTERVAL 1 DAY AS o_orderdate, o_orderpriority || '_upd' AS o_orderpriority FROM orders")
def harness_mutation(spark: SparkSession, sf: str) -> DataFrame:
    return profile.mutate_frame(_orders(spark, sf), ["o_orderkey"])


@query(f"WITH {_SLICES}, c AS (SELECT p_partkey, p_name, p_size, o, n, o >= floor(n * 0.3) AND o < floor(n * 0.6) AS m, o IN (0, floor(n * 0.4), floor(n * 0.7)) AS u FROM r, n WHERE o < floor(n * 0.8)) SELECT p_partkey, p_name || CASE WHEN m THEN '_upd' ELSE '' END || CASE WHEN u THEN '_fin' ELSE '' END AS p_name, p_size + CAST(m AS INT) + CAST(u AS INT) AS p_size FROM c")
def harness_expected_cycle(spark: SparkSession, sf: str) -> DataFrame:
    from .harness import expected_states

    p = dml.with_order(_t(spark, sf, "part").select("p_partkey", "p_name", "p_size"), ["p_partkey"])
    return expected_states(p, ["p_partkey"], p.count())["update"].drop(ORDER)


@query("SELECT CAST(count_if(s_suppkey % 7 = 0) AS BIGINT) AS missing, 0 AS unexpected, CAST(count_if(s_suppkey % 7 <> 0 AND s_suppkey % 5 = 0) AS BIGINT) AS different, CAST(count_if(s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0) AS BIGINT) AS equal FROM supplier")
def compare_frames(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "supplier")
    actual = s.where("s_suppkey % 7 <> 0").withColumn("s_acctbal", F.expr("if(s_suppkey % 5 = 0, s_acctbal + 1000, s_acctbal * (1 + 1e-9))"))
    return profile.compare(actual, s, ["s_suppkey"])


@query("SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def set_difference_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("o_custkey").exceptAll(_t(spark, sf, "customer").where("c_custkey % 3 = 0").select("c_custkey"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionByName(_t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


# --- monitoring, streams ---------------------------------------------------


@query("SELECT 'orders' AS table_name, max(o_orderdate) AS latest FROM orders UNION ALL SELECT 'events', max(ts) FROM events UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem")
def freshness_max_ts(spark: SparkSession, sf: str) -> DataFrame:
    return freshness({"orders": (_orders(spark, sf), "o_orderdate"), "events": (_t(spark, sf, "events"), "ts"), "lineitem": (_t(spark, sf, "lineitem"), "l_shipdate")})


@query("SELECT * FROM (VALUES ('orders', 'o_orderdate', 'timestamp_ntz'), ('events', 'ts', 'timestamp_ntz')) AS t(table_name, column_name, data_type)")
def active_join_timecols(spark: SparkSession, sf: str) -> DataFrame:
    names = ("orders", "events", "part", "lineitem")
    catalog = spark.createDataFrame([(t, c, d) for t in names for c, d in _t(spark, sf, t).dtypes], "table_name string, column_name string, data_type string")
    tables = spark.createDataFrame([("orders", 10), ("events", 9), ("part", 8), ("lineitem", 1)], "table_name string, modified_at int")
    return active_time_columns(tables, catalog, 5).select("table_name", "column_name", "data_type")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return watch.windowed_counts(_t(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = watch.sessions(_t(spark, sf, "events"), gap="6 hours")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The events table read as a stream to its end, counted in the shared memory sink."""
    import uuid

    name = f"counts_{uuid.uuid4().hex}"
    schema: T.StructType = _t(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parq*")
    q = stream.groupBy("event_type").agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
