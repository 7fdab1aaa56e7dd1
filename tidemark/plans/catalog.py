"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .. import Database, P, Policies, TableSchema, external
from ..functions.schema import RECORD_ID
from ..lifecycle import Lease
from ..operators import verbs
from ..streaming.changes import changes, count_trigger, stream, summary_trigger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return keep


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def over(spark, sf, name, df=None):
    return external(read(spark, sf, name) if df is None else df, name=name)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most expensive open orders."""
    return over(spark, sf, "orders").where(P.eq("o_orderstatus", "O") & P.gt("o_totalprice", 100000.0)).order_by_desc("o_totalprice").then_by("o_orderkey").take(10).df()


query("SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(flagship)


@query("SELECT * FROM region")
def scan_all_region(spark, sf):
    return over(spark, sf, "region").df()


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(spark, sf):
    return over(spark, sf, "customer").where(P.eq("c_mktsegment", "BUILDING")).select("c_custkey", "c_mktsegment").df()


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
def filter_ne(spark, sf):
    return over(spark, sf, "customer").where(P.ne("c_mktsegment", "BUILDING")).select("c_custkey", "c_mktsegment").df()


def _size(op, sql):
    def f(spark, sf):
        return over(spark, sf, "part").where(getattr(P, op)("p_size", 25)).select("p_partkey", "p_size").df()

    f.__name__ = f"filter_{op}"
    query(f"SELECT p_partkey, p_size FROM part WHERE p_size {sql} 25")(f)


for _op, _sql in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _size(_op, _sql)


@query("SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-07-01'")
def filter_ts_range(spark, sf):
    return over(spark, sf, "lineitem").where(P.ge("l_shipdate", dt.datetime(1995, 1, 1))).where(P.lt("l_shipdate", dt.datetime(1995, 7, 1))).select("l_orderkey", "l_shipdate").df()


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 49)")
def filter_in_int(spark, sf):
    return over(spark, sf, "part").where(P.isin("p_size", [1, 5, 49])).select("p_partkey", "p_size").df()


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('FRANCE', 'GERMANY', 'NATION_3', 'nowhere')")
def filter_in_str(spark, sf):
    return over(spark, sf, "nation").where(P.isin("n_name", ["FRANCE", "GERMANY", "NATION_3", "nowhere"])).select("n_nationkey", "n_name").df()


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IN (TIMESTAMP '1995-01-01', TIMESTAMP '1996-06-15', TIMESTAMP '1997-03-03')")
def filter_in_ts(spark, sf):
    return over(spark, sf, "orders").where(P.isin("o_orderdate", [dt.datetime(1995, 1, 1), dt.datetime(1996, 6, 15), dt.datetime(1997, 3, 3)])).select("o_orderkey", "o_orderdate").df()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def filter_not_in(spark, sf):
    return over(spark, sf, "orders").where(P.notin("o_orderstatus", ["O", "F"])).select("o_orderkey", "o_orderstatus").df()


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 3 = 0 AND o_custkey < 4500")
def filter_in_long_list(spark, sf):
    """An IN list too long for the plan: a semi-join."""
    return over(spark, sf, "orders").where(P.isin("o_custkey", range(0, 4500, 3))).select("o_custkey", "o_orderkey").df()


@query("SELECT p_partkey FROM part WHERE p_size <= 10 AND p_retailprice >= 905")
def filter_and(spark, sf):
    return over(spark, sf, "part").where(P.le("p_size", 10)).where(P.ge("p_retailprice", 905.0)).select("p_partkey").df()


@query("SELECT p_partkey FROM part WHERE p_size < 5 OR p_retailprice > 1500")
def filter_or(spark, sf):
    return over(spark, sf, "part").where(P.lt("p_size", 5) | P.gt("p_retailprice", 1500.0)).select("p_partkey").df()


@query("SELECT p_partkey FROM part WHERE NOT (p_size < 5 OR p_brand = 'Brand#13')")
def filter_not(spark, sf):
    return over(spark, sf, "part").where(~(P.lt("p_size", 5) | P.eq("p_brand", "Brand#13"))).select("p_partkey").df()


@query("SELECT p_partkey FROM part WHERE p_size >= 5 AND p_brand <> 'Brand#13'")
def de_morgan(spark, sf):
    return over(spark, sf, "part").where(~P.lt("p_size", 5) & ~P.eq("p_brand", "Brand#13")).select("p_partkey").df()


@query("SELECT count(*) AS n FROM region WHERE true")
def filter_all(spark, sf):
    return over(spark, sf, "region").where(P.all()).df().agg(F.count("*").alias("n"))


def _nested(spark, sf):
    d = read(spark, sf, "nation").select("n_nationkey", F.struct(F.col("n_regionkey").alias("Region"), F.struct(F.col("n_name").alias("Name")).alias("Inner")).alias("Key"))
    return external(d, name="nested")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1 AND n_name = 'NATION_1'")
def filter_struct_eq(spark, sf):
    return _nested(spark, sf).where(P.eq("Key", {"Region": 1, "Inner": {"Name": "NATION_1"}})).select("n_nationkey").df()


@query("SELECT n_nationkey FROM nation WHERE NOT (n_regionkey = 1 AND n_name = 'NATION_1')")
def filter_struct_ne(spark, sf):
    return _nested(spark, sf).where(P.ne("Key", {"Region": 1, "Inner": {"Name": "NATION_1"}})).select("n_nationkey").df()


def _nulled(spark, sf):
    return over(spark, sf, "part", read(spark, sf, "part").select("p_partkey", F.expr("nullif(p_size, 5)").alias("s"), F.expr("nullif(p_brand, 'Brand#11')").alias("b")))


_NULLED = "(SELECT p_partkey, nullif(p_size, 5) AS s, nullif(p_brand, 'Brand#11') AS b FROM part)"


@query(f"SELECT p_partkey FROM {_NULLED} WHERE s IS DISTINCT FROM 7")
def null_ne(spark, sf):
    return _nulled(spark, sf).where(P.ne("s", 7)).select("p_partkey").df()


@query(f"SELECT p_partkey FROM {_NULLED} WHERE s < 9 OR s IS NULL")
def null_lt_numeric(spark, sf):
    return _nulled(spark, sf).where(P.lt("s", 9)).select("p_partkey").df()


@query(f"SELECT p_partkey FROM {_NULLED} WHERE b < 'Brand#30'")
def null_lt_string(spark, sf):
    return _nulled(spark, sf).where(P.lt("b", "Brand#30")).select("p_partkey").df()


@query(f"SELECT p_partkey FROM {_NULLED} WHERE s IN (1, 2) OR s IS NULL")
def null_in(spark, sf):
    return _nulled(spark, sf).where(P.isin("s", [1, 2, None])).select("p_partkey").df()


@query(f"SELECT p_partkey FROM {_NULLED} WHERE s NOT IN (1, 2) OR s IS NULL")
def null_not_in(spark, sf):
    return _nulled(spark, sf).where(P.notin("s", [1, 2])).select("p_partkey").df()


@query(f"SELECT p_partkey FROM {_NULLED} WHERE s IS NULL")
def null_eq_null(spark, sf):
    return _nulled(spark, sf).where(P.eq("s", None)).select("p_partkey").df()


@query(f"SELECT p_partkey FROM {_NULLED} WHERE s < 9")
def null_sql_mode(spark, sf):
    return _nulled(spark, sf).where(P.lt("s", 9)).with_null_mode("sql").select("p_partkey").df()


@query("SELECT s_name, s_suppkey FROM supplier")
def project_subset(spark, sf):
    return over(spark, sf, "supplier").select("s_name", "s_suppkey").df()


@query("SELECT s_acctbal, s_suppkey FROM supplier")
def project_ordinal(spark, sf):
    return over(spark, sf, "supplier").select(3, 0).df()


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal, c_custkey LIMIT 25")
def order_multi_topk(spark, sf):
    return over(spark, sf, "customer").order_by_desc("c_nationkey").then_by("c_acctbal").then_by("c_custkey").take(25).select("c_custkey", "c_nationkey", "c_acctbal").df()


@query(f"SELECT p_partkey, s FROM {_NULLED} ORDER BY s NULLS FIRST, p_partkey LIMIT 30")
def order_nulls_first(spark, sf):
    return _nulled(spark, sf).order_by("s").then_by("p_partkey").take(30).select("p_partkey", "s").df()


@query(f"SELECT p_partkey, s FROM {_NULLED} ORDER BY s DESC NULLS LAST, p_partkey DESC LIMIT 30")
def order_nulls_last(spark, sf):
    return _nulled(spark, sf).order_by_desc("s").then_by_desc("p_partkey").take(30).select("p_partkey", "s").df()


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_name")
def order_full(spark, sf):
    return over(spark, sf, "region").order_by("r_name").df()


@query("SELECT * FROM region LIMIT 0")
def take_zero(spark, sf):
    return over(spark, sf, "region").take(0).df()


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity < 10")
def count_filtered(spark, sf):
    n = over(spark, sf, "lineitem").where(P.lt("l_quantity", 10.0))
    return n.select("l_orderkey").df().agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def group_sum(spark, sf):
    return verbs.group_sum(over(spark, sf, "orders").select("o_orderstatus", "o_totalprice").df(), ["o_orderstatus"], "o_totalprice").withColumn("total", F.round("total", 2))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def group_count(spark, sf):
    return verbs.group_count(over(spark, sf, "events").select("event_type").df(), ["event_type"])


@query("SELECT CAST(sum(p_size) AS BIGINT) AS total FROM part")
def global_sum(spark, sf):
    return verbs.total(over(spark, sf, "part").select("p_size").df(), "p_size")


@query("SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def min_max(spark, sf):
    return verbs.extremes(over(spark, sf, "lineitem").select("l_shipdate").df(), "l_shipdate")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_keys(spark, sf):
    return verbs.distinct(over(spark, sf, "customer").df(), "c_mktsegment", "c_nationkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def having_count(spark, sf):
    return verbs.group_count_having(over(spark, sf, "orders").select("o_custkey").df(), ["o_custkey"], 12)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def nested_group(spark, sf):
    d = verbs.nested_groups(over(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").df(), "l_returnflag", "l_linestatus")
    return d.select("l_returnflag", F.explode("groups").alias("g")).select("l_returnflag", "g.l_linestatus", "g.n")


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region")
def concat_all(spark, sf):
    return verbs.concat(over(spark, sf, "nation").df().select(F.col("n_nationkey").alias("k")), over(spark, sf, "region").df().select(F.col("r_regionkey").alias("k")))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_in_subquery(spark, sf):
    return verbs.semi_join(over(spark, sf, "customer").select("c_custkey").df(), over(spark, sf, "orders").where(P.gt("o_totalprice", 400000.0)).select("o_custkey").df(), "c_custkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_not_in(spark, sf):
    dear = over(spark, sf, "orders").where(P.gt("o_totalprice", 300000.0)).select("o_custkey").df()
    return verbs.anti_join(over(spark, sf, "customer").select("c_custkey").df(), dear, "c_custkey", "o_custkey")


# ---- queries over a stored database

_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
_SUMMARY = "o_orderstatus string, n long"


def store_root(spark: SparkSession) -> str:
    """A fresh folder for a database: under spark.checkpoint.dir, or the warehouse where that is unset; both are shared."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    root = f"{base}/tidemark-db-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return root


def orders_db(spark: SparkSession, sf: str, filled: bool = True, triggers: bool = False, policies: Policies | None = None) -> Database:
    from pyspark.sql.types import _parse_datatype_string as struct

    orders = TableSchema.of("orders", read(spark, sf, "orders").select(*_ORDERS).schema).with_primary_key("o_orderkey")
    if triggers:
        orders = orders.with_trigger(summary_trigger("orders", "order_summary", ["o_orderstatus"], into="n"))
    db = Database(spark, store_root(spark), [orders, TableSchema.of("order_summary", struct(_SUMMARY))], policies)
    if filled:
        db["orders"].append_df(read(spark, sf, "orders").select(*_ORDERS))
    return db


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def append_scan(spark, sf):
    return orders_db(spark, sf)["orders"].query().df()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def tombstone_delete(spark, sf):
    db = orders_db(spark, sf)
    db["orders"].query().where(P.eq("o_orderstatus", "F")).delete()
    return db["orders"].query().select("o_orderkey").df()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)")
def delete_sorted_take(spark, sf):
    db = orders_db(spark, sf)
    db["orders"].query().order_by_desc("o_totalprice").then_by("o_orderkey").take(100).delete()
    return db["orders"].query().select("o_orderkey").df()


@query("SELECT count(*) - 100 AS n FROM orders")
def delete_take_count(spark, sf):
    db = orders_db(spark, sf)
    db["orders"].query().take(100).delete()
    return db["orders"].query().df().agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_pk(spark, sf):
    db = orders_db(spark, sf)
    old = db["orders"].query().order_by("o_orderkey").take(1).collect()[0]
    db["orders"].update(tuple(old), (old[0], old[1], "X", old[3]))
    return db["orders"].query().select("o_orderkey", "o_orderstatus").df()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT CAST(-1 AS BIGINT) AS o_orderkey")
def tx_read_your_writes(spark, sf):
    db = orders_db(spark, sf)
    tx = db.transaction()
    db["orders"].append((-1, 1, "O", 1.0), tx)
    db["orders"].query(tx).where(P.eq("o_orderstatus", "P")).delete()
    return db["orders"].query(tx).select("o_orderkey").df()


@query("SELECT o_orderkey FROM orders")
def tx_rollback(spark, sf):
    db = orders_db(spark, sf)
    tx = db.transaction()
    db["orders"].append((-1, 1, "O", 1.0), tx)
    db["orders"].query(tx).where(P.eq("o_orderstatus", "P")).delete()
    tx.rollback()
    return db["orders"].query().select("o_orderkey").df()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def deleted_rows_view(spark, sf):
    db = orders_db(spark, sf)
    tx = db.transaction()
    db["orders"].query(tx).where(P.eq("o_orderstatus", "P")).delete()
    return db["orders"].tombstoned_within(tx).select("o_orderkey")


@query("SELECT CAST(-1 AS BIGINT) AS o_orderkey UNION ALL SELECT CAST(-2 AS BIGINT) AS o_orderkey")
def inserted_rows_view(spark, sf):
    db = orders_db(spark, sf)
    tx = db.transaction()
    db["orders"].append_many([(-1, 1, "O", 1.0), (-2, 1, "O", 1.0)], tx)
    return db["orders"].query(tx).within_transaction_only().select("o_orderkey").df()


@query("SELECT o_orderkey FROM orders")
def include_deleted_scan(spark, sf):
    db = orders_db(spark, sf)
    db["orders"].query().where(P.eq("o_orderstatus", "P")).delete()
    return db["orders"].query().with_ignore_deleted().select("o_orderkey").df()


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice <= 300000 GROUP BY o_orderstatus")
def trigger_incremental_summary(spark, sf):
    db = orders_db(spark, sf, filled=False, triggers=True)
    rows = read(spark, sf, "orders").select(*_ORDERS)
    db["orders"].append_df(rows.where("o_orderkey % 2 = 0"))
    db["orders"].append_df(rows.where("o_orderkey % 2 = 1"))
    db["orders"].query().where(P.gt("o_totalprice", 300000.0)).delete()
    return db["order_summary"].query().df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 2000")
def zone_pruned_range(spark, sf):
    db = orders_db(spark, sf, filled=False)
    db["orders"].append_df(read(spark, sf, "orders").select(*_ORDERS).repartitionByRange(8, "o_orderkey"))
    return db["orders"].query().where(P.ge("o_orderkey", 1000) & P.lt("o_orderkey", 2000)).with_tag("range").select("o_orderkey", "o_totalprice").df()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def after_optimize(spark, sf):
    db = orders_db(spark, sf, filled=False)
    rows = read(spark, sf, "orders").select(*_ORDERS)
    for k in range(3):
        db["orders"].append_df(rows.where(f"o_orderkey % 3 = {k}"))
    db["orders"].query().where(P.eq("o_orderstatus", "F")).delete()
    db.optimize()
    return db["orders"].query().select("o_orderkey", "o_orderstatus").df()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def after_hard_delete(spark, sf):
    db = orders_db(spark, sf)
    db["orders"].query().where(P.eq("o_orderstatus", "F")).delete()
    db.hard_delete()
    db.vacuum(0, 0)
    return db["orders"].query().select("o_orderkey", "o_orderstatus").df()


@query("SELECT o_orderkey FROM orders")
def after_reopen(spark, sf):
    db = orders_db(spark, sf)
    db.checkpoint()
    again = Database(spark, db.root, list(db.schemas.values()))
    return again["orders"].query().select("o_orderkey").df()


@query("SELECT 'orders' AS table_name, count(*) AS rows, CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS BIGINT) AS tombstones FROM orders UNION ALL SELECT 'order_summary' AS table_name, 0 AS rows, 0 AS tombstones")
def statistics(spark, sf):
    db = orders_db(spark, sf)
    db["orders"].query().where(P.eq("o_orderstatus", "P")).delete()
    return db.statistics().select("table_name", "rows", "tombstones")


@query("SELECT 'orders' AS table_name, count(*) AS rows, min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(4 AS BIGINT) AS files FROM orders")
def manifest_rows(spark, sf):
    db = orders_db(spark, sf, filled=False)
    db["orders"].append_df(read(spark, sf, "orders").select(*_ORDERS).repartition(4, "o_custkey"))
    span = F.split(F.split(F.col("stats")["o_orderkey"], ",")[0], r"\.\.")
    files = db.manifest_df().select("table_name", "rows", span[0].cast("long").alias("lo"), span[1].cast("long").alias("hi"))
    return files.groupBy("table_name").agg(F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("files"))


def _ranged(spark, sf, policies: Policies | None = None) -> Database:
    """Four files by ranges of 250, 250, 500 and the rest of the keys."""
    db = orders_db(spark, sf, filled=False, policies=policies)
    rows = read(spark, sf, "orders").select(*_ORDERS)
    for lo, hi in ((0, 250), (250, 500), (500, 1000), (1000, 1 << 62)):
        db["orders"].append_df(rows.where(f"o_orderkey >= {lo} and o_orderkey < {hi}").coalesce(1))
    return db


@query("""SELECT iteration, pruned, predicate FROM (VALUES (0, true), (1, false), (2, false), (3, true)) AS t(iteration, pruned),
    (SELECT '(v[o_orderkey] >= 300) && (v[o_orderkey] < 700)' AS predicate)""")
def query_audit(spark, sf):
    """Which of four files a tagged range reads."""
    db = _ranged(spark, sf)
    db["orders"].query().where(P.ge("o_orderkey", 300) & P.lt("o_orderkey", 700)).with_tag("audit").df()
    return db.query_execution().where("query_tag = 'audit'").select("iteration", "pruned", "predicate")


@query("SELECT o_orderkey AS phantom FROM orders WHERE o_orderkey < 40")
def integrity(spark, sf):
    """Rows deleted by a transaction whose files a forced rewrite dropped meanwhile: its tombstones are of no row."""
    db = _ranged(spark, sf)
    late = db.transaction()
    db["orders"].query(late).where(P.lt("o_orderkey", 40)).delete()
    keys = db.as_of("orders", db.manifest.snapshot().version, with_id=True).select("o_orderkey", F.col(RECORD_ID).alias("id"))
    db["orders"].query().where(P.lt("o_orderkey", 40)).delete()
    db.hard_delete()
    late.complete()
    return db.check_integrity().join(keys, F.col(RECORD_ID) == F.col("id")).select(F.col("o_orderkey").alias("phantom"))


@query("SELECT 'insert' AS change, o_orderkey FROM orders UNION ALL SELECT 'delete' AS change, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def change_feed(spark, sf):
    db = orders_db(spark, sf)
    db["orders"].query().where(P.eq("o_orderstatus", "P")).delete()
    return changes(db, "orders").select("change", "o_orderkey")


# ---- scopes, checks and transactions


def _fails(kind: type, call) -> bool:
    try:
        call()
    except kind:
        return True
    return False


def _said(spark, **flags) -> DataFrame:
    """One row of what was seen."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in flags.items()])


def _with_rows(df: DataFrame, spark, **flags) -> DataFrame:
    """Every row beside what was seen."""
    return df.select("*", *[F.lit(v).alias(k) for k, v in flags.items()])


@query("SELECT o_orderkey FROM orders")
def committed_only_scan(spark, sf):
    db = orders_db(spark, sf)
    tx = db.transaction()
    db["orders"].append_many([(-1, 1, "O", 1.0), (-2, 1, "O", 1.0)], tx)
    return db["orders"].query(tx).with_committed_only().select("o_orderkey").df()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def delta_only_scan(spark, sf):
    """What no rewrite has taken up yet."""
    db = orders_db(spark, sf, filled=False)
    rows = read(spark, sf, "orders").select(*_ORDERS)
    db["orders"].append_df(rows.where("o_orderkey % 2 = 0"))
    db.optimize("orders", force=True)
    db["orders"].append_df(rows.where("o_orderkey % 2 = 1"))
    return db["orders"].query().within_delta_only().select("o_orderkey").df()


@query("SELECT o_orderkey, true AS unknown, true AS reserved, true AS other_type FROM orders WHERE o_orderstatus = 'P'")
def table_lookup(spark, sf):
    db = orders_db(spark, sf)
    rows = db.table("orders").query().where(P.eq("o_orderstatus", "P")).select("o_orderkey").df()
    return _with_rows(rows, spark, unknown=_fails(KeyError, lambda: db.table("nothing")), reserved=_fails(ValueError, lambda: db.table("$tombstone")), other_type=_fails(TypeError, lambda: db.table("orders", Policies)))


@query("SELECT count(*) AS n, true AS arity, true AS columns FROM orders")
def append_arity(spark, sf):
    db = orders_db(spark, sf)
    arity = _fails(ValueError, lambda: db["orders"].append((1, 2)))
    columns = _fails(ValueError, lambda: db["orders"].append_df(read(spark, sf, "region")))
    return _with_rows(db["orders"].query().df().agg(F.count("*").alias("n")), spark, arity=arity, columns=columns)


@query("SELECT count(*) AS n, true AS by_row, true AS by_frame FROM region")
def append_non_null(spark, sf):
    """A null in a column that may not hold one fails the append, and nothing of it stays."""
    from pyspark.errors import PySparkException

    schema = TableSchema.of("regions", StructType([StructField("r_regionkey", IntegerType(), False), StructField("r_name", StringType())]))
    db = Database(spark, store_root(spark), [schema])
    rows = read(spark, sf, "region")
    db["regions"].append_df(rows)
    by_row = _fails(ValueError, lambda: db["regions"].append((None, "x")))
    by_frame = _fails(PySparkException, lambda: db["regions"].append_df(rows.withColumn("r_regionkey", F.expr("nullif(r_regionkey, 2)"))))
    return _with_rows(db["regions"].query().df().agg(F.count("*").alias("n")), spark, by_row=by_row, by_frame=by_frame)


@query("SELECT o_orderkey, true AS no_tombstone FROM orders WHERE o_orderstatus <> 'P'")
def delete_own_rows(spark, sf):
    """Rows a transaction appended and deleted again leave no tombstone."""
    db = orders_db(spark, sf, filled=False)
    with db.transaction() as tx:
        db["orders"].append_df(read(spark, sf, "orders").select(*_ORDERS), tx)
        db["orders"].query(tx).where(P.eq("o_orderstatus", "P")).delete()
    return _with_rows(db["orders"].query().select("o_orderkey").df(), spark, no_tombstone=not db.manifest.snapshot().tombstones)


@query("SELECT count(*) AS n, count(*) AS ids, true AS ascending FROM orders")
def record_ids(spark, sf):
    """Ids are unique over appends, ascend from one to the next, and a rewrite keeps them."""
    db = orders_db(spark, sf, filled=False)
    rows = read(spark, sf, "orders").select(*_ORDERS)
    for k in range(2):
        db["orders"].append_df(rows.where(f"o_orderkey % 2 = {k}"))
    db.optimize("orders", force=True)
    got = db["orders"].query().select("o_orderkey", RECORD_ID).df()
    even = F.col("o_orderkey") % 2 == 0
    ids = got.agg(F.count("*").alias("n"), F.countDistinct(RECORD_ID).alias("ids"), F.max(F.when(even, F.col(RECORD_ID))).alias("a"), F.min(F.when(~even, F.col(RECORD_ID))).alias("b"))
    return ids.select("n", "ids", (F.col("a") < F.col("b")).alias("ascending"))


@query("SELECT count(*) AS n, true AS refused FROM orders")
def empty_projection(spark, sf):
    """Nothing projected can be counted, not enumerated."""
    q = orders_db(spark, sf)["orders"].query().select()
    return _said(spark, n=q.count(), refused=_fails(ValueError, q.df))


@query("SELECT count(*) AS plain, (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS filtered, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS after_delete, CAST(7 AS BIGINT) AS taken FROM orders")
def count_terminal(spark, sf):
    db = orders_db(spark, sf)
    q = db["orders"].query()
    plain, filtered, taken = q.count(), q.where(P.gt("o_totalprice", 200000.0)).count(), q.take(7).count()
    q.where(P.eq("o_orderstatus", "F")).delete()
    flags = {"plain": plain, "filtered": filtered, "after_delete": db["orders"].query().count(), "taken": taken}
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in flags.items()])


@dataclass
class Place:
    Name: str
    Region: int


@dataclass
class Country:
    Id: int
    Where: Place
    Note: str | None


@query("SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_regionkey = 1 THEN n_name END AS note FROM nation WHERE n_nationkey >= 3")
def typed_round_trip(spark, sf):
    """Objects to rows and back, nested ones too."""
    db = Database(spark, store_root(spark), [TableSchema.from_dataclass(Country)])
    t = db.table("Country", Country)
    rows = read(spark, sf, "nation").collect()  # 25 rows at any scale
    t.append_many([Country(r["n_nationkey"], Place(r["n_name"], r["n_regionkey"]), r["n_name"] if r["n_regionkey"] == 1 else None) for r in rows])
    got = t.query().where(P.ge("Id", 3)).collect()
    flat = [(c.Id, c.Where.Name, c.Where.Region, c.Note) for c in got if isinstance(c, Country)]
    return spark.createDataFrame(flat, "n_nationkey int, n_name string, n_regionkey int, note string")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE false")
def filter_none(spark, sf):
    return over(spark, sf, "orders").where(P.none() & P.eq("o_orderstatus", "O")).select("o_orderkey", "o_orderstatus").df()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def predicate_replaced(spark, sf):
    """An injected predicate replaces the one there was."""
    return over(spark, sf, "orders").where(P.eq("o_orderstatus", "O")).with_predicate(P.eq("o_orderstatus", "F")).select("o_orderkey").df()


@query("SELECT p_partkey, true AS text_for_number, true AS number_for_text, true AS too_large, true AS in_list FROM part WHERE p_size = 7")
def literal_types(spark, sf):
    """A literal of another type than the column's is refused, nothing is cast."""
    q = over(spark, sf, "part")
    wrong = {"text_for_number": P.eq("p_size", "7"), "number_for_text": P.eq("p_brand", 7), "too_large": P.eq("p_size", 1 << 40), "in_list": P.isin("p_size", [7, "8"])}
    return _with_rows(q.where(P.eq("p_size", 7)).select("p_partkey").df(), spark, **{k: _fails(TypeError, q.where(p).df) for k, p in wrong.items()})


@query("SELECT n_nationkey, true AS by_range, true AS by_list, true AS by_sort FROM nation WHERE n_regionkey = 2")
def interior_paths(spark, sf):
    """Ranges, lists and sorts need a single column."""
    q = _nested(spark, sf)
    flags = {"by_range": _fails(ValueError, q.where(P.lt("Key", {"Region": 1})).df), "by_list": _fails(ValueError, q.where(P.isin("Key.Inner", ["x"])).df), "by_sort": _fails(ValueError, lambda: q.order_by("Key"))}
    return _with_rows(q.where(P.eq("Key.Region", 2)).select("n_nationkey").df(), spark, **flags)


@query("SELECT c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 20")
def order_untyped_keys(spark, sf):
    return over(spark, sf, "customer").with_sort(("c_nationkey", True), ("c_custkey", False)).take(20).select("c_custkey").df()


@query("SELECT o_orderkey, true AS where_late, true AS sort_late, true AS two_sorts, true AS then_alone, true AS two_takes FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def builder_order(spark, sf):
    q = over(spark, sf, "orders")
    calls = {"where_late": lambda: q.take(1).where(P.all()), "sort_late": lambda: q.take(1).order_by("o_orderkey"), "two_sorts": lambda: q.order_by("o_orderkey").order_by("o_custkey"), "then_alone": lambda: q.then_by("o_orderkey"), "two_takes": lambda: q.take(1).take(1)}
    top = q.order_by_desc("o_totalprice").then_by("o_orderkey").take(5).select("o_orderkey").df()
    return _with_rows(top, spark, **{k: _fails(ValueError, f) for k, f in calls.items()})


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def late_materialisation(spark, sf):
    """Sort on keys and record ids first; only the survivors' other columns are read."""
    return orders_db(spark, sf)["orders"].query().order_by_desc("o_totalprice").then_by("o_orderkey").take(15).late()


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def lookup_join(spark, sf):
    open_ = over(spark, sf, "orders").where(P.eq("o_orderstatus", "P")).select("o_orderkey", "o_custkey").df()
    return verbs.lookup_join(open_, over(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").df(), "o_custkey", "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


# ---- triggers and the change log


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_orderstatus")
def trigger_not_on_replay(spark, sf):
    """A transaction that runs no triggers leaves the summary as it is; reopening runs none either."""
    db = orders_db(spark, sf, filled=False, triggers=True)
    rows = read(spark, sf, "orders").select(*_ORDERS)
    db["orders"].append_df(rows.where("o_orderkey % 2 = 0"))
    with db.transaction(run_triggers=False) as tx:
        db["orders"].append_df(rows.where("o_orderkey % 2 = 1"), tx)
    again = Database(spark, db.root, list(db.schemas.values()))
    return again["order_summary"].query().df()


@query("SELECT 'first' AS name, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'second' AS name, CAST(2 AS BIGINT) AS n")
def trigger_single_pass(spark, sf):
    """One pass in schema order: an earlier table's trigger that changes a later one fires that one's; not the other way round."""
    row = StructType([StructField("Count", IntegerType())])
    first = TableSchema.of("first", row).with_trigger(count_trigger("second"))
    second = TableSchema.of("second", row).with_trigger(count_trigger("first"))
    db = Database(spark, store_root(spark), [first, second])
    db["first"].append((1,))
    db["second"].append((1,))
    count = lambda t: db[t].query().df().select(F.lit(t).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return count("first").select("name", (F.col("n") - 1).alias("n")).unionByName(count("second"))


@query("SELECT version, count(*) AS n FROM (SELECT 1 AS version FROM orders UNION ALL SELECT 2 FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 4 FROM orders WHERE o_orderkey < 50 AND o_orderstatus <> 'P') GROUP BY version")
def change_stream(spark, sf):
    """A structured streaming query over the log, run until it has seen every commit; the rewrite in between changes no row."""
    db = orders_db(spark, sf)
    db["orders"].query().where(P.eq("o_orderstatus", "P")).delete()
    db.optimize("orders", force=True)
    db["orders"].query().where(P.lt("o_orderkey", 50)).delete()
    out = f"{db.root}/seen"
    stream(db, "orders", lambda df, n: df.select(F.col("version").cast("int").alias("version")).write.mode("overwrite").parquet(f"{out}/{n}"), f"{db.root}/offsets", once=True).awaitTermination()
    return spark.read.parquet(f"{out}/*").groupBy("version").agg(F.count("*").alias("n"))


# ---- commits


@query("SELECT o_orderkey, true AS twice, true AS ended FROM orders UNION ALL SELECT CAST(-1 AS BIGINT), true, true")
def double_completion(spark, sf):
    db = orders_db(spark, sf)
    tx = db.transaction()
    db["orders"].append((-1, 1, "O", 1.0), tx)
    tx.complete()
    return _with_rows(db["orders"].query().select("o_orderkey").df(), spark, twice=_fails(RuntimeError, tx.complete), ended=_fails(RuntimeError, lambda: db["orders"].append((-2, 1, "O", 1.0), tx)))


@query("SELECT o_orderkey, count(*) OVER () AS ids FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey >= 100")
def racing_commits(spark, sf):
    """Two writers that don't know of each other: both appends and both deletes stay, ids don't clash."""
    db = orders_db(spark, sf, filled=False)
    other = Database(spark, db.root, list(db.schemas.values()))
    rows = read(spark, sf, "orders").select(*_ORDERS)
    one, two = db.transaction(), other.transaction()
    db["orders"].append_df(rows.where("o_orderkey % 2 = 0"), one)
    other["orders"].append_df(rows.where("o_orderkey % 2 = 1"), two)
    one.complete()
    two.complete()
    one, two = db.transaction(), other.transaction()
    db["orders"].query(one).where(P.eq("o_orderstatus", "P")).delete()
    other["orders"].query(two).where(P.lt("o_orderkey", 100)).delete()
    two.complete()
    one.complete()
    got = db["orders"].query().select("o_orderkey", RECORD_ID).df()
    return got.select("o_orderkey").crossJoin(F.broadcast(got.agg(F.countDistinct(RECORD_ID).alias("ids"))))


@query("SELECT o_orderkey, true AS few FROM orders")
def group_commit(spark, sf):
    """Four transactions completed in the background share versions."""
    db = orders_db(spark, sf, filled=False, policies=Policies(group_seconds=1.0))
    rows, txs = read(spark, sf, "orders").select(*_ORDERS), [db.transaction() for _ in range(4)]
    for k, tx in enumerate(txs):
        db["orders"].append_df(rows.where(f"o_orderkey % 4 = {k}"), tx)
    versions = {f.result(120) for f in [tx.complete_async() for tx in txs]}
    return _with_rows(db["orders"].query().select("o_orderkey").df(), spark, few=len(versions) < 4)


@query("SELECT o_orderkey, true AS refused, true AS taken_over FROM orders")
def writer_lease(spark, sf):
    db = orders_db(spark, sf, filled=False)
    one, two = Lease(db), Lease(db)
    with one:
        refused = not two.acquire()
        db["orders"].append_df(read(spark, sf, "orders").select(*_ORDERS))
    return _with_rows(db["orders"].query().select("o_orderkey").df(), spark, refused=refused, taken_over=two.acquire())


# ---- upkeep


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 250 AND o_orderkey < 900")
def deletes_by_file(spark, sf):
    """Tombstones are kept by file: of the files this range reads, one is joined with its own deleted rows only."""
    db = _ranged(spark, sf)
    db["orders"].query().where(P.lt("o_orderkey", 200)).delete()
    db["orders"].query().where(P.ge("o_orderkey", 900) & P.lt("o_orderkey", 1100)).delete()
    return db["orders"].query().where(P.ge("o_orderkey", 250) & P.lt("o_orderkey", 1000)).select("o_orderkey").df()


@query("SELECT CAST(3 AS BIGINT) AS worn_before, CAST(1 AS BIGINT) AS worn_after, (SELECT count(*) FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 1010) AS tombstones, (SELECT count(*) FROM orders WHERE o_orderkey >= 480 AND NOT (o_orderkey >= 1000 AND o_orderkey < 1010)) AS rows")
def partial_hard_delete(spark, sf):
    """Files with half their rows deleted or more are rewritten, others keep their tombstones."""
    db = _ranged(spark, sf, Policies(small_files=100))
    db["orders"].query().where(P.lt("o_orderkey", 480)).delete()
    db["orders"].query().where(P.ge("o_orderkey", 1000) & P.lt("o_orderkey", 1010)).delete()
    before = len(db.manifest.snapshot().worn("orders"))
    db.life.maintain()
    snap = db.manifest.snapshot()
    flags = {"worn_before": before, "worn_after": len(snap.worn("orders")), "tombstones": sum(t.rows for t in snap.dead("orders")), "rows": db["orders"].query().count()}
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in flags.items()])


@query("SELECT o_orderkey, true AS due_before, true AS settled, true AS merged FROM orders WHERE o_orderstatus <> 'F'")
def awaited_life_cycle(spark, sf):
    """Small files are merged, all four where the table is small; a file over half the target size stays, or is rewritten for its deletes."""
    db = _ranged(spark, sf, Policies(small_files=2))
    small = lambda: {f.path for f in db.manifest.snapshot().of("orders") if f.rows * 2 < db.policies.file_rows}
    db["orders"].query().where(P.eq("o_orderstatus", "F")).delete()
    due, before = bool(db.life.due()), small()
    db.await_life_cycle()
    merged = len(small()) <= 1 and before.isdisjoint(f.path for f in db.manifest.snapshot().of("orders"))
    return _with_rows(db["orders"].query().select("o_orderkey").df(), spark, due_before=due, settled=not db.life.due(), merged=merged)


@query("SELECT o_orderkey, true AS kept_for_reader, true AS released FROM orders WHERE o_orderstatus = 'P'")
def release_when_unused(spark, sf):
    """Files of a snapshot that an open transaction pins outlive their rewrite."""
    db = orders_db(spark, sf)
    reader = db.transaction()
    db["orders"].query().where(P.ne("o_orderstatus", "P")).delete()
    db.hard_delete()
    db.vacuum(0, 0)
    kept = db["orders"].query(reader).count() == read(spark, sf, "orders").count()
    reader.rollback()
    return _with_rows(db["orders"].query().select("o_orderkey").df(), spark, kept_for_reader=kept, released=db.vacuum(0, 0) > 0)


@query("SELECT count(*) AS n, true AS checkpointed, true AS expired FROM orders WHERE o_orderkey >= 700")
def checkpoint_policy(spark, sf):
    """A checkpoint once rows enough were appended and of these a share deleted; the log before it goes; a reopened database has all."""
    db = _ranged(spark, sf, Policies(checkpoint_rows=1000, checkpoint_percent=10, checkpoint_commits=1000))
    none = not db.manifest.versions()[1]
    db["orders"].query().where(P.lt("o_orderkey", 700)).delete()
    checkpoints = db.manifest.versions()[1]
    share = read(spark, sf, "orders").where("o_orderkey < 700").count() * 10 >= read(spark, sf, "orders").count()
    if not share:
        db.checkpoint()
    expired = db.manifest.expire(db.manifest.snapshot().version, 0.0) > 0
    again = Database(spark, db.root, list(db.schemas.values()))
    return _with_rows(again["orders"].query().df().agg(F.count("*").alias("n")), spark, checkpointed=none and bool(checkpoints) == share, expired=expired)


@query("SELECT o_orderkey, true AS in_memory FROM orders WHERE o_totalprice > 100000")
def cached_scan(spark, sf):
    db = orders_db(spark, sf)
    q = db["orders"].query().with_cache()
    q.count()
    rows = q.where(P.gt("o_totalprice", 100000.0)).select("o_orderkey").df()
    return _with_rows(rows, spark, in_memory="InMemoryTableScan" in rows._jdf.queryExecution().executedPlan().toString())


@query("SELECT CAST(1 AS BIGINT) AS version, false AS rewrite, count(*) AS rows_added, CAST(0 AS BIGINT) AS rows_deleted FROM orders UNION ALL SELECT 2, false, 0, count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 3, true, count(*), 0 FROM orders WHERE o_orderstatus <> 'P'")
def log_view(spark, sf):
    db = orders_db(spark, sf)
    db["orders"].query().where(P.eq("o_orderstatus", "P")).delete()
    db.hard_delete("orders")
    return db.log_df().select("version", "rewrite", "rows_added", "rows_deleted")
