"""Relational extension pack over the star schema: joins, aggregation, frames, as-of and range joins, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time; one shuffle, no pairs."""
    a = left.select("*", F.lit(1).alias("_side"), F.col(left_time).alias("_t"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    b = right.select(key, F.lit(0).alias("_side"), F.col(right_time).alias("_t"), *[F.col(v).alias(f"_{v}") for v in values])
    frame = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{v}").alias(v) for v in values])), ignorenulls=True).over(frame)
    out = a.unionByName(b, allowMissingColumns=True).withColumn("_seen", seen).where("_side = 1")
    return out.select(*left.columns, *[F.col("_seen")[v].alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, *, at: str, lo: str, hi: str, bin_size: float) -> DataFrame:
    """Points within [lo, hi]: ranges are repeated for the bins they cover, points fall in one."""
    binned = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor(F.col(hi) / bin_size))))
    return points.withColumn("_bin", F.floor(F.col(at) / bin_size)).join(binned, "_bin").where(F.col(at).between(F.col(lo), F.col(hi))).drop("_bin")


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r2(c, name):
    return F.round(c, 2).alias(name)


def pricing_summary(spark, sf):
    li = _t(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        _r2(F.sum("l_quantity"), "sum_qty"), _r2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "revenue"), F.count("*").alias("n")
    )


def revenue_by_nation(spark, sf):
    li, o, c, n = (_t(spark, sf, x) for x in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name").agg(_r2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "revenue"))


def forecast_revenue(spark, sf):
    li = _t(spark, sf, "lineitem").where("l_discount between 0.05 and 0.07 and l_quantity < 24")
    return li.agg(_r2(F.sum(F.col("l_extendedprice") * F.col("l_discount")), "revenue"))


def customers_without_orders(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


def order_status_cube(spark, sf):
    return _t(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def running_balance(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, sf, "orders").select("o_orderkey", _r2(F.sum("o_totalprice").over(w), "running"))


def event_as_of(spark, sf):
    """Each purchase with the value of its user's last other event."""
    e = _t(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    kind = "purchase"
    left = e.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type") != kind).groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return as_of(left, right, key="user_id", left_time="ts", right_time="ts", values=["last_value"]).select("event_id", F.round("last_value", 6).alias("last_value"))


def quantity_bands(spark, sf):
    p = _t(spark, sf, "lineitem").select("l_quantity")
    bands = spark.createDataFrame([("low", 1.0, 10.0), ("mid", 8.0, 30.0), ("high", 30.0, 60.0)], "band string, lo double, hi double")
    return range_join(p, bands, at="l_quantity", lo="lo", hi="hi", bin_size=10.0).groupBy("band").agg(F.count("*").alias("n"))


def user_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("ts") > F.lag("ts").over(w) + F.expr("interval 6 hours")).alias("gap"))
    s = e.withColumn("session", F.sum(F.coalesce(F.col("gap").cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id").agg((F.max("session") + 1).alias("n_sessions"), F.count("*").alias("n_events"))


def property_totals(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return _t(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total_k"))


def source_overlap(spark, sf):
    d = _t(spark, sf, "documents")
    return d.where("lang = 'fr'").select("source").intersect(d.where("lang = 'de'").select("source"))


PACK = {
    "rel_pricing_summary": (pricing_summary, """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""),
    "rel_revenue_by_nation": (revenue_by_nation, """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""),
    "rel_forecast_revenue": (forecast_revenue, "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"),
    "rel_customers_without_orders": (customers_without_orders, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "rel_order_status_cube": (order_status_cube, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "rel_running_balance": (running_balance, "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders"),
    "rel_event_as_of": (event_as_of, """WITH r AS (SELECT user_id, ts, max(value) AS last_value FROM events WHERE event_type <> 'purchase' GROUP BY ALL)
        SELECT l.event_id, round(r.last_value, 6) AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""),
    "rel_quantity_bands": (quantity_bands, "SELECT band, count(*) AS n FROM lineitem JOIN (VALUES ('low', 1, 10), ('mid', 8, 30), ('high', 30, 60)) b(band, lo, hi) ON l_quantity BETWEEN lo AND hi GROUP BY band"),
    "rel_user_sessions": (user_sessions, """WITH g AS (SELECT user_id, event_id, ts, ts > lag(ts) OVER w + INTERVAL 6 HOURS AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) + 1 AS BIGINT) AS n_sessions, count(*) AS n_events FROM g GROUP BY user_id"""),
    "rel_property_totals": (property_totals, "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY event_type"),
    "rel_source_overlap": (source_overlap, "SELECT source FROM documents WHERE lang = 'fr' INTERSECT SELECT source FROM documents WHERE lang = 'de'"),
}
