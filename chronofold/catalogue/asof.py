"""Queries of as-of joins of two tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions.scalars import DAY_US, micros
from ..operators.asof import asof_join
from ..views import with_views
from . import query

HOUR_US = DAY_US // 24


def _orders(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), micros("o_orderdate").alias("order_us"))


_ORDERS = ", o AS (SELECT o_orderkey, o_custkey AS user_id, epoch_us(o_orderdate) AS order_us FROM orders), r AS (SELECT user_id AS u, event_us, max(event_id) AS event_id, arg_max(rating, event_id) AS rating FROM re GROUP BY ALL)"


@query(with_views("re", _ORDERS + """
SELECT o_orderkey, user_id, order_us, event_id, rating, event_us AS matched FROM o ASOF LEFT JOIN r ON o.user_id = r.u AND o.order_us > r.event_us"""))  # fmt: skip
def asof_join_latest(spark, sf):
    """Each order with its customer's latest rating before it; of one time, that of the largest event_id. Customers with over 30 rows are hot."""
    events = views.events(spark, sf).select("user_id", "event_us", "event_id", "rating")
    return asof_join(_orders(spark, sf), events, "user_id", "order_us", "event_us", strict=True, ties=["event_id"], hot=30)


@query(with_views("re", _ORDERS + f"""
SELECT o_orderkey, user_id, order_us, CASE WHEN event_us - order_us <= {60 * DAY_US} THEN event_id END AS event_id,
  CASE WHEN event_us - order_us <= {60 * DAY_US} THEN rating END AS rating, CASE WHEN event_us - order_us <= {60 * DAY_US} THEN event_us END AS matched
FROM o ASOF LEFT JOIN r ON o.user_id = r.u AND o.order_us <= r.event_us"""))  # fmt: skip
def asof_join_next(spark, sf):
    """Each order with its customer's next rating, on that day or up to 60 days after it."""
    events = views.events(spark, sf).select("user_id", "event_us", "event_id", "rating")
    return asof_join(_orders(spark, sf), events, "user_id", "order_us", "event_us", direction="forward", tolerance=60 * DAY_US, ties=["event_id"])


_CLICKS = """
WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS event_us FROM events),
v AS (SELECT user_id AS u, event_us AS us, event_id AS view_id FROM e WHERE event_type = 'view'), p AS (SELECT event_id, user_id, event_us FROM e WHERE event_type = 'purchase'),
"""


@query(_CLICKS + f"""
b AS (SELECT p.*, view_id AS b_id, v.us AS b_at FROM p ASOF LEFT JOIN v ON p.user_id = v.u AND p.event_us >= v.us),
f AS (SELECT b.*, view_id AS f_id, v.us AS f_at FROM b ASOF LEFT JOIN v ON b.user_id = v.u AND b.event_us <= v.us),
n AS (SELECT *, CASE WHEN f_at IS NULL OR event_us - b_at <= f_at - event_us THEN b_id ELSE f_id END AS id, CASE WHEN f_at IS NULL OR event_us - b_at <= f_at - event_us THEN b_at ELSE f_at END AS us FROM f)
SELECT event_id, user_id, event_us, CASE WHEN abs(event_us - us) <= {12 * HOUR_US} THEN id END AS view_id, CASE WHEN abs(event_us - us) <= {12 * HOUR_US} THEN us END AS matched FROM n""")  # fmt: skip
def asof_join_nearest(spark, sf):
    """Each purchase with its user's view that is nearest in time, within twelve hours."""
    e = views.table(spark, sf, "events").select("event_id", "user_id", "event_type", micros("ts").alias("event_us"))
    seen = e.where("event_type = 'view'").select("user_id", "event_us", F.col("event_id").alias("view_id"))
    bought = e.where("event_type = 'purchase'").drop("event_type")
    return asof_join(bought, seen, "user_id", direction="nearest", tolerance=12 * HOUR_US)


@query(_CLICKS + """
x AS (SELECT user_id AS u, event_us AS us, value FROM e WHERE event_type = 'click'), y AS (SELECT user_id AS u, event_us AS us, event_id FROM e WHERE event_type = 'view'),
a AS (SELECT p.*, value AS last_value, x.us AS last_value_matched FROM p ASOF LEFT JOIN x ON p.user_id = x.u AND p.event_us > x.us)
SELECT a.*, y.event_id AS last_view, y.us AS last_view_matched FROM a ASOF LEFT JOIN y ON a.user_id = y.u AND a.event_us > y.us""")  # fmt: skip
def asof_join_carried(spark, sf):
    """Each purchase with its user's last value of a click and last view, each carried forward over rows that have none."""
    e = views.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("event_us"))
    state = e.select("user_id", "event_us", F.when(F.col("event_type") == "click", F.col("value")).alias("value"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("view"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "event_us")
    return asof_join(bought, state, "user_id", strict=True, carry=True, prefix="last_", hot=40)
