"""Queries of filters, joins, aggregates, order and sets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F, Window

from sedge.functions import text as T
from sedge.operators import estimators as E, ordered as O, predicates as P, tables as K
from sedge.sources import table as t

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT d.lang, l.quality, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE regexp_matches(d.text, 'the\\s+of', 'i') GROUP BY d.lang, l.quality""")
def doc_phrase_search(s, d):
    found = t(s, d, "documents").where(P.phrase(F.col("text"), "the of")).select("doc_id", "lang")
    return found.join(t(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("lang", "quality").agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.source = 'src3' OR (coalesce(l.quality = 1, false) AND (CASE WHEN l.toxic = 1 THEN 'private' END) IS DISTINCT FROM 'private')""")
def doc_visibility_filter(s, d):
    j = t(s, d, "documents").select("doc_id", "source").join(t(s, d, "labels"), "doc_id", "left")
    return j.where(P.visible_to("src3", F.col("source"), F.col("quality") == 1, F.when(F.col("toxic") == 1, "private"))).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%an%' OR p_type ILIKE '%an%' OR p_brand ILIKE '%an%'")
def multi_column_search(s, d):
    return t(s, d, "part").where(P.any_column_like([F.col(c) for c in ("p_name", "p_type", "p_brand")], "an")).select("p_partkey", "p_name")


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)the\\s+and')) AS n FROM documents WHERE regexp_matches(text, '(?i)the\\s+and')")
def phrase_range_counts(s, d):
    x = t(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"(?i)the\s+and")).cast("long").alias("n"))
    return x.where("n > 0")


@query("""SELECT o_orderkey, o_orderstatus FROM (SELECT *, date_trunc('month', o_orderdate) AS mon FROM orders) WHERE o_orderstatus IS DISTINCT FROM 'F'
AND (mon < TIMESTAMP '1996-12-01' OR mon = TIMESTAMP '1996-12-01' AND o_orderkey < 800) ORDER BY mon DESC, o_orderkey DESC LIMIT 21""")
def keyset_page(s, d):
    """The page after a row in the middle of many with the same time."""
    o = t(s, d, "orders").where(P.differs(F.col("o_orderstatus"), "F")).withColumn("at", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"))
    return K.keyset_page(o, "at", (dt.datetime(1996, 12, 1), 800), 20, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(s, d):
    return K.offset_page(t(s, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 3, 20).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM orders WHERE o_orderpriority LIKE '1%'")
def page_totals(s, d):
    return t(s, d, "orders").where(F.col("o_orderpriority").startswith("1")).agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).alias("pages"))


@query("""SELECT c.o_custkey % 10 AS grp, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled,
count(*) FILTER (WHERE o_orderstatus = 'X') AS missing FROM orders c GROUP BY 1""")
def status_counts_zero_filled(s, d):
    g = t(s, d, "orders").groupBy((F.col("o_custkey") % 10).alias("grp")).pivot("o_orderstatus", ["O", "F", "X"]).count().fillna(0)
    return g.select("grp", F.col("O").alias("open"), F.col("F").alias("filled"), F.col("X").alias("missing"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0) AS own, count(DISTINCT user_id) AS users,
array_to_string(list_sort(list(event_id))[1:3], ',') AS first3 FROM events GROUP BY event_type""")
def three_key_group_pivot(s, d):
    """Counts from partial sums; the first three of each type from a window that passes on three rows a task."""
    owner = F.when(F.col("user_id") % 2 == 0, "personal").otherwise("public")
    e = t(s, d, "events").select("event_type", "user_id", owner.alias("owner"), "event_id")
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("owner") == "personal").cast("long")).alias("own"), F.count_distinct("user_id").alias("users"))
    first = O.top_n(e.select("event_type", "event_id"), ["event_type"], ["event_id"], 3).groupBy("event_type")
    return sums.join(first.agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("first3")), "event_type")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) rn, count(*) OVER (PARTITION BY l_orderkey) n FROM lineitem)
SELECT o.o_orderkey, any_value(x.n) AS n, string_agg(CAST(x.l_partkey AS VARCHAR), ',' ORDER BY x.l_linenumber, x.l_partkey) AS parts
FROM orders o JOIN x ON o.o_orderkey = x.l_orderkey WHERE x.rn <= 3 AND o.o_orderstatus = 'O' GROUP BY o.o_orderkey""")
def post_comment_topn(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    x = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n")).where("rn <= 3")
    o = t(s, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    g = o.join(x, o.o_orderkey == x.l_orderkey).groupBy("o_orderkey")
    return g.agg(F.first("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda r: r["l_partkey"]), ",").alias("parts"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_enrichment(s, d):
    return t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def two_hop_enrichment(s, d):
    n = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("""SELECT c_mktsegment, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers, max(l_extendedprice) AS top
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40 GROUP BY c_mktsegment""")
def join_chain(s, d):
    l = t(s, d, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_suppkey", "l_extendedprice")
    j = t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("c_mktsegment").agg(F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"), F.max("l_extendedprice").alias("top"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)")
def anti_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 480000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH a AS (SELECT c_custkey AS alias, c_custkey AS id, 1 AS p FROM customer UNION ALL SELECT c_custkey + 100000 AS alias, c_custkey AS id, 2 AS p FROM customer),
b AS (SELECT alias, arg_min(id, p * 10000000 + id) AS id FROM a GROUP BY alias), k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 100000 END AS alias FROM orders)
SELECT k.o_orderkey, b.id FROM k LEFT JOIN b USING (alias)""")
def alias_join(s, d):
    c = t(s, d, "customer")
    a = c.select(F.col("c_custkey").alias("alias"), F.col("c_custkey").alias("id"), F.lit(1).alias("priority")).union(c.select(F.col("c_custkey") + 100000, "c_custkey", F.lit(2)))
    k = t(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 100000).alias("alias"))
    return K.resolved(k, "alias", a).select("o_orderkey", "id")


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) rn FROM conversations)
SELECT conv_id, max(turn) FILTER (WHERE rn = 1) AS last_turn, max(role) FILTER (WHERE rn = 1) AS last_role, count(*) FILTER (WHERE role <> 'user') AS unread FROM w GROUP BY conv_id""")
def latest_per_key_and_unread(s, d):
    g = t(s, d, "conversations").groupBy("conv_id")
    return g.agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count_if(F.col("role") != "user").alias("unread"))


@query("SELECT a.conv_id, a.turn, a.role, b.role AS replied_role FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def reply_self_join(s, d):
    a = t(s, d, "conversations").select("conv_id", "turn", "role")
    b = a.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("replied_role"))
    return a.join(b, ["conv_id", "turn"], "left")


@query("""WITH g AS (SELECT event_type, user_id % 5 AS u, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, event_type, u LIMIT 1)
SELECT event_id FROM events e JOIN g ON e.event_type = g.event_type AND e.user_id % 5 = g.u""")
def largest_group(s, d):
    e = t(s, d, "events").select("event_id", "event_type", (F.col("user_id") % 5).alias("u"))
    top = e.groupBy("event_type", "u").count().orderBy(F.desc("count"), "event_type", "u").limit(1)
    return e.join(F.broadcast(top), ["event_type", "u"], "left_semi").select("event_id")


@query("SELECT l_returnflag, median(l_quantity) AS median, quantile_disc(l_quantity, 0.9) AS p90, list_sort(list(l_quantity))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS lower90, max(l_quantity) AS top FROM lineitem GROUP BY l_returnflag")
def percentile_definitions(s, d):
    """Midpoint median, nearest rank, and lower index; the last by rank, so that no group is gathered into one row."""
    x = t(s, d, "lineitem").select("l_returnflag", "l_quantity")
    w = Window.partitionBy("l_returnflag").orderBy("l_quantity")
    counted = x.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("l_returnflag")))
    low = upto.where(F.col("upto") > F.floor((F.col("n") - 1) * 0.9)).groupBy("l_returnflag").agg(F.min("l_quantity").alias("lower90"))
    g = x.groupBy("l_returnflag").agg(F.expr("percentile(l_quantity, 0.5)").alias("median"), E.nearest_rank("l_quantity", 0.9).alias("p90"), F.max("l_quantity").alias("top"))
    return g.join(low, "l_returnflag")


@query("""WITH m AS (SELECT event_type, median(value) AS median FROM events GROUP BY 1), d AS (SELECT e.event_type, value, median, abs(value - median) AS dev FROM events e JOIN m USING (event_type)),
s AS (SELECT event_type, median(dev) AS mad FROM d GROUP BY 1)
SELECT d.event_type, round(any_value(median), 6) AS median, round(any_value(mad), 6) AS mad, round(median(value), 6) AS robust_median FROM d JOIN s USING (event_type) WHERE mad = 0 OR dev <= 1.5 * mad GROUP BY d.event_type""")
def mad_filtered_median(s, d):
    r = E.mad_filtered(t(s, d, "events").select("event_type", "value"), ["event_type"], "value", 1.5)
    return r.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "mad", "robust_median")])


@query("""WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), i AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS i FROM e),
r AS (SELECT user_id, i, count(*) AS days, max(d) AS stop FROM i GROUP BY 1, 2) SELECT user_id, max(days) AS highest, arg_max(days, stop) AS current, sum(days) AS active FROM r GROUP BY user_id""")
def user_streaks(s, d):
    return O.streaks(t(s, d, "events"), "user_id", "ts").groupBy("user_id").agg(F.max("days").alias("highest"), F.max_by("days", "end").alias("current"), F.sum("days").alias("active"))


@query("""WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), i AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS i FROM e),
k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, i ORDER BY d) AS s FROM i)
SELECT user_id, CAST(sum(10 + CASE WHEN s <= 10 THEN 0 WHEN s <= 30 THEN 2 WHEN s <= 90 THEN 5 WHEN s <= 180 THEN 10 WHEN s <= 270 THEN 15 ELSE 20 END + least(s // 10, 5)) AS BIGINT) AS points FROM k GROUP BY user_id""")
def daily_points(s, d):
    r = O.streaks(t(s, d, "events"), "user_id", "ts").select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("days"))).alias("s"))
    return r.groupBy("user_id").agg(F.sum(E.streak_points(F.col("s"))).cast("long").alias("points"))


@query("""SELECT user_id, target, n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) JOIN (VALUES (1), (5), (10), (50), (100)) m(target) ON n >= target""")
def milestones(s, d):
    n = t(s, d, "events").where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(F.array(*[F.lit(x) for x in (1, 5, 10, 50, 100)])).alias("target"), "n").where("n >= target")


@query("""SELECT o_custkey, CASE WHEN p >= 2000000 AND n >= 15 THEN 'top' WHEN p >= 1000000 THEN 'gold' WHEN p >= 300000 THEN 'silver' ELSE 'bronze' END AS tier
FROM (SELECT o_custkey, sum(o_totalprice) AS p, count(*) AS n FROM orders GROUP BY 1)""")
def rank_tiers(s, d):
    g = t(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("p"), F.count("*").alias("n"))
    return g.select("o_custkey", P.first_match([("top", F.expr("p >= 2000000 and n >= 15")), ("gold", F.col("p") >= 1000000), ("silver", F.col("p") >= 300000)], "bronze").alias("tier"))


@query("""SELECT event_id, n, n <= 3 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events)""")
def trailing_window_limit(s, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp")) * 1_000_000 + F.date_format("ts", "SSSSSS").cast("long")
    e = t(s, d, "events").select("event_id", "user_id", at.alias("us"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-6 * 3600 * 1_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("n")).withColumn("allowed", F.col("n") <= 3)


@query("""WITH RECURSIVE o AS (SELECT user_id, min(ts) AS opened FROM events GROUP BY 1 UNION ALL
SELECT e.user_id, min(e.ts) FROM o JOIN events e ON e.user_id = o.user_id AND e.ts >= o.opened + INTERVAL 86400 SECONDS GROUP BY e.user_id),
x AS (SELECT e.event_id, e.user_id AS key, e.ts AS "at", max(o.opened) AS opened FROM events e JOIN o ON o.user_id = e.user_id AND o.opened <= e.ts GROUP BY 1, 2, 3)
SELECT key, "at", opened, row_number() OVER (PARTITION BY key, opened ORDER BY "at") AS count, row_number() OVER (PARTITION BY key, opened ORDER BY "at") <= 2 AS allowed FROM x""")
def first_event_fixed_window(s, d):
    return O.first_event_windows(t(s, d, "events"), "user_id", "ts", 86_400, 2)


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, CAST(ts AS DATE) AS day FROM events), a AS (SELECT user_id, day, min(ts) AS t FROM e GROUP BY 1, 2 UNION ALL
SELECT e.user_id, e.day, min(e.ts) FROM a JOIN e ON e.user_id = a.user_id AND e.day = a.day AND e.ts >= a.t + INTERVAL 3600 SECONDS GROUP BY 1, 2) SELECT user_id AS key, t AS "at" FROM a""")
def accepted_heartbeats(s, d):
    return O.accepted(t(s, d, "events"), "user_id", "ts", 3600)


@query("""WITH w AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, turn, n FROM w WHERE used <= 600 OR rn = 1""")
def token_budget_tail(s, d):
    c = t(s, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return O.budget_tail(c, "conv_id", "turn", F.col("n"), 600)


@query("""WITH x AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS pt FROM conversations),
y AS (SELECT conv_id, turn, role, sum(CASE WHEN role IS DISTINCT FROM p AND pt IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) AS role, count(*) AS n FROM y GROUP BY conv_id, run""")
def role_runs(s, d):
    return O.runs(t(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.count("*").alias("n"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations""")
def forward_fill(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", O.filled_forward(F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn").alias("asked"))


@query("""WITH e AS (SELECT user_id, event_id AS a, event_id + 5 AS b FROM events), x AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
y AS (SELECT user_id, a, sum(CASE WHEN a - before > 240 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS cluster FROM x)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(a) AS low, max(a) AS high FROM y GROUP BY user_id, cluster""")
def gap_clusters(s, d):
    e = t(s, d, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 5).alias("b"))
    return O.gap_clusters(e, "user_id", "a", "b", 240).groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("a").alias("low"), F.max("a").alias("high"))


@query("SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(s, d):
    return t(s, d, "events").select("user_id", F.from_json("props", "k int")["k"].alias("k")).groupBy("user_id", "k").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders) GROUP BY o_custkey")
def recent_group_totals(s, d):
    o = t(s, d, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    floor = o.agg((F.max("o_orderdate") - F.expr("INTERVAL 365 DAYS")).alias("floor"))
    return o.join(F.broadcast(floor), F.col("o_orderdate") >= F.col("floor")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query("""SELECT k FROM (SELECT DISTINCT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def set_operations(s, d):
    c = t(s, d, "customer")
    a = t(s, d, "orders").select(F.col("o_custkey").alias("k")).union(c.where("c_acctbal > 5000").select("c_custkey")).distinct()
    return a.join(c.where("c_nationkey = 3").select(F.col("c_custkey").alias("k")), "k", "left_anti")


@query("""SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) rn FROM part) WHERE rn = 1""")
def first_wins_dedup(s, d):
    return O.first_wins(t(s, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"]).select("p_brand", "p_partkey", "p_name")


@query("""WITH n AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey FROM orders WHERE o_orderkey % 3 = 0)
SELECT o.o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey FROM orders o LEFT JOIN n USING (o_orderkey)""")
def upsert_by_key(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey")
    return K.upserted(o, o.where("o_orderkey % 3 = 0").withColumn("o_custkey", F.col("o_custkey") + 1), ["o_orderkey"], [F.desc("o_custkey")])


@query("""SELECT o_custkey, min_by_key AS o_orderkey, price FROM (SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS min_by_key, round(min(o_totalprice), 2) AS price, round(sum(o_totalprice), 1) AS s FROM orders GROUP BY 1)""")
def weakest_component(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_totalprice").alias("o_orderkey"), F.round(F.min("o_totalprice"), 2).alias("price"))


@query("""SELECT user_id, greatest(0, least(100, 50 + CAST(sum(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN -2 ELSE 0 END) AS BIGINT))) AS score FROM events GROUP BY user_id""")
def weighted_votes(s, d):
    v = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -2).otherwise(0)
    return t(s, d, "events").groupBy("user_id").agg(F.greatest(F.lit(0).cast("long"), F.least(F.lit(100).cast("long"), 50 + F.sum(v))).alias("score"))


@query("""SELECT s_suppkey, avg_q FROM (SELECT l_suppkey AS s_suppkey, floor(avg(q) + 0.5) AS avg_q FROM (SELECT l_suppkey, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1)""")
def representative_mean(s, d):
    g = t(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    return g.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(T.js_round(F.avg("q")).cast("double").alias("avg_q"))


@query("""SELECT p.l_partkey AS a, q.l_partkey AS b, count(*) AS n FROM lineitem p JOIN lineitem q ON p.l_orderkey = q.l_orderkey AND p.l_partkey < q.l_partkey GROUP BY 1, 2 HAVING count(*) > 1""")
def blocked_pairs(s, d):
    x = t(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"))
    n = K.parts_for(x)
    p = x.repartition(n, "l_orderkey")
    pairs = p.join(p.select("l_orderkey", F.col("a").alias("b")), "l_orderkey").where("a < b").select("a", "b")
    # Hardly any pair comes twice to a task, so they are counted where they meet: an order has some four lines, a line some pairs.
    return pairs.repartition(4 * n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS bucket, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'A') AS a, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1""")
def distinct_per_stance(s, d):
    b = P.first_match([("low", F.col("l_quantity") < 10), ("mid", F.col("l_quantity") < 30)], "high")
    k = lambda x: F.count_distinct(F.when(F.col("l_returnflag") == x, F.col("l_suppkey")))
    return t(s, d, "lineitem").groupBy(b.alias("bucket")).agg(k("A").alias("a"), k("R").alias("r"))


@query("""WITH q AS (SELECT event_id, value FROM events WHERE event_id < 5) SELECT q.event_id AS query_id, CAST(round(avg(x.value), 6) AS DOUBLE) AS mean16 FROM q, LATERAL (SELECT e.value FROM events e WHERE e.event_id >= 5 ORDER BY abs(ln((e.value + 400) / (q.value + 400))), e.event_id LIMIT 16) x GROUP BY 1""")
def nearest_runs(s, d):
    e = t(s, d, "events").select("event_id", "value")
    q = e.where("event_id < 5").select(F.col("event_id").alias("query_id"), F.col("value").alias("v"))  # a stated query set
    w = Window.partitionBy("query_id").orderBy(F.abs(F.log((F.col("value") + 400) / (F.col("v") + 400))), "event_id")
    near = e.where("event_id >= 5").join(F.broadcast(q), F.lit(True)).withColumn("rn", F.row_number().over(w)).where("rn <= 16")
    return near.groupBy("query_id").agg(F.round(F.avg("value"), 6).alias("mean16"))


@query("""SELECT p_partkey, CAST(greatest(20, least(14400, floor((18 + greatest(1, p_size) * 0.62 + least(180, (p_retailprice * 1000) / (1024 * 1024) * 0.28)) + 0.5))) AS BIGINT) AS seconds FROM part""")
def import_estimate(s, d):
    e = E.import_seconds(F.col("p_size"), F.col("p_retailprice") * 1000, F.lit(False), F.lit(None).cast("double"))
    return t(s, d, "part").select("p_partkey", e.cast("long").alias("seconds"))


@query("SELECT l_shipmode_proxy AS flag, round(avg(CASE WHEN l_quantity BETWEEN 10 AND 40 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(median(CASE WHEN l_quantity BETWEEN 10 AND 40 THEN 0.0 WHEN l_quantity < 10 THEN (10 - l_quantity) / l_quantity * 100 ELSE (l_quantity - 40) / l_quantity * 100 END), 6) AS error FROM (SELECT l_linestatus AS l_shipmode_proxy, l_quantity FROM lineitem) GROUP BY 1")
def interval_coverage(s, d):
    x = t(s, d, "lineitem").select(F.col("l_linestatus").alias("flag"), F.col("l_quantity").alias("q"))
    x = x.withColumn("e", E.interval_error(F.lit(10.0), F.lit(40.0), F.col("q")))
    return x.groupBy("flag").agg(F.round(F.avg(F.col("q").between(10, 40).cast("double")), 6).alias("coverage"), F.round(F.expr("percentile(e, 0.5)"), 6).alias("error"))
