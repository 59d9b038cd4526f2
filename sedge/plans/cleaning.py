"""Queries that clean extracted text and metadata, check copies and estimate durations."""

from __future__ import annotations

from pyspark.sql import functions as F, Window

from sedge.functions import cleaning as L, text as T
from sedge.operators import estimators as E, ordered as O, tables as K
from sedge.sources import table as t

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT doc_id, CASE WHEN c IN ('', 'unknown') THEN NULL WHEN c IN ('en', 'eng', 'en-us', 'en-gb', 'english') THEN 'en' WHEN regexp_matches(c, '^[a-z]{2,3}([-_].*)?$') THEN regexp_extract(c, '^[a-z]+') END AS code
FROM (SELECT doc_id, trim(lower(CASE doc_id % 5 WHEN 0 THEN lang || '-US' WHEN 1 THEN ' ' || lang || '_x ' WHEN 2 THEN 'English' WHEN 3 THEN 'x1' ELSE '' END)) AS c FROM documents)""")
def language_codes(s, d):
    k = F.col("doc_id") % 5
    name = F.when(k == 0, F.concat("lang", F.lit("-US"))).when(k == 1, F.concat(F.lit(" "), "lang", F.lit("_x "))).when(k == 2, "English").when(k == 3, "x1").otherwise("")
    return t(s, d, "documents").select("doc_id", L.language_code(name).alias("code"))


@query("""WITH c AS (SELECT doc_id, trim(unnest(string_split(text, '|'))) AS c FROM documents WHERE contains(text, '|')) SELECT doc_id, count(*) AS cells, count(*) FILTER (WHERE """
       + " OR ".join(f"regexp_matches(c, '{p}')" for p in L.PLAIN_CELLS) + """) AS plain FROM c GROUP BY doc_id""")
def plain_cells(s, d):
    c = t(s, d, "documents").where(F.contains("text", F.lit("|"))).select("doc_id", F.explode(F.split("text", r"\|")).alias("c"))
    return c.groupBy("doc_id").agg(F.count("*").alias("cells"), F.sum(L.plain_cell(F.col("c")).cast("long")).alias("plain"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size || 'b' WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE '' END AS number FROM part""")
def caption_numbers(s, d):
    k = F.col("p_size") % 3
    caption = F.when(k == 0, F.concat(F.lit("Supplementary FIG. "), "p_size", F.lit("B shows "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" (bảng "), "p_size", F.lit(")"))).otherwise(F.col("p_name"))
    return t(s, d, "part").select("p_partkey", L.caption_number(caption).alias("number"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(text, 'en ', 'en-' || chr(10)), 'non-' || chr(10), 'non-' || chr(10) || ' '), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
r AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN regexp_matches(a, '\\p{L}-$') AND regexp_matches(x, '^\\p{L}') THEN CASE WHEN regexp_matches(a, '(?i)(^|[^a-z])(""" + "|".join(L.COMPOUNDS) + """)-$') THEN a || x ELSE a[1:-2] || x END ELSE a || ' ' || x END) AS x FROM l WHERE len(l) > 0)
SELECT doc_id, md5(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS flowed FROM r""")
def reflowed_texts(s, d):
    broken = F.replace(F.replace("text", F.lit("en "), F.lit("en-\n")), F.lit("non-\n"), F.lit("non-\n "))
    x = t(s, d, "documents").select("doc_id", L.reflowed(broken).alias("x"))
    return x.where("x <> ''").select("doc_id", F.md5(F.col("x").cast("binary")).alias("flowed"))


@query("""SELECT doc_id, doc_id % 3 <> 0 AND length(text) >= 20 AS verified FROM documents""")
def anchors_verified(s, d):
    """Quotes checked against the texts they were taken from; every third was moved by one, short texts lack the place."""
    a = t(s, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("digest"), F.lit(5).alias("start"), F.lit(20).alias("end"))
    quote = F.when(F.length("text") >= 20, F.substring("text", 6, 15))
    a = a.withColumn("quote", quote).withColumn("digest", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("digest")))
    return a.select("doc_id", L.anchored(F.col("text"), F.col("digest"), F.col("start"), F.col("end"), F.col("quote")).alias("verified"))


@query("""SELECT event_id, greatest(0, epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000) AS ms FROM events QUALIFY lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL""")
def durations(s, d):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select("event_id", (at - F.lag(at).over(w)).alias("d")).where("d is not null").select("event_id", F.greatest(F.lit(0), "d").alias("ms"))


@query("""SELECT o_orderkey, nullif(trim(CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE o_orderpriority END), '') AS label, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year, CASE WHEN lower(o_orderstatus) IN ('o', 'f') THEN lower(o_orderstatus) ELSE 'other' END AS status FROM orders""")
def sanitized_metadata(s, d):
    """Blank texts as null, years as numbers within bounds, values outside a list as a default."""
    k = F.col("o_orderkey")
    return t(s, d, "orders").select(
        "o_orderkey", L.text_or_null(F.when(k % 4 == 0, "  ").otherwise(F.col("o_orderpriority"))).alias("label"),
        L.year(F.when(k % 5 == 0, F.when(k % 2 == 0, "9999").otherwise("n.d.")).otherwise(F.year("o_orderdate").cast("string"))).alias("year"), L.one_of(F.col("o_orderstatus"), ["o", "f"], "other").alias("status"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END AS word FROM part""")
def case_restored(s, d):
    k = F.col("p_partkey") % 3
    source = F.when(k == 0, F.col("p_type")).when(k == 1, F.lit("Word")).otherwise("word")
    word = F.when(k == 0, F.lower("p_type")).otherwise(F.col("p_name"))
    return t(s, d, "part").select("p_partkey", L.like_case(source, word).alias("word"))


@query("""WITH q AS (SELECT event_id AS query_id, value AS v FROM events WHERE event_id < 20), n AS (SELECT query_id, 1000 * value * greatest(0.65, least(1.65, pow((v + 400) / (value + 400), 0.32))) AS x FROM q, LATERAL (SELECT event_id, value FROM events WHERE event_id >= 20 ORDER BY abs(ln((value + 400) / (v + 400))), event_id LIMIT 16) e),
a AS (SELECT query_id, list_sort(list(x)) AS a FROM n WHERE x BETWEEN 1000 AND 1800000 GROUP BY query_id), m AS (SELECT query_id, a, a[CAST(floor((len(a) - 1) * 0.5) + 1 AS BIGINT)] AS m FROM a),
dv AS (SELECT *, list_sort(list_transform(a, lambda v: abs(v - m))) AS d FROM m), f AS (SELECT query_id, CASE WHEN d[CAST(floor((len(d) - 1) * 0.5) + 1 AS BIGINT)] > 0 THEN list_filter(a, lambda v: abs(v - m) <= 3.5 * d[CAST(floor((len(d) - 1) * 0.5) + 1 AS BIGINT)]) ELSE a END AS a FROM dv),
g AS (SELECT query_id, a, a[CAST(floor((len(a) - 1) * 0.5) + 1 AS BIGINT)] AS m FROM f), h AS (SELECT query_id, m, list_sort(list_transform(a, lambda v: abs(v - m)))[CAST(floor((len(a) - 1) * 0.5) + 1 AS BIGINT)] AS d FROM g)
SELECT query_id, CAST(greatest(5000, floor(m * 0.72 + 0.5)) AS BIGINT) AS min_ms, CAST(greatest(15000, floor(m + least(m * 0.08, d * 0.25) + 0.5)) AS BIGINT) AS max_ms FROM h""")
def run_intervals(s, d):
    """For a stated set of runs, the time to expect from the sixteen most like each, scaled to its size."""
    e = t(s, d, "events").select("event_id", "value")
    q = e.where("event_id < 20").select(F.col("event_id").alias("query_id"), F.col("value").alias("v"))  # twenty rows
    near = e.where("event_id >= 20").join(F.broadcast(q), F.lit(True)).withColumn("far", F.abs(F.log((F.col("value") + 400) / (F.col("v") + 400))))
    near = O.top_n(near, ["query_id"], ["far", "event_id"], 16).select("query_id", E.scaled_duration(F.col("value") * 1000, F.col("value"), F.col("v")).alias("x"))
    got = near.where("x between 1000 and 1800000").groupBy("query_id").agg(E.run_interval(F.collect_list("x")).alias("r"))
    return got.select("query_id", F.col("r.min_ms").alias("min_ms"), F.col("r.max_ms").alias("max_ms"))


@query("""WITH h AS (SELECT user_id, median(value / (10 + event_id % 50)) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase') WHERE n <= 8 GROUP BY user_id)
SELECT c_custkey, CAST(greatest(45, least(1800, floor(coalesce((45 + n * 0.06) * 0.3 + (45 + rate * n) * 0.7, 45 + n * 0.06) + 0.5))) AS BIGINT) AS seconds FROM (SELECT c_custkey, greatest(1, c_nationkey * 100) AS n FROM customer) LEFT JOIN h ON user_id = c_custkey""")
def analysis_estimates(s, d):
    runs = O.top_n(t(s, d, "events").where("event_type = 'purchase'"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 8)
    rate = runs.groupBy(F.col("user_id").alias("c_custkey")).agg(F.expr("percentile(value / (10 + event_id % 50), 0.5)").alias("rate"))
    c = t(s, d, "customer").join(rate, "c_custkey", "left")
    return c.select("c_custkey", E.analysis_seconds(F.col("c_nationkey") * 100, F.col("rate")).cast("long").alias("seconds"))


@query("""WITH h AS (SELECT l_suppkey, l_linestatus = 'O' AS ocr, median(greatest(0.05, (l_extendedprice / 100 - CASE WHEN l_linestatus = 'O' THEN 40 ELSE 18 END) / greatest(1, l_quantity))) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY l_orderkey * 10 + l_linenumber DESC) AS n FROM lineitem WHERE l_returnflag <> 'R' QUALIFY n <= 8) GROUP BY 1, 2)
SELECT s_suppkey, ocr, CAST(greatest(20, least(14400, floor((CASE WHEN ocr THEN 40 ELSE 18 END + 30 * CASE WHEN ocr THEN 7.5 ELSE 0.62 END + 2 * CASE WHEN ocr THEN 0.75 ELSE 0.28 END) * 0.25 + (CASE WHEN ocr THEN 40 ELSE 18 END + rate * 30 + 2 * CASE WHEN ocr THEN 0.75 ELSE 0.28 END) * 0.75 + 0.5))) AS BIGINT) AS seconds FROM supplier JOIN h ON l_suppkey = s_suppkey""")
def import_estimates(s, d):
    """Seconds to import 30 pages of 2 MB, from each owner's last eight comparable imports."""
    l = t(s, d, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order"), (F.col("l_extendedprice") / 100).alias("seconds"),
        F.col("l_quantity").alias("pages"), (F.col("l_linestatus") == "O").alias("ocr"), (F.col("l_returnflag") != "R").alias("succeeded"),
    )
    rate = E.page_rate(l, ["s_suppkey"])
    return rate.select("s_suppkey", "ocr", E.import_seconds(F.lit(30), F.lit(2 * 1024 * 1024), F.col("ocr"), F.col("rate")).cast("long").alias("seconds"))


SIGNALS = [("both", ["thand", "onen"], [], ["nicht"]), ("either", [], ["erthe", "que"], []), ("plain", ["the"], [], ["[0-9]"])]


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, 'thand') AND regexp_matches(text, 'onen') AND NOT regexp_matches(text, 'nicht') THEN 'both' WHEN regexp_matches(text, 'erthe|que') THEN 'either' WHEN regexp_matches(text, 'the') AND NOT regexp_matches(text, '[0-9]') THEN 'plain' ELSE 'none' END AS signal FROM documents""")
def signals(s, d):
    return t(s, d, "documents").select("doc_id", L.signal(F.col("text"), SIGNALS, "none").alias("signal"))


@query("""WITH x AS (SELECT c_mktsegment AS topic, o_orderpriority AS source, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT topic, source, count(*) AS n FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, source) AS place FROM n),
q AS (SELECT *, row_number() OVER (PARTITION BY topic, source ORDER BY o_totalprice DESC, o_orderkey) AS k FROM x) SELECT topic, source, place, n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY k) AS quotes FROM r JOIN q USING (topic, source) WHERE place <= 4 AND k <= 3 GROUP BY 1, 2, 3, 4""")
def grouped_evidence(s, d):
    """The four sources of each topic with the most evidence, and the three best quotes of each."""
    x = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("topic"), F.col("o_orderpriority").alias("source"), "o_orderkey", "o_totalprice")
    n = O.numbered(x.groupBy("topic", "source").agg(F.count("*").alias("n")), ["topic"], [F.desc("n"), "source"], "place").where("place <= 4")
    best = O.top_n(x, ["topic", "source"], [F.desc("o_totalprice"), "o_orderkey"], 3).groupBy("topic", "source")
    quotes = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))), lambda q: q["o_orderkey"])
    return n.join(best.agg(F.array_join(quotes, ",").alias("quotes")), ["topic", "source"]).select("topic", "source", "place", "n", "quotes")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey || ':' || o_orderstatus AS v FROM orders), n AS (SELECT id, CASE WHEN id % 7 = 0 THEN v || '!' ELSE v END AS v FROM o WHERE id % 5 <> 0 UNION ALL SELECT id + 1000000, v FROM o WHERE id % 100 = 0)
SELECT CASE WHEN o.id IS NULL THEN 'unknown' WHEN n.id IS NULL THEN 'missing' WHEN o.v <> n.v THEN 'conflict' ELSE 'same' END AS state, count(*) AS n FROM o FULL JOIN n ON o.id = n.id GROUP BY 1""")
def migration_check(s, d):
    """A copied table against its source by key and digest: rows that are the same, that conflict, that are missing, that nobody sent."""
    k = F.col("id")
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(":", "o_custkey", "o_orderstatus").alias("v"))
    n = o.where(k % 5 != 0).select("id", F.when(k % 7 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")).alias("v")).unionByName(o.where(k % 100 == 0).select((k + 1_000_000).alias("id"), "v"))
    a, b = [x.select("id", F.sha2("v", 256).alias(c)) for x, c in ((o, "old"), (n, "new"))]
    state = F.when(F.col("old").isNull(), "unknown").when(F.col("new").isNull(), "missing").when(F.col("old") != F.col("new"), "conflict").otherwise("same")
    return a.join(b, "id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT l_suppkey AS source, l_orderkey AS rule FROM lineitem), k AS (SELECT * FROM e WHERE source % 10 <> 3) SELECT o_orderkey, (SELECT count(DISTINCT source) FROM k WHERE rule = o_orderkey) AS sources FROM orders WHERE o_orderkey IN (SELECT rule FROM k) OR o_orderkey NOT IN (SELECT rule FROM e)""")
def retracted_sources(s, d):
    """Evidence of withdrawn sources goes, and with it the rules that had no other; rules that never had any stay."""
    e = t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_suppkey") % 10 != 3, F.col("l_suppkey")).alias("source"))
    n = K.parts_for(e)
    each = e.repartition(n, "o_orderkey").groupBy("o_orderkey", "source").agg(F.lit(True).alias("had"))
    kept = each.groupBy("o_orderkey").agg(F.count("source").alias("sources"))  # of an order's rows in one partition; 0 where all are withdrawn
    met = t(s, d, "orders").select("o_orderkey").repartition(n, "o_orderkey").join(kept, "o_orderkey", "left")
    return met.where("sources is null or sources > 0").select("o_orderkey", F.coalesce("sources", F.lit(0).cast("long")).alias("sources"))


@query("""SELECT l_partkey, l_returnflag, l_linestatus, count(*) AS n, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)) AS spans FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def signature_dedup(s, d):
    """Rows with one composite signature as one, with all their spans."""
    g = t(s, d, "lineitem").groupBy("l_partkey", "l_returnflag", "l_linestatus")
    return g.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("l_orderkey").cast("string"))), ",").alias("spans")).where("n > 1")


@query("""SELECT doc_id, replace(x, '[?]', CASE WHEN doc_id % 4 = 0 THEN '' ELSE '[' || (doc_id % 4) || ']' END) AS text FROM (SELECT doc_id, text || ' [?] and [1].' AS x FROM documents)""")
def rewritten_markers(s, d):
    """Open citation marks as the number of the source found since, or taken out where there is none."""
    number = F.nullif(F.col("doc_id") % 4, F.lit(0))
    x = F.concat("text", F.lit(" [?] and [1]."))
    mark = F.coalesce(F.concat(F.lit("["), number.cast("string"), F.lit("]")), F.lit(""))
    return t(s, d, "documents").select("doc_id", F.replace(x, F.lit("[?]"), mark).alias("text"))


PROTECTED = ["10\\.[0-9]{4,9}/[^\\s]+", "\\[[0-9, ]+\\]", "p\\s*[<=>]\\s*[0-9.]+", "[0-9]+(?:\\.[0-9]+)?%", "[0-9]+(?:\\.[0-9]+)?"]


@query("WITH x AS (SELECT doc_id, text, list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}')" for p in PROTECTED) + ")) AS p FROM documents) SELECT doc_id, CAST(len(p) AS INTEGER) AS n, len(list_filter(p, lambda x: NOT contains(replace(text, '7', '8'), x))) = 0 AS kept FROM x")
def protected_tokens(s, d):
    """Tokens that a translation must keep, and whether one that changes a digit keeps them."""
    x = F.col("text")
    return t(s, d, "documents").select("doc_id", F.size(T.protected_tokens(x)).alias("n"), T.tokens_kept(x, F.replace(x, F.lit("7"), F.lit("8"))).alias("kept"))


_SET = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) >= 3))"


@query(f"""WITH f AS (SELECT conv_id, arg_max({_SET.format('text')}, length(text) * 1000 - turn) AS hay FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, hay)) / len(w) ELSE 0 END, 6) AS coverage FROM (SELECT conv_id, turn, {_SET.format('text')} AS w FROM conversations) JOIN f USING (conv_id)""")
def needle_coverage(s, d):
    """How many of a message's words its conversation's longest message has."""
    c = t(s, d, "conversations").select("conv_id", "turn", T.token_set(F.col("text")).alias("w"), F.length("text").alias("n"))
    longest = c.groupBy("conv_id").agg(F.max_by("w", F.struct("n", -F.col("turn"))).alias("hay"))
    return c.join(longest, "conv_id").select("conv_id", "turn", F.round(T.coverage(F.col("w"), F.col("hay")), 6).alias("coverage"))


@query("""SELECT doc_id, CAST(2 AS INTEGER) AS dois, doc_id % 10 = 3 AS isbn10, doc_id % 2 = 0 AS isbn13 FROM documents""")
def identifiers(s, d):
    """DOIs in a text, and ISBNs whose check digit is right."""
    k = F.col("doc_id")
    x = F.concat(F.lit("see doi:10.1234/abc."), k, F.lit(" and https://doi.org/10.55555/x-"), k, F.lit(" or 10.12/short"))
    ten = F.concat(F.lit("0-306-40615-"), (F.lit(1) + (k + 8) % 10).cast("string"))
    thirteen = F.when(k % 2 == 0, "978-0-306-40615-7").otherwise("978-0-306-40615-8")
    return t(s, d, "documents").select("doc_id", F.size(T.dois(x)).alias("dois"), T.isbn10(ten).alias("isbn10"), T.isbn13(thirteen).alias("isbn13"))
