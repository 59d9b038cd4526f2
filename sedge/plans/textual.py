"""Queries over texts, vectors, pages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F, Window

from sedge.functions import text as T, vectors as V
from sedge.operators import estimators as E, ordered as O, tables as K
from sedge.operators.components import components
from sedge.sources import html, table as t
from sedge.streaming import events as stream

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WORDS = "list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) > 0)"


@query(f"SELECT doc_id, len({WORDS}) AS words, len(list_distinct(list_filter({WORDS}, lambda w: length(w) >= 3))) AS different FROM documents")
def fold_and_token_stats(s, d):
    x = F.col("text")
    return t(s, d, "documents").select("doc_id", F.size(T.words(x)).cast("long").alias("words"), F.size(T.token_set(x)).cast("long").alias("different"))


@query("""SELECT doc_id, CASE WHEN de >= 12 AND de > 1.15 * en THEN 'de' WHEN en >= 12 AND en > 1.15 * de THEN 'en' ELSE 'unknown' END AS vote FROM (
SELECT doc_id, 4 * len(regexp_extract_all(lower(text), '[ .](der|die|und|das)[ .,]')) + least(40, len(regexp_extract_all(text, '[äöüß]'))) AS de, 4 * len(regexp_extract_all(lower(text), '[ .](the|and|of|to)[ .,]')) AS en FROM documents)""")
def language_vote(s, d):
    n = lambda c, p: F.regexp_count(c, F.lit(p))
    low = F.lower("text")
    x = t(s, d, "documents").select("doc_id", (4 * n(low, "[ .](der|die|und|das)[ .,]") + F.least(F.lit(40), n(F.col("text"), "[äöüß]"))).alias("de"), (4 * n(low, "[ .](the|and|of|to)[ .,]")).alias("en"))
    win = lambda a, b: (F.col(a) >= 12) & (F.col(a) > 1.15 * F.col(b))
    return x.select("doc_id", F.when(win("de", "en"), "de").when(win("en", "de"), "en").otherwise("unknown").alias("vote"))


@query("""SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: length(trim(x, ' ' || chr(10) || chr(9) || chr(13))) > 0)) AS n FROM documents""")
def sentence_counts(s, d):
    return t(s, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query("SELECT text_key, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS text_key FROM documents) GROUP BY text_key HAVING count(*) > 1")
def exact_dup_groups(s, d):
    return t(s, d, "documents").groupBy(T.symbol_key(F.col("text")).alias("text_key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM w, LATERAL unnest(range(1, len(w) - 6)) r(i)),
b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark), h AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS g FROM b, LATERAL unnest(range(1, len(w) - 6)) r(i))
SELECT item_id, doc_id, count(*) AS n FROM g JOIN h USING (g) GROUP BY 1, 2""")
def benchmark_contamination(s, d):
    """8-grams meet by their hash; the words of the few that meet are then compared."""

    def words(df, key):
        return df.select(key, F.split(T.symbol_key(F.col("text")), " ").alias("w")).where(F.size("w") >= 8)

    def grams(df, key, at):
        g = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(F.slice("w", i, 8)))
        return words(df, key).select(key, F.posexplode(g).alias(at, "h"))

    docs, items = t(s, d, "documents"), t(s, d, "benchmark")
    met = grams(docs, "doc_id", "i").join(grams(items, "item_id", "j"), "h").join(words(items, "item_id").withColumnRenamed("w", "v"), "item_id")
    met = met.join(words(docs, "doc_id"), "doc_id").withColumn("g", F.slice("w", F.col("i") + 1, 8)).where(F.col("g") == F.slice("v", F.col("j") + 1, 8))
    return met.groupBy("item_id", "doc_id").agg(F.count_distinct("g").alias("n"))


COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query(f"SELECT b.vec_id, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 ORDER BY {COS} DESC, b.vec_id LIMIT 20")
def cosine_topk(s, d):
    e = t(s, d, "embeddings")
    q = e.where("vec_id = 7").select(F.col("embedding").alias("q"))  # one query row
    x = e.where("vec_id <> 7").join(F.broadcast(q), F.lit(True)).select("vec_id", V.cosine(F.col("q"), F.col("embedding")).alias("c"))
    return x.orderBy(F.desc("c"), "vec_id").limit(20).select("vec_id", F.round("c", 6).alias("score"))


@query("""WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, LATERAL unnest(range(1, 65)) r(i) GROUP BY 1, 2), k AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY 1)
SELECT label, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM k""")
def centroid_norms(s, d):
    x = t(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return x.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"))


@query(f"""WITH q AS (SELECT list_distinct(list_filter({WORDS}, lambda w: length(w) >= 3)) AS qw FROM documents WHERE doc_id = 3),
x AS (SELECT d.doc_id, list_distinct(list_filter({WORDS}, lambda w: length(w) >= 3)) AS w FROM documents d), l AS (SELECT doc_id, CASE WHEN least(len(w), len(qw)) > 0 THEN len(list_intersect(w, qw)) / least(len(w), len(qw)) ELSE 0 END AS lex FROM x, q),
c AS (SELECT b.vec_id AS doc_id, {COS} AS cos FROM embeddings a, embeddings b WHERE a.vec_id = 3)
SELECT doc_id, round(s, 6) AS score FROM (SELECT l.doc_id, CASE WHEN l.doc_id = 3 THEN 1 WHEN cos IS NULL THEN lex ELSE 0.85 * greatest(0, cos) + 0.15 * lex END AS s FROM l LEFT JOIN c USING (doc_id)) WHERE round(s, 6) >= 0.1""")
def hybrid_rank(s, d):
    docs = t(s, d, "documents").select("doc_id", T.token_set(F.col("text")).alias("w"))
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = docs.where("doc_id = 3").join(e, "doc_id").select(F.col("w").alias("qw"), F.col("embedding").alias("qe"))  # one query row
    x = docs.join(e, "doc_id", "left").join(F.broadcast(q), F.lit(True))
    cos = F.when(F.col("embedding").isNotNull(), V.cosine(F.col("qe"), F.col("embedding")))
    score = V.blended(F.col("doc_id") == 3, cos, T.overlap(F.col("w"), F.col("qw")))
    return x.select("doc_id", F.round(score, 6).alias("score")).where("score >= 0.1")


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), c AS (SELECT doc_id, w, i AS chunk FROM w, LATERAL unnest(range(0, CAST(greatest(0, ceil((len(w) - 1000) / 850.0)) AS BIGINT) + 1)) r(i))
SELECT doc_id, chunk, chunk * 850 AS start, len(w[chunk*850+1:chunk*850+1000]) AS n FROM c WHERE chunk = 0 OR len(w[chunk*850+1:chunk*850+1000]) >= 80""")
def sliding_chunks(s, d):
    c = O.sliding(t(s, d, "documents").select("doc_id", T.words(F.col("text")).alias("w")), "doc_id", "w", 1000, 850, 80)
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.size("tokens").cast("long").alias("n"))


@query("""WITH RECURSIVE x AS (SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 0)) AS BIGINT) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r AS (SELECT conv_id, turn, n, rn, n AS held, CAST(0 AS BIGINT) AS bin FROM x WHERE rn = 1 UNION ALL
SELECT x.conv_id, x.turn, x.n, x.rn, CASE WHEN r.held > 0 AND r.held + x.n > 120 THEN x.n ELSE r.held + x.n END, CASE WHEN r.held > 0 AND r.held + x.n > 120 THEN r.bin + 1 ELSE r.bin END FROM r JOIN x ON x.conv_id = r.conv_id AND x.rn = r.rn + 1)
SELECT conv_id, turn, n, bin FROM r""")
def greedy_chunks(s, d):
    x = t(s, d, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).cast("long").alias("n"))
    return O.packed(x, "conv_id", "turn", "n", 120)


@query(None)
def html_blocks(s, d):
    return html.blocks(t(s, d, "pages"))


@query(None)
def block_quality(s, d):
    return html.quality(html.blocks(t(s, d, "pages")))


@query("""SELECT lower(w) AS skeleton, count(*) AS n, count(DISTINCT w) AS forms, arg_max(w, c * 1000000 - rn) AS dominant FROM (SELECT w, c, row_number() OVER (PARTITION BY lower(w) ORDER BY c DESC, w) AS rn FROM (
SELECT w, count(*) AS c FROM (SELECT unnest(list_filter(string_split(trim(regexp_replace(text, '[^\\p{L}]+', ' ', 'g')), ' '), lambda x: length(x) > 0)) AS w FROM documents) GROUP BY w)) GROUP BY lower(w)
HAVING count(*) > 1 AND max(c) >= 3 AND max(c) >= 1.5 * max(CASE WHEN rn = 2 THEN c END)""")
def form_dominance(s, d):
    w = F.filter(F.split(F.trim(F.regexp_replace("text", r"[^\p{L}]+", " ")), " "), lambda x: F.length(x) > 0)
    c = t(s, d, "documents").select(F.explode(w).alias("w")).groupBy("w").agg(F.count("*").alias("c")).withColumn("skeleton", F.lower("w"))
    r = c.withColumn("rn", F.row_number().over(Window.partitionBy("skeleton").orderBy(F.desc("c"), "w")))
    g = r.groupBy("skeleton").agg(F.count("*").alias("n"), F.count_distinct("w").alias("forms"), F.max(F.when(F.col("rn") == 1, F.col("w"))).alias("dominant"), F.max("c").alias("top"), F.max(F.when(F.col("rn") == 2, F.col("c"))).alias("next"))
    return g.where("n > 1 and top >= 3 and top >= 1.5 * next").select("skeleton", "n", "forms", "dominant")


@query("""SELECT line, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(l)),
'(^|[^\\p{L}\\p{N}_])(page|trang|p|pp)\\.?\\s*[0-9]+(\\s*(of|/)\\s*[0-9]+)?($|[^\\p{L}\\p{N}_])', '\\1\\2 #\\5', 'g'), '^[0-9]+$', '#'), '\\s*[0-9]+\\s*$', ' #'), '^\\s*[0-9]+\\s*', '# '),
'[^\\p{L}\\p{N}_\\s#]', '', 'g'), '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 2""")
def repeated_lines(s, d):
    x = t(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", T.line_key(F.col("l")).alias("line")).where("line <> ''")
    return x.groupBy("line").agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 2")


@query("SELECT lang, sum(CAST(regexp_matches(text, '(?i)(token|secret|password)\\s*[=:]') AS BIGINT)) AS n, sum(CAST(regexp_matches(text, '[0-9]{6}') AS BIGINT)) AS codes FROM documents GROUP BY lang")
def secret_counts(s, d):
    n = lambda p: F.sum(F.col("text").rlike(p).cast("long"))
    return t(s, d, "documents").groupBy("lang").agg(n(r"(?i)(token|secret|password)\s*[=:]").alias("n"), n("[0-9]{6}").alias("codes"))


@query(rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(x, '(?i)\b(?:otp|verification code)\b') THEN regexp_replace(x, '\b[0-9]{{6}}\b', '[REDACTED]', 'g') ELSE x END AS text FROM (
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'),
'(?i)([?&](?:token|otp|code|password|secret|key|authorization)=)[^&#\s]*', '\1[REDACTED]', 'g'), '(?i)("(?:{T.SECRET_KEYS})"\s*:\s*)"[^"]*"', '\1"[REDACTED]"', 'g') AS x FROM conversations)""")
def redacted_turns(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", T.redacted(F.col("text")).alias("text"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def content_digest(s, d):
    return K.digest(t(s, d, "conversations"), ["conv_id"], F.col("turn"), F.col("text"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE lang IN ('en', 'de')), p AS (SELECT *, CASE WHEN rn <= 25 THEN 0 ELSE 1 END AS late FROM r)
SELECT doc_id, lang FROM p ORDER BY late, doc_id LIMIT 50""")
def lang_balanced_sample(s, d):
    x = t(s, d, "documents").where(F.col("lang").isin("en", "de")).select("doc_id", "lang")
    w = Window.partitionBy("lang").orderBy("doc_id")
    r = x.withColumn("rn", F.row_number().over(w)).where("rn <= 50")  # no more of one can be wanted
    return r.orderBy(F.when(F.col("rn") <= 25, 0).otherwise(1), "doc_id").limit(50).select("doc_id", "lang")


def _cases(s, d):
    """A case for each user: parts of orders they should have seen (large amounts), the first 12 they saw, returned ones forbidden, a claim for each order."""
    l = t(s, d, "lineitem").join(t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"), "o_orderstatus", "o_totalprice"), "l_orderkey")
    part = F.col("l_partkey").cast("string")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]  # rows that tie in all of these show the same part
    shown = O.top_n(l, ["id"], order, 12).select("id", F.struct(*order, part.alias("part")).alias("x"))
    retrieved = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"])
    claims = l.groupBy("id", "l_orderkey", "o_orderstatus").agg(F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 35, part))).alias("citationIds"))
    claims = claims.groupBy("id").agg(F.collect_list(F.struct(F.col("l_orderkey").cast("string").alias("text"), "citationIds", (F.col("o_orderstatus") == "F").alias("supported"))).alias("claims"))
    marked = l.groupBy("id").agg(
        F.collect_set(F.when(F.col("l_extendedprice") > 60_000, part)).alias("relevant"), F.collect_set(F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09), part)).alias("forbidden"),
        F.when(F.max("o_totalprice") > 150_000, F.max("o_totalprice") / 300_000).alias("relevance"),
    )
    return marked.join(shown.groupBy("id").agg(retrieved.alias("retrieved")), "id").join(claims, "id")


RAG_SQL = """WITH l AS (SELECT o_custkey AS id, o_orderstatus, o_totalprice, lineitem.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
got AS (SELECT id, l_partkey AS part, row_number() OVER (PARTITION BY id ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM l QUALIFY rn <= 12),
rel AS (SELECT DISTINCT id, l_partkey AS part FROM l WHERE l_extendedprice > 60000), bad AS (SELECT DISTINCT id, l_partkey AS part FROM l WHERE l_returnflag = 'R' AND l_discount > 0.09),
cite AS (SELECT id, l_orderkey, o_orderstatus, count(*) FILTER (WHERE l_quantity > 35) AS n, count(*) FILTER (WHERE l_quantity > 35 AND NOT EXISTS (SELECT 1 FROM got WHERE got.id = l.id AND got.part = l.l_partkey)) AS lost FROM l GROUP BY 1, 2, 3),
claim AS (SELECT id, avg(CASE WHEN n > 0 AND lost = 0 AND o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS faithfulness, avg(CASE WHEN n > 0 AND lost = 0 THEN 1.0 ELSE 0 END) AS traceability FROM cite GROUP BY id),
hits AS (SELECT got.id, count(*) AS n, count(rel.part) AS good, count(DISTINCT rel.part) AS found, min(CASE WHEN rel.part IS NOT NULL THEN rn END) AS first, count(bad.part) AS leaked FROM got LEFT JOIN rel USING (id, part) LEFT JOIN bad USING (id, part) GROUP BY got.id),
wanted AS (SELECT id, count(*) AS n FROM rel GROUP BY id), best AS (SELECT id, max(o_totalprice) AS top FROM l GROUP BY id),
m AS (SELECT hits.id, good / hits.n AS precision, coalesce(found / wanted.n, 1.0) AS recall, coalesce(1.0 / first, 0) AS reciprocal_rank, faithfulness, traceability, leaked = 0 AS privacy,
CASE WHEN top > 150000 THEN least(1.0, top / 300000) END AS relevance FROM hits JOIN claim USING (id) JOIN best USING (id) LEFT JOIN wanted USING (id))
"""
ROUNDED = ("precision", "recall", "reciprocal_rank", "faithfulness", "traceability", "relevance")


@query(RAG_SQL + "SELECT id, privacy, " + ", ".join(f"round({c}, 6) AS {c}" for c in ROUNDED) + " FROM m")
def rag_metrics(s, d):
    return E.retrieval_metrics(_cases(s, d)).select("id", "privacy", *[F.round(c, 6).alias(c) for c in ROUNDED])


@query(RAG_SQL + "SELECT count(*) AS cases, round(avg(CASE WHEN privacy THEN 1.0 ELSE 0 END), 6) AS privacy_rate, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ROUNDED) + " FROM m")
def rag_summary(s, d):
    m = E.metrics_summary(E.retrieval_metrics(_cases(s, d)))
    return m.select("cases", F.round("privacy_rate", 6).alias("privacy_rate"), *[F.round(c, 6).alias(c) for c in ROUNDED])


@query("""SELECT doc_id, CASE WHEN length(x) > 80 THEN substr(x, 1, 79) || '…' ELSE x END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)""")
def excerpts(s, d):
    return t(s, d, "documents").select("doc_id", T.excerpt(F.col("text"), 80).alias("excerpt"))


@query("SELECT doc_id, CAST(ceil(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 4 + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) / 2.6) AS BIGINT) AS tokens FROM documents")
def token_estimates(s, d):
    return t(s, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, substr(sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))), 1, 32) AS key FROM documents")
def content_keys(s, d):
    return t(s, d, "documents").select("doc_id", T.content_key(F.col("text")).alias("key"))


@query("""WITH RECURSIVE e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id > b.doc_id), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS root FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.root = u.a) SELECT node, min(root) AS root FROM r GROUP BY node""")
def copy_clusters(s, d):
    x = t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    least = x.groupBy("h").agg(F.min("doc_id").alias("b"))
    return components(x.join(least, "h").where("doc_id > b").select(F.col("doc_id").alias("a"), "b"))


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0 AND round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) >= 0.1""")
def lexical_overlap_pairs(s, d):
    """Candidates share a word (an equality join on the inverted index), so no pair is made that can't score."""
    w = t(s, d, "benchmark").select("item_id", T.token_set(F.col("text")).alias("w"))
    i = w.select("item_id", F.size("w").alias("n"), F.explode("w").alias("k"))
    x = i.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "k").join(i.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "k"), "k").where("a < b")
    g = x.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return g.select("a", "b", F.round(F.col("c") / F.least("na", "nb"), 6).alias("overlap")).where("overlap >= 0.1")


@query("SELECT page_id, CASE WHEN u[-1:] = '/' THEN u[1:-2] ELSE u END AS url FROM (SELECT page_id, CASE WHEN starts_with(v, 'www.') THEN v[5:] ELSE v END AS u FROM (SELECT page_id, CASE WHEN starts_with(x, 'https://') THEN x[9:] WHEN starts_with(x, 'http://') THEN x[8:] ELSE x END AS v FROM (SELECT page_id, lower(trim(url)) AS x FROM pages)))")
def normal_urls(s, d):
    return t(s, d, "pages").select("page_id", T.normal_url(F.col("url")).alias("url"))


@query("SELECT event_type, CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS opened, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_counts(s, d):
    return stream.tumbling(s, f"{d}/events.parquet", "6 hours")


@query("""WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM n)
SELECT user_id, epoch_us(min(ts)) AS opened, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(s, d):
    """Sessions of each user on a stream: events with less than twelve hours between them."""
    e = stream.sessions(stream.source(s, f"{d}/events.parquet"), "user_id", "12 hours", "1 day")
    return stream.drained(e.select("user_id", F.unix_micros("session_window.start").alias("opened"), "n"), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_idempotent(s, d):
    return stream.once_by_key(s, f"{d}/events.parquet", ["user_id", "event_type"])
