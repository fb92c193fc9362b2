"""Histograms, rates, counts and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from .registry import Tables, query

QUANTITY = [0, 2, 10, 20, 30, 40, 50]
BALANCE = [-1000, -990, 0, 2500, 5000, 7500, 9900, 9990, 10000]


def histogram_sql(table: str, value: str, edges: list[float]) -> str:
    n = len(edges) - 1
    bins = " UNION ALL ".join(f"SELECT {i}::BIGINT AS bin, '{edges[i]:g}–{edges[i + 1]:g}' AS label, count(*) FILTER (WHERE ({value} >= {edges[i]} AND {value} < {edges[i + 1]}) OR ({i} = {n - 1} AND {value} = {edges[-1]})) AS c FROM {table}" for i in range(n))
    return f"SELECT bin, label, CASE WHEN c >= 5 OR c = 0 THEN c END AS n FROM ({bins})"


@query(histogram_sql("lineitem", "l_quantity", QUANTITY))
def hist_suppressed(t: Tables) -> DataFrame:
    return A.histogram(t.lineitem, F.col("l_quantity"), QUANTITY)


@query(histogram_sql("customer", "c_acctbal", BALANCE))
def hist_balance(t: Tables) -> DataFrame:
    return A.histogram(t.customer, F.col("c_acctbal"), BALANCE)


@query("""SELECT d.source, count(l.toxic) AS tested, CASE WHEN sum(coalesce(l.toxic, 0)) >= 5 OR sum(coalesce(l.toxic, 0)) = 0 THEN sum(coalesce(l.toxic, 0))::BIGINT END AS positive,
CASE WHEN NOT (sum(coalesce(l.toxic, 0)) BETWEEN 1 AND 4) AND count(l.toxic) > 0 THEN round(sum(coalesce(l.toxic, 0)) / count(l.toxic), 4) END AS rate,
sum(coalesce(l.toxic, 0)) BETWEEN 1 AND 4 AS suppressed, count(*) - count(l.toxic) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def rate_suppressed(t: Tables) -> DataFrame:
    return A.rates(t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left"), ["source"], F.col("toxic") == 1)


@query("SELECT d.lang, count(*) AS n, count(*) - count(l.quality) AS missing, round(avg(d.n_chars), 1) AS mean_chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def missing_counts(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n"), (F.count("*") - F.count("quality")).alias("missing"), F.round(F.avg("n_chars"), 1).alias("mean_chars"))


@query("""WITH u AS (SELECT 'orders' AS origin, o_totalprice AS v FROM orders UNION ALL SELECT 'events', value FROM events)
SELECT origin, count(*) AS n, round(avg(v), 1) AS mean_value, count(*) - count(v) AS missing, CASE WHEN count(*) FILTER (WHERE v > 400) >= 5 OR count(*) FILTER (WHERE v > 400) = 0 THEN count(*) FILTER (WHERE v > 400) END AS large FROM u GROUP BY origin""")
def union_dashboard(t: Tables) -> DataFrame:
    orders = t.orders.select(F.lit("orders").alias("origin"), F.col("o_totalprice").alias("v"))
    both = orders.unionByName(t.events.select(F.lit("events").alias("origin"), F.col("value").alias("v")))
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.round(F.avg("v"), 1).alias("mean_value"), (F.count("*") - F.count("v")).alias("missing"), A.suppressed(F.count_if(F.col("v") > 400)).alias("large"))


@query("SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1")
def count_by_state(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, bool_and(o_totalprice > 0) AS all_paid FROM orders GROUP BY 1")
def pivot_status(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"), F.bool_and(F.col("o_totalprice") > 0).alias("all_paid"))


@query("SELECT d.source, bool_or(l.toxic = 1) AS any_toxic, bool_or(CASE WHEN l.quality = 1 THEN l.toxic = 1 END) AS any_good_toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def bool_three_valued(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return d.groupBy("source").agg(A.any_true(F.col("toxic") == 1).alias("any_toxic"), A.any_true(F.when(F.col("quality") == 1, F.col("toxic") == 1)).alias("any_good_toxic"))


CONFIDENCE = "least(n_chars / 8000.0, 1.0)"


@query(f"WITH x AS (SELECT least({CONFIDENCE}::DOUBLE, 1.0) AS c, l.quality = 1 AS r FROM documents JOIN labels l USING (doc_id)) SELECT least(9, floor(c * 10))::BIGINT AS bin, count(*) AS n, round(avg(CASE WHEN r THEN 1.0 ELSE 0.0 END), 4) AS acc FROM x GROUP BY 1")
def calibration_bins(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return A.reliability(d, F.least(F.col("n_chars") / 8000.0, F.lit(1.0)), F.col("quality") == 1)


@query(f"WITH x AS (SELECT least({CONFIDENCE}::DOUBLE, 1.0) AS c, l.quality = 1 AS r FROM documents JOIN labels l USING (doc_id)), b AS (SELECT least(9, floor(c * 10))::BIGINT AS bin, count(*) AS n, avg(CASE WHEN r THEN 1.0 ELSE 0.0 END) AS acc FROM x GROUP BY 1) SELECT round(sum(abs(acc - (bin + 0.5) / 10) * n) / sum(n), 6) AS ece FROM b")
def ece(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return A.calibration_error(d, F.least(F.col("n_chars") / 8000.0, F.lit(1.0)), F.col("quality") == 1)


@query("""WITH x AS (SELECT d.lang, d.n_chars >= 1000 AS auto, l.quality = 1 AS r FROM documents d JOIN labels l USING (doc_id))
SELECT lang, count(*) AS n, round(count(*) FILTER (WHERE auto) / greatest(count(*), 1), 4) AS coverage, round(count(*) FILTER (WHERE auto AND r) / greatest(count(*) FILTER (WHERE auto), 1), 4) AS precision,
round(count(*) FILTER (WHERE auto AND NOT r) / greatest(count(*), 1), 4) AS silent, round(count(*) FILTER (WHERE NOT auto AND NOT r) / greatest(count(*) FILTER (WHERE NOT r), 1), 4) AS caught FROM x GROUP BY lang""")
def precision_coverage(t: Tables) -> DataFrame:
    auto, right = F.col("n_chars") >= 1000, F.col("quality") == 1
    ratio = lambda a, b: F.round(F.count_if(a) / F.greatest(F.count_if(b), F.lit(1)), 4)
    every = F.lit(True)
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("n"), ratio(auto, every).alias("coverage"), ratio(auto & right, auto).alias("precision"), ratio(auto & ~right, every).alias("silent"), ratio(~auto & ~right, ~right).alias("caught"))


@query("SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def distinct_sorted(t: Tables) -> DataFrame:
    return t.documents.agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("lang").alias("langs"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM benchmark) WHERE word <> '' GROUP BY word HAVING count(*) = 1")
def unique_words(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n = 1")


@query("""WITH s AS (SELECT page_id, (position('<script' IN html) > 0)::INT + (position('<table' IN html) > 0)::INT + (position('<nav' IN html) > 0)::INT AS a, (position('<pre' IN html) > 0)::INT + (position('<code' IN html) > 0)::INT AS b FROM pages)
SELECT page_id, CASE WHEN a >= b THEN 'page' ELSE 'code' END AS class, greatest(a, b)::BIGINT AS covered, CASE WHEN a >= b THEN a = 3 ELSE b = 2 END AS complete FROM s""")
def keyword_coverage(t: Tables) -> DataFrame:
    cover = lambda *words: sum((F.contains(F.col("html"), F.lit(w)).cast("int") for w in words), F.lit(0))
    d = t.pages.select("page_id", cover("<script", "<table", "<nav").alias("a"), cover("<pre", "<code").alias("b"))
    first = F.col("a") >= F.col("b")
    return d.select("page_id", F.when(first, "page").otherwise("code").alias("class"), F.greatest("a", "b").cast("long").alias("covered"), F.when(first, F.col("a") == 3).otherwise(F.col("b") == 2).alias("complete"))


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles, round(avg(length(text)), 1) AS mean_chars, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_concat(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["role"]), " ").alias("roles"), F.round(F.avg(F.length("text")), 1).alias("mean_chars"), F.count("*").alias("n"))


@query("""SELECT user_id, round(sum(value) FILTER (WHERE event_type = 'click'), 2) AS clicks, round(avg(value), 1) AS mean_value, bool_or(event_type = 'error' AND value > 50) AS any_error, min(value) FILTER (WHERE event_type = 'purchase') / 10.0 AS least_purchase FROM events GROUP BY user_id""")
def analytic_wide(t: Tables) -> DataFrame:
    value = F.col("value")
    of = lambda kind: F.when(F.col("event_type") == kind, value)
    return t.events.groupBy("user_id").agg(A.rounded_sum(of("click"), 2).alias("clicks"), A.rounded_mean(value, 1).alias("mean_value"), F.bool_or((F.col("event_type") == "error") & (value > 50)).alias("any_error"), (F.min(of("purchase")) / 10.0).alias("least_purchase"))


@query("SELECT l_returnflag, measure, count(*) AS n, sum(v) AS total FROM (SELECT l_returnflag, 'quantity' AS measure, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'linenumber', l_linenumber FROM lineitem) GROUP BY 1, 2")
def unpivot_long(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_linenumber").cast("double").alias("linenumber"))
    return d.unpivot("l_returnflag", ["quantity", "linenumber"], "measure", "v").groupBy("l_returnflag", "measure").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
