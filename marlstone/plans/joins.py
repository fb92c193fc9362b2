"""Joins, set operations, linkage and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import linkage, spatial, status
from ..operators.nearest import nearest
from .registry import Tables, query


FOLDED = "translate(lower(strip_accents(v)), ' ''-.,', '')"


@query(f"""WITH l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS v, CASE c_custkey % 3 WHEN 0 THEN 'KNOWN' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'NOT_PROVIDED' END AS s, round(0.5 + c_custkey % 47 / 100.0, 2)::DOUBLE AS c, 'ai_local' AS src, '' AS n FROM customer WHERE c_custkey % 5 <> 0),
r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN lower(left(c_mktsegment, 3)) || '- ' || substr(c_mktsegment, 4) || '.' WHEN c_custkey % 7 = 0 THEN 'other' ELSE c_mktsegment END AS v, CASE WHEN c_custkey % 4 = 0 THEN 'NOT_PROVIDED' WHEN c_custkey % 4 = 1 THEN 'KNOWN' ELSE 'NEEDS_REVIEW' END AS s, round(0.5 + c_custkey % 41 / 100.0, 2)::DOUBLE AS c, (1 + c_custkey % 3)::INT AS i, 'ai' AS src, CASE WHEN c_custkey % 10 = 3 THEN 'valeur hors plage' ELSE '' END AS n FROM customer WHERE c_custkey % 7 <> 1),
j AS (SELECT coalesce(l.k, r.k) AS k, l.k IS NULL AS nol, r.k IS NULL AS nor, l.v AS lv, l.s AS ls, l.c AS lc, l.src AS lsrc, l.n AS ln, r.v AS rv, r.s AS rs, r.c AS rc, r.src AS rsrc, r.n AS rn, r.i, (l.s = r.s OR (l.s IN ('KNOWN', 'NEEDS_REVIEW') AND r.s IN ('KNOWN', 'NEEDS_REVIEW'))) AND ({FOLDED.replace("(v)", "(l.v)")} IS NOT DISTINCT FROM {FOLDED.replace("(v)", "(r.v)")}) AS same, round(greatest(r.c, 1 - (1 - r.c) * (1 - l.c)), 3) AS joint FROM l FULL JOIN r ON l.k = r.k),
q AS (SELECT *, NOT nol AND NOT nor AND same AND rs = 'NEEDS_REVIEW' AND joint >= CASE i WHEN 1 THEN 0.8 WHEN 2 THEN 0.85 ELSE 0.92 END AND rv IS NOT NULL AND position('hors' IN rn) = 0 AS up, NOT nol AND NOT nor AND NOT same AND lc >= 0.8 AND ls = 'KNOWN' AS against FROM j)
SELECT k, CASE WHEN nor THEN lv ELSE rv END AS value, CASE WHEN nor THEN ls WHEN nol THEN rs WHEN up THEN 'KNOWN' WHEN against THEN 'NEEDS_REVIEW' ELSE rs END AS status, CASE WHEN nor THEN lc WHEN nol THEN rc WHEN same THEN joint WHEN against THEN least(rc, 0.55) ELSE rc END AS confidence,
CASE WHEN nor THEN lsrc WHEN nol THEN rsrc WHEN same THEN 'ai_ensemble' ELSE rsrc END AS source, CASE WHEN nor THEN ln WHEN nol THEN rn WHEN up THEN 'deux lectures concordantes' WHEN against THEN 'lectures divergentes : « ' || coalesce(rv, 'None') || ' » / « ' || coalesce(lv, 'None') || ' »' ELSE rn END AS note, CASE WHEN against THEN coalesce(rv, '-') || '|' || coalesce(lv, '-') END AS candidates FROM q""")
def fuse_full_outer(t: Tables) -> DataFrame:
    """Two readings of each customer's segment, some in another spelling, some null, some out of range."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    share = lambda n: F.round(k % n / 100 + 0.5, 2)
    local = t.customer.where("c_custkey % 5 <> 0").select(k.alias("k"), F.when(k % 11 != 0, seg).alias("value"), F.when(k % 3 == 0, "KNOWN").when(k % 3 == 1, "NEEDS_REVIEW").otherwise("NOT_PROVIDED").alias("status"), share(47).alias("confidence"), (k % 3 + 1).alias("importance"), F.lit("ai_local").alias("source"), F.lit("").alias("note"))
    other = F.concat(F.lower(F.substring(seg, 1, 3)), F.lit("- "), F.substring(seg, 4, 99), F.lit("."))
    value = F.when((k % 13 == 0) | (k % 11 == 0), None).when(k % 2 == 0, other).when(k % 7 == 0, "other").otherwise(seg)
    remote = t.customer.where("c_custkey % 7 <> 1").select(k.alias("k"), value.alias("value"), F.when(k % 4 == 0, "NOT_PROVIDED").when(k % 4 == 1, "KNOWN").otherwise("NEEDS_REVIEW").alias("status"), share(41).alias("confidence"), (k % 3 + 1).alias("importance"), F.lit("ai").alias("source"), F.when(k % 10 == 3, "valeur hors plage").otherwise("").alias("note"))
    both = status.fuse(local, remote, ["k"])
    return both.withColumn("candidates", F.array_join(F.transform("candidates", lambda c: F.coalesce(c, F.lit("-"))), "|"))


@query("""WITH old AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM orders WHERE o_orderkey % 5 <> 0), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 3 <> 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.v IS NULL THEN 'kept' WHEN o.v IS NULL THEN 'added' WHEN o.v <> n.v THEN 'changed' ELSE 'same' END AS class, CASE WHEN n.k IS NOT NULL AND (n.k % 8 = 0 OR o.k IS NULL) THEN n.v ELSE o.v END AS merged FROM old o FULL JOIN new n ON o.k = n.k""")
def diff_merge(t: Tables) -> DataFrame:
    key, price = F.col("o_orderkey").alias("k"), F.col("o_totalprice")
    old = t.orders.where("o_orderkey % 5 <> 0").select(key, F.when(F.col("o_orderkey") % 7 != 0, price).alias("v"))
    new = t.orders.where("o_orderkey % 3 <> 0").select(key, F.when(F.col("o_orderkey") % 4 == 0, price + 1).otherwise(price).alias("v"))
    merged = linkage.merge(old, new, "k", "v", F.col("k") % 8 == 0)
    classes = linkage.diff(old, new, "k", "v").select("k", "class")
    return merged.join(classes, "k", "left").select("k", F.coalesce("class", F.lit("kept")).alias("class"), "merged")


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL AND d.source NOT IN ('src1', 'src2') THEN 'midwife' ELSE 'ai' END AS origin, CASE WHEN l.quality IS NOT NULL AND d.source NOT IN ('src1', 'src2') THEN l.quality::BIGINT ELSE d.n_chars END AS value FROM documents d LEFT JOIN labels l USING (doc_id)""")
def keep_human_overlay(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id", "left")
    human = F.col("quality").isNotNull() & ~F.col("source").isin("src1", "src2")
    return d.select("doc_id", F.when(human, "midwife").otherwise("ai").alias("origin"), F.when(human, F.col("quality").cast("long")).otherwise(F.col("n_chars")).alias("value"))


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1)")
def dup_key_selfjoin(t: Tables) -> DataFrame:
    """Rows whose key another id has too: minimum and maximum of a key's ids tell, without pairs."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("key")).where("key is not null")
    shared = d.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key")
    return d.join(shared, "key", "left_semi").select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def present_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""WITH d AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE length(word) >= 9), b AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM benchmark)), p AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part)
SELECT d.doc_id, count(*) AS leaked FROM d WHERE word IN (SELECT word FROM b) AND word NOT IN (SELECT word FROM p) GROUP BY 1""")
def token_leak(t: Tables) -> DataFrame:
    words = lambda df, c, *keep: df.select(*keep, F.explode(F.split(F.lower(c), " ")).alias("word")).distinct()
    d = words(t.documents, "text", "doc_id").where(F.length("word") >= 9)
    leaked = d.join(words(t.benchmark, "text"), "word", "left_semi").join(words(t.part, "p_name"), "word", "left_anti")
    return leaked.groupBy("doc_id").agg(F.count("*").alias("leaked"))


RECORDS = """SELECT c_custkey AS id, 'C' || lpad((c_custkey * 37 % 900)::VARCHAR, 3, '0') || '-' || (c_custkey % 7)::VARCHAR AS code, (20 + c_custkey % 25)::INT AS age, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS place, CAST(DATE '2025-01-01' + (c_custkey * 13 % 300)::INT AS DATE) AS due, CAST(DATE '2024-03-01' + (c_custkey * 29 % 300)::INT AS DATE) AS period FROM customer"""


def records(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    code = F.concat(F.lit("C"), F.lpad((k * 37 % 900).cast("string"), 3, "0"), F.lit("-"), (k % 7).cast("string"))
    place = F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return t.customer.select(k.alias("id"), code.alias("code"), (k % 25 + 20).cast("int").alias("age"), place.alias("place"), F.date_add(F.lit("2025-01-01").cast("date"), (k * 13 % 300).cast("int")).alias("due"), F.date_add(F.lit("2024-03-01").cast("date"), (k * 29 % 300).cast("int")).alias("period"))


@query(f"""WITH r AS ({RECORDS}), s AS (SELECT a.id AS probe, b.id, least(100, greatest(0,
CASE WHEN replace(a.code, '-', '') = replace(b.code, '-', '') THEN 70 WHEN levenshtein(replace(a.code, '-', ''), replace(b.code, '-', '')) = 1 THEN 35 WHEN levenshtein(replace(a.code, '-', ''), replace(b.code, '-', '')) = 2 THEN 25 ELSE 0 END
+ CASE WHEN abs(a.age - b.age) <= 1 THEN 10 WHEN abs(a.age - b.age) > 3 THEN -20 ELSE 0 END + CASE WHEN lower(a.place) = lower(b.place) THEN 8 ELSE 0 END
+ CASE WHEN abs(date_diff('day', a.due, b.due)) <= 10 THEN 25 WHEN abs(date_diff('day', a.due, b.due)) > 60 THEN -10 ELSE 0 END + CASE WHEN abs(date_diff('day', a.period, b.period)) <= 10 THEN 20 WHEN abs(date_diff('day', a.period, b.period)) > 60 THEN -10 ELSE 0 END))::BIGINT AS score
FROM r a JOIN r b ON a.id <> b.id AND a.id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS rank FROM s WHERE score >= 35) SELECT * FROM k WHERE rank <= 3""")
def fuzzy_candidates(t: Tables) -> DataFrame:
    """Probes are the records whose id is divisible by 20; every record is a possible match."""
    known = records(t)
    return linkage.candidates(known.where("id % 20 = 0"), known)


LABELS = "SELECT p_brand AS page, p_partkey AS label, (p_partkey * 7 % 400)::DOUBLE AS x, (p_partkey * 11 % 600)::DOUBLE AS y FROM part WHERE p_size <= 25"
BOXES = "SELECT p_brand AS page, p_partkey AS box, (p_partkey * 13 % 500)::DOUBLE AS x0, (p_partkey * 5 % 600)::DOUBLE AS y0, (p_partkey * 13 % 500 + 8)::DOUBLE AS x1, (p_partkey * 5 % 600 + 8)::DOUBLE AS y1 FROM part WHERE p_size > 25"


def page_labels(t: Tables) -> DataFrame:
    return t.part.where("p_size <= 25").selectExpr("p_brand AS page", "p_partkey AS label", "CAST(p_partkey * 7 % 400 AS DOUBLE) AS x", "CAST(p_partkey * 11 % 600 AS DOUBLE) AS y")


def page_boxes(t: Tables) -> DataFrame:
    return t.part.where("p_size > 25").selectExpr("p_brand AS page", "p_partkey AS box", "CAST(p_partkey * 13 % 500 AS DOUBLE) AS x0", "CAST(p_partkey * 5 % 600 AS DOUBLE) AS y0", "CAST(p_partkey * 13 % 500 + 8 AS DOUBLE) AS x1", "CAST(p_partkey * 5 % 600 + 8 AS DOUBLE) AS y1")


@query(f"SELECT page, label, arg_min(box, (x0 - x, box)) AS box, min(x0 - x) AS gap FROM ({LABELS}) JOIN ({BOXES}) USING (page) WHERE abs(y0 - y) <= 7 AND x0 - x >= -3 AND x0 - x < 130 GROUP BY page, label")
def nearest_box(t: Tables) -> DataFrame:
    return spatial.nearest_box(page_labels(t), page_boxes(t))


@query(f"SELECT page, label, box FROM (SELECT *, row_number() OVER (PARTITION BY page, label ORDER BY x0, box) AS r FROM ({LABELS}) JOIN ({BOXES}) USING (page) WHERE abs(y0 - y) <= 7 AND x0 >= x) WHERE r = 2")
def nth_box(t: Tables) -> DataFrame:
    return spatial.nth_box(page_labels(t), page_boxes(t), 1)


@query(f"SELECT page, label AS point, box AS region FROM ({LABELS}) JOIN ({BOXES}) USING (page) WHERE x BETWEEN x0 AND x1 + 40 AND y BETWEEN y0 AND y1 + 20")
def point_in_rect(t: Tables) -> DataFrame:
    regions = page_boxes(t).select("page", F.col("box").alias("region"), "x0", "y0", (F.col("x1") + 40).alias("x1"), (F.col("y1") + 20).alias("y1"))
    return spatial.inside(page_labels(t).withColumnRenamed("label", "point"), regions)


@query(f"""WITH j AS (SELECT b.page, b.box, (x1 - x0) * (y1 - y0) AS size, coalesce(sum(greatest(0.0, least(x1, m.x + 30) - greatest(x0, m.x)) * greatest(0.0, least(y1, m.y + 12) - greatest(y0, m.y))), 0.0) AS ink FROM ({BOXES}) b LEFT JOIN ({LABELS}) m ON b.page = m.page GROUP BY ALL)
SELECT page, box, round(ink / size, 4) AS share, ink > size * 0.15 AS ticked FROM j""")
def overlap_area(t: Tables) -> DataFrame:
    marks = page_labels(t).select("page", F.col("x").alias("mx0"), F.col("y").alias("my0"), (F.col("x") + 30).alias("mx1"), (F.col("y") + 12).alias("my1"))
    return spatial.overlap(marks, page_boxes(t))


@query(f"""WITH RECURSIVE g AS (SELECT page, label AS glyph, y AS top, row_number() OVER (PARTITION BY page ORDER BY y, x, label) AS n FROM ({LABELS})), f(page, n, glyph, head, line) AS (SELECT page, n, glyph, top, 0 FROM g WHERE n = 1
UNION ALL SELECT g.page, g.n, g.glyph, CASE WHEN g.top - f.head >= 4 THEN g.top ELSE f.head END, CASE WHEN g.top - f.head >= 4 THEN f.line + 1 ELSE f.line END FROM f JOIN g ON g.page = f.page AND g.n = f.n + 1) SELECT page, glyph, line::INT AS line FROM f""")
def line_clusters(t: Tables) -> DataFrame:
    return spatial.lines(page_labels(t).select("page", F.col("label").alias("glyph"), "x", F.col("y").alias("top")))


@query("""WITH q AS (SELECT vec_id AS probe, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT probe, vec_id, round(list_distance(a, embedding::DOUBLE[]), 4) AS distance FROM q JOIN embeddings ON vec_id <> probe), k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY distance, vec_id) AS rank FROM s)
SELECT a.probe, a.vec_id, a.distance, round(a.distance / b.distance, 4) < 0.75 AS good FROM k a JOIN k b ON a.probe = b.probe AND a.rank = 1 AND b.rank = 2""")
def knn_top2(t: Tables) -> DataFrame:
    """The nearest two of every vector whose id is divisible by 20, and the ratio test between them."""
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = nearest(vectors.where("id % 20 = 0"), vectors)
    two = near.groupBy("probe").agg(F.min_by(F.struct("id", "distance"), "rank").alias("first"), F.max_by("distance", "rank").alias("second"), F.count("*").alias("n")).where("n = 2")
    return two.select("probe", F.col("first.id").alias("vec_id"), "first.distance", (F.round(F.col("first.distance") / F.col("second"), 4) < 0.75).alias("good"))


LEAST = 8


@query("""WITH d AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents), b AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS v FROM benchmark), s AS (SELECT doc_id, item_id, len(list_intersect(w, v)) AS n FROM d, b)
SELECT doc_id, arg_max(item_id, (n, -item_id)) AS item_id, max(n)::BIGINT AS n FROM s WHERE n >= 8 GROUP BY doc_id""")
def shared_words(t: Tables) -> DataFrame:
    """The template with most words in common, LEAST at least.

    A document that shares so many words with an item has one of those that are
    left without the item's LEAST - 1 commonest (prefix), so the commonest words
    meet nothing; the pairs that remain are counted exactly.
    """
    sets = lambda df, key: df.select(key, F.array_distinct(F.split(F.lower("text"), " ")).alias("words"))
    d, b = sets(t.documents, "doc_id"), sets(t.benchmark, "item_id")
    words = b.select("item_id", F.explode("words").alias("word"))
    common = d.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ranked = words.join(common, "word").withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("n"), "word")))
    posted = ranked.where(F.col("rank") >= LEAST).select("item_id", "word")
    pairs = d.select("doc_id", F.explode("words").alias("word")).join(posted, "word").select("doc_id", "item_id").distinct()
    n = pairs.join(d, "doc_id").join(b.withColumnRenamed("words", "own"), "item_id").select("doc_id", "item_id", F.size(F.array_intersect("words", "own")).cast("long").alias("n")).where(F.col("n") >= LEAST)
    return n.groupBy("doc_id").agg(F.max_by("item_id", F.struct("n", -F.col("item_id"))).alias("item_id"), F.max("n").alias("n"))


@query("SELECT user_id AS id FROM events UNION SELECT o_custkey FROM orders")
def set_union(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("id")).union(t.orders.select("o_custkey")).distinct()


@query("SELECT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def set_except(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("id")).subtract(t.events.select("user_id"))


@query("SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def set_intersect(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("id")).intersect(t.events.select("user_id"))


@query("SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'O')) AS subset FROM orders GROUP BY o_custkey")
def subset_test(t: Tables) -> DataFrame:
    extra = F.array_except(F.collect_set("o_orderstatus"), F.array(F.lit("F"), F.lit("O")))
    return t.orders.groupBy("o_custkey").agg((F.size(extra) == 0).alias("subset"))


@query("""WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, count(*) FILTER (WHERE l_quantity > 45) OVER (PARTITION BY l_orderkey, l_returnflag) AS n, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 45 AND n > 1 THEN 'NEEDS_REVIEW' WHEN days < 0 THEN 'NEEDS_REVIEW' ELSE 'KNOWN' END AS status FROM x""")
def rules_consistency(t: Tables) -> DataFrame:
    """Exclusive ticks and a date rule; rules write different fields and read one snapshot, so one pass is exact."""
    j = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("grp", F.col("l_returnflag"))
    j = status.exclusive(j, "l_orderkey", "grp", F.col("l_quantity") > 45)
    bad = F.col("flag") | (F.datediff("l_shipdate", "o_orderdate") < 0)
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.flagged(F.lit("KNOWN"), bad).alias("status"))
