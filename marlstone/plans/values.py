"""Scalar functions and status rules on columns of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import status as S
from .registry import Tables, query


@query("""SELECT p_partkey, raw, value, value BETWEEN 5 AND 45 AS valid FROM (SELECT p_partkey, raw, round(replace(regexp_extract(raw, '-?[0-9]+(?:[.,][0-9]+)?'), ',', '.')::DOUBLE)::BIGINT AS value FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || ' g' WHEN 1 THEN 'env. ' || p_size || ',0' ELSE p_size || ' SA' END AS raw FROM part))""")
def norm_number(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 3
    d = t.part.select("p_partkey", F.when(k == 0, F.concat(size, F.lit(" g"))).when(k == 1, F.concat(F.lit("env. "), size, F.lit(",0"))).otherwise(F.concat(size, F.lit(" SA"))).alias("raw"))
    return d.select("p_partkey", "raw", N.norm_int(F.regexp_replace("raw", r"env\.", ""), 5, 45).alias("x")).select("p_partkey", "raw", "x.value", "x.valid")


WORDS_BOOL = ("Oui", "NON", "oui.", "nom", "x", "peut-être", "vrai", "ou")


def words_sql(words: tuple[str, ...]) -> str:
    """(p_partkey, raw): each part with a word of the list."""
    return f"SELECT p_partkey, ([{', '.join(repr(w) for w in words)}])[p_partkey % {len(words)} + 1] AS raw FROM part"


def one_of(words: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))


def listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(f"""WITH x AS (SELECT p_partkey, regexp_replace(regexp_replace(strip_accents(lower(trim(raw))), '\\s', '', 'g'), '\\.+$', '') AS n FROM ({words_sql(WORDS_BOOL)})),
d AS (SELECT p_partkey, n, levenshtein(n, 'oui') AS o, levenshtein(n, 'non') AS z FROM x)
SELECT p_partkey, CASE WHEN n IN ({listed(N.YES)}) THEN true WHEN n IN ({listed(N.NO)}) THEN false WHEN length(n) >= 2 AND least(o, z) <= 1 THEN o <= z END AS value, n IN ({listed(N.YES + N.NO)}) OR (length(n) >= 2 AND least(o, z) <= 1) AS valid FROM d""")
def norm_bool(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", N.norm_bool(one_of(WORDS_BOOL)).alias("x")).select("p_partkey", "x.value", "x.valid")


WORDS_LAB = ("Neg", "positif", "négatiff", "Non immun", "+", "zzz", "N.F.", "imune")


def lab_sql() -> str:
    rows = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(N.LAB.items()))
    return f"""WITH x AS (SELECT p_partkey, regexp_replace(strip_accents(lower(trim(raw))), '[^a-z+-]', '', 'g') AS n FROM ({words_sql(WORDS_LAB)})), l(i, k, v) AS (VALUES {rows}),
d AS (SELECT p_partkey, arg_min(k, (levenshtein(n, k), i)) AS k, arg_min(v, (levenshtein(n, k), i)) AS v, min(levenshtein(n, k)) AS d FROM x, l GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN d = 0 OR (d <= 1 AND length(k) >= 3) THEN v END AS value, d = 0 OR (d <= 1 AND length(k) >= 3) AS valid FROM d"""


@query(lab_sql())
def norm_lab(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", N.norm_lab(one_of(WORDS_LAB)).alias("x")).select("p_partkey", "x.value", "x.valid")


@query("""WITH x AS (SELECT p_partkey, (10 + p_size % 10) * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 10 END AS a, (4 + p_size % 7) * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 10 END AS b FROM part), y AS (SELECT p_partkey, CASE WHEN a < 30 THEN a * 10 ELSE a END AS a, CASE WHEN a < 30 THEN b * 10 ELSE b END AS b FROM x)
SELECT p_partkey, a || '/' || b AS value, a BETWEEN 60 AND 250 AND b BETWEEN 30 AND 160 AND a > b AS valid FROM y""")
def norm_bp(t: Tables) -> DataFrame:
    scale = F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(10)
    raw = F.concat(((F.col("p_size") % 10 + 10) * scale).cast("string"), F.lit(" / "), ((F.col("p_size") % 7 + 4) * scale).cast("string"))
    return t.part.select("p_partkey", N.norm_pressure(raw).alias("x")).select("p_partkey", "x.value", "x.valid")


@query("SELECT p_partkey, upper(replace(p_name, ' ', '')) || '-' || p_size AS value, regexp_full_match(upper(replace(p_name, ' ', '')) || '-' || p_size, '[A-Z0-9][A-Z0-9\\-/]{3,20}') AS valid FROM part")
def norm_code(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", N.norm_code(F.concat("p_name", F.lit(" -"), F.col("p_size").cast("string"))).alias("x")).select("p_partkey", "x.value", "x.valid")


#: Formats a day is written in, and those that aren't one: two-digit years after other signs than slashes, mixed signs, no such day.
DAYS = ("dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yy", "yyyy-MM-dd", "yyyy", "dd-MM-yy", "dd.MM.yy", "dd/MM-yyyy", "45/MM/yyyy")
DAYS_SQL = ("%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d/%m/%y", "%Y-%m-%d")


WRITTEN_SQL = ("%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d/%m/%y", "%Y-%m-%d", "%Y", "%d-%m-%y", "%d.%m.%y", "%d/%m-%Y", "45/%m/%Y")


def date_sql() -> str:
    raw = " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(WRITTEN_SQL))
    four = lambda f: "NOT " if f.endswith("y") else ""
    read = ", ".join(f"CASE WHEN year(try_strptime(raw, '{f}')) BETWEEN 1990 AND 2035 AND {four(f)}regexp_matches(raw, '[0-9]{{4}}') THEN try_strptime(raw, '{f}') END" for f in DAYS_SQL)
    return f"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % {len(WRITTEN_SQL)} {raw} END AS raw FROM orders), p AS (SELECT o_orderkey, raw, coalesce({read}) AS d FROM x), y AS (SELECT *, CASE WHEN d IS NULL AND regexp_full_match(raw, '(19|20)[0-9][0-9]') THEN raw::INT END AS year_only FROM p)
SELECT o_orderkey, coalesce(strftime(d, '%Y-%m-%d'), year_only::VARCHAR) AS value, d IS NOT NULL OR year_only IS NOT NULL AS valid, year_only FROM y"""


@query(date_sql())
def parse_date(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % len(DAYS), F.col("o_orderdate")
    raw = F.coalesce(*(F.when(k == i, F.date_format(d, f)) for i, f in enumerate(DAYS)))
    return t.orders.select("o_orderkey", N.norm_date(raw).alias("x")).select("o_orderkey", "x.value", "x.valid", "x.year_only")


@query("SELECT conv_id, turn, strip_accents(lower(replace(trim(text), 'œ', 'oe'))) AS folded FROM conversations")
def fold_accents(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", N.norm(F.col("text")).alias("folded"))


CONTACTS = (r"[A-Za-z0-9.]+@[A-Za-z0-9.]+\.[a-z]+", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", r"[0-9]{16}")


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+\\.[a-z]+', '[masqué]', 'g'), '\\+1 \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}', '[masqué]', 'g'), '[0-9]{16}', '[masqué]', 'g') AS text FROM documents")
def scrub_pii(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", N.scrub(F.col("text"), CONTACTS).alias("text"))


TERMS = ("red", "blue", "green", "hot", "cold", "small", "large", "steel")


def term_sql() -> str:
    rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(TERMS))
    return f"""WITH w AS (SELECT p_partkey, replace(string_split(p_name, ' ')[1], 'l', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'l' END) AS word FROM part), d AS (SELECT p_partkey, word, i, term, levenshtein(word, term) AS d FROM w, (VALUES {rows}) v(i, term)),
k AS (SELECT p_partkey, word, min(d) AS best, arg_min(term, (d, i)) AS term FROM d GROUP BY ALL), u AS (SELECT k.*, greatest(length(word), length(term)) AS size, (SELECT count(*) FROM d WHERE d.p_partkey = k.p_partkey AND d.d = k.best) AS ties FROM k),
g AS (SELECT *, best = 0 OR (ties = 1 AND best <= CASE WHEN size <= 2 THEN 0 WHEN size <= 5 THEN 1 ELSE greatest(2, size // 4) END) AS good FROM u)
SELECT p_partkey, word, CASE WHEN good THEN term END AS snapped, CASE WHEN good THEN round(1 - best / size, 4) END AS similarity FROM g"""


@query(term_sql())
def lexicon_snap(t: Tables) -> DataFrame:
    word = F.replace(F.split("p_name", " ")[0], F.lit("l"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.lit("l")))
    d = t.part.select("p_partkey", word.alias("word")).withColumn("x", N.snap(F.col("word"), TERMS))
    return d.select("p_partkey", "word", F.col("x.term").alias("snapped"), F.round("x.similarity", 4).alias("similarity"))


@query("SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(url, '/', ';'), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM pages")
def split_list(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(N.split_list(F.replace("url", F.lit("/"), F.lit(";"))), "|").alias("parts"))


@query("SELECT page_id, CASE WHEN position('=' IN url) > 0 THEN substr(url, 1, position('=' IN url) - 1) ELSE url END AS key, CASE WHEN position('=' IN url) > 0 THEN substr(url, position('=' IN url) + 1) END AS value FROM pages")
def kv_split(t: Tables) -> DataFrame:
    parts = F.split("url", "=", 2)
    return t.pages.select("page_id", parts[0].alias("key"), F.get(parts, F.lit(1)).alias("value"))


@query("SELECT event_id, regexp_extract_all(props, '[0-9]+')[1]::INT AS first, len(regexp_extract_all(props, '[0-9]+'))::INT AS n FROM events")
def extract_ints(t: Tables) -> DataFrame:
    found = N.integers(F.col("props"))
    return t.events.select("event_id", F.get(found, F.lit(0)).alias("first"), F.size(found).alias("n"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events")
def json_path(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT c_custkey, CASE WHEN lower(c_mktsegment) LIKE '%auto%' OR lower(c_mktsegment) LIKE '%mach%' THEN 2 WHEN lower(c_mktsegment) LIKE 'build%' THEN 1 ELSE 0 END AS level, lower(c_mktsegment) LIKE 'f%' AS prefix FROM customer")
def prefix_flags(t: Tables) -> DataFrame:
    key = N.norm(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", F.when(key.contains("auto") | key.contains("mach"), 2).when(key.startswith("build"), 1).otherwise(0).alias("level"), key.startswith("f").alias("prefix"))


WORDS_SCHOOL = ("Supérieur", "Lycée", "aucune", "", "UNIVERSITÉ", "collège", "Secondaire", "primaire")


@query(f"""WITH x AS (SELECT p_partkey, strip_accents(lower(trim(raw))) AS n FROM ({words_sql(WORDS_SCHOOL)}))
SELECT p_partkey, CASE WHEN regexp_matches(n, 'sup|univ') THEN 2 WHEN regexp_matches(n, 'coll|lyc|second') THEN 1 WHEN n <> '' THEN 0 END AS level FROM x""")
def education_bucket(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", N.education(one_of(WORDS_SCHOOL)).alias("level"))


@query("""WITH x AS (SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'inconnu' WHEN l.toxic = 1 THEN 'n/a' WHEN d.n_chars < 200 THEN '' ELSE 'v' END AS raw, least(d.n_chars / 3000.0, 1.0)::DOUBLE AS c, coalesce(l.quality, 0) = 1 AS valid, (d.doc_id % 4)::INT AS importance FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN raw = '' THEN CASE WHEN c >= 0.7 THEN 'NOT_PROVIDED' ELSE 'NEEDS_REVIEW' END WHEN raw = 'n/a' THEN 'NOT_APPLICABLE' WHEN raw = 'inconnu' THEN 'UNKNOWN' WHEN valid AND c >= CASE importance WHEN 1 THEN 0.8 WHEN 2 THEN 0.85 WHEN 3 THEN 0.92 ELSE 0.8 END THEN 'KNOWN' ELSE 'NEEDS_REVIEW' END AS status FROM x""")
def threshold_status(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    raw = F.when(F.col("quality").isNull(), "inconnu").when(F.col("toxic") == 1, "n/a").when(F.col("n_chars") < 200, "").otherwise("v")
    confidence = F.least(F.col("n_chars") / 3000.0, F.lit(1.0))
    return d.select("doc_id", S.read_status(raw, confidence, F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("doc_id") % 4).alias("status"))


@query("SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'NOT_APPLICABLE' ELSE 'NOT_PROVIDED' END AS status FROM labels")
def na_rule(t: Tables) -> DataFrame:
    """Only an absent value becomes not applicable, when the field it hangs on says no."""
    return t.labels.select("doc_id", F.when((F.col("quality") == 0) & (F.col("toxic") == 0), S.NA).otherwise(S.ABSENT).alias("status"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN n_chars > 10000 THEN 'long' END, CASE WHEN position('%%%' IN text) > 0 THEN 'noise' END) AS issues FROM documents""")
def quality_gate(t: Tables) -> DataFrame:
    issues = F.concat_ws(",", F.when(F.col("n_chars") < 100, "short"), F.when(F.col("n_chars") > 10000, "long"), F.when(F.contains("text", F.lit("%%%")), "noise"))
    return t.documents.select("doc_id", issues.alias("issues"))


@query("""SELECT conv_id, count(*) AS n, CASE WHEN count(*) <= 3 THEN 'button' WHEN count(*) <= 10 THEN 'list' ELSE 'menu' END AS shape, array_to_string(list_slice(list(left(text, 20) ORDER BY turn, text), 1, 9), '|') AS titles FROM conversations GROUP BY conv_id""")
def messages_shape(t: Tables) -> DataFrame:
    """A list takes nine titles, so no more of a conversation's turns are gathered."""
    c = t.conversations
    first = c.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text"))).where("rank <= 9")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, 20).alias("title")))), lambda x: x["title"])
    n = F.count("*")
    shapes = c.groupBy("conv_id").agg(n.alias("n"), F.when(n <= 3, "button").when(n <= 10, "list").otherwise("menu").alias("shape"))
    return shapes.join(first.groupBy("conv_id").agg(F.array_join(titles, "|").alias("titles")), "conv_id").select("conv_id", "n", "shape", "titles")


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def sha256_key(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.sha2("c_name", 256).alias("digest"))


def hmac_sql(key: str) -> str:
    """HMAC by its definition (RFC 2104), the key's two pads as literals."""
    pad = lambda x: "".join(f"\\x{b ^ x:02X}" for b in key.encode().ljust(64, b"\0"))
    return f"SELECT s_suppkey, sha256('{pad(0x5C)}'::BLOB || unhex(sha256('{pad(0x36)}'::BLOB || encode('supplier ' || s_suppkey)))) AS code_idx FROM supplier"


INDEX_KEY = "index key"


@query(hmac_sql(INDEX_KEY))
def hmac_index(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", N.hmac_sha256(F.lit(INDEX_KEY), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string"))).alias("code_idx"))
