"""Fields of records: specifications, readings, rules, review, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import aggregates as A
from ..operators import lifecycle as L
from ..operators import specs as P
from ..operators import status as S
from ..operators.analytic import wide
from ..operators.rules import consistent
from ..operators.spatial import cells, value_region
from ..sources import files
from .registry import Tables, query

SPECS = (
    P.Spec("quantity", "inline", "float", 3, 2.0, 45.0, "a"), P.Spec("linenumber", "inline", "int", 1, 1.0, 5.0, "a"), P.Spec("discount", "cell", "float", 2, None, 0.08, "b"),
    P.Spec("tax", "cell", "float", 0, 0.01, None, "b"), P.Spec("flag", "check", "bool", 1, None, None, "c"),
)
SPECS_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in s) + ")" for s in SPECS) + ") AS s(field_id, kind, type, importance, low, high, page)"
LONG_SQL = "SELECT l_orderkey AS record_id, 'quantity' AS field_id, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, 'linenumber', l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, 'discount', l_discount FROM lineitem UNION ALL SELECT l_orderkey, 'tax', l_tax FROM lineitem UNION ALL SELECT l_orderkey, 'price', l_extendedprice FROM lineitem"


@query(f"""WITH v AS ({LONG_SQL}), j AS (SELECT v.*, s.* EXCLUDE (field_id) FROM v LEFT JOIN {SPECS_SQL} ON v.field_id = s.field_id)
SELECT field_id, coalesce(page, 'none') AS page, CASE WHEN type IS NULL THEN 'NO_SPEC' WHEN (low IS NULL OR v >= low) AND (high IS NULL OR v <= high) THEN 'KNOWN' ELSE 'NEEDS_REVIEW' END AS status, max(CASE importance WHEN 1 THEN 0.8 WHEN 2 THEN 0.85 WHEN 3 THEN 0.92 ELSE CASE WHEN type IS NOT NULL THEN 0.8 END END)::DOUBLE AS threshold, count(*) AS n FROM j GROUP BY ALL""")
def spec_lookup(t: Tables) -> DataFrame:
    """Each value takes type, range and importance from its field's specification; fields without one are told apart."""
    c = lambda name: F.col(f"l_{name}").cast("double").alias(name)
    long = t.lineitem.select(F.col("l_orderkey").alias("record_id"), c("quantity"), c("linenumber"), c("discount"), c("tax"), F.col("l_extendedprice").alias("price")).unpivot("record_id", ["quantity", "linenumber", "discount", "tax", "price"], "field_id", "v")
    j = P.with_spec(long, P.spec_table(t.spark, SPECS))
    inside = (F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))
    status = F.when(F.col("type").isNull(), "NO_SPEC").when(inside, S.KNOWN).otherwise(S.REVIEW)
    return j.groupBy("field_id", F.coalesce("page", F.lit("none")).alias("page"), status.alias("status")).agg(F.max(F.when(F.col("type").isNotNull(), S.threshold(F.col("importance")))).alias("threshold"), F.count("*").alias("n"))


TERMS = ("Césarienne", "voie basse", "normale", "Présentation du siège", "sommet", "RAS")


def reading_sql() -> str:
    text = "CASE p_size % 6 WHEN 0 THEN 'cesarienne' WHEN 1 THEN 'voie  base' WHEN 2 THEN 'Normal' WHEN 3 THEN 'appel 0612345678' WHEN 4 THEN 'somet' ELSE 'r.a.s' END"
    rows = ", ".join(f"({i}, '{x}', translate(lower(strip_accents('{x}')), ' ''-.,', ''))" for i, x in enumerate(TERMS))
    return f"""WITH x AS (SELECT p_partkey, p_size, (p_partkey % 12)::INT AS c, (0.5 + p_size % 50 / 100.0)::DOUBLE AS conf, (p_partkey % 4)::INT AS imp FROM part),
r AS (SELECT *, CASE imp WHEN 2 THEN 0.85 WHEN 3 THEN 0.92 ELSE 0.8 END AS thr, regexp_replace({text}, ' +', ' ', 'g') AS txt FROM x), t(i, term, k) AS (VALUES {rows}),
d AS (SELECT p_partkey, i, term, k, translate(lower(strip_accents(txt)), ' ''-.,', '') AS q, levenshtein(translate(lower(strip_accents(txt)), ' ''-.,', ''), k) AS d FROM r, t WHERE c = 8),
b AS (SELECT p_partkey, arg_min(term, (d, i)) AS term, min(d) AS best, arg_min(greatest(length(q), length(k)), (d, i)) AS size, list_sort(list(d))[2] AS second FROM d GROUP BY p_partkey),
g AS (SELECT p_partkey, CASE WHEN best <= CASE WHEN size <= 2 THEN 0 WHEN size <= 5 THEN 1 ELSE greatest(2, size // 4) END AND (second > best OR best = 0) THEN term END AS term, 1 - best / size AS sim FROM b),
n AS (SELECT r.*, g.term, CASE WHEN g.term IS NOT NULL THEN g.sim END AS sim, (5 + p_size)::BIGINT AS whole FROM r LEFT JOIN g USING (p_partkey)),
f AS (SELECT *, CASE c WHEN 8 THEN CASE WHEN sim IS NULL THEN least(conf, 0.75) WHEN sim >= 0.8 THEN greatest(conf, 0.55 + 0.4 * sim) ELSE conf * (0.6 + 0.4 * sim) END WHEN 7 THEN CASE WHEN whole BETWEEN 10 AND 45 THEN conf ELSE least(conf, 0.35) END WHEN 10 THEN least(conf, 0.35) ELSE conf END AS fc, CASE c WHEN 7 THEN whole BETWEEN 10 AND 45 WHEN 10 THEN false ELSE true END AS valid FROM n)
SELECT p_partkey, CASE c WHEN 0 THEN (p_size % 2 = 0)::VARCHAR WHEN 7 THEN whole::VARCHAR WHEN 8 THEN regexp_replace(coalesce(term, txt), '\\b0[5-7]([ .-]?[0-9]{{2}}){{4}}\\b', '[masqué]') WHEN 9 THEN 'AB' || p_partkey || '-X' WHEN 10 THEN 'x' || p_size WHEN 11 THEN '2026-04-' || lpad((1 + p_size % 28)::VARCHAR, 2, '0') END AS value,
CASE c WHEN 0 THEN CASE WHEN conf >= 0.7 THEN 'KNOWN' ELSE 'NEEDS_REVIEW' END WHEN 1 THEN 'ILLEGIBLE' WHEN 2 THEN CASE WHEN conf >= 0.7 THEN 'NOT_PROVIDED' ELSE 'NEEDS_REVIEW' END WHEN 3 THEN 'ILLEGIBLE' WHEN 4 THEN 'NOT_APPLICABLE' WHEN 5 THEN 'UNKNOWN' WHEN 6 THEN 'NOT_APPLICABLE' ELSE CASE WHEN valid AND fc >= thr THEN 'KNOWN' ELSE 'NEEDS_REVIEW' END END AS status,
round(CASE WHEN c IN (5, 6) THEN greatest(conf, 0.7) WHEN c = 3 THEN 0.3 ELSE fc END, 3) AS confidence,
CASE WHEN c = 1 THEN 'flou' WHEN c = 2 THEN 'vide sur le papier' WHEN c = 3 THEN 'encre présente mais illisible' WHEN c = 4 THEN 'tiret sur le papier' WHEN c = 5 THEN 'inconnu sur le papier' WHEN c = 8 AND sim < 1 THEN 'lu « ' || txt || ' », rapproché de « ' || term || ' »' WHEN NOT valid THEN 'valeur hors format / hors plage' ELSE '' END AS note FROM f"""


@query(reading_sql())
def reading_value(t: Tables) -> DataFrame:
    """Readings of every kind to values with status, confidence and note."""
    c, size = F.col("p_partkey") % 12, F.col("p_size")
    text = F.element_at(F.array(*map(F.lit, ("cesarienne", "voie  base", "Normal", "appel 0612345678", "somet", "r.a.s"))), (size % 6 + 1).cast("int"))
    by = lambda **cases: F.coalesce(*(F.when(c == int(k[1:]), v) for k, v in cases.items()))
    day = F.concat(F.lpad((size % 28 + 1).cast("string"), 2, "0"), F.lit("/O4/2026"))
    raw = by(c0=(size % 2 == 0).cast("string"), c1=F.lit("??"), c4=F.lit("—"), c5=F.lit(" Inconnu. "), c6=F.lit("N/A"), c7=F.concat((size + 5).cast("string"), F.lit(" cm")), c8=text, c9=F.concat(F.lit("ab "), F.col("p_partkey").cast("string"), F.lit("-x")), c10=F.concat(F.lit("x"), size.cast("string")), c11=day)
    kinds = F.coalesce(by(c0=F.lit("bool"), c7=F.lit("int"), c8=F.lit("text"), c9=F.lit("code"), c10=F.lit("date"), c11=F.lit("date")), F.lit("text"))
    columns = {
        "kind": F.when(c == 0, "check").otherwise("inline"), "type": kinds, "raw": raw, "confidence": size % 50 / 100.0 + 0.5, "dash": c == 4, "hint": F.when(c == 1, "ILLEGIBLE"),
        "note": F.coalesce(by(c1=F.lit("flou"), c2=F.lit("blank")), F.lit("")), "low": F.when(c == 7, 10.0), "high": F.when(c == 7, 45.0), "importance": (F.col("p_partkey") % 4).cast("int"),
    }
    return S.readings(t.part.select("p_partkey", *(v.alias(n) for n, v in columns.items())), TERMS)


VALUES_SQL = """WITH c AS (SELECT c_custkey AS r, DATE '2025-01-01' + (c_custkey * 7 % 300)::INT AS lmp, c_custkey % 9 AS a, c_custkey % 7 AS b, c_custkey % 5 AS d FROM customer),
x AS (SELECT r, a, b, d, lmp::DATE AS lmp, CAST(lmp + (CASE WHEN a < 6 THEN 278 + a ELSE 290 END)::INT AS DATE) AS edd, CAST(lmp + (CASE WHEN a < 6 THEN 278 + a ELSE 290 END)::INT + (5 + b % 4)::INT AS DATE) AS term, CAST(lmp + (140 + 3 * b)::INT AS DATE) AS visit, 20 + d AS ga, r % 4 AS gravidity, r % 6 AS parity, r % 8 AS living FROM c)"""


def ruled_values(t: Tables) -> DataFrame:
    """Long values of records built from the customers' keys."""
    k = F.col("c_custkey")
    a, b, d = k % 9, k % 7, k % 5
    lmp = F.date_add(F.lit("2025-01-01").cast("date"), (k * 7 % 300).cast("int"))
    edd = F.date_add(lmp, F.when(a < 6, a + 278).otherwise(290).cast("int"))
    fields = {
        "lmp": lmp, "edd": edd, "term_date": F.date_add(edd, (b % 4 + 5).cast("int")), "g_visit_date_m7": F.date_add(lmp, (b * 3 + 140).cast("int")),
        "g_ga_m7": d + 20, "gravidity": k % 4, "parity": k % 6, "living_children": k % 8, "rh_neg": k % 3 == 0, "rh_pos": k % 2 == 0, "del_complications": k % 2 == 0, "dc_other_text": None,
    }
    rows = []
    for f, v in fields.items():
        day, tick, blank = f in ("lmp", "edd", "term_date", "g_visit_date_m7"), f in ("rh_neg", "rh_pos", "del_complications"), f == "dc_other_text"
        none = F.lit(None)
        status = F.lit("NOT_PROVIDED") if blank else F.when(k % 2 == 0, "KNOWN").otherwise("NEEDS_REVIEW")
        rows.append(F.struct(F.lit(f).alias("field_id"), (F.date_format(v, "yyyy-MM-dd") if day else none.cast("string")).alias("value_str"), (none.cast("double") if day or tick or blank else v.cast("double")).alias("value_num"), (v if tick else none.cast("boolean")).alias("value_bool"), status.alias("status"), F.lit(0.7).alias("confidence"), F.when(k % 10 == 0, "midwife").otherwise("ai").alias("source"), F.when(k % 13 == 0, "hors plage").otherwise("").alias("note")))
    return t.customer.select(k.cast("string").alias("record_id"), F.inline(F.array(*rows)))


def rule_rows_sql() -> str:
    days = {"lmp": ("abs(edd - lmp - 280) <= 3", "cohérent avec la DPA", "DDR et DPA incohérentes (≠ 280 j)"), "edd": ("abs(edd - lmp - 280) <= 3", "cohérent avec la DDR", "DDR et DPA incohérentes (≠ 280 j)"), "term_date": ("abs(term - edd - 7) <= 1", "DPA + 7 j", "date de dépassement ≠ DPA + 7 j"), "g_visit_date_m7": ("abs((visit - lmp) / 7 - ga) <= 1.5", "cohérent avec DDR + âge gestationnel", "date incohérente avec l''âge gestationnel")}
    parts = [f"SELECT r, '{f}' AS field_id, CASE WHEN {c} THEN 'boost' ELSE 'flag' END AS action, CASE WHEN {c} THEN '{y}' ELSE '{n}' END AS why FROM x" for f, (c, y, n) in days.items()]
    parts.append("SELECT r, 'g_ga_m7', CASE WHEN abs((visit - lmp) / 7 - ga) <= 1.5 THEN 'boost' ELSE 'flag' END, CASE WHEN abs((visit - lmp) / 7 - ga) <= 1.5 THEN 'cohérent avec la date de visite' ELSE 'âge gestationnel incohérent avec la date (' || round_even((visit - lmp) / 7, 0)::INT || ' SA attendues)' END FROM x")
    parts += [f"SELECT r, '{f}', CASE WHEN parity > gravidity THEN 'flag' ELSE '' END, 'parité > gestité' FROM x" for f in ("gravidity", "parity")]
    parts.append("SELECT r, 'living_children', CASE WHEN living > parity + 1 THEN 'flag' ELSE '' END, 'enfants vivants > parité' FROM x")
    parts += [f"SELECT r, '{f}', CASE WHEN r % 3 = 0 AND r % 2 = 0 THEN 'flag' ELSE '' END, 'plusieurs cases cochées dans un groupe exclusif' FROM x" for f in ("rh_neg", "rh_pos")]
    parts.append("SELECT r, 'del_complications', '', '' FROM x")
    parts.append("SELECT r, 'dc_other_text', CASE WHEN r % 2 <> 0 THEN 'na' ELSE '' END, 'pas de complication' FROM x")
    blank = "field_id = 'dc_other_text'"
    return f"""{VALUES_SQL}, p AS ({" UNION ALL ".join(parts)}), v AS (SELECT *, CASE WHEN {blank} THEN 'NOT_PROVIDED' WHEN r % 2 = 0 THEN 'KNOWN' ELSE 'NEEDS_REVIEW' END AS s, CASE WHEN r % 13 = 0 THEN 'hors plage' ELSE '' END AS n, r % 10 <> 0 AS ai FROM p),
w AS (SELECT *, action = 'flag' AND s = 'KNOWN' AND ai AS f, action = 'boost' AND s = 'NEEDS_REVIEW' AND ai AND n = '' AS b, action = 'na' AND s = 'NOT_PROVIDED' AS m FROM v)
SELECT r::VARCHAR AS record_id, field_id, CASE WHEN f THEN 'NEEDS_REVIEW' WHEN b THEN 'KNOWN' WHEN m THEN 'NOT_APPLICABLE' ELSE s END AS status, CASE WHEN f THEN 0.5 WHEN b THEN 0.93 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN f OR b THEN CASE WHEN n <> '' THEN n || '; ' || why ELSE why END WHEN m THEN why ELSE n END AS note FROM w"""


@query(rule_rows_sql())
def record_rules(t: Tables) -> DataFrame:
    """All rules between the fields of a record: dates, visits, parity, exclusive ticks, what a false tick rules out."""
    return consistent(ruled_values(t)).select("record_id", "field_id", "status", "confidence", "note")


def analytic_values(t: Tables) -> DataFrame:
    """Long values of records built from the customers' keys; every fifth record's are not known."""
    k = F.col("c_custkey")
    word = lambda *w: F.element_at(F.array(*map(F.lit, w)), (k % len(w) + 1).cast("int"))
    texts = {"education": word("Supérieur", "Lycée", "aucune", ""), "hx_medical": word("HTA", "diabète", "RAS"), "g_bp_t1v1": word("120/80", "130/85", "x"), "g_bp_m7": word("110/70", "140/90"), "g_hiv_m8": word("négatif", "positif", "non fait"), "g_albuminuria_m7": word("positif", "négatif", "non fait", "trace"), "nb_sex": word("Masculin", "féminin", "?"), "pd1_mode": word("Césarienne", "voie basse")}
    numbers = {"age": k % 30 + 16, "gravidity": k % 5, "g_weight_t1v2": k % 40 + 45, "height_cm": k % 30 + 150, "g_glycemia_m7": k % 60 / 100.0 + 0.7, "nb_ga": k % 12 + 30, "g_ga_t2v1": k % 20 + 8, "g_hb_m9": k % 50 / 10.0 + 8}
    ticks = {"consanguinity": k % 2 == 0, "mode_cs_planned": k % 3 == 0, "mode_vaginal": k % 3 == 1, "nbe_bf_artificial": k % 4 == 0, "nbe_bf_mixed": k % 4 == 1, "nbe_transfer": k % 7 == 0}
    none = F.lit(None)
    status = F.when(k % 5 == 0, "NEEDS_REVIEW").otherwise("KNOWN")
    row = lambda f, s, n, b: F.struct(F.lit(f).alias("field_id"), s.cast("string").alias("value_str"), n.cast("double").alias("value_num"), b.cast("boolean").alias("value_bool"), status.alias("status"), (F.lit(f) != "height_cm").alias("valid") | (k % 11 != 0))
    rows = [row(f, v, none, none) for f, v in texts.items()] + [row(f, none, v, none) for f, v in numbers.items()] + [row(f, none, none, v) for f, v in ticks.items()]
    return t.customer.select(k.cast("string").alias("record_id"), F.inline(F.array(*rows))).toDF("record_id", "field_id", "value_str", "value_num", "value_bool", "status", "valid")


@query("""WITH x AS (SELECT c_custkey AS r, c_custkey % 5 <> 0 AS ok, c_custkey AS k FROM customer)
SELECT r::VARCHAR AS record_id, CASE WHEN ok THEN (k % 30 + 16)::DOUBLE END AS age, CASE WHEN ok THEN CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END END AS education, CASE WHEN ok THEN (k % 3 = 0)::INT END AS hypertension, CASE WHEN ok THEN (k % 3 = 1)::INT END AS diabetes, CASE WHEN ok THEN (k % 2 = 0)::INT END AS consanguinity,
CASE WHEN ok AND k % 11 <> 0 THEN round((k % 40 + 45) / power((k % 30 + 150) / 100.0, 2), 2) END AS bmi,
CASE WHEN ok THEN round(((CASE k % 3 WHEN 0 THEN 120 WHEN 1 THEN 130 ELSE 0 END) + (CASE k % 2 WHEN 0 THEN 110 ELSE 140 END)) / (CASE WHEN k % 3 = 2 THEN 1 ELSE 2 END), 1) END AS mean_sbp, CASE WHEN ok THEN round(((CASE k % 3 WHEN 0 THEN 80 WHEN 1 THEN 85 ELSE 0 END) + (CASE k % 2 WHEN 0 THEN 70 ELSE 90 END)) / (CASE WHEN k % 3 = 2 THEN 1 ELSE 2 END), 1) END AS mean_dbp,
CASE WHEN ok THEN (k % 50 / 10.0 + 8)::DOUBLE END AS hemoglobin, CASE WHEN ok THEN round((k % 60 / 100.0 + 0.7) * 100, 1)::DOUBLE END AS glucose, CASE WHEN ok THEN CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END END AS proteinuria, CASE WHEN ok THEN CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END END AS hiv,
CASE WHEN ok THEN (k % 20 + 8)::DOUBLE END AS ga_enrollment, CASE WHEN ok THEN (k % 12 + 30 < 37)::INT END AS preterm, CASE WHEN ok AND k % 3 <> 2 THEN (k % 3 = 0)::INT END AS delivery, CASE WHEN ok THEN CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END END AS sex, CASE WHEN ok THEN (k % 2 = 0)::INT END AS previous_cesarean, CASE WHEN ok THEN (k % 4 = 1)::INT END AS breastfeeding, CASE WHEN ok THEN (k % 7 = 0)::INT END AS referral FROM x""")
def analytic_record(t: Tables) -> DataFrame:
    """The wide analytic row of each record, out of its trusted values."""
    return wide(analytic_values(t)).select("record_id", "age", "education", "hypertension", "diabetes", "consanguinity", "bmi", "mean_sbp", "mean_dbp", "hemoglobin", "glucose", "proteinuria", "hiv", "ga_enrollment", "preterm", "delivery", "sex", "previous_cesarean", "breastfeeding", "referral")


@query(f"""WITH p AS (SELECT DISTINCT o_custkey AS r, CASE WHEN o_orderpriority LIKE '1%' THEN 'a' WHEN o_orderpriority LIKE '2%' THEN 'b' END AS page FROM orders)
SELECT c_custkey AS record_id, field_id, 'NOT_PROVIDED' AS status, 1.0::DOUBLE AS confidence, 'rule' AS source, 'page non photographiée' AS note FROM customer, {SPECS_SQL} WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.r = c_custkey AND p.page = s.page)""")
def missing_page_fill(t: Tables) -> DataFrame:
    page = F.when(F.col("o_orderpriority").startswith("1"), "a").when(F.col("o_orderpriority").startswith("2"), "b")
    pages = t.orders.select(F.col("o_custkey").alias("record_id"), page.alias("page")).distinct()
    return P.missing_pages(t.customer.select(F.col("c_custkey").alias("record_id")), pages, P.spec_table(t.spark, SPECS))


@query(f"""WITH v AS (SELECT o_custkey AS r, 'quantity' AS field_id, max(o_totalprice) AS value FROM orders GROUP BY 1)
SELECT c_custkey AS record_id, s.field_id, v.value, CASE WHEN v.r IS NULL THEN 'NOT_PROVIDED' ELSE 'KNOWN' END AS status FROM customer CROSS JOIN {SPECS_SQL} LEFT JOIN v ON v.r = c_custkey AND v.field_id = s.field_id""")
def unresolved_default(t: Tables) -> DataFrame:
    values = t.orders.groupBy(F.col("o_custkey").alias("record_id")).agg(F.max("o_totalprice").alias("value")).withColumn("field_id", F.lit("quantity")).withColumn("status", F.lit(S.KNOWN))
    return P.all_fields(t.customer.select(F.col("c_custkey").alias("record_id")), values, P.spec_table(t.spark, SPECS))


KINDS_SQL = "CASE doc_id % 3 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' ELSE 'text' END"


@query(f"SELECT doc_id, CASE WHEN quality = 1 AND ({KINDS_SQL} = 'bool' OR doc_id % 4 <> 0) THEN toxic END AS value FROM labels")
def trusted_projection(t: Tables) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "bool").when(F.col("doc_id") % 3 == 1, "int").otherwise("text")
    status = F.when(F.col("quality") == 1, S.KNOWN).otherwise(S.REVIEW)
    return t.labels.select("doc_id", P.trusted(kind, F.col("toxic"), status, F.col("doc_id") % 4 != 0).alias("value"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR (doc_id % 3 <> 0 AND quality = 0) THEN CASE WHEN doc_id % 7 = 0 THEN 'ILLEGIBLE' ELSE 'NEEDS_REVIEW' END WHEN doc_id % 3 = 0 THEN 'NOT_PROVIDED' ELSE 'KNOWN' END AS status, CASE WHEN NOT (doc_id % 7 = 0 OR (doc_id % 3 <> 0 AND quality = 0)) THEN 'midwife_confirmed' END AS source, doc_id % 7 = 0 OR (doc_id % 3 <> 0 AND quality = 0) AS refused FROM labels""")
def confirm_guard(t: Tables) -> DataFrame:
    value = F.when(F.col("doc_id") % 3 != 0, F.col("toxic"))
    status = F.when(F.col("doc_id") % 7 == 0, S.ILLEGIBLE).otherwise(S.REVIEW)
    return t.labels.select("doc_id", P.confirmed(value, status, F.col("quality") == 1).alias("x")).select("doc_id", "x.*")


FIELDS = (("age", "Âge", "Age"), ("edd", "Date prévue d’accouchement", "Due date"), ("bp", "Tension artérielle", "Blood pressure"), ("nb_weight", "Poids — nouveau-né", "Birth weight"), ("lmp", "Dernières règles", "Last period"))
QUESTIONS = ("age", "AGE", "date prevue d’acouchement", "tension arterielle", "poids nouveau-ne", "Birthweigt", "dernieres regle", "lnp", "xyzxyzxyz", "blood presure", "Due  date", "poid nouveau né")


def find_field_sql() -> str:
    clean = lambda x: f"replace(replace(lower(strip_accents({x})), ' ', ''), '—', '')"
    rows = ", ".join(f"({k}, '{i}', {clean(repr(x))})" for k, (i, x) in enumerate((f[0], x) for f in FIELDS for x in (*f[1:], f[0])))
    words = ", ".join(f"'{q}'" for q in QUESTIONS)
    return f"""WITH q AS (SELECT p_partkey, ([{words}])[p_partkey % {len(QUESTIONS)} + 1] AS raw FROM part), x AS (SELECT p_partkey, raw, replace(lower(strip_accents(raw)), ' ', '') AS k FROM q), f(n, id, label) AS (VALUES {rows}),
d AS (SELECT p_partkey, raw, k, id, n, levenshtein(k, label) AS d FROM x, f) SELECT p_partkey, CASE WHEN min(d) <= greatest(2, length(any_value(k)) // 5) THEN arg_min(id, (d, n)) END AS field_id FROM d GROUP BY p_partkey"""


@query(find_field_sql())
def find_field(t: Tables) -> DataFrame:
    """The field that each of a list of typed names means, misspelled ones too; an exact label is at distance 0."""
    raw = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("p_partkey") % len(QUESTIONS) + 1).cast("int"))
    return t.part.select("p_partkey", P.find_field(raw, FIELDS).alias("field_id"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN toxic = 1 THEN 'oui' ELSE 'non' END WHEN 1 THEN strftime(DATE '2026-01-31' - (doc_id % 100)::INT, '%d/%m/%Y') WHEN 2 THEN '—' ELSE 'v' || quality END AS shown, round_even(100 * (doc_id % 200 / 199.0)::DOUBLE, 0)::INT AS percent FROM labels")
def show_values(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    day = F.date_format(F.date_sub(F.lit("2026-01-31").cast("date"), (F.col("doc_id") % 100).cast("int")), "yyyy-MM-dd")
    value = F.when(k == 0, (F.col("toxic") == 1).cast("string")).when(k == 1, day).when(k == 3, F.concat(F.lit("v"), F.col("quality").cast("string")))
    kind = F.when(k == 0, "bool").when(k == 1, "date").otherwise("text")
    return t.labels.select("doc_id", N.shown(kind, value).alias("shown"), N.percent(F.col("doc_id") % 200 / 199.0).alias("percent"))


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN CASE doc_id % 3 WHEN 0 THEN 'bool' WHEN 1 THEN 'float' ELSE 'text' END ELSE 'lab' END AS kind, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'Positif' WHEN doc_id % 3 = 0 THEN CASE WHEN quality = 1 THEN 'true' ELSE 'false' END WHEN doc_id % 3 = 1 THEN quality || '.0000001' ELSE 'Voie-Basse ' || quality END END AS got, CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN CASE WHEN toxic = 1 THEN 'négatif' ELSE 'positif' END WHEN doc_id % 3 < 2 THEN toxic::VARCHAR WHEN doc_id % 13 = 0 THEN 'v�ie bas�e' || toxic ELSE 'voie basse' || toxic END END AS expected, quality AS q, toxic AS x FROM labels)
SELECT doc_id, CASE WHEN expected IS NULL THEN got IS NULL WHEN got IS NULL THEN false WHEN kind = 'lab' THEN x = 0 ELSE q = x END AS matched FROM x""")
def reading_match(t: Tables) -> DataFrame:
    """Whether readings equal the expected values, by the field's type."""
    d, q, x = F.col("doc_id"), F.col("quality").cast("string"), F.col("toxic").cast("string")
    lab, k = d % 5 == 0, d % 3
    kind = F.when(lab, "lab").when(k == 0, "bool").when(k == 1, "float").otherwise("text")
    got = F.when(lab, "Positif").when(k == 0, (F.col("quality") == 1).cast("string")).when(k == 1, F.concat(q, F.lit(".0000001"))).otherwise(F.concat(F.lit("Voie-Basse "), q))
    expected = F.when(lab, F.when(F.col("toxic") == 1, "négatif").otherwise("positif")).when(k < 2, x).when(d % 13 == 0, F.concat(F.lit("v\ufffdie bas\ufffde"), x)).otherwise(F.concat(F.lit("voie basse"), x))
    return t.labels.select("doc_id", P.matches(kind, F.when(d % 7 != 0, got), F.when(d % 11 != 0, expected)).alias("matched"))


@query("""WITH x AS (SELECT p_partkey, (p_size / 100.0)::DOUBLE AS ink FROM part) SELECT p_partkey, ink > 0.07 AS ticked, least(greatest(0.5 + 0.5 * (CASE WHEN ink > 0.07 THEN ink - 0.07 ELSE 0.07 - ink END / 0.07), 0.5), 0.99) AS tick_confidence, ink / 20 < 0.003 AS blank, least(greatest(1 - ink / 20 / 0.003, 0.6), 0.98) AS blank_confidence FROM x""")
def ink_decisions(t: Tables) -> DataFrame:
    """Ticks by their share of ink, blanks by the lack of it, each with its confidence."""
    ink = F.col("p_size") / 100.0
    ticked, distance = S.ticked(ink), F.abs(ink - S.TICK) / S.TICK
    return t.part.select("p_partkey", ticked.alias("ticked"), S.tick_confidence(distance).alias("tick_confidence"), S.blank(ink / 20).alias("blank"), S.blank_confidence(ink / 20).alias("blank_confidence"))


@query("""WITH b AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size > 42) AS blue FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN blue >= greatest(3, 0.15 * n) THEN 'blue' ELSE 'dark' END AS pen, CASE WHEN p_size > 42 AND blue >= greatest(3, 0.15 * n) THEN 'blue' ELSE 'dark' END AS mask FROM part JOIN b USING (p_brand)""")
def pen_colour(t: Tables) -> DataFrame:
    """A page's pen is blue if enough of its regions hold blue ink; the page's pen then says how each region is read."""
    blue = F.col("p_size") > 42
    pages = t.part.groupBy("p_brand").agg(A.pen(blue).alias("pen"))
    return t.part.join(pages, "p_brand").select("p_partkey", "pen", F.when(blue & (F.col("pen") == "blue"), "blue").otherwise("dark").alias("mask"))


@query("SELECT p_brand, count(*) AS n_tasks, sum(CASE WHEN p_size % 5 = 0 THEN 1 ELSE len(string_split(p_name, ' ')) END)::BIGINT AS n_points FROM part GROUP BY 1")
def nested_sizes(t: Tables) -> DataFrame:
    """Points to review of each page: the fields that its tasks name, one for a task that names none."""
    fields = F.when(F.col("p_size") % 5 != 0, F.split("p_name", " "))
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n_tasks"), A.nested_size(fields).alias("n_points"))


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_quantity, l_linenumber, l_returnflag) AS text, round(avg(l_discount * 1000) / 100, 4) AS confidence FROM lineitem GROUP BY l_orderkey")
def ordered_words(t: Tables) -> DataFrame:
    """The words of a region from the left, with the mean of their confidences (in hundredths)."""
    word = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    words = F.array_sort(F.collect_list(F.struct("l_quantity", "l_linenumber", "l_returnflag", word.alias("word"))))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(words, lambda x: x["word"]), " ").alias("text"), F.round(F.avg(F.col("l_discount") * 1000) / 100, 4).alias("confidence"))


RUNS_SQL = "SELECT p_brand AS page, p_partkey AS k, (p_partkey * 7 % 400)::DOUBLE AS x, (p_partkey * 11 % 600)::DOUBLE AS y, 'r' || (p_partkey % 5) AS rname, 'c' || (p_partkey % 3) AS cname FROM part"
CELL_SPECS = (("f1", "r0", "c0", 8.0, 20.0), ("f2", "r1", "c0", 6.0, 25.0), ("f3", "r4", "c2", 8.0, 30.0), ("f4", "r9", "c1", 8.0, 20.0))
CELLS_SQL = ", ".join(f"('{f}', '{r}', '{c}', {h}, {w})" for f, r, c, h, w in CELL_SPECS)


@query(f"""WITH u AS ({RUNS_SQL}), r AS (SELECT page, rname AS name, arg_min(y, (y, x)) AS y FROM u GROUP BY ALL), c AS (SELECT page, cname AS name, arg_min(x, (y, x)) AS x FROM u GROUP BY ALL)
SELECT r.page, s.field, c.x - 5 AS x0, r.y - s.h AS y0, c.x - 5 + 2 * s.hw AS x1, r.y + s.h AS y1 FROM (VALUES {CELLS_SQL}) s(field, row, col, h, hw) JOIN r ON r.name = s.row JOIN c ON c.name = s.col AND c.page = r.page""")
def anchored_cells(t: Tables) -> DataFrame:
    """Table cells from the first run of a row's label and the first of a column's header on each page."""
    runs = t.part.selectExpr("p_brand AS page", "CAST(p_partkey * 7 % 400 AS DOUBLE) AS x", "CAST(p_partkey * 11 % 600 AS DOUBLE) AS y", "concat('r', p_partkey % 5) AS r", "concat('c', p_partkey % 3) AS c")
    specs = t.spark.createDataFrame(list(CELL_SPECS), "field string, row string, col string, h double, hw double")
    return cells(runs.withColumnRenamed("r", "text"), runs.withColumnRenamed("c", "text"), specs)


@query(f"""WITH u AS ({RUNS_SQL}), l AS (SELECT page, k AS label, x + 10 + k % 30 + 2 AS x_from, y FROM u) SELECT l.page, l.label, l.x_from, least(l.x_from + 90, coalesce(min(o.x) - 3, 1e9)) AS x_to FROM l LEFT JOIN u o ON o.page = l.page AND o.k <> l.label AND abs(o.y - l.y) <= 4 AND o.x > l.x_from + 4 AND o.x < l.x_from + 90 GROUP BY l.page, l.label, l.x_from""")
def next_label(t: Tables) -> DataFrame:
    """Value regions right of labels, cut off before the next label on the line."""
    labels = t.part.selectExpr("p_brand AS page", "p_partkey AS label", "CAST(p_partkey * 7 % 400 AS DOUBLE) AS x0", "CAST(p_partkey * 7 % 400 + 10 + p_partkey % 30 AS DOUBLE) AS x1", "CAST(p_partkey * 11 % 600 AS DOUBLE) AS y")
    return value_region(labels, 2, 90)


@query("""WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click') SELECT user_id, n, a.event_id AS image, b.event_id AS page FROM a JOIN b USING (user_id, n)""")
def page_zip(t: Tables) -> DataFrame:
    """Images and page types of a record side by side by position, as far as the shorter list goes."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("n")
    side = lambda kind, name: t.events.where(F.col("event_type") == kind).select("user_id", place, F.col("event_id").alias(name))
    return side("view", "image").join(side("click", "page"), ["user_id", "n"])


STATES_SQL = "CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' WHEN 'O' THEN 'NEEDS_REVIEW' ELSE 'PENDING_AI' END"
LEGAL = ", ".join(f"('{a}', '{b}')" for a, to in L.TRANSITIONS.items() for b in to)


@query(f"""WITH c AS (SELECT o_orderkey AS k, {STATES_SQL} AS state FROM orders WHERE o_orderkey % 10 <> 9), q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'NEEDS_REVIEW' ELSE {STATES_SQL} END AS expected, CASE o_orderkey % 3 WHEN 0 THEN 'PATIENT_MATCHED' WHEN 1 THEN 'VALIDATED' ELSE 'PENDING_AI' END AS t FROM orders),
j AS (SELECT q.k, c.state AS f, q.t, c.state = q.expected AND (c.state, q.t) IN ({LEGAL}) AS ok FROM q LEFT JOIN c USING (k)) SELECT k, f AS from_state, CASE WHEN ok THEN t ELSE f END AS state, CASE WHEN f IS NULL THEN 'missing' WHEN ok THEN 'applied' ELSE 'refused' END AS outcome FROM j""")
def guarded_update(t: Tables) -> DataFrame:
    """Transitions asked for with the state they expect; what doesn't hold is refused as a row."""
    state = F.when(F.col("o_orderstatus") == "F", "VALIDATED").when(F.col("o_orderstatus") == "O", "NEEDS_REVIEW").otherwise("PENDING_AI")
    k = F.col("o_orderkey")
    current = t.orders.where("o_orderkey % 10 <> 9").select(k.alias("k"), state.alias("state"))
    to = F.when(k % 3 == 0, "PATIENT_MATCHED").when(k % 3 == 1, "VALIDATED").otherwise("PENDING_AI")
    asked = t.orders.select(k.alias("k"), F.when(k % 4 == 0, "NEEDS_REVIEW").otherwise(state).alias("expected"), to.alias("to_state"))
    return L.guarded(current, asked, ["k"], L.transition_table(t.spark))


@query("SELECT o_orderkey AS k, o_orderstatus AS state, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 6 <> 0 THEN 'p' || o_custkey END ELSE o_orderpriority END AS payload FROM orders")
def payload_update(t: Tables) -> DataFrame:
    """The payload of some rows is replaced, by null too; keys that aren't there add nothing."""
    k = F.col("o_orderkey")
    old = t.orders.select(k.alias("k"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("payload"))
    new = t.orders.where("o_orderkey % 3 = 0").select(k.alias("k"), F.when(k % 6 != 0, F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("payload"))
    return L.update_payload(old, new.unionByName(new.select((-F.col("k") - 1).alias("k"), "payload")), ["k"], "payload")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'view', ts, event_id) AS seq FROM events WHERE event_type IN ('view', 'click')")
def append_journal(t: Tables) -> DataFrame:
    """Clicks are appended to a journal of views; their numbers go on from each record's last."""
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq")
    old = t.events.where("event_type = 'view'").select("user_id", "event_id", seq)
    return L.append_journal(old, t.events.where("event_type = 'click'").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), s AS (SELECT user_id, min(n) AS n FROM e WHERE event_type = 'error' AND value > 60 GROUP BY 1)
SELECT e.event_id, CASE WHEN s.n <= e.n THEN 'pending' WHEN e.event_type = 'error' THEN 'failed' ELSE 'done' END AS outcome FROM e LEFT JOIN s USING (user_id)""")
def batch_interrupt(t: Tables) -> DataFrame:
    """Each user's events are a batch; one without a network ends it, and what is left stays pending."""
    error = F.col("event_type") == "error"
    return L.interrupted(t.events, "user_id", ["ts", "event_id"], error & (F.col("value") > 60), error).select("event_id", "outcome")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN 'F' || (c_custkey * 37 % 200) ELSE '' END AS code FROM customer)
SELECT a.k, a.code, CASE WHEN count(b.k) > 0 THEN 'DUPLICATE_SUSPECTED' ELSE 'SYNCED' END AS state, count(b.k) AS n_others, CASE WHEN min(b.k) < a.k THEN min(b.k) ELSE max(b.k) END AS other FROM c a LEFT JOIN c b ON a.code = b.code AND a.k <> b.k AND a.code <> '' GROUP BY a.k, a.code""")
def duplicate_feedback(t: Tables) -> DataFrame:
    """What delivery reports back: another patient with the same code makes a record suspect."""
    k = F.col("c_custkey")
    code = F.when(k % 9 != 0, F.concat(F.lit("F"), (k * 37 % 200).cast("string"))).otherwise("")
    return L.duplicate_feedback(t.customer.select(k.alias("k"), code.alias("code")), "k", "code")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS kept, count(*) AS copies FROM events GROUP BY user_id, event_type, props::JSON ->> '$.k'")
def capture_dedupe(t: Tables) -> DataFrame:
    """A page captured again with the same content counts once, as first captured."""
    content = F.from_json("props", "k int")["k"]
    return t.events.groupBy("user_id", "event_type", content.alias("content")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("kept"), F.count("*").alias("copies")).drop("content")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey")
def in_list_scan(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus").isin("O", "P")).orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT c_custkey, c_name AS name, c_nationkey AS nation FROM customer")
def decoded_scan(t: Tables) -> DataFrame:
    """Every patient's payload, encrypted at rest (AES, GCM), decrypted and parsed as it is read."""
    key = F.lit("0123456789abcdef")
    stored = t.customer.select("c_custkey", F.aes_encrypt(F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))), key).alias("enc"))
    return stored.select("c_custkey", F.from_json(F.aes_decrypt("enc", key).cast("string"), "name string, nation int").alias("x")).select("c_custkey", "x.*")


@query("SELECT 'H' || s_suppkey AS key, s_name AS name, s_nationkey::VARCHAR AS nation, CASE WHEN s_suppkey % 3 <> 0 THEN s_name || ', \"x\"' END AS note FROM supplier")
def csv_registry(t: Tables) -> DataFrame:
    """A registry exported as CSV and read back: all text, blanks null, ids with a prefix."""
    at = f"{files.shared_folder(t.spark)}/registry"
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 3 != 0, F.concat("s_name", F.lit(', "x"'))).alias("note"))
    if files.export(rows, at, "midwife") or not files.export(rows, at, "analyst"):
        raise PermissionError("roles are not as they should be")
    return files.read_registry(t.spark, at)


@query("SELECT s_suppkey, s_name FROM supplier")
def historical_scan(t: Tables) -> DataFrame:
    """Rows of an earlier table, which may not be there yet, and those of now."""
    old = files.table_or_empty(t.spark, "historical_rows_not_there", "s_suppkey long, s_name string")
    return old.unionByName(t.supplier.select("s_suppkey", "s_name"))


@query("""SELECT conv_id, turn, role AS sender, CASE turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'button' ELSE 'photo' END AS kind, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'b' || turn ELSE 'i' || conv_id END AS value FROM conversations WHERE turn % 4 <> 3 AND (turn % 4 <> 0 OR text IS NOT NULL)""")
def webhook_messages(t: Tables) -> DataFrame:
    """Messages of webhook documents, typed by what they hold; kinds that aren't known are dropped."""
    k = F.col("turn") % 4
    kind = F.when(k == 0, "text").when(k == 1, "interactive").when(k == 2, "image").otherwise("sticker")
    reply = F.when(k == 1, F.struct(F.struct(F.concat(F.lit("b"), F.col("turn").cast("string")).alias("id"), F.lit("t").alias("title")).alias("button_reply")))
    message = F.struct(F.col("role").alias("from"), kind.alias("type"), F.when(k == 0, F.struct(F.col("text").alias("body"))).alias("text"), reply.alias("interactive"), F.when(k == 2, F.struct(F.concat(F.lit("i"), F.col("conv_id").cast("string")).alias("id"))).alias("image"))
    payload = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.struct(F.array(message).alias("messages")).alias("value"))).alias("changes"))).alias("entry")))
    return files.webhook_messages(t.conversations.select("conv_id", "turn", payload.alias("payload")), keep=["conv_id", "turn"]).where("kind <> 'text' OR value is not null")


@query("SELECT doc_id, json_object('id', doc_id, 'quality', quality, 'toxic', toxic = 1)::VARCHAR AS body FROM labels")
def json_payload(t: Tables) -> DataFrame:
    """The body that is sent out for each row."""
    return t.labels.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "quality", (F.col("toxic") == 1).alias("toxic"))).alias("body"))


@query("""SELECT doc_id, 'quality' AS field, quality::VARCHAR AS expected, CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END AS got FROM documents JOIN labels USING (doc_id) WHERE quality <> CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END""")
def error_rows(t: Tables) -> DataFrame:
    """Rows of an evaluation where the reading isn't what was expected, as they go to the error file."""
    got = F.when(F.col("n_chars") > 1500, "1").otherwise("0")
    d = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select("doc_id", F.lit("quality").alias("field"), F.col("quality").cast("string").alias("expected"), got.alias("got"))
    return d.where(~P.matches(F.lit("int"), F.col("got"), F.col("expected")))


@query("""WITH v AS (SELECT CASE event_type WHEN 'view' THEN 'pme_temp' WHEN 'click' THEN 'pml_temp' ELSE 'other' END AS f, value / 2 AS t, event_id % 3 <> 0 AS known FROM events), b AS (SELECT unnest([0, 1, 2]) AS bin)
SELECT bin::BIGINT AS bin, ['0–20', '20–40', '40–60'][bin + 1] AS label, CASE WHEN n >= 5 OR n = 0 THEN n END AS n FROM (SELECT bin, count(t) AS n FROM b LEFT JOIN v ON v.f IN ('pme_temp', 'pml_temp') AND known AND t >= bin * 20 AND (t < bin * 20 + 20 OR (bin = 2 AND t = 60)) GROUP BY bin)""")
def temperatures(t: Tables) -> DataFrame:
    """Known temperatures out of two fields, as a histogram without small cells."""
    field = F.when(F.col("event_type") == "view", "pme_temp").when(F.col("event_type") == "click", "pml_temp").otherwise("other")
    v = t.events.select(field.alias("f"), (F.col("value") / 2).alias("t"), (F.col("event_id") % 3 != 0).alias("known"))
    return A.histogram(v.where(F.col("f").isin("pme_temp", "pml_temp") & F.col("known") & F.col("t").isNotNull()), F.col("t"), [0, 20, 40, 60])


WEEKS_RAW = ("45.4", "3.6", "3.4", "12 SA", "l2", "45,6", "-4", "abc", "2O")


@query(f"""WITH x AS (SELECT p_partkey, ([{", ".join(repr(w) for w in WEEKS_RAW)}])[p_partkey % {len(WEEKS_RAW)} + 1] AS raw, ([45.4, 3.6, 3.4, 12, 12, 45.6, -4, NULL, 20])[p_partkey % {len(WEEKS_RAW)} + 1]::DOUBLE AS n FROM part)
SELECT p_partkey, raw, round_even(n, 0)::BIGINT AS weeks, coalesce(round_even(n, 0) BETWEEN 4 AND 45, false) AS weeks_valid, n AS number, coalesce(n BETWEEN 3.5 AND 45.5, false) AS number_valid FROM x""")
def norm_weeks(t: Tables) -> DataFrame:
    """Weeks are rounded before their range is tested, decimals aren't."""
    raw = F.element_at(F.array(*map(F.lit, WEEKS_RAW)), (F.col("p_partkey") % len(WEEKS_RAW) + 1).cast("int"))
    d = t.part.select("p_partkey", raw.alias("raw")).withColumn("w", N.norm_weeks(F.col("raw"))).withColumn("f", N.norm_float(F.col("raw"), 3.5, 45.5))
    return d.select("p_partkey", "raw", F.col("w.value").alias("weeks"), F.col("w.valid").alias("weeks_valid"), F.col("f.value").alias("number"), F.col("f.valid").alias("number_valid"))


@query("""SELECT conv_id, turn, translate(lower(strip_accents(replace(replace(trim(text), 'œ', 'oe'), 'Œ', 'OE'))), ' ''-.,', '') AS key, TRY_CAST(trim(split_part(text, ' ', 1)) AS DOUBLE) AS number FROM conversations""")
def fold_key(t: Tables) -> DataFrame:
    """A text's key for equality, and its first word where that is a number."""
    return t.conversations.select("conv_id", "turn", N.fold(F.col("text")).alias("key"), N.clean_number(F.split_part(F.col("text"), F.lit(" "), F.lit(1))).alias("number"))


@query("""WITH x AS (SELECT doc_id, least(n_chars / 3000.0, 1.0)::DOUBLE AS c, quality = 1 AS valid, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 11) / 10.0::DOUBLE END AS sim FROM documents JOIN labels USING (doc_id)),
y AS (SELECT *, CASE WHEN sim IS NULL THEN least(c, 0.75) WHEN sim >= 0.8 THEN greatest(c, 0.55 + 0.4 * sim) ELSE c * (0.6 + 0.4 * sim) END AS s FROM x) SELECT doc_id, round(CASE WHEN valid THEN s ELSE least(s, 0.35) END, 6) AS confidence FROM y""")
def lexicon_confidence(t: Tables) -> DataFrame:
    """Confidence after the lexicon: raised by a near term, capped without one, capped lower if invalid."""
    d = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    sim = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 11 / 10.0)
    return d.select("doc_id", F.round(S.adjusted(F.least(F.col("n_chars") / 3000.0, F.lit(1.0)), F.col("quality") == 1, sim), 6).alias("confidence"))


def flag_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@query("""WITH x AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'KNOWN' ELSE 'NEEDS_REVIEW' END AS s, CASE WHEN doc_id % 5 = 0 THEN 'valeur hors plage' ELSE '' END AS n, toxic = 1 AS bad FROM labels) SELECT doc_id, CASE WHEN bad AND s = 'KNOWN' THEN 'NEEDS_REVIEW' WHEN NOT bad AND s = 'NEEDS_REVIEW' AND n = '' THEN 'KNOWN' ELSE s END AS status FROM x""")
def flag_boost(t: Tables) -> DataFrame:
    """Contradiction sends a known value to review; agreement makes one under review known, unless it is out of range."""
    status = F.when(F.col("quality") == 1, S.KNOWN).otherwise(S.REVIEW)
    note, bad = F.when(F.col("doc_id") % 5 == 0, "valeur hors plage").otherwise(""), flag_of(F.col("toxic") == 1)
    return t.labels.select("doc_id", F.when(bad, S.flagged(status, bad)).otherwise(S.boosted(status, ~bad, note)).alias("status"))


@query("""SELECT p_partkey, CASE WHEN f LIKE 'g\\_%' ESCAPE '\\' THEN false ELSE i >= 2 OR (p = 'cover' AND f IN ('fiche_number', 'region', 'province', 'facility')) END AS asked FROM (SELECT p_partkey, (p_partkey % 4)::INT AS i, CASE WHEN p_size % 2 = 0 THEN 'cover' ELSE 'pregnancy' END AS p, (['g_weight_m7', 'region', 'age', 'facility', 'gx'])[p_partkey % 5 + 1] AS f FROM part)""")
def manual_questions(t: Tables) -> DataFrame:
    """Which fields are asked for when a page is typed in."""
    k = F.col("p_partkey")
    field = F.element_at(F.array(*map(F.lit, ("g_weight_m7", "region", "age", "facility", "gx"))), (k % 5 + 1).cast("int"))
    return t.part.select("p_partkey", P.manual(F.when(F.col("p_size") % 2 == 0, "cover").otherwise("pregnancy"), field, k % 4).alias("asked"))


NAMES = ("education", "region", "fh_1", "hx_medical", "pd1_mode", "xcs_indication", "del_complications", "g_conjunctiva_m7", "g_breasts_t1v1", "g_cervix_m8", "g_presentation_m9", "g_skeleton_m7", "g_speculum_m7", "g_pelvis_m7", "ob_1_place", "x_place", "pme_scar", "nb_decision", "nb_anomaly", "nb_sex", "cervical_screening", "age", "hx_mode")
LISTS = ("education", "region", "family", "hx", "delivery_mode", "cs_indication", "complication", "conjunctiva", "breasts", "cervix", "presentation", "exam", "exam", "exam", "place", "common", "scar", "decision", "nb_anomaly", "sex", "screening", "common", "hx")


@query(f"SELECT p_partkey, n.lexicon FROM part JOIN (VALUES {', '.join(f'({i}, {x!r})' for i, x in enumerate(LISTS))}) n(i, lexicon) ON p_partkey % {len(NAMES)} = n.i")
def lexicon_choice(t: Tables) -> DataFrame:
    """The word list of each field, by rules on its name."""
    field = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    return t.part.select("p_partkey", P.lexicon_of(field).alias("lexicon"))


@query("""WITH x AS (SELECT event_id, value AS a, value * 3 AS b, value / 2 AS c, (value * 20)::BIGINT AS p FROM events) SELECT event_id, concat_ws(',', CASE WHEN a < 60 THEN 'blur' END, CASE WHEN b < 60 THEN 'dark' END, CASE WHEN b > 235 THEN 'overexposed' END, CASE WHEN c < 25 THEN 'low_contrast' END, CASE WHEN p < 900 THEN 'low_resolution' END) AS issues FROM x""")
def image_gate(t: Tables) -> DataFrame:
    """What is wrong with captures whose metrics follow the events' values."""
    v = F.col("value")
    return t.events.select("event_id", F.array_join(P.image_issues(v, v * 3, v / 2, F.round(v * 20).cast("long")), ",").alias("issues"))


@query(f"""SELECT page, string_agg(field_id || ' | ' || upper(field_id) || ' | ' || CASE WHEN kind = 'check' THEN '{P.CHECKBOX}' ELSE type END, chr(10) ORDER BY place) AS schema FROM (SELECT *, row_number() OVER () AS place FROM {SPECS_SQL}) GROUP BY page""")
def page_schema(t: Tables) -> DataFrame:
    """The lines that tell a model which fields a page has."""
    rows = [(*x, i, x.field_id.upper()) for i, x in enumerate(SPECS)]
    return P.page_schemas(t.spark.createDataFrame(rows, P.SCHEMA + ", place int, label string"))


SAID = ("KNOWN", "known", "NOT_APPLICABLE", "ILLEGIBLE", "weird", "NOT_PROVIDED")


@query(f"""WITH x AS (SELECT doc_id, doc_id % 2 = 0 AS a, upper((['{"', '".join(SAID)}'])[doc_id % 6 + 1]) AS said, least(doc_id % 15 / 10.0, 1.0)::DOUBLE AS c, doc_id % 3 = 0 AS tick FROM labels WHERE doc_id % 11 <> 0), s AS (SELECT *, CASE WHEN said = 'WEIRD' THEN 'NEEDS_REVIEW' ELSE said END AS st FROM x)
SELECT doc_id, 'quantity' AS field_id, CASE st WHEN 'NOT_APPLICABLE' THEN '—' WHEN 'KNOWN' THEN '12' WHEN 'NEEDS_REVIEW' THEN '12' END AS value, CASE WHEN st = 'NEEDS_REVIEW' THEN least(c, 0.7) ELSE c END AS confidence, st = 'NOT_APPLICABLE' AS dash, CASE WHEN st = 'ILLEGIBLE' THEN st END AS hint, CASE WHEN st = 'NOT_PROVIDED' THEN 'blank' ELSE '' END AS note FROM s WHERE a
UNION ALL SELECT doc_id, 'linenumber', NULL, 0.3, false, 'NEEDS_REVIEW', 'non renvoyé par le modèle' FROM s WHERE a UNION ALL SELECT doc_id, 'flag', tick::VARCHAR, CASE WHEN st = 'KNOWN' THEN c ELSE least(c, 0.6) END, false, NULL, '' FROM s WHERE NOT a""")
def model_answers(t: Tables) -> DataFrame:
    """Readings out of a model's answers: JSON in free text, with statuses and confidences that can't be taken as they are."""
    d = F.col("doc_id")
    said = F.element_at(F.array(*map(F.lit, SAID)), (d % 6 + 1).cast("int"))
    one = lambda v: F.struct(v.alias("value"), said.alias("status"), (d % 15 / 10.0).alias("confidence"))
    a = F.struct(one(F.lit("12")).alias("quantity"), one(F.lit("x")).alias("zzz"))
    c = F.struct(one(d % 3 == 0).alias("flag"))
    json = F.when(d % 2 == 0, F.when(d % 4 == 0, F.to_json(F.struct(a.alias("fields")))).otherwise(F.to_json(a))).otherwise(F.when(d % 4 == 1, F.to_json(F.struct(c.alias("fields")))).otherwise(F.to_json(c)))
    text = F.when(d % 11 == 0, "désolé").otherwise(F.concat(F.lit("Voici :\n"), json, F.lit("\nfin.")))
    texts = t.labels.select("doc_id", F.when(d % 2 == 0, "a").otherwise("c").alias("page"), text.alias("text"))
    return P.answers(texts, P.spec_table(t.spark, SPECS), "doc_id")


@query(f"""{VALUES_SQL} SELECT r::VARCHAR AS record_id, CASE WHEN r % 2 = 0 THEN strftime(lmp, '%Y-%m-%d') END AS lmp, CASE WHEN r % 2 = 0 THEN strftime(edd, '%Y-%m-%d') END AS edd, CASE WHEN r % 2 = 0 THEN gravidity::DOUBLE::VARCHAR END AS gravidity FROM x""")
def profile_projection(t: Tables) -> DataFrame:
    """The fields that identify a person, where they are known."""
    values = ruled_values(t).withColumn("value", F.coalesce("value_str", F.col("value_num").cast("string")))
    return P.profile(values, ("lmp", "edd", "gravidity"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE o_orderstatus END AS v, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS ts FROM orders")
def idempotent_delivery(t: Tables) -> DataFrame:
    """Two batches delivered, the second one twice and with an older row of each key: the table is that of one delivery."""
    from ..streaming.lifecycle import upsert_sink, upserted

    at = files.shared_folder(t.spark)
    write = upsert_sink(at, ["k"], "ts")
    first = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.lit(1).alias("ts"))
    some = first.where("k % 3 = 0")
    second = some.withColumn("v", F.lit("again")).withColumn("ts", F.lit(2)).unionByName(some.withColumn("v", F.lit("old")).withColumn("ts", F.lit(0)))
    for batch_id, batch in ((0, first), (1, second), (1, second)):
        write(batch, batch_id)
    return upserted(t.spark, at, ["k"], "ts")
