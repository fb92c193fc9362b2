"""The dimension of field specifications, and what hangs on it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalise import fold, strip_accents
from .status import ABSENT, ILLEGIBLE, KNOWN, NA, REVIEW, UNKNOWN_STATUS

RULE = "rule"
NO_PAGE = "page non photographiée"
CONFIRMED = "midwife_confirmed"
# Fields of the cover that are always asked; rules from field names to word lists, the first that holds;
# bounds of an image's metrics; what a model's answer is worth when it says so itself, or says nothing.
COVER = ("fiche_number", "region", "province", "facility")
LEXICONS = (
    ("is", "education", "education"), ("is", "profession", "profession"), ("is", "husband_profession", "husband_profession"), ("is", "region", "region"),
    ("starts", "fh_", "family"), ("starts", "hx_", "hx"), ("ends", "_mode", "delivery_mode"), ("ends", "cs_indication", "cs_indication"), ("has", "complication", "complication"),
    ("starts", "g_conjunctiva", "conjunctiva"), ("starts", "g_breasts", "breasts"), ("starts", "g_cervix", "cervix"), ("starts", "g_presentation", "presentation"),
    ("starts", "g_skeleton", "exam"), ("starts", "g_speculum", "exam"), ("starts", "g_pelvis", "exam"), ("around", "ob_ _place", "place"), ("ends", "_scar", "scar"),
    ("ends", "decision", "decision"), ("is", "nb_anomaly", "nb_anomaly"), ("is", "nb_sex", "sex"), ("is", "cervical_screening", "screening"),
)
SHARP, DARK, BRIGHT, CONTRAST, PIXELS = 60, 60, 235, 25, 900
CHECK_CAP, VALUE_CAP, ABSENT_CONFIDENCE, UNSAID = 0.6, 0.7, 0.3, 0.5
CHECKBOX = "checkbox (true if ticked/crossed/hatched, else false)"
NOT_RETURNED = "non renvoyé par le modèle"
STATUSES = (KNOWN, UNKNOWN_STATUS, ABSENT, ILLEGIBLE, NA, REVIEW)


class Spec(NamedTuple):
    field_id: str
    kind: str
    type: str
    importance: int
    low: float | None
    high: float | None
    page: str


SCHEMA = "field_id string, kind string, type string, importance int, low double, high double, page string"


def spec_table(spark: SparkSession, specs: tuple[Spec, ...]) -> DataFrame:
    return spark.createDataFrame(list(specs), SCHEMA)


def with_spec(values: DataFrame, specs: DataFrame) -> DataFrame:
    """Values with their field's specification; null where the field isn't in the catalogue, whose size is fixed."""
    return values.join(F.broadcast(specs), "field_id", "left")


def every_field(records: DataFrame, specs: DataFrame) -> DataFrame:
    """(record_id, specification): a row for each record and field of the catalogue, without a join of all rows."""
    listed = F.broadcast(specs.agg(F.collect_list(F.struct(*specs.columns)).alias("specs")).withColumn("one", F.lit(1)))
    return records.select("record_id", F.lit(1).alias("one")).join(listed, "one").select("record_id", F.inline("specs"))


def missing_pages(records: DataFrame, pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Values by rule for the fields of all pages that a record doesn't have: pages(record_id, page)."""
    return every_field(records, specs).join(pages.select("record_id", "page"), ["record_id", "page"], "left_anti").select("record_id", "field_id", F.lit(ABSENT).alias("status"), F.lit(1.0).alias("confidence"), F.lit(RULE).alias("source"), F.lit(NO_PAGE).alias("note"))


def all_fields(records: DataFrame, values: DataFrame, specs: DataFrame) -> DataFrame:
    """Every field of the catalogue for every record: its value, or the default of one that nothing resolved."""
    j = every_field(records, specs).select("record_id", "field_id").join(values.select("record_id", "field_id", "value", "status"), ["record_id", "field_id"], "left")
    return j.withColumn("status", F.coalesce("status", F.lit(ABSENT)))


def trusted(kind: Column, value: Column, status: Column, valid: Column) -> Column:
    """A value that may be counted: known and, unless a tick, passing its field's check."""
    return F.when((status == KNOWN) & ((kind == "bool") | valid), value)


def confirmed(value: Column, status: Column, valid: Column) -> Column:
    """struct(status, source, refused) when a person confirms a reading; what is illegible or fails its field's check must be typed instead."""
    refused = (status == ILLEGIBLE) | (value.isNotNull() & ~F.coalesce(valid, F.lit(False)))
    return F.struct(F.when(refused, status).when(value.isNull(), ABSENT).otherwise(KNOWN).alias("status"), F.when(~refused, CONFIRMED).alias("source"), refused.alias("refused"))


def find_field(query: Column, fields: tuple[tuple[str, ...], ...]) -> Column:
    """The field that a text means: its id or a label of it, else the nearest of all within a fifth of the text's length, two edits at least.

    fields: (id, labels...) in order; of equally near ones the first counts.
    """
    key = fold_label(query)
    ids = F.coalesce(*(F.when(F.trim(query) == f[0], f[0]) for f in fields))
    named = [(f[0], fold_label(F.replace(F.lit(x), F.lit("—"), F.lit("")))) for f in fields for x in (*f[1:], f[0])]
    exact = F.coalesce(*(F.when(key == x, i) for i, x in named))
    best = F.array_min(F.array(*(F.struct(F.levenshtein(key, x).alias("d"), F.lit(k).alias("k"), F.lit(i).alias("id")) for k, (i, x) in enumerate(named))))
    near = F.when(best["d"] <= F.greatest(F.lit(2), F.floor(F.length(key) / 5).cast("int")), best["id"])
    return F.coalesce(ids, exact, near)


def fold_label(c: Column) -> Column:
    return F.replace(strip_accents(F.lower(c)), F.lit(" "), F.lit(""))


LOST = "\ufffd"


def matches(kind: Column, got: Column, expected: Column) -> Column:
    """Whether a reading is right: nothing where nothing was, the same tick, a number within 1e-6, a text or code by its folded key, all else in any case."""
    numeric = kind.isin("int", "float", "ga")
    lost = F.concat(F.lit(r"^\Q"), F.replace(fold(expected), F.lit(LOST), F.lit(r"\E.?\Q")), F.lit(r"\E$"))  # a glyph that wasn't rendered stands for one or none
    a, b = (c.try_cast("double") for c in (got, expected))
    return (
        F.when(expected.isNull(), got.isNull()).when(got.isNull(), False)
        .when(kind == "bool", F.coalesce(got.try_cast("boolean") == (b != 0), F.lit(False)))
        .when(numeric, F.coalesce(F.abs(a - b) < 1e-6, F.lit(False)))
        .when(kind.isin("text", "code") & ~expected.contains(LOST), fold(got) == fold(expected)).when(expected.contains(LOST), F.regexp_like(fold(got), lost)).otherwise(F.lower(got) == F.lower(expected))
    )


def manual(page: Column, field_id: Column, importance: Column) -> Column:
    """Whether a field outside the grid is asked for when a page is typed in."""
    return ~field_id.startswith("g_") & ((importance >= 2) | ((page == "cover") & field_id.isin(*COVER)))


def lexicon_of(field_id: Column) -> Column:
    """The name of a field's word list, by the first rule that holds; common for all others."""
    out = None
    for how, text, name in LEXICONS:
        if how == "around":
            first, last = text.split(" ")
            when = field_id.startswith(first) & field_id.endswith(last)
        else:
            when = {"is": field_id == text, "starts": field_id.startswith(text), "ends": field_id.endswith(text), "has": field_id.contains(text)}[how]
        out = F.when(when, name) if out is None else out.when(when, name)
    return out.otherwise("common")


def image_issues(sharpness: Column, brightness: Column, contrast: Column, pixels: Column) -> Column:
    """What is wrong with a captured image, by its metrics; empty if nothing is."""
    found = [F.when(sharpness < SHARP, "blur"), F.when(brightness < DARK, "dark"), F.when(brightness > BRIGHT, "overexposed"), F.when(contrast < CONTRAST, "low_contrast"), F.when(pixels < PIXELS, "low_resolution")]
    return F.array_compact(F.array(*found))


def page_schemas(specs: DataFrame) -> DataFrame:
    """(page, schema): a line for each field of a page in order of place: id, label and type. specs also has place and label."""
    line = F.concat_ws(" | ", "field_id", "label", F.when(F.col("kind").isin("check", "checkrow"), CHECKBOX).otherwise(F.col("type")))
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return specs.groupBy("page").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("schema"))


def answers(texts: DataFrame, specs: DataFrame, record: str) -> DataFrame:
    """texts(record, page, text) of a model -> a reading for each field of the page, whether the model gave it or not.

    The text's first brace to its last is its JSON, with the fields inside or
    under fields; other names are dropped, and a text without JSON gives nothing.
    An unknown status goes to review; confidence is held between 0 and 1, and what
    the model itself doubts is capped.
    """
    one = "struct<value:string,status:string,confidence:double>"
    json = F.nullif(F.regexp_extract("text", r"(?s)\{.*\}", 0), F.lit(""))
    parsed = texts.select(record, "page", json.alias("json")).where("json is not null").withColumn("inner", F.from_json("json", f"fields map<string,{one}>")["fields"]).withColumn("found", F.coalesce("inner", F.from_json("json", f"map<string,{one}>"))).where("found is not null")
    j = parsed.join(F.broadcast(specs), "page").withColumn("f", F.try_element_at("found", F.col("field_id")))
    status = F.upper(F.coalesce("f.status", F.lit(REVIEW)))
    j = j.withColumn("st", F.when(status.isin(*STATUSES), status).otherwise(REVIEW)).withColumn("c", F.least(F.greatest(F.coalesce("f.confidence", F.lit(UNSAID)), F.lit(0.0)), F.lit(1.0)))
    there, check, st = F.col("f").isNotNull(), F.col("kind").isin("check", "checkrow"), F.col("st")
    cap = lambda most: F.when(st == KNOWN, F.col("c")).otherwise(F.least("c", F.lit(most)))
    ticked = F.coalesce(~F.lower("f.value").isin("false", "0", ""), F.lit(False)).cast("string")
    value = F.when(check, ticked).when(st == NA, "—").when(~st.isin(ABSENT, ILLEGIBLE, UNKNOWN_STATUS), F.col("f.value"))
    confidence = F.when(check, cap(CHECK_CAP)).when(st.isin(NA, ABSENT, ILLEGIBLE, UNKNOWN_STATUS), F.col("c")).otherwise(cap(VALUE_CAP))
    hint = F.when(~there, REVIEW).when(~check & st.isin(ILLEGIBLE, UNKNOWN_STATUS), st)
    note = F.when(~there, NOT_RETURNED).when(~check & (st == ABSENT), "blank").otherwise("")
    return j.select(record, "field_id", F.when(there, value).alias("value"), F.when(there, confidence).otherwise(ABSENT_CONFIDENCE).alias("confidence"), (there & ~check & (st == NA)).alias("dash"), hint.alias("hint"), note.alias("note"))


def profile(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A column for each key: the field's known value; a row for each record that has a value at all."""
    known = F.when(F.col("status") == KNOWN, F.col("value"))
    return values.groupBy("record_id").agg(*(F.max(F.when(F.col("field_id") == k, known)).alias(k) for k in keys))
