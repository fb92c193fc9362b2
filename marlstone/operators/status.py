"""Status and confidence rules of field values.

A value is null for four different reasons, so status is a column of its own and
is never folded into the value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalise import NOT_APPLICABLE, UNKNOWN, fold, norm, scrub, snap, strip, typed

# Statuses, acceptance thresholds by importance, and the floor of blank and token readings.
KNOWN, REVIEW, UNKNOWN_STATUS, ABSENT, ILLEGIBLE, NA = "KNOWN", "NEEDS_REVIEW", "UNKNOWN", "NOT_PROVIDED", "ILLEGIBLE", "NOT_APPLICABLE"
THRESHOLDS: Mapping[int, float] = {1: 0.80, 2: 0.85, 3: 0.92}
FLOOR = 0.7
ENSEMBLE = "ai_ensemble"
OUTSIDE = "hors"


def threshold(importance: Column) -> Column:
    """Importance 0, and any other without an entry, takes 0.8."""
    out = F.lit(0.8)
    for level, value in THRESHOLDS.items():
        out = F.when(importance == level, value).otherwise(out)
    return out


def read_status(raw: Column, confidence: Column, valid: Column, importance: Column, hint: Column | None = None) -> Column:
    """The first that holds of: tick, hint, blank, dash or token, invalid, sure, else review."""
    key = norm(raw)
    sure = F.when(confidence >= FLOOR, F.lit(True)).otherwise(F.lit(False))
    out = F.when(hint.isNotNull(), hint) if hint is not None else F.when(F.lit(False), F.lit(None).cast("string"))
    return (
        out.when(raw.isNull() | (key == ""), F.when(sure, ABSENT).otherwise(REVIEW))
        .when(key.isin(*NOT_APPLICABLE), NA)
        .when(key.isin(*UNKNOWN), UNKNOWN_STATUS)
        .when(valid & (confidence >= threshold(importance)), KNOWN)
        .otherwise(REVIEW)
    )


# Shares of ink above which a box is ticked, and below which a region is blank.
TICK, BLANK = 0.07, 0.003


def ticked(ink: Column) -> Column:
    return ink > TICK


def blank(ink: Column) -> Column:
    return ink < BLANK


def tick_confidence(distance: Column) -> Column:
    return F.least(F.greatest(F.lit(0.5) + F.lit(0.5) * distance, F.lit(0.5)), F.lit(0.99))


def blank_confidence(ink: Column) -> Column:
    return F.least(F.greatest(F.lit(1.0) - ink / BLANK, F.lit(0.6)), F.lit(0.98))


def adjusted(confidence: Column, valid: Column, similarity: Column) -> Column:
    """Confidence after the lexicon: similarity null is a miss; invalid values are capped."""
    snapped = F.when(similarity.isNull(), F.least(confidence, F.lit(0.75))).when(similarity >= 0.8, F.greatest(confidence, F.lit(0.55) + F.lit(0.4) * similarity)).otherwise(confidence * (F.lit(0.6) + F.lit(0.4) * similarity))
    return F.when(valid, snapped).otherwise(F.least(snapped, F.lit(0.35)))


READING = ("kind", "type", "raw", "confidence", "dash", "hint", "note", "low", "high", "importance")


def readings(df: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """df with the columns of READING replaced by value, status, confidence and note: what each reading is, by its field's specification.

    The first that holds of: tick, hint, blank or illegible, dash, unknown token,
    token of not applicable, else the typed value; a text is snapped to the terms.
    """
    rest = [c for c in df.columns if c not in READING]
    c = F.col
    text = c("type") == "text"
    d = df.withColumn("s", strip(c("raw"))).withColumn("token", F.regexp_replace(F.lower("s"), r"^[ .]+|[ .]+$", "")).withColumn("read", typed(c("type"), c("s"), c("low"), c("high")))
    d = d.withColumn("near", F.when(text, snap(c("read.value"), terms)))
    conf = F.when(text, adjusted(c("confidence"), c("read.valid"), c("near.similarity"))).when(c("read.valid"), c("confidence")).otherwise(F.least(c("confidence"), F.lit(0.35)))
    own_note = F.when(text & (c("near.similarity") < 1), F.concat(F.lit("lu « "), c("read.value"), F.lit(" », rapproché de « "), c("near.term"), F.lit(" »"))).when(~c("read.valid"), "valeur hors format / hors plage").otherwise("")
    d = d.withColumn("conf", conf).withColumn("own_note", own_note)
    final = F.when(text, scrub(F.coalesce("near.term", "read.value"))).otherwise(c("read.value"))
    out = lambda v, s, conf, n: F.struct(v.cast("string").alias("value"), s.alias("status"), F.round(conf, 3).alias("confidence"), n.alias("note"))
    nothing, empty, given = F.lit(None).cast("string"), F.lit(""), c("confidence")
    by_floor = lambda good: F.when(given >= FLOOR, good).otherwise(REVIEW)
    result = (
        F.when(c("kind").isin("check", "checkrow"), out(c("raw") == "true", by_floor(KNOWN), given, empty))
        .when(c("hint").isin(ILLEGIBLE, UNKNOWN_STATUS, NA, ABSENT), out(nothing, c("hint"), given, c("note")))
        .when(c("raw").isNull() & (c("note") == "blank"), out(nothing, by_floor(ABSENT), given, F.lit("vide sur le papier")))
        .when(c("raw").isNull(), out(nothing, F.lit(ILLEGIBLE), F.lit(0.3), F.lit("encre présente mais illisible")))
        .when(c("dash"), out(nothing, F.lit(NA), given, F.lit("tiret sur le papier")))
        .when(c("token").isin(*UNKNOWN), out(nothing, F.lit(UNKNOWN_STATUS), F.greatest(given, F.lit(FLOOR)), F.lit("inconnu sur le papier")))
        .when(c("token").isin(*NOT_APPLICABLE), out(nothing, F.lit(NA), F.greatest(given, F.lit(FLOOR)), empty))
        .otherwise(out(final, F.when(c("read.valid") & (c("conf") >= threshold(c("importance"))), KNOWN).otherwise(REVIEW), c("conf"), c("own_note")))
    )
    return d.select(*rest, result.alias("result")).select(*rest, "result.*")


SIDE = ("value", "status", "confidence", "importance", "source", "note")


def fuse(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Two readers' values (SIDE, value as text) of the same fields, full outer: value, status, confidence, source, note, candidates.

    Agreement, with texts compared by their folded keys, adds up as independent
    evidence and makes a value known that is there and not out of range; against a
    sure local reading the remote one goes to review with both as candidates.
    """
    a, b = (d.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in SIDE)) for d, side in ((local, "l"), (remote, "r")))
    both = a.join(b, keys, "full_outer")
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))  # noqa: E741
    one = r("status").isNull() | l("status").isNull()
    open_ = lambda s: s.isin(KNOWN, REVIEW)
    same = ((l("status") == r("status")) | (open_(l("status")) & open_(r("status")))) & fold(l("value")).eqNullSafe(fold(r("value")))
    joint = F.round(F.greatest(r("confidence"), F.lit(1.0) - (F.lit(1.0) - r("confidence")) * (F.lit(1.0) - l("confidence"))), 3)
    promoted = same & (r("status") == REVIEW) & (joint >= threshold(r("importance"))) & r("value").isNotNull() & ~F.coalesce(r("note").contains(OUTSIDE), F.lit(False))
    contested = ~same & (l("confidence") >= 0.8) & (l("status") == KNOWN)
    differ = F.concat(F.lit("lectures divergentes : « "), F.coalesce(r("value"), F.lit("None")), F.lit(" » / « "), F.coalesce(l("value"), F.lit("None")), F.lit(" »"))
    pick = lambda c, **cases: F.when(one, F.when(r("status").isNull(), l(c)).otherwise(r(c))).when(promoted, cases.get("promoted", cases.get("same", r(c)))).when(same, cases.get("same", r(c))).when(contested, cases.get("contested", r(c))).otherwise(r(c)).alias(c)
    return both.select(
        *keys,
        pick("value"),
        pick("status", promoted=F.lit(KNOWN), contested=F.lit(REVIEW)),
        pick("confidence", same=joint, contested=F.least(r("confidence"), F.lit(0.55))),
        pick("source", same=F.lit(ENSEMBLE)),
        pick("note", promoted=F.lit("deux lectures concordantes"), contested=differ),
        F.when(~one & contested, F.array(r("value"), l("value"))).alias("candidates"),
    )


def flagged(status: Column, when: Column) -> Column:
    return F.when(when & (status == KNOWN), REVIEW).otherwise(status)


def boosted(status: Column, when: Column, note: Column) -> Column:
    return F.when(when & (status == REVIEW) & ~F.coalesce(note.contains(OUTSIDE), F.lit(False)), KNOWN).otherwise(status)


def exclusive(values: DataFrame, record: str, group: str, ticked: Column) -> DataFrame:
    """flag is true on each ticked value of a record's exclusive group that has more than one."""
    n = F.sum(F.when(ticked, 1).otherwise(0)).over(W.partitionBy(record, group))
    return values.withColumn("flag", ticked & (n > 1))
