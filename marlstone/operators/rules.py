"""Cross-field consistency rules over long field values.

values: record_id, field_id, value_str, value_num, value_bool, status,
confidence, source, note. Every rule reads one snapshot of a record (a map of its
few hundred fields) and names fields to flag, to boost or to mark as not
applicable. Rules name different fields, so one pass in any order is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .status import ABSENT, KNOWN, NA, OUTSIDE, REVIEW

# Visits in order, exclusive tick groups, what a false tick makes not applicable, and the notes of findings().
VISITS = ("t1v1", "t1v2", "t1v3", "t2v1", "t2v2", "t2v3", "m7", "m8", "m9")
EXCLUSIVE = (
    ("nb_alive", "nb_stillborn", "nb_death24"),
    ("bg_a", "bg_b", "bg_o", "bg_ab"),
    ("rh_neg", "rh_pos"),
    ("nbe_bf_exclusive", "nbe_bf_artificial", "nbe_bf_mixed"),
    ("nbl_bf_exclusive", "nbl_bf_artificial", "nbl_bf_mixed"),
)
NEEDS = (
    ("cs_indication", ("mode_cs_planned", "mode_cs_emergency"), "pas de césarienne"),
    ("dc_other_text", ("del_complications",), "pas de complication"),
    ("pme_scar", ("pme_cesarean",), "pas de césarienne"),
    ("pml_scar", ("pml_cesarean",), "pas de césarienne"),
)
READ = ("ai", "ai_ensemble")
FLAG, BOOST, MARK = "flag", "boost", "na"


def field_map(entries: str | Column) -> Column:
    """An array of (field_id, own) as a map, with the largest entry of each field."""
    ordered = F.reverse(F.array_sort(entries))
    first = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (F.get(ordered, i - 1)["field_id"] != x["field_id"]), x)), lambda x: x.isNotNull())
    return F.map_from_entries(first)


def used() -> list[str]:
    """The fields that rules look at."""
    pairs = [f"g_{row}_{v}" for row in ("visit_date", "ga") for v in VISITS]
    return ["lmp", "edd", "term_date", *pairs, "gravidity", "parity", "living_children", *(f for g in EXCLUSIVE for f in g), *sorted({s for _, switches, _ in NEEDS for s in switches})]


def findings(prefix: str = "") -> Column:
    """All (field, action, note) that the rules have to say about the columns of used(), whose names have the prefix."""
    at = lambda f: F.col(f"`{prefix}{f}`")
    day = lambda f: F.when(F.length(at(f)["text"]) == 10, at(f)["text"].try_cast("date"))
    whole = lambda f: F.when(at(f)["number"] == F.floor(at(f)["number"]), at(f)["number"])
    out: list[Column] = []

    def say(when: Column, field: str, action: str, note: Column | str) -> None:
        out.append(F.when(when, F.struct(F.lit(field).alias("field_id"), F.lit(action).alias("action"), (F.lit(note) if isinstance(note, str) else note).alias("why"))))

    def either(known: Column, good: Column, fields: dict[str, tuple[str, Column | str]]) -> None:
        for field, (yes, no) in fields.items():
            say(known & good, field, BOOST, yes)
            say(known & ~good, field, FLAG, no)

    lmp, edd, term = day("lmp"), day("edd"), day("term_date")
    clash = "DDR et DPA incohérentes (≠ 280 j)"
    either(lmp.isNotNull() & edd.isNotNull(), F.abs(F.datediff(edd, lmp) - 280) <= 3, {"lmp": ("cohérent avec la DPA", clash), "edd": ("cohérent avec la DDR", clash)})
    either(edd.isNotNull() & term.isNotNull(), F.abs(F.datediff(term, edd) - 7) <= 1, {"term_date": ("DPA + 7 j", "date de dépassement ≠ DPA + 7 j")})
    for visit in VISITS:
        date, weeks = f"g_visit_date_{visit}", f"g_ga_{visit}"
        expected = F.datediff(day(date), lmp) / 7
        late = F.concat(F.lit("âge gestationnel incohérent avec la date ("), F.bround(expected).cast("int").cast("string"), F.lit(" SA attendues)"))
        known = lmp.isNotNull() & day(date).isNotNull() & whole(weeks).isNotNull()
        either(known, F.abs(expected - whole(weeks)) <= 1.5, {date: ("cohérent avec DDR + âge gestationnel", "date incohérente avec l'âge gestationnel"), weeks: ("cohérent avec la date de visite", late)})
    more = whole("parity") > whole("gravidity")
    say(more, "parity", FLAG, "parité > gestité")
    say(more, "gravidity", FLAG, "parité > gestité")
    say(whole("living_children") > whole("parity") + 1, "living_children", FLAG, "enfants vivants > parité")
    for group in EXCLUSIVE:
        ticked = sum((F.when(at(f)["tick"], 1).otherwise(0) for f in group), F.lit(0))
        for f in group:
            say((ticked > 1) & at(f)["tick"], f, FLAG, "plusieurs cases cochées dans un groupe exclusif")
    for field, switches, why in NEEDS:
        off = F.lit(True)
        for s in switches:
            off &= F.coalesce(~at(s)["tick"], F.lit(False))
        say(off, field, MARK, why)
    return F.array_compact(F.array(*out))


def consistent(values: DataFrame) -> DataFrame:
    """The values with status, confidence and note as the rules leave them.

    A record's rows come together once and take what was said from the same row,
    so nothing is joined: a table of all that was said has no bound, and its size
    before it is there would be guessed from the input's.
    """
    rest = [c for c in values.columns if c != "record_id"]
    record = F.col("record_id").isNotNull()
    own = lambda x: F.struct(x["value_str"].alias("text"), x["value_num"].alias("number"), x["value_bool"].alias("tick"))
    listed = values.where(record).groupBy("record_id").agg(F.collect_list(F.struct(*rest)).alias("rows"))
    entries = F.transform(F.filter("rows", lambda x: x["field_id"].isNotNull()), lambda x: F.struct(x["field_id"], own(x).alias("own")))
    snapshot = listed.select("record_id", "rows", field_map(entries).alias("v"))  # of several rows of a field the largest counts
    fields = snapshot.select("record_id", "rows", *(F.col("v")[f].alias(f"at {f}") for f in used()))
    found = fields.select("record_id", "rows", F.inline(F.array(F.struct(findings("at ").alias("said")))))  # a generator keeps the optimizer from looking fields up anew for each use
    each = found.select("record_id", F.inline("rows"), "said")
    of = lambda name: F.array_max(F.transform(F.filter("said", lambda s: s["field_id"] == F.col("field_id")), lambda s: s[name])).alias(name)
    j = each.select("record_id", *rest, of("action"), of("why"))
    nothing = F.lit(None).cast("string")
    j = j.unionByName(values.where(~record).select("*", nothing.alias("action"), nothing.alias("why")))  # a row without a record or field has nothing said
    read = F.col("source").isin(*READ)
    note = F.coalesce("note", F.lit(""))
    filled = F.coalesce(F.col("value_str"), F.col("value_num").cast("string"), F.col("value_bool").cast("string")).isNotNull()
    flag = F.coalesce((F.col("action") == FLAG) & (F.col("status") == KNOWN) & read, F.lit(False))
    boost = F.coalesce((F.col("action") == BOOST) & (F.col("status") == REVIEW) & filled & read & ~note.contains(OUTSIDE), F.lit(False))
    mark = F.coalesce((F.col("action") == MARK) & (F.col("status") == ABSENT), F.lit(False))
    longer = F.when(note != "", F.concat(note, F.lit("; "), F.col("why"))).otherwise(F.col("why"))
    changed = {
        "status": F.when(flag, REVIEW).when(boost, KNOWN).when(mark, NA).otherwise(F.col("status")),
        "confidence": F.when(flag, F.least("confidence", F.lit(0.5))).when(boost, F.greatest("confidence", F.lit(0.93))).otherwise(F.col("confidence")),
        "note": F.when(flag | boost, longer).when(mark, F.col("why")).otherwise(F.col("note")),
    }
    return j.select(*(changed.get(c, F.col(c)).alias(c) for c in values.columns))
