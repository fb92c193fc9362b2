"""Long field values to the wide analytic row, in one aggregation for each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import VISITS, field_map
from .status import ABSENT, KNOWN


def first_of(columns: list[Column]) -> Column:
    return F.coalesce(*columns)


def wide(values: DataFrame) -> DataFrame:
    """values(record_id, field_id, value_str, value_num, value_bool, status, valid) -> one row for each record.

    Only known values that pass their field's check count; all else is null.
    Abortions count as 0 where gravidity is known and the field was left blank,
    as they always have in this table. Two columns have no source and stay null.
    """
    trusted = (F.col("status") == KNOWN) & F.coalesce("valid", F.lit(True))
    m = values.groupBy("record_id").agg(
        F.collect_list(F.when(trusted & F.col("field_id").isNotNull(), F.struct("field_id", F.struct(F.col("value_str").alias("text"), F.col("value_num").alias("number"), F.col("value_bool").alias("tick")).alias("own")))).alias("xs"),
        F.max(F.when(F.col("field_id") == "ob_abortion_n", F.col("status"))).alias("abortion_status"),
    )
    m = m.withColumn("v", field_map("xs"))
    at = lambda f: F.col("v")[f]
    text = lambda f: F.lower(F.nullif(at(f)["text"], F.lit("")))
    num, tick = (lambda f: at(f)["number"]), (lambda f: at(f)["tick"])
    visit = lambda row, part: [at(f"g_{row}_{v}")[part] for v in VISITS]
    has = lambda c, *words: F.coalesce(F.greatest(*(c.contains(w).cast("int") for w in words)) if len(words) > 1 else c.contains(words[0]).cast("int"), F.lit(0)) == 1
    whole = lambda c: c.cast("int")
    lab = lambda c: F.when(c == "positif", 1).when(c.isNotNull() & (c != "non fait"), 0)
    edu, med, sex = text("education"), text("hx_medical"), F.upper(at("nb_sex")["text"])
    modes = F.array_compact(F.array(*(text(f"pd{k}_mode") for k in range(1, 6))))
    weight, height = first_of(visit("weight", "number")), num("height_cm")
    pressures = F.filter(F.array_compact(F.array(*visit("bp", "text"))), lambda b: b.rlike(r"^\d{2,3}/\d{2,3}$"))
    mean = lambda i: F.round(F.aggregate(pressures, F.lit(0.0), lambda s, b: s + F.split(b, "/")[i].cast("double")) / F.size(pressures), 1)
    albumin = F.filter(F.array_compact(F.array(*visit("albuminuria", "text"))), lambda a: a.isin("positif", "négatif"))
    glucose = first_of(visit("glycemia", "number"))
    some = lambda *fs: F.greatest(*(F.coalesce(tick(f), F.lit(False)) for f in fs))
    any_known = lambda *fs: F.coalesce(*(tick(f) for f in fs)).isNotNull()
    caesarean, vaginal = some("mode_cs_planned", "mode_cs_emergency"), some("mode_vaginal", "mode_instrumental")
    gravidity, abortions = num("gravidity"), num("ob_abortion_n")
    columns = {
        "age": num("age"),
        "education": F.when(has(edu, "sup", "univ"), 2).when(has(edu, "coll", "lyc", "second"), 1).when(edu.isNotNull(), 0),
        "consanguinity": whole(tick("consanguinity")), "desired_pregnancy": whole(tick("desired_pregnancy")),
        "hypertension": F.when(has(med, "hta", "hypert"), 1).when(med.isNotNull(), 0), "diabetes": F.when(has(med, "diab"), 1).when(med.isNotNull(), 0),
        "gravidity": gravidity, "parity": num("parity"),
        "abortions": F.coalesce(abortions, F.when(gravidity.isNotNull() & (F.col("abortion_status") == ABSENT), 0.0)),
        "living_children": num("living_children"),
        "previous_cesarean": F.when(F.size(modes) > 0, whole(F.exists(modes, lambda x: x.contains("c") & x.contains("sar")))),
        "bmi": F.when((weight > 0) & (height > 0), F.round(weight / F.pow(height / 100, F.lit(2)), 2)),
        "mean_sbp": F.when(F.size(pressures) > 0, mean(0)), "mean_dbp": F.when(F.size(pressures) > 0, mean(1)),
        "hemoglobin": first_of(visit("hb", "number")), "glucose": F.when(glucose != 0, F.round(glucose * 100, 1)),
        "proteinuria": F.when(F.size(albumin) > 0, whole(F.array_contains(albumin, "positif"))),
        "hiv": lab(first_of(visit("hiv", "text"))), "syphilis": lab(first_of(visit("syphilis", "text"))), "hepatitis_c": F.lit(None).cast("int"),
        "ga_enrollment": first_of(visit("ga", "number")), "gestational_dm": F.lit(None).cast("int"),
        "ga_birth": num("nb_ga"), "preterm": whole(num("nb_ga") < 37),
        "delivery": F.when(caesarean | vaginal, whole(caesarean)),
        "sex": F.when(sex.startswith("M"), 1).when(sex.startswith("F"), 0),
        "birth_weight": num("nb_weight"), "head_circumference": num("nb_hc"),
        "breastfeeding": F.when(any_known("nbe_bf_exclusive", "nbe_bf_mixed", "nbe_bf_artificial"), whole(some("nbe_bf_exclusive", "nbe_bf_mixed"))),
        "referral": F.when(any_known("nbe_transfer", "nbl_transfer", "pme_fp_referred"), whole(some("nbe_transfer", "nbl_transfer", "pme_fp_referred"))),
    }
    return m.select("record_id", *(c.alias(n) for n, c in columns.items()))
