from marlstone.operators.analytic import wide
from marlstone.operators.rules import consistent

VALUES = "record_id string, field_id string, value_str string, value_num double, value_bool boolean, status string, confidence double, source string, note string"


def ruled(spark, rows):
    return {(r.record_id, r.field_id): (r.status, r.confidence, r.note) for r in consistent(spark.createDataFrame(rows, VALUES)).collect()}


def test_rules(spark):
    text = lambda r, f, v, s="KNOWN", c=0.9, n="": (r, f, v, None, None, s, c, "ai", n)
    num = lambda r, f, v, s="KNOWN": (r, f, None, float(v), None, s, 0.9, "ai", "")
    tick = lambda r, f, v: (r, f, None, None, v, "KNOWN", 0.9, "ai", "")
    out = ruled(spark, [
        text("a", "lmp", "2025-01-01"), text("a", "edd", "2026-05-01"),
        text("b", "lmp", "2025-07-25", "NEEDS_REVIEW", 0.6), text("b", "edd", "2026-05-01"), text("b", "term_date", "2026-05-20"),
        text("b", "g_visit_date_m7", "2026-02-06"), num("b", "g_ga_m7", 28, "NEEDS_REVIEW"),
        text("c", "lmp", "2025-07-25", "NEEDS_REVIEW", 0.6, "hors plage"), text("c", "edd", "2026-05-01"),
        num("d", "gravidity", 2), num("d", "parity", 3), num("d", "living_children", 5),
        tick("e", "rh_neg", True), tick("e", "rh_pos", True), tick("e", "bg_a", True), tick("e", "del_complications", False),
        ("e", "dc_other_text", None, None, None, "NOT_PROVIDED", 1.0, "rule", ""),
        text("f", "lmp", "2024"), text("f", "edd", "2026-05-01"),
        ("g", "lmp", "2025-01-01", None, None, "KNOWN", 0.9, "midwife", ""), text("g", "edd", "2026-05-01"),
    ])
    status = {k: v[0] for k, v in out.items()}
    assert status["a", "lmp"] == status["a", "edd"] == "NEEDS_REVIEW" and out["a", "lmp"][1] == 0.5
    assert status["b", "lmp"] == "KNOWN" and out["b", "lmp"][1] == 0.93 and status["b", "term_date"] == "NEEDS_REVIEW"
    assert status["b", "g_ga_m7"] == "KNOWN" and status["b", "g_visit_date_m7"] == "KNOWN"
    assert status["c", "lmp"] == "NEEDS_REVIEW" and status["f", "lmp"] == "KNOWN" and status["g", "lmp"] == "KNOWN"
    assert [status["d", f] for f in ("gravidity", "parity", "living_children")] == ["NEEDS_REVIEW"] * 3
    assert status["e", "rh_neg"] == "NEEDS_REVIEW" and status["e", "bg_a"] == "KNOWN" and out["e", "dc_other_text"][::2] == ("NOT_APPLICABLE", "pas de complication")


def test_wide_row(spark):
    rows = [("a", "age", None, 27.0, None, "KNOWN", True), ("a", "education", "Supérieur", None, None, "KNOWN", True), ("a", "gravidity", None, 2.0, None, "KNOWN", True), ("a", "ob_abortion_n", None, None, None, "NOT_PROVIDED", None),
            ("a", "g_bp_t1v1", "120/80", None, None, "KNOWN", True), ("a", "g_bp_m7", "110/70", None, None, "KNOWN", True), ("a", "g_bp_m8", "990/10", None, None, "KNOWN", False), ("a", "g_weight_t1v2", None, 60.0, None, "KNOWN", True), ("a", "g_weight_m7", None, 70.0, None, "KNOWN", True),
            ("a", "height_cm", None, 160.0, None, "KNOWN", True), ("a", "g_hiv_t1v1", "négatif", None, None, "KNOWN", True), ("a", "nb_ga", None, 36.0, None, "KNOWN", True), ("a", "mode_cs_planned", None, None, True, "KNOWN", True), ("a", "g_glycemia_m7", None, 0.85, None, "KNOWN", True),
            ("a", "nbe_transfer", None, None, False, "KNOWN", True), ("a", "pd1_mode", "Césarienne / CESAR", None, None, "KNOWN", True), ("b", "age", None, 30.0, None, "NEEDS_REVIEW", True)]
    out = {r.record_id: r for r in wide(spark.createDataFrame(rows, "record_id string, field_id string, value_str string, value_num double, value_bool boolean, status string, valid boolean")).collect()}
    a = out["a"]
    assert (a.age, a.education, a.abortions, a.mean_sbp, a.mean_dbp, a.bmi, a.hiv, a.preterm, a.delivery, a.glucose, a.referral, a.previous_cesarean) == (27, 2, 0, 115.0, 75.0, 23.44, 0, 1, 1, 85.0, 0, 1)
    assert a.breastfeeding is None and a.syphilis is None and out["b"].age is None and len(a) == 31


def test_repeated_and_nameless_fields(spark):
    """Of two rows of a field the larger value counts; a row without a field takes no part."""
    rows = [("a", "gravidity", None, 2.0, None, "KNOWN", 0.9, "ai", ""), ("a", "gravidity", None, 1.0, None, "KNOWN", 0.9, "ai", ""), ("a", "parity", None, 3.0, None, "KNOWN", 0.9, "ai", ""), ("a", None, "x", None, None, "KNOWN", 0.9, "ai", "")]
    out = [(r.field_id, r.status) for r in consistent(spark.createDataFrame(rows, VALUES)).collect()]
    assert sorted(out, key=str) == [("gravidity", "NEEDS_REVIEW"), ("gravidity", "NEEDS_REVIEW"), ("parity", "NEEDS_REVIEW"), (None, "KNOWN")]
    kept = [("a", "age", None, 27.0, None, "KNOWN", True), ("a", "age", None, 31.0, None, "KNOWN", True), ("a", None, None, 5.0, None, "KNOWN", True)]
    assert [r.age for r in wide(spark.createDataFrame(kept, "record_id string, field_id string, value_str string, value_num double, value_bool boolean, status string, valid boolean")).collect()] == [31.0]


def test_rules_join_nothing(spark):
    """What was said of all records isn't sent to the driver, whatever the size that is guessed for it; rows without a record stay as they are."""
    rows = [(r, f, None, n, None, "KNOWN", 0.9, "ai", "") for r in ("a", "b", None) for f, n in (("gravidity", 2.0), ("parity", 3.0 if r != "b" else 1.0))]
    out = consistent(spark.createDataFrame(rows, VALUES))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
    assert sorted((str(r.record_id), r.field_id, r.status) for r in out.collect()) == [
        ("None", "gravidity", "KNOWN"), ("None", "parity", "KNOWN"), ("a", "gravidity", "NEEDS_REVIEW"), ("a", "parity", "NEEDS_REVIEW"), ("b", "gravidity", "KNOWN"), ("b", "parity", "KNOWN"),
    ]
