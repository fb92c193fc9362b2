import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from marlstone.functions import normalise as N


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r.x)[:2] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_examples(spark):
    assert values(spark, ["3587 g", "1O5", "2l", "none", None], N.norm_int) == [(3587, True), (105, True), (21, True), (None, False), (None, False)]
    assert values(spark, ["7", "12", "55", "56", "12,5"], lambda c: N.norm_int(c, 12, 55)) == [(7, False), (12, True), (55, True), (56, False), (12, False)]
    assert values(spark, ["38 SA", "3", "38,5", "45.4", "3.6", "45,6"], N.norm_weeks) == [(38, True), (3, False), (38, True), (45, True), (4, True), (46, False)]
    assert values(spark, ["12/8", "60/120", "120-80", "x"], N.norm_pressure) == [("120/80", True), ("60/120", False), ("120/80", True), (None, False)]
    assert values(spark, ["26/04/2025", "45/04/2025", "2-3-2025", "1.2.1995", "2025-04-26", "2023", "2O23", "01/01/1980", "26-04-25", "26.04.25", "26/04-2025", "26/4/25", " 2 /3/ 2025"], N.norm_date) == [("2025-04-26", True), (None, False), ("2025-03-02", True), ("1995-02-01", True), ("2025-04-26", True), ("2023", True), ("2023", True), (None, False), (None, False), (None, False), (None, False), ("2025-04-26", True), ("2025-03-02", True)]
    assert values(spark, ["Neg", "POSITIF.", "négatiff", "?"], N.norm_lab) == [("négatif", True), ("positif", True), ("négatif", True), (None, False)]
    assert values(spark, ["Oui", "non.", "ouii", "maybe", "n"], N.norm_bool) == [(True, True), (False, True), (True, True), (None, False), (False, True)]
    assert values(spark, ["2026-823-001", "ab", "a b12-3"], N.norm_code) == [("2026-823-001", True), ("AB", False), ("AB12-3", True)]


def test_scrubbing_and_folding(spark):
    df = spark.createDataFrame([("appeler 06 00 76 13 48 svp", "CIN CB609814", "L'Œuf-à la. Coque")], "a string, b string, c string")
    row = df.select(N.scrub(F.col("a")), N.scrub(F.col("b")), N.fold(F.col("c")), N.integers(F.lit("1, 22 et 3")), N.split_list(F.lit(" a ;;b\nc ")), N.clean_number(F.lit("NaN")), N.clean_number(F.lit(" 1.5 "))).first()
    assert tuple(row) == ("appeler [masqué] svp", "CIN [masqué]", "loeufalacoque", [1, 22, 3], ["a", "b", "c"], None, 1.5)


@pytest.mark.parametrize("key", ["k", "a longer key with spaces"])
def test_hmac(spark, key):
    got = spark.range(1).select(N.hmac_sha256(F.lit(key), F.lit("message é"))).first()[0]
    assert got == hmac.new(key.encode(), "message é".encode(), hashlib.sha256).hexdigest()


def test_letters_fold_as_decomposition_does(spark):
    import unicodedata

    letters = [chr(c) for c in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)) if chr(c) not in "œŒ" and len("".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1]
    text = "".join(letters) + "e\u0301"
    plain = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
    assert spark.createDataFrame([(text,)], "t string").select(N.strip_accents(F.col("t"))).first()[0] == plain(text)


def test_typed_values(spark):
    rows = [("int", " 12 ", 5.0, 20.0, "12", True), ("int", "12.5", None, None, "12.5", False), ("int", "99", 5.0, 20.0, "99", False), ("ga", "38 SA", None, None, "38", True), ("ga", "45.4", None, 44.0, "45", False), ("float", "1,5", None, 2.0, "1.5", True), ("date", "1/2/2025", None, None, "2025-02-01", True), ("date", "soon", None, None, "soon", False), ("bool", "Oui", None, None, "true", True), ("lab", "Neg", None, None, "négatif", True), ("bp", "12/8", None, None, "120/80", True), ("code", "a b1-2", None, None, "AB1-2", True), ("text", " a  b ", None, None, "a b", True), ("text", "  ", None, None, None, False), ("int", None, None, None, None, False)]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, kind string, t string, low double, high double")
    got = [tuple(r.x) for r in df.select("i", N.typed(F.col("kind"), F.col("t"), F.col("low"), F.col("high")).alias("x")).orderBy("i").collect()]
    assert got == [r[4:] for r in rows]
