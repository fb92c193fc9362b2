"""Typed normalisation of dirty strings, as Column expressions.

Each norm_* returns struct(value, valid): what was read, and whether it may be
trusted. Nothing here leaves the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token sets, folded.
YES = ("oui", "o", "yes", "y", "x", "+", "نعم", "true", "vrai", "1")
NO = ("non", "n", "no", "لا", "false", "faux", "0")
UNKNOWN = ("inconnu", "inconnue", "?", "nsp", "ne sait pas", "unknown", "غير معروف")
NOT_APPLICABLE = ("/", "—", "-", "–", "na", "n/a", "nap", "sans objet", "s/o", "non applicable")
LAB = {
    "neg": "négatif", "negatif": "négatif", "negative": "négatif", "-": "négatif", "n": "négatif",
    "pos": "positif", "positif": "positif", "positive": "positif", "+": "positif",
    "immune": "immune", "immun": "immune", "nonimmune": "non immune", "nonimmun": "non immune",
    "nf": "non fait", "nonfait": "non fait", "notdone": "non fait",
}
PII = (r"\b0[5-7](?:[\s.-]?\d{2}){4}\b", r"\+212[\s\d.-]{8,}", r"\b[A-Z]{1,2}\d{5,7}\b")
MASK = "[masqué]"
NUMBER, ZERO, ONE = r"-?\d+(?:\.\d+)?", r"(?<=\d)[Oo]|[Oo](?=\d)", r"(?<=\d)[lI]|[lI](?=\d)"
CODE = r"^[A-Z0-9][A-Z0-9\-/]{3,20}$"
WEEKS = (4, 45)
YEARS = (1990, 2035)


def plain_letters() -> tuple[str, str]:
    """(characters, what stands for them) of those that compatibility decomposition turns into one character; combining marks at the end stand for nothing."""
    accented, plain = [], []
    for code in range(0xA0, 0x2200):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            accented.append(chr(code))
            plain.append(base)
    marks = [chr(code) for code in range(0x300, 0x2200) if unicodedata.combining(chr(code))]
    return "".join(accented + marks), "".join(plain)


ACCENTED, PLAIN = plain_letters()


def strip_accents(c: Column) -> Column:
    return F.translate(F.replace(F.replace(c, F.lit("œ"), F.lit("oe")), F.lit("Œ"), F.lit("OE")), ACCENTED, PLAIN)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    return strip_accents(F.lower(strip(c)))


def fold(c: Column) -> Column:
    """norm without spaces, quotes, hyphens, full stops and commas: a key for equality."""
    return F.translate(norm(c), " '-.,", "")


def result(value: Column, valid: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(valid, F.lit(False)).alias("valid"))


def number(c: Column) -> Column:
    """The first signed decimal of a text; O and l beside digits are read as 0 and 1."""
    dense = F.translate(c, ", ", ".")
    ones = F.regexp_replace(F.regexp_replace(dense, ZERO, "0"), ONE, "1")
    return F.regexp_extract(ones, NUMBER, 0).try_cast("double")


def between(c: Column, low: float | None, high: float | None) -> Column:
    inside = F.lit(True)
    if low is not None:
        inside &= c >= low
    if high is not None:
        inside &= c <= high
    return inside


def norm_int(c: Column, low: float | None = None, high: float | None = None) -> Column:
    n = number(c)
    whole = F.bround(n).cast("long")
    return result(whole, (F.abs(n - whole) <= 1e-6) & between(whole, low, high))


def norm_float(c: Column, low: float | None = None, high: float | None = None) -> Column:
    n = number(c)
    return result(n, between(n, low, high))


def norm_weeks(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Weeks, rounded half to even before any test of their range."""
    whole = F.bround(number(c)).cast("long")
    return result(whole, between(whole, *WEEKS) & between(whole, low, high))


def norm_bool(c: Column) -> Column:
    """Token sets first; else the nearer of oui and non within one edit, from two characters on."""
    key = F.regexp_replace(F.regexp_replace(norm(c), r"\s", ""), r"\.+$", "")
    close = F.length(key) >= 2
    value = F.when(key.isin(*YES), True).when(key.isin(*NO), False).when(close & (F.levenshtein(key, F.lit("oui"), 1) >= 0), True).when(close & (F.levenshtein(key, F.lit("non"), 1) >= 0), False)
    return result(value, value.isNotNull())


def norm_lab(c: Column) -> Column:
    """Dictionary first; else the first key of three characters or more within one edit."""
    key = F.regexp_replace(norm(c), r"[^a-z+-]", "")
    pairs = [x for k, v in LAB.items() for x in (F.lit(k), F.lit(v))]
    value = F.try_element_at(F.create_map(*pairs), key)
    near = [F.when(F.levenshtein(key, F.lit(k), 1) >= 0, F.lit(v)) for k, v in LAB.items() if len(k) >= 3]
    value = F.coalesce(value, *near)
    return result(value, value.isNotNull())


def norm_pressure(c: Column) -> Column:
    """sys/dia; a pair whose first value is under 30 is in centimetres of mercury."""
    dense = F.regexp_replace(c, r"\s", "")
    high, low = (F.regexp_extract(dense, r"(\d{2,3})[/\\\\|-](\d{1,3})", i).try_cast("long") for i in (1, 2))
    unit = F.when(high < 30, 10).otherwise(1)
    high, low = high * unit, low * unit
    value = F.when(high.isNotNull(), F.concat_ws("/", high.cast("string"), low.cast("string")))
    return result(value, high.between(60, 250) & low.between(30, 160) & (high > low))


def norm_code(c: Column) -> Column:
    key = F.upper(F.regexp_replace(c, r"\s", ""))
    return result(key, key.rlike(CODE))


def norm_date(c: Column) -> Column:
    """(value, valid, year_only): day first with one kind of separator, then ISO; a bare year has no date.

    Two-digit years, from 69 on of the last century, stand after slashes only.
    """
    key = F.translate(strip(c), "OolI ", "0011")
    day = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$"
    short = r"^(\d{1,2})/(\d{1,2})/(\d{2})$"
    part = lambda pattern, i: F.regexp_extract(key, pattern, i)
    y = part(short, 3)
    century = F.when(y >= "69", "19").otherwise("20")
    iso = F.when(key.rlike(day), F.concat_ws("-", part(day, 4), F.lpad(part(day, 3), 2, "0"), F.lpad(part(day, 1), 2, "0")))
    iso = iso.when(key.rlike(short), F.concat_ws("-", F.concat(century, y), F.lpad(part(short, 2), 2, "0"), F.lpad(part(short, 1), 2, "0")))
    iso = iso.when(key.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), key)
    date = iso.try_cast("date")
    date = F.when(F.year(date).between(*YEARS), date)
    year = F.when(date.isNull(), F.nullif(F.regexp_extract(key, r"^(?:19|20)\d\d$", 0), F.lit(""))).cast("int")
    return F.struct(F.coalesce(F.date_format(date, "yyyy-MM-dd"), year.cast("string")).alias("value"), (date.isNotNull() | year.isNotNull()).alias("valid"), year.alias("year_only"))


def scrub(c: Column, patterns: tuple[str, ...] = PII, mask: str = MASK) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, mask)
    return c


def clean_number(c: Column) -> Column:
    """A double, or null for blanks, NaN and what is no number."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def integers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), 0), lambda x: x.cast("int"))


def split_list(c: Column) -> Column:
    """Parts between semicolons or line feeds, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"[;\n]"), lambda x: F.trim(x)), lambda x: x != "")


def education(c: Column) -> Column:
    key = norm(c)
    return F.when(key.contains("sup") | key.contains("univ"), 2).when(key.contains("coll") | key.contains("lyc") | key.contains("second"), 1).when(key != "", 0)


def hmac_sha256(key: Column, message: Column) -> Column:
    """RFC 2104 out of sha2, for text keys of at most 64 bytes."""
    code = F.rpad(F.hex(key.cast("binary")), 128, "0")

    def pad(byte: int) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte))), 2, "0"))
        return F.unhex(F.array_join(pairs, ""))

    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def typed(kind: Column, c: Column, low: Column, high: Column) -> Column:
    """struct(value as text, valid) of a raw text by the type of its field; what can't be read stays as it stands."""
    s = strip(c)
    inside = lambda v: (low.isNull() | (v >= low)) & (high.isNull() | (v <= high))
    n, date, flag, lab, pressure, code = number(s), norm_date(s), norm_bool(s), norm_lab(s), norm_pressure(s), norm_code(s)
    whole = F.bround(n).cast("long")
    read = lambda x: F.coalesce(x["value"].cast("string"), s)
    exact = F.abs(n - whole) <= 1e-6
    value = (
        F.when(kind == "float", F.coalesce(n.cast("string"), s)).when(kind == "int", F.coalesce(F.when(exact, whole).cast("string"), s)).when(kind == "ga", F.coalesce(whole.cast("string"), s))
        .when(kind == "date", read(date)).when(kind == "bool", read(flag)).when(kind == "lab", read(lab)).when(kind == "bp", read(pressure)).when(kind == "code", read(code)).otherwise(F.regexp_replace(s, r"(?U)\s+", " "))
    )
    valid = (
        F.when(kind == "float", inside(n)).when(kind == "int", exact & inside(whole)).when(kind == "ga", between(whole, *WEEKS) & inside(whole))
        .when(kind == "date", date["valid"]).when(kind == "bool", flag["valid"]).when(kind == "lab", lab["valid"]).when(kind == "bp", pressure["valid"]).when(kind == "code", code["valid"]).otherwise(True)
    )
    return F.struct(F.when(s != "", value).alias("value"), F.coalesce(valid & (s != ""), F.lit(False)).alias("valid"))


def snap(c: Column, terms: tuple[str, ...]) -> Column:
    """struct(term, similarity): the only nearest term within a tolerance that follows the longer of both keys; an exact one always counts. Nulls without."""
    key = fold(c)
    near = F.array_sort(F.array(*(F.struct(F.levenshtein(key, fold(F.lit(t))).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("term")) for i, t in enumerate(terms))))
    best, second = near[0], F.get(near, F.lit(1))["d"]
    size = F.greatest(F.length(key), F.length(fold(best["term"])))
    tolerance = F.when(size <= 2, 0).when(size <= 5, 1).otherwise(F.greatest(F.lit(2), F.floor(size * 0.25).cast("int")))
    good = (key != "") & (best["d"] <= tolerance) & (second.isNull() | (second > best["d"]) | (best["d"] == 0))
    return F.struct(F.when(good, best["term"]).alias("term"), F.when(good, 1 - best["d"] / size).alias("similarity"))


def shown(kind: Column, value: Column, yes: str = "oui", no: str = "non") -> Column:
    """A value for people: ISO dates day first, ticks as words, a dash for none."""
    date = F.regexp_replace(value, r"^(\d{4})-(\d{2})-(\d{2})$", "$3/$2/$1")
    return F.when(value.isNull(), "—").when(kind == "bool", F.when(value == "true", yes).otherwise(no)).otherwise(date)


def percent(share: Column) -> Column:
    return F.bround(share * 100).cast("int")
