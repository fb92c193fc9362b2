"""Secret scans over a ledger of content-addressed blobs, in SQL functions only.

Each version of a text is a blob, named by the SHA-256 of its bytes. A ledger
says which (blob, rule version) pairs have been scanned and what was found. A
run scans the pairs that the ledger doesn't have, once for each blob however
many paths hold it, and joins the findings back to all paths.

Blobs that the ledger has, or that several rows hold, set a bit of a bitmap of
fixed size, which is broadcast. A row without its bit is the only one of a new
blob and is scanned where it stands; only the others (and false alarms) move.

Matches come with their places: split() by a rule gives the text between its
matches and regexp_extract_all() the matches, so running sums of both lengths are
the spans, in code points.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bitmaps import bitmap, marked
from .common import materialise, shared_base
from .components import join_hot


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: Least length of group 1; a match with a shorter one is dropped, with all it covers.
    least: int = 0


# The base rules. A run of hex digits or of an access key's characters is matched
# as a whole, so a least length inside the pattern is the same as dropping shorter matches.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{3,100}@"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,rank:int,end:int>>"
LEDGER = f"blob binary, rule_version int, spans {SPAN}"
MASK = "[SECRET]"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's leftmost non-overlapping matches, as (start, rank, end)."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    least = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), F.length) if rule.least else F.transform(found, lambda _: F.lit(0))
    steps = F.arrays_zip(F.transform(F.split(text, rule.pattern), F.length).alias("gap"), F.transform(found, F.length).alias("size"), least.alias("least"))
    empty = F.array().cast(SPAN)

    def fold(done: Column, step: Column) -> Column:
        start = done["at"] + step["gap"]
        end = start + F.coalesce(step["size"], F.lit(0))
        own = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        good = step["size"].isNotNull() & (step["least"] >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.concat(done["spans"], own)).otherwise(done["spans"]).alias("spans"))

    folded = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")), fold, lambda done: done["spans"])
    return F.when(text.rlike(rule.pattern), folded).otherwise(empty)


def named(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs(blob, text) -> (blob, spans): each text's spans of all rules.

    The row number only makes the column one that the optimizer doesn't move: a
    filter on it would else go below the join with the unseen blobs, and all
    texts would be scanned there.
    """
    found = F.concat(*(spans_of(F.col("text"), r, i) for i, r in enumerate(rules)))
    return blobs.select("blob", F.when(F.monotonically_increasing_id() >= 0, found).alias("spans"))


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def version(rules: tuple[Rule, ...]) -> int:
    """The rules' version, which is another one with any change of them."""
    return int.from_bytes(hashlib.sha256(repr([tuple(r) for r in rules]).encode()).digest()[:4], "big") >> 1


def crowded(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The bitmap of blobs that several rows hold or that are known."""
    several = rows.groupBy("__blob").agg(F.count("*").alias("n")).where("n > 1").select("__blob")
    return bitmap(several.unionByName(known.select(F.col("blob").alias("__blob"))))


def findings(docs: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, all rows of docs with __blob and __spans, null where nothing was found).

    The new rows are (blob, rule_version, spans) of the pairs scanned now. Without
    keep_text, the text of rows that are scanned where they stand is dropped.
    """
    now = version(rules)
    if ledger is None:
        ledger = empty_ledger(docs.sparkSession)
    known = ledger.where(F.col("rule_version") == now)
    own = F.coalesce(F.col(text), F.lit(""))
    named = docs.withColumn("__blob", address(F.col(text)))
    rows = marked(named, F.col("__blob"), crowded(named.select("__blob"), known), "__maybe").withColumn("__alone", ~F.col("__maybe"))
    found = F.concat(*(spans_of(own, r, i) for i, r in enumerate(rules)))
    columns = [F.col(f"`{c}`") if keep_text or c != text else F.when(~F.col("__alone"), F.col(f"`{c}`")).alias(c) for c in docs.columns]
    first = materialise(rows.select(*columns, "__blob", "__alone", F.monotonically_increasing_id().alias("__row"), F.when(F.col("__alone"), found).alias("__spans")), "scanned")
    many = first.where("not __alone")
    one = many.groupBy("__blob").agg(F.min("__row").alias("__one"), F.count("*").alias("__n"))
    unseen = one.join(known.select(F.col("blob").alias("__blob")).distinct(), "__blob", "left_anti").select("__one")
    texts = many.select("__row", F.col("__blob").alias("blob"), own.alias("text")).join(unseen, F.col("__row") == F.col("__one"), "left_semi")
    fresh = materialise(scan(texts.select("blob", "text"), rules), "fresh")
    # a blob that two runs put down at once has two equal rows
    seen = known.select("blob", "spans").unionByName(fresh).where(F.size("spans") > 0).groupBy("blob").agg(F.max("spans").alias("__spans"))
    hits = one.join(seen.withColumnRenamed("blob", "__blob"), "__blob", "left").select("__blob", "__spans", "__n")
    back = join_hot(many.drop("__spans"), hits, ["__blob"], "__n", many.count())
    rows = first.where("__alone").unionByName(back.select(first.columns)).drop("__alone", "__row")
    new = first.where("__alone").select(F.col("__blob").alias("blob"), F.col("__spans").alias("spans")).unionByName(fresh)
    return new.select("blob", F.lit(now).alias("rule_version"), "spans"), rows


def report(paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, the hash of the base spans and all spans, for each row."""
    spans = F.coalesce(F.col("__spans"), F.array().cast(SPAN))
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    ranks = F.transform(spans, lambda s: s["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[: len(BASE)])]
    return paths.select("doc_id", *counts, F.sha2(named(base, rules).cast("binary"), 256).alias("base_sha256"), named(spans, rules).alias("spans"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    """A ledger without rows, made in the JVM: createDataFrame() would make it an RDD of Python's, with workers of a second kind that stay in each executor."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(LEDGER)))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path (Parquet), empty if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:
        return empty_ledger(spark)


def ledger_of(spark: SparkSession, place: str) -> str:
    """Where the ledger of a table's folder is kept, under the shared folder, from run to run."""
    return f"{shared_base(spark)}/secret_ledger/{hashlib.sha256(place.encode()).hexdigest()[:32]}"


def with_ledger(docs: DataFrame, ledger_path: str, text: str = "text", rules: tuple[Rule, ...] = RULES, keep_text: bool = False) -> DataFrame:
    """Scans what the ledger lacks, adds it there, and gives all rows of docs with __blob and __spans.

    A run that breaks off leaves the ledger as it was or with whole files of
    right findings; the next one scans what is missing.
    """
    new, rows = findings(docs, text, read_ledger(docs.sparkSession, ledger_path), rules, keep_text)
    new.write.mode("append").parquet(ledger_path)
    return rows


def secrets(docs: DataFrame, ledger_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document row; with a ledger_path, through that ledger.

    Null texts are empty and have no spans; texts of any length are scanned whole;
    a null id is carried through; repeated rows each give their own result; an
    empty table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return report(with_ledger(own, ledger_path) if ledger_path else findings(own)[1])


def redact(docs: DataFrame, ledger_path: str | None = None, text: str = "text") -> DataFrame:
    """The documents with each run of overlapping spans replaced by MASK; n_chars, if there, follows. Null texts stay null."""
    rows = with_ledger(docs, ledger_path, text, keep_text=True) if ledger_path else findings(docs, text, keep_text=True)[1]

    def fold(done: Column, span: Column) -> Column:
        before = F.substring(F.col(text), done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.when(span["start"] >= done["at"], F.concat(done["out"], before, F.lit(MASK))).otherwise(done["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(F.array_sort("__spans"), start, fold, lambda done: F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.length(text))))
    some = F.size("__spans") > 0
    out = rows.withColumn(text, F.when(some, masked).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the ledger of sf_dir: a second run over the same folder scans only what is new there."""
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), ledger_of(spark, sf_dir))


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    steps, kinds = [], []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        least = f"length(regexp_extract_all(t, '{pattern}', 1)[k])" if r.least else "0"
        steps.append(
            f"SELECT doc_id, rn, {i} AS rank, g.s::BIGINT AS s, g.e::BIGINT AS e FROM (SELECT doc_id, rn, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda k: "
            f"{{'s': coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0), "
            f"'e': coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0), 'w': {least}}}), lambda g: g.w >= {r.least})) AS g "
            f"FROM (SELECT doc_id, rn, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')))"
        )
        kinds.append(f"WHEN {i} THEN '{r.kind}'")
    name = f"CASE rank {' '.join(kinds)} END || ':' || s || ':' || e"
    base = len(BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    return (
        f"WITH d AS (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(steps)}) "
        f"SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({name}, ',' ORDER BY s, rank) FILTER (WHERE rank < {base}), '')) AS base_sha256, coalesce(string_agg({name}, ',' ORDER BY s, rank) FILTER (WHERE rank IS NOT NULL), '') AS spans "
        f"FROM d LEFT JOIN f USING (doc_id, rn) GROUP BY d.doc_id, d.rn"
    )
