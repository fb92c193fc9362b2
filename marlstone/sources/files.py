"""CSV, JSON and journal sources, and the sinks beside them. Schemas are explicit; blanks are null."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Roles that may export.
EXPORTERS = ("supervisor", "analyst")
WEBHOOK = "entry array<struct<changes:array<struct<value:struct<messages:array<struct<`from`:string,type:string,text:struct<body:string>,interactive:struct<button_reply:struct<id:string,title:string>,list_reply:struct<id:string,title:string>>,image:struct<id:string>>>>>>>>"


def read_registry(spark: SparkSession, path: str, id_column: str = "id", prefix: str = "H") -> DataFrame:
    """A CSV with a header, all columns as text, blanks null; the id becomes key, with a prefix."""
    df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', encoding="UTF-8", nullValue="", emptyValue="")
    rest = [F.col(f"`{c}`") for c in df.columns if c != id_column]
    return df.select(F.concat(F.lit(prefix), F.col(f"`{id_column}`")).alias("key"), *rest)


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A table, or no rows where it isn't there yet."""
    try:
        return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def webhook_messages(payloads: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """(sender, kind, value) and the columns to keep: every message of webhook documents, typed by what it holds; other kinds are dropped."""
    keep = keep or []
    parsed = payloads.select(*keep, F.from_json(payload, WEBHOOK).alias("p"))
    messages = parsed.select(*keep, F.explode("p.entry").alias("e")).select(*keep, F.explode("e.changes").alias("c")).select(*keep, F.explode("c.value.messages").alias("m"))
    reply = F.coalesce("m.interactive.button_reply.id", "m.interactive.list_reply.id")
    kind = F.when(F.col("m.type") == "text", "text").when(F.col("m.type") == "interactive", "button").when(F.col("m.type") == "image", "photo")
    value = F.when(kind == "text", F.col("m.text.body")).when(kind == "button", reply).when(kind == "photo", F.col("m.image.id"))
    return messages.select(*keep, F.col("m.from").alias("sender"), kind.alias("kind"), value.alias("value")).where("kind is not null")


def outgoing(message: Column, buttons: Column) -> Column:
    """Shape of a message: up to 3 buttons as buttons, up to 10 as a list, more as the first nine and a menu; texts are clipped."""
    n = F.coalesce(F.size(buttons), F.lit(0))
    clip = lambda c, k: F.when(F.length(c) > k, F.concat(F.substring(c, 1, k - 1), F.lit("…"))).otherwise(c)
    shown = F.when(n > 10, F.concat(F.slice(buttons, 1, 9), F.array(F.lit("Menu")))).otherwise(buttons)
    shape = F.when(n == 0, "text").when(n <= 3, "button").otherwise("list")
    size = F.when(n <= 3, 20).otherwise(24)
    titles = F.transform(shown, lambda b: F.substring(b, F.lit(1), size))
    return F.struct(shape.alias("shape"), F.when(n == 0, clip(message, 4096)).otherwise(clip(message, 1024)).alias("text"), titles.alias("titles"))


def export(df: DataFrame, path: str, role: str) -> bool:
    """CSV with a header, for roles that may; says whether it was granted."""
    if role not in EXPORTERS:
        return False
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    return True


def since(df: DataFrame, sequence: str, last: int) -> DataFrame:
    """What came after an offset, in order; the filter reaches the scan."""
    return df.where(F.col(sequence) > last).orderBy(sequence)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that isn't set and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marlstone-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
