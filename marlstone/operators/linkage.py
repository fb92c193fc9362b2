"""Record linkage: a scored fuzzy join with blocking that loses no candidate.

Points are whole numbers (hundredths), so that sums meet the threshold exactly.
A pair over the threshold shares a code within two edits, or enough else: its due
dates within ten days and with them age or period, or its periods, ages and
places. Each of the four makes blocking keys of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Points of each signal, in hundredths, and the acceptance rule.
CODE_SAME, CODE_ONE, CODE_TWO = 70, 35, 25
AGE_NEAR, AGE_FAR, PLACE = 10, -20, 8
DUE_NEAR, PERIOD_NEAR, DATE_FAR = 25, 20, -10
THRESHOLD, BEST = 35, 3
NEAR_DAYS, FAR_DAYS = 10, 60


def code_key(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit("-"), F.lit("")))


def date_points(a: Column, b: Column, near: int) -> Column:
    days = F.abs(F.datediff(a, b))
    return F.when(days <= NEAR_DAYS, near).when(days > FAR_DAYS, DATE_FAR).otherwise(0)


def points(left: str = "a", right: str = "b") -> Column:
    """Of two records (code, age, place, due, period)."""
    col = lambda name: (F.col(f"{left}.{name}"), F.col(f"{right}.{name}"))
    x, y = (code_key(c) for c in col("code"))
    edits = F.levenshtein(x, y, 2)
    there = (col("code")[0] != "") & (col("code")[1] != "")
    code = F.when(there & (x == y), CODE_SAME).when(there & (edits == 1), CODE_ONE).when(there & (edits == 2), CODE_TWO).otherwise(0)
    years = F.abs(col("age")[0] - col("age")[1])
    age = F.when(years <= 1, AGE_NEAR).when(years > 3, AGE_FAR).otherwise(0)
    place = F.when((col("place")[0] != "") & (F.lower(col("place")[0]) == F.lower(col("place")[1])), PLACE).otherwise(0)
    total = code + age + place + date_points(*col("due"), DUE_NEAR) + date_points(*col("period"), PERIOD_NEAR)
    return F.greatest(F.least(total, F.lit(100)), F.lit(0))


def deletions(key: Column) -> Column:
    """The key with up to two characters taken out, all ways: two keys within two edits share one."""
    drop = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(k), F.lit(1))), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))
    one = drop(key)
    return F.array_distinct(F.concat(F.array(key), one, F.flatten(F.transform(one, drop))))


def blocks(records: DataFrame, neighbours: bool) -> DataFrame:
    """(block, all columns): keys of a record; dates and ages take their cell, and for one side of the join those beside it."""
    reach = [-1, 0, 1] if neighbours else [0]
    day = lambda name: F.floor(F.unix_date(F.col(name)) / (NEAR_DAYS + 1))
    due, period, age = day("due"), day("period"), F.floor(F.col("age") / 2)
    text = lambda c, d: (c + d).cast("string")
    pairs = [(x, y) for x in reach for y in reach]
    keys = [F.concat(F.lit("due+age:"), text(due, x), F.lit(":"), text(age, y)) for x, y in pairs]
    keys += [F.concat(F.lit("due+period:"), text(due, x), F.lit(":"), text(period, y)) for x, y in pairs]
    keys += [F.concat(F.lit("period+age+place:"), text(period, x), F.lit(":"), text(age, y), F.lit(":"), F.lower("place")) for x, y in pairs]
    codes = F.when(F.col("code") != "", F.transform(deletions(code_key(F.col("code"))), lambda k: F.concat(F.lit("code:"), k)))
    every = F.concat(F.coalesce(codes, F.array().cast("array<string>")), F.array(*keys))
    return records.select(F.explode(F.array_distinct(F.filter(every, lambda k: k.isNotNull()))).alias("block"), "*")


#: What a pair's points hang on. Records alike in it are one class, with the smallest id as its name.
SIGNATURE = ("code", "age", "place", "due", "period")


def candidates(probes: DataFrame, known: DataFrame, best: int = BEST) -> DataFrame:
    """(probe, id, score, rank): for each probe the best known records at the threshold or over; ties go to the smaller id. Ids are unique.

    Pairs are made of classes, not of records. As all of a class have the same
    points and ties go by id, the best + 1 records of a probe's class are among the
    best + 1 smallest ids of its best + 1 classes, by points and smallest id; one
    more than best, as a probe may be among them and isn't its own candidate. A pair
    is scored where it meets, so none moves but the best of each task. The joins are
    merge joins by hint: what a size is guessed from doesn't count a record's keys.
    """
    most = best + 1
    signature = F.struct(*SIGNATURE)
    first = lambda df, key, *order: df.withColumn("place in order", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place in order") <= most).drop("place in order")
    own = first(known.where("id is not null").select(signature.alias("b"), "id"), "b", "id").groupBy("b").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = own.withColumn("k", F.get("ids", F.lit(0)))
    asking = probes.where("id is not null").select(signature.alias("a"), F.col("id").alias("probe"))
    askers = asking.groupBy("a").agg(F.min("probe").alias("p"))

    left = blocks(askers.select("a.*", "a", "p"), True).select("block", "a", "p")
    right = blocks(classes.select("b.*", "b", "k"), False).select("block", "b", "k")
    scored = left.join(right.hint("merge"), "block").select("p", "k", points().cast("long").alias("score")).where(F.col("score") >= THRESHOLD)
    # a pair meets in several blocks, and then holds one place in this order
    near = scored.withColumn("place in order", F.dense_rank().over(W.partitionBy("p").orderBy(F.desc("score"), "k"))).where(F.col("place in order") <= most).select("p", "k", "score").distinct()
    listed = near.join(classes.select("k", "ids").hint("merge"), "k").select("p", "score", F.explode("ids").alias("id"))
    top = first(listed, "p", F.desc("score"), "id").groupBy("p").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("top"))

    found = asking.join(askers.join(top.hint("merge"), "p").hint("merge"), "a")
    others = F.slice(F.filter("top", lambda x: x["id"] != F.col("probe")), 1, best)
    each = found.select("probe", F.posexplode(others).alias("at", "x"))
    return each.select("probe", "x.id", (-F.col("x.less")).alias("score"), (F.col("at") + 1).cast("long").alias("rank"))


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """class of each new value that is there: added (also where the old one is null), changed or same."""
    joined = new.select(key, F.col(value).alias("new")).where("new is not null").join(old.select(key, F.col(value).alias("old")), key, "left")
    return joined.withColumn("class", F.when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "changed").otherwise("same"))


def merge(old: DataFrame, new: DataFrame, key: str, value: str, accepted: Column) -> DataFrame:
    """Old fields, replaced where a new one is accepted; fields that never existed come from the new ones. An old null stays."""
    a = old.select(key, F.col(value).alias("old"), F.lit(True).alias("was"))
    b = new.select(key, F.col(value).alias("new"), F.lit(True).alias("is"))
    take = (accepted & F.col("is")) | F.col("was").isNull()
    return a.join(b, key, "full_outer").select(key, F.when(take, F.col("new")).otherwise(F.col("old")).alias("merged"))
