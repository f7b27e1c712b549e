"""Which names stand inside which others: posting lists of q-grams instead of all pairs.

A name that another contains has all its q-grams there, so it is enough to meet on one: each
name posts its rarest gram alone, the one that the fewest longer names hold, and a name with
a gram that nothing holds posts nothing.  What meets is compared as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import simple_name


def grams(c: Column, g: Column) -> Column:
    """The different pieces of g characters, none where there are fewer characters."""
    n = F.length(c) - g + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, g)))).otherwise(F.array().cast("array<string>"))


def contained(needles: DataFrame, hay: DataFrame, q: int = 4) -> DataFrame:
    """needles(needle), hay(name) -> (needle, name): each different pair where name contains needle, equal ones too.

    Empty and null names have no pairs.  Names shorter than q meet on the whole of them.
    """
    n = needles.select("needle").where("needle <> ''").distinct().withColumn("g", F.least(F.length("needle"), F.lit(q)))
    lengths = sorted(r[0] for r in n.select("g").distinct().collect())  # at most q numbers
    if not lengths:
        return n.select("needle", F.col("needle").alias("name"))
    asked = n.select("needle", F.explode(grams(F.col("needle"), F.col("g"))).alias("gram"))
    wanted = asked.select("gram").distinct()
    names = hay.select("name").where("name <> ''").distinct()
    held = names.select("name", F.explode(F.flatten(F.array(*[grams(F.col("name"), F.lit(g)) for g in lengths]))).alias("gram")).join(wanted, "gram", "left_semi")
    holders = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(holders, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    posted = rarest.where("r.n > 0").select("needle", F.col("r.gram").alias("gram"))
    return posted.join(held, "gram").where(F.col("name").contains(F.col("needle"))).select("needle", "name")


def resolve(entries: DataFrame, keys: DataFrame, q: int = 4) -> DataFrame:
    """entries(pos, name), keys(key) -> (key, equal, inside, around, pos): how manifest names fit each key.

    Names are compared without case and punctuation.  equal: entries of the same name;
    inside: entries whose name contains the key; around: entries whose name the key
    contains (equal ones not counted again); pos: the first entry that fits, null if none.
    """
    e = entries.select("pos", simple_name(F.col("name")).alias("name"))
    k = keys.select("key", simple_name(F.col("key")).alias("simple"))
    wanted = k.select("simple").distinct()
    inside = contained(wanted.select(F.col("simple").alias("needle")), e).select(F.col("needle").alias("simple"), "name")
    around = contained(e.select(F.col("name").alias("needle")), wanted.select(F.col("simple").alias("name"))).select(F.col("name").alias("simple"), F.col("needle").alias("name"))
    pairs = inside.withColumn("kind", F.when(F.col("simple") == F.col("name"), "equal").otherwise("inside")).unionByName(around.where("simple <> name").withColumn("kind", F.lit("around")))
    # entries are folded by name before they meet the keys, so that a name of many entries is one row
    per_name = e.groupBy("name").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == x, F.col("n"))), F.lit(0)).alias(x) for x in ("equal", "inside", "around")]
    per_key = pairs.join(per_name, "name").groupBy("simple").agg(*sums, F.min("pos").alias("pos"))
    out = k.join(per_key, "simple", "left")
    return out.select("key", *[F.coalesce(x, F.lit(0).cast("bigint")).alias(x) for x in ("equal", "inside", "around")], "pos")
