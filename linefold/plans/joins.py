"""Queries of joins that need more than an equal key: nested spans, containment of names, memoised results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import memo
from ..functions import text as T
from ..operators import contain, folds, spans
from ..runtime import materialize, new_path
from ..sources import xml
from .catalogue import big, query, table

# -- nested spans ---------------------------------------------------------------------------------------------


def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    """(grp, id, lo, hi, tag): the elements of pages that are opened and closed again; places count the '<' of the page.

    An opening tag belongs to the next closing tag of its name at its depth among tags of its name.
    """
    piece = table(spark, sf, "pages").select("page_id", F.posexplode(F.split(F.coalesce("html", F.lit("")), "<", -1)).alias("k", "piece")).where("k > 0")
    t = piece.select(F.col("page_id").alias("grp"), big("k").alias("k"), F.lower(F.regexp_extract("piece", "^/?([A-Za-z][A-Za-z0-9]*)", 1)).alias("tag"), F.col("piece").startswith("/").alias("ends")).where("tag <> ''")
    upto = F.sum(F.when(F.col("ends"), -1).otherwise(1)).over(Window.partitionBy("grp", "tag").orderBy("k"))
    t = t.withColumn("at", upto + F.col("ends").cast("int"))
    following = F.lead(F.struct("ends", "k")).over(Window.partitionBy("grp", "tag", "at").orderBy("k"))
    return t.withColumn("n", following).where(~F.col("ends") & F.col("n.ends")).select("grp", F.col("k").alias("id"), F.col("k").alias("lo"), F.col("n.k").alias("hi"), "tag")


@query
def enclosing_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Every element of every page with its depth and the tags of the elements around it, from the outside."""
    e = materialize(page_elements(spark, sf), "elements")
    around = spans.enclosing(e, carry=("tag",))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("around_depth", "around_tag"))), lambda x: x["around_tag"]), "/")
    per = around.groupBy(F.col("grp").alias("g"), F.col("id").alias("i")).agg(F.count("*").alias("depth"), path.alias("path"))
    j = e.join(per, (F.col("grp") == F.col("g")) & (F.col("id") == F.col("i")), "left")
    return j.select(F.col("grp").alias("page_id"), F.col("id").alias("at"), "tag", F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"), F.coalesce("path", F.lit("")).alias("path"))


@query
def parent_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tags by the tag of the nearest element around them, and at what depth they stand."""
    p = spans.enclosing(materialize(page_elements(spark, sf), "elements"), parents_only=True, carry=("tag",))
    return p.groupBy(F.col("around_tag").alias("parent")).agg(F.count("*").alias("n"), F.count_distinct("grp").alias("n_pages"), F.max("depth").alias("deepest"))


# -- results by content ---------------------------------------------------------------------------------------


def count_tokens(texts: DataFrame) -> DataFrame:
    """What the memo keeps of a line: its code tokens and its different identifiers."""
    t = F.col(memo.TEXT)
    return texts.select(memo.DIGEST, big(F.size(T.code_tokens(t))).alias("n_tokens"), big(F.size(F.array_distinct(T.idents(t)))).alias("n_idents"))


@query
def memo_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Line measures of three tables by content: rows, different lines, how many had to be computed, and their sums.

    Lines that an earlier table had are looked up, not computed again.
    """
    kept = memo.Memo(spark, new_path(spark, "memo"), memo.version_of(count_tokens), "n_tokens bigint, n_idents bigint")
    parts, before = [], 0
    for name in ("documents", "benchmark", "conversations"):
        lines = table(spark, sf, name).select(F.explode(T.lines(F.col("text"))).alias("line"))
        out = materialize(kept.apply(lines, F.col("line"), count_tokens), "measured")
        after = kept.table().count()
        parts.append(out.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct("line").alias("n_texts"), F.lit(after - before).cast("bigint").alias("n_computed"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_idents").alias("n_idents")))
        before = after
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- XML as a source ------------------------------------------------------------------------------------------

UNIT = "_id long, _customer long, statement array<struct<_line: long, _part: long, _VALUE: double>>"


@query
def xml_units(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as XML units with a statement per line item, written, then read by their tag and schema: statements and values per unit.

    Files are read in splits at units, so that a large one is many tasks.
    """
    items = F.array_sort(F.collect_list(F.struct(big("l_linenumber").alias("_line"), big("l_partkey").alias("_part"), F.col("l_extendedprice").cast("double").alias("_VALUE"))))
    units = table(spark, sf, "lineitem").groupBy(big("l_orderkey").alias("_id")).agg(items.alias("statement"))
    units = units.join(table(spark, sf, "orders").select(big("o_orderkey").alias("_order"), big("o_custkey").alias("_customer")), F.col("_id") == F.col("_order")).select("_id", "_customer", "statement")
    path = new_path(spark, "units")
    xml.write_units(units, path)
    read = xml.read_units(spark, path, UNIT)
    s = read.select(F.col("_id").alias("id"), F.col("_customer").alias("customer"), F.explode("statement").alias("s"))
    return s.groupBy("id", "customer").agg(F.count("*").alias("n"), F.sum("s._part").alias("parts"), F.max("s._line").alias("last_line"), F.round(F.sum("s._VALUE"), 2).alias("total"))




# -- containment of names -------------------------------------------------------------------------------------


@query
def manifest_substrings(spark: SparkSession, sf: str) -> DataFrame:
    """Keys against manifest entries, but for case and punctuation: equal, part of a name, or a name part of the key.

    Entries are parts by name and brand, and suppliers; keys are names, brands and types of
    parts, and suppliers with their nation.
    """
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    entries = p.select(big("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", "p_brand").alias("name")).unionByName(s.select((big("s_suppkey") + 1_000_000_000).alias("pos"), F.col("s_name").alias("name")))
    keys = p.select(F.explode(F.array("p_name", "p_brand", "p_type", F.concat_ws("-", "p_name", "p_brand"))).alias("key"))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    keys = keys.unionByName(s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat_ws(" of ", "s_name", "n_name").alias("key"))).distinct()
    return contain.resolve(entries, keys).withColumn("pos", F.coalesce("pos", F.lit(-1).cast("bigint")))


# -- group folds of a long tail -------------------------------------------------------------------------------


@query
def grouped_folds_long_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Stratified folds of orders by customer: rows, customers and finished orders per fold."""
    o = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("done"))
    f = folds.stratified_group_folds(o, "o_custkey", "done")
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_groups"), F.sum("done").alias("n_pos"))
