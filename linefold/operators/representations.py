"""Representations of texts for detection: each gives the terms (doc, tok, tf) of documents, by the name of the registry.

Kinds: text terms are words and word pairs; feature terms are abstract features, one token
each, or EMPTYFEAT where there is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from . import regions

#: Lines that a region begins with.
CRITERION = "[0-9]"


def criterion() -> Column:
    return F.col("line").rlike(CRITERION)


def abstract_features(line: Column) -> Column:
    """Features of a line that do not name its words: numbers, signs, lengths of identifiers."""
    of = lambda t: (
        F.when(t.rlike("^[0-9]"), F.lit("lit:num")).when(t.rlike("^[A-Za-z_]"), F.concat(F.lit("id:"), F.least(F.length(t), F.lit(9)).cast("string"))).otherwise(F.concat(F.lit("op:"), t))
    )
    return F.transform(T.code_tokens(line), of)


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc", "tok").agg(F.count("*").alias("tf"))


def _text(docs: DataFrame) -> DataFrame:
    # words are a column of their own: inside the lambda of the pairs they would be found again for every pair
    w = docs.select(F.col("doc_id").alias("doc"), T.words(F.col("text")).alias("w"))
    return _counted(w.select("doc", F.explode(F.concat("w", T.bigrams(F.col("w")))).alias("tok")))


def _region_text(docs: DataFrame, region: DataFrame) -> DataFrame:
    """docs with the text of a region of theirs; without one, empty."""
    kept = region.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_idx")).alias("kept"))
    j = docs.join(kept, "doc_id", "left")
    return j.select("doc_id", F.coalesce(A.region_text(T.lines(F.col("text")), F.col("kept")), F.lit("")).alias("text"))


def _features(docs: DataFrame, region: DataFrame | None) -> DataFrame:
    """Feature terms of all lines, or of a region's."""
    lines = regions.explode_lines(docs)
    if region is not None:
        lines = lines.join(region.distinct(), ["doc_id", "line_idx"], "left_semi")
    t = lines.select(F.col("doc_id").alias("doc"), F.explode(abstract_features(F.col("line"))).alias("tok"))
    none = docs.select(F.col("doc_id").alias("doc")).join(t.select("doc").distinct(), "doc", "left_anti").select("doc", F.lit("EMPTYFEAT").alias("tok"))
    return _counted(t.unionByName(none))


def normalized(docs: DataFrame) -> DataFrame:
    """docs whose identifiers are VARn by first appearance."""
    t = docs.select("doc_id", F.posexplode_outer(T.idents(F.col("text"))).alias("pos", "tok"))
    first = F.min("pos").over(Window.partitionBy("doc_id", "tok"))
    named = t.withColumn("first", first).withColumn("name", F.concat(F.lit("VAR"), F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first")).cast("string")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tok").isNotNull(), F.struct("pos", "name")))), lambda x: x["name"]), " ")
    return named.groupBy("doc_id").agg(text.alias("text"))


def _mention(docs: DataFrame) -> DataFrame:
    return regions.mention_region(regions.explode_lines(docs), criterion())


def _slice(docs: DataFrame) -> DataFrame:
    return regions.window_region(regions.explode_lines(docs), criterion(), 2)


#: name -> terms of documents(doc_id, text).
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "WHOLE_TEXT": _text,
    "SLICE_TEXT": lambda d: _text(_region_text(d, _slice(d))),
    "AUG_WHOLE": lambda d: _features(d, None),
    "AUG_SLICE": lambda d: _features(d, _slice(d)),
    "AUG_VARMENTION": lambda d: _features(d, _mention(d)),
    "NORM_WHOLE": lambda d: _text(normalized(d)),
    "NORM_SLICE": lambda d: _text(normalized(_region_text(d, _slice(d)))),
}


def terms(docs: DataFrame, name: str) -> DataFrame:
    """(doc, tok, tf) of documents(doc_id, text) under a representation of the registry."""
    if name not in REGISTRY:
        raise ValueError(f"no representation {name}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name](docs.select("doc_id", "text"))
