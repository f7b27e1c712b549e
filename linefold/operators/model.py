"""TF-IDF and vocabularies; logistic regression over folds is in logistic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

PAD, UNK = 0, 1


def vocabulary(tokens: DataFrame, size: int) -> DataFrame:
    """tokens(doc, pos, tok) -> (tok, rank): the most frequent, ties by first appearance; a top-k."""
    c = tokens.groupBy("tok").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("first"))
    top = c.orderBy(F.col("n").desc(), "first").limit(size)
    return top.select("tok", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "first")).cast("bigint").alias("rank"))


def encode_ids(tokens: DataFrame, vocab: DataFrame, length: int) -> DataFrame:
    """(doc, ids): vocabulary ids from 2 on, 1 where unknown, padded with 0 or cut to length."""
    coded = tokens.where(F.col("pos") < length).join(vocab, "tok", "left").select("doc", "pos", F.coalesce(F.col("rank") + 1, F.lit(UNK)).alias("id"))
    per = coded.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s"))
    ids = F.transform("s", lambda x: x["id"])
    return per.select("doc", F.slice(F.concat(ids, F.array_repeat(F.lit(PAD).cast("bigint"), length)), 1, length).alias("ids"))


def tfidf(tokens: DataFrame, vocab: DataFrame | None = None, n_docs: int | None = None, fit_on: Column | None = None) -> DataFrame:
    """tokens(doc, tok) -> (doc, tok, weight): tf * (ln((1 + N) / (1 + df)) + 1), rows of unit length.

    fit_on: a condition on tokens; document frequencies come from those rows only.
    """
    tf = tokens.groupBy("doc", "tok").agg(F.count("*").alias("tf"))
    if vocab is not None:
        tf = tf.join(vocab.select("tok"), "tok", "left_semi")
    fit = tokens if fit_on is None else tokens.where(fit_on)
    df = fit.select("doc", "tok").distinct().groupBy("tok").agg(F.count("*").alias("df"))
    n = n_docs if n_docs is not None else fit.select("doc").distinct().count()
    w = tf.join(df, "tok").withColumn("w", F.col("tf") * (F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1))
    length = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return w.join(length, "doc").select("doc", "tok", (F.col("w") / F.col("l")).alias("weight"))


def train_fit_tfidf(terms: DataFrame, folds: DataFrame, size: int = 2000) -> DataFrame:
    """TF-IDF of terms(doc, tok, tf) as each fold's training rows give it, for all rows.

    folds: (doc, repeat, fold, label), the fold in which a row is a test row.  Vocabulary
    (the size most frequent terms, ties by name) and document frequencies come from the
    training rows alone.  Gives (repeat, fold, doc, label, test, at, weights): places in the
    vocabulary and weights of unit length, empty where no term is known.
    """
    terms = materialize(terms, "terms")
    vocab, n_folds = fold_vocabulary(terms, folds, size)
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(n_folds - 1).cast("bigint"))
    known = terms.join(vocab, "tok").groupBy("repeat", "doc").agg(F.collect_list(F.struct("tf", "in")).alias("terms"))
    rows = folds.select("repeat", "doc", "label", F.col("fold").alias("own")).join(known, ["repeat", "doc"], "left").withColumn("fold", F.explode(every))
    own = F.flatten(F.transform(F.coalesce("terms", F.array().cast(known.schema["terms"].dataType)), lambda t: F.transform(F.filter(t["in"], lambda e: e["fold"] == F.col("fold")), lambda e: F.struct(e["at"].alias("at"), (t["tf"] * e["idf"]).alias("w")))))
    rows = rows.select("repeat", "fold", "doc", "label", (F.col("own") == F.col("fold")).alias("test"), F.array_sort(own).alias("s"))
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    rows = rows.select("repeat", "fold", "doc", "label", "test", F.transform("s", lambda x: x["at"]).alias("at"), length.alias("length"), F.transform("s", lambda x: x["w"]).alias("w"))
    return rows.select("repeat", "fold", "doc", "label", "test", "at", F.when(F.col("length") > 0, F.transform("w", lambda x: x / F.col("length"))).otherwise(F.array().cast("array<double>")).alias("weights"))


def fold_vocabulary(terms: DataFrame, folds: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(repeat, tok, in), where in has (fold, at, idf) of each fold whose vocabulary has the term; and the number of folds."""
    last = folds.agg(F.max("fold")).collect()[0][0]
    n_folds = int(last or 0) + 1
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(n_folds - 1).cast("bigint"))
    # a row per term: counted per fold in arrays, as what a fold trains on is the whole less its own
    at = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("fold") == k, c)), F.lit(0)) for k in range(n_folds)])
    per = terms.join(folds.select("doc", "repeat", "fold"), "doc").groupBy("repeat", "tok").agg(F.sum("tf").alias("total"), F.count("*").alias("df"), at(F.col("tf")).alias("totals"), at(F.lit(1)).alias("dfs"))
    per = materialize(per.withColumn("least", F.col("total") - F.array_max("totals")), "fold-terms")
    # size terms have at least so many places in every training set: a term with fewer in all is in no vocabulary
    # the least of the term in that place, by counts of equal ones: a repeat's terms are never sorted in one task
    upto = F.sum("many").over(Window.partitionBy("repeat").orderBy(F.col("least").desc()))
    bar = per.groupBy("repeat", "least").agg(F.count("*").alias("many")).withColumn("upto", upto).where(F.col("upto") >= size).groupBy(F.col("repeat").alias("r")).agg(F.max("least").alias("bar"))
    cand = per.join(bar, F.col("repeat") == F.col("r"), "left").where(F.col("total") >= F.coalesce("bar", F.lit(0)))
    rest = lambda whole, own: F.col(whole) - F.get(own, F.col("fold").cast("int"))
    fit = cand.withColumn("fold", F.explode(every)).select("repeat", "fold", "tok", rest("total", "totals").alias("total"), rest("df", "dfs").alias("df")).where("df > 0")
    n = folds.groupBy("repeat").agg(F.count("*").alias("whole"), at(F.lit(1)).alias("own")).withColumn("fold", F.explode(every)).select("repeat", "fold", rest("whole", "own").alias("n"))
    place = F.row_number().over(Window.partitionBy("repeat", "fold").orderBy(F.col("total").desc(), "tok"))
    vocab = fit.withColumn("at", place - 1).where(F.col("at") < size).join(n, ["repeat", "fold"])
    entry = F.struct("fold", "at", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    vocab = materialize(vocab.groupBy("repeat", "tok").agg(F.collect_list(entry).alias("in")), "fold-vocabulary")
    return vocab, n_folds


def train_fit_counts(terms: DataFrame, folds: DataFrame, size: int = 2000) -> tuple[DataFrame, DataFrame]:
    """What train_fit_tfidf() weighs, with one row per text for all folds: its counts, and apart from them what each fold makes of a term.

    Gives (repeat, doc, label, fold, at, tf), fold being the one in which the row is a test row,
    and (repeat, at, idf), idf having a number per fold, 0 where its vocabulary lacks the term.
    A repeat has at most folds times size different places.
    """
    terms = materialize(terms, "terms")
    vocab, n_folds = fold_vocabulary(terms, folds, size)
    at = (F.row_number().over(Window.partitionBy("repeat").orderBy("tok")) - 1).alias("at")
    vocab = materialize(vocab.select("repeat", "tok", at, "in"), "shared-vocabulary")
    known = terms.join(F.broadcast(vocab.select("repeat", "tok", "at")), "tok").groupBy("repeat", "doc").agg(F.collect_list(F.struct("at", F.col("tf").cast("double").alias("tf"))).alias("t"))
    rows = folds.select("repeat", "doc", "label", "fold").join(known, ["repeat", "doc"], "left")
    of = lambda c, kind: F.coalesce(F.col(f"t.{c}"), F.array().cast(f"array<{kind}>")).alias(c)
    idf = F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: F.coalesce(F.get(F.filter("in", lambda e: e["fold"] == k), F.lit(0))["idf"], F.lit(0.0)))
    return rows.select("repeat", "doc", "label", "fold", of("at", "int"), of("tf", "double")), vocab.select("repeat", "at", idf.alias("idf"))
