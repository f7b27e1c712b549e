"""Queries of the detection study and of slicing over tables of functions, registered with the catalogue's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import code, embeddings, folds, logistic, match, model, regions, representations
from ..operators import statistics as S
from ..runtime import materialize, ship
from .catalogue import _detection, big, efforts, fold_metrics, line_shares, pair_lines, quality_scores, query, r6, table

# -- slicing ------------------------------------------------------------------------------------------------


def order_statements(spark: SparkSession, sf: str) -> DataFrame:
    """(id, k, kind, i, j): line items as the statements of a function per order, numbered from 1; i and j are below k."""
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    # one shuffle for numbering and for the functions; a given number of parts is not made fewer, as few bytes here are much work
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    t = items.select(F.col("l_orderkey").alias("id"), big(k).alias("k"), (F.col("l_partkey") % 4).alias("kind"), F.floor("l_quantity").cast("bigint").alias("q"), F.col("l_suppkey").alias("s"))
    return t.select("id", "k", "kind", (F.col("q") % F.col("k")).alias("i"), (F.col("s") % F.col("k")).alias("j"))


def order_functions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, code): a C function per order, a statement per line item that copies, adds, guards or calls.

    Statement k sets v{k} from v{i} and v{j}, set before it if at all, or the parameter v0; a call sets nothing.
    """
    kind = F.col("kind")
    v = lambda x: F.concat(F.lit("v"), F.col(x).cast("string"))
    line = (
        F.when(kind == 0, F.concat(F.lit("  "), v("k"), F.lit(" = "), v("j"), F.lit(";")))
        .when(kind == 1, F.concat(F.lit("  "), v("k"), F.lit(" = "), v("j"), F.lit(" + "), v("i"), F.lit(";")))
        .when(kind == 2, F.concat(F.lit("  if ("), v("j"), F.lit(" > 3) "), v("k"), F.lit(" = "), v("i"), F.lit(";")))
        .otherwise(F.concat(F.lit("  memcpy("), v("j"), F.lit(", "), v("i"), F.lit(", 4);")))
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n")
    per = order_statements(spark, sf).groupBy("id").agg(body.alias("body"))
    return per.select("id", F.concat(F.lit("int f"), F.col("id").cast("string"), F.lit("(int v0)\n{\n"), F.col("body"), F.lit("\n}\n")).alias("code"))


def joined(lines: str) -> Column:
    """0-based lines as a list of 1-based ones."""
    return F.array_join(F.transform(lines, lambda x: (x + 1).cast("string")), ",")


@query
def c_slice_table(spark: SparkSession, sf: str) -> DataFrame:
    """Backward slices of a table of functions: all and memory criteria, data only, depth, and how they matched."""
    ship(spark)
    f = order_functions(spark, sf).select("id", code.slice_measures(F.col("code")).alias("m"))
    return f.select(
        "id", big("m.n_lines").alias("n_lines"), joined("m.sinks").alias("sinks"), joined("m.kept").alias("slice"), joined("m.data").alias("data_slice"), joined("m.memory").alias("memory_slice"),
        F.col("m.status").alias("status"), F.col("m.memory_status").alias("memory_status"), big("m.depth").alias("depth"),
    )


@query
def c_slice_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Size ratios of slices by function length: means, and shares of the fallback."""
    ship(spark)
    m = order_functions(spark, sf).select(code.slice_measures(F.col("code")).alias("m")).select("m.*")
    share = lambda c: r6(F.avg((F.col(c) == "fallback").cast("double")))
    size = lambda c: r6(F.avg(F.size(c) / F.col("n_lines")))
    return m.groupBy(big("n_lines").alias("n_lines")).agg(
        F.count("*").alias("n"), size("kept").alias("rsr"), size("data").alias("data_rsr"), size("memory").alias("memory_rsr"), r6(F.avg("depth")).alias("mean_depth"), share("status").alias("fallback"), share("memory_status").alias("memory_fallback")
    )


@query
def reference_graph_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Slices over program graphs: from call nodes back along reaching definitions, controls and children, without parameters.

    A graph per order: a node per line item, whose part decides its kind and whose supplier and quantity where its edges lead.
    """
    line = order_statements(spark, sf).withColumnRenamed("id", "grp")
    nodes = line.select("grp", F.col("k").alias("node"), F.col("k").alias("line"), F.when(F.col("kind") == 3, "call").when(F.col("kind") == 2, "parameter").otherwise("other").alias("kind"))
    e = line.select("grp", F.col("k").alias("src"), F.explode(F.array(F.struct(F.col("j").alias("dst"), F.lit("reaching").alias("kind")), F.struct(F.col("i").alias("dst"), F.lit("controls").alias("kind")))).alias("e"))
    edges = e.select("grp", "src", "e.dst", "e.kind").where("dst > 0")
    s = regions.graph_slice(nodes, edges)
    return s.groupBy("grp").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("line")).cast("array<string>"), ",").alias("lines"))


@query
def xml_code_features(spark: SparkSession, sf: str) -> DataFrame:
    """Abstract features from the XML markup of a table of functions: places, functions and lines per feature."""
    ship(spark)
    at = lambda text: F.concat(F.lit(f'<{text} pos:start="'), (F.col("k") + 2).cast("string"), F.lit(':3">'))
    name = lambda c: F.concat(F.lit("<name>v"), F.col(c).cast("string"), F.lit("</name>"))
    op = lambda t: F.concat(at("operator"), F.lit(f"{t}</operator>"))
    number = lambda v: F.concat(at('literal type="number"'), F.lit(f"{v}</literal>"))
    sets = lambda *what: F.concat(F.lit("<expr_stmt><expr>"), name("k"), op("="), *what, F.lit("</expr></expr_stmt>"))
    kind = F.col("kind")
    xml = (
        F.when(kind == 0, sets(name("j")))
        .when(kind == 1, sets(name("j"), op("+"), name("i")))
        .when(kind == 2, F.concat(at("if"), F.lit("<condition>"), name("j"), op("&gt;"), number(3), F.lit("</condition>"), sets(name("i")), F.lit("</if>")))
        .otherwise(F.concat(at("call"), F.lit("<name>memcpy</name><argument_list>"), name("j"), name("i"), number(4), F.lit("</argument_list></call>")))
    )
    rows = order_statements(spark, sf).select("id", F.struct("k", xml.alias("x")).alias("s")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["x"]), "\n").alias("body"))
    unit = F.concat(F.lit('<unit xmlns:pos="urn:pos"><function><type><name>int</name></type><name>f</name><block>'), F.col("body"), F.lit("</block></function></unit>"))
    f = rows.select("id", F.explode(code.xml_line_features(unit)).alias("f")).select("id", "f.line", "f.feat")
    return f.groupBy("feat").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_functions"), F.sum("line").cast("bigint").alias("lines"))


@query
def version_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Functions against their versions without the last statement: how many slice features a change removes, adds and keeps."""
    ship(spark)
    f = order_functions(spark, sf)
    before = F.regexp_replace("code", r"\n[^\n]*\n\}\n$", "\n}\n")
    d = code.versions_delta(f.select("id", before.alias("before"), F.col("code").alias("after")))
    return d.groupBy(big(F.size("phi_removed")).alias("removed"), big(F.size("phi_added")).alias("added")).agg(F.count("*").alias("n"), F.sum("phi_shared").alias("shared"))


@query
def frozen_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a frozen encoder: each different text once, cut to 512 tokens, the mean over real tokens."""
    e = embeddings.embed(table(spark, sf, "documents"), embeddings.hashed_encoder)
    return e.select(F.col("id").alias("doc_id"), *[r6(F.col("embedding")[i]).alias(f"e{i}") for i in range(4)])


# -- detection ------------------------------------------------------------------------------------------------


def detection_grams(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(rows with folds, terms per document) of the detection set."""
    rows = materialize(_detection(spark, sf), "detection")
    docs = table(spark, sf, "documents").select("doc_id", "text").join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows, representations.terms(docs, "WHOLE_TEXT")


@query
def tfidf_train_fit(spark: SparkSession, sf: str) -> DataFrame:
    """TF-IDF fitted on the training rows of each fold (words and pairs, the 2000 most frequent): what it gives the test rows."""
    rows, terms = detection_grams(spark, sf)
    w = model.train_fit_tfidf(terms, rows.select(F.col("doc_id").alias("doc"), "repeat", "fold", "label"))
    long = w.where("test").select("repeat", "fold", "doc", F.explode_outer("weights").alias("w"))
    return long.groupBy("repeat", "fold").agg(F.count("w").alias("n_terms"), F.count_distinct("doc").alias("n_docs"), F.round(F.sum("w"), 4).alias("total"), r6(F.max("w")).alias("top"))


@query
def lr_cv_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression over train-fit TF-IDF, repeated stratified folds: average precision and F1 per fold."""
    ship(spark)
    rows, terms = detection_grams(spark, sf)
    w = model.train_fit_tfidf(terms, rows.select(F.col("doc_id").alias("doc"), "repeat", "fold", "label"))
    return rounded(per_fold(logistic.sparse_scores(w.withColumn("rep", F.lit("WHOLE_TEXT")))))


@query
def lr_cv_uncapped(spark: SparkSession, sf: str) -> DataFrame:
    """The same on every labelled document, without a sample: five folds, all fitted where their rows lie."""
    ship(spark)
    labels = table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("label")).where("label IS NOT NULL")
    rows = materialize(folds.repeated_folds(labels, "label", "doc_id", repeats=1), "detection-all")
    # dealt by document, so that its terms are counted where it lies
    docs = table(spark, sf, "documents").select("doc_id", "text").join(rows.select("doc_id"), "doc_id", "left_semi").repartition("doc_id")
    w = model.train_fit_counts(representations.terms(docs, "WHOLE_TEXT"), rows.select(F.col("doc_id").alias("doc"), "repeat", "fold", "label"))
    return rounded(per_fold(logistic.shared_scores(*w).withColumn("rep", F.lit("WHOLE_TEXT"))))


@query
def fusion_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings, standardised on the training rows, beside train-fit TF-IDF; documents without an embedding are left out."""
    ship(spark)
    rows, terms = detection_grams(spark, sf)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), F.transform("embedding", lambda x: x.cast("double")).alias("dense"))
    own = rows.join(e.select("v"), F.col("doc_id") == F.col("v"), "left_semi").select(F.col("doc_id").alias("doc"), "repeat", "fold", "label")
    w = model.train_fit_tfidf(terms, own).join(e, F.col("doc") == F.col("v")).drop("v")
    return rounded(per_fold(logistic.sparse_scores(w.withColumn("rep", F.lit("fused")))))


def rounded(folds: DataFrame) -> DataFrame:
    return folds.select("rep", "repeat", "fold", "n", "n_pos", r6("ap").alias("ap"), r6("f1").alias("f1"))


@query
def detection_study(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced logistic regression over train-fit TF-IDF, per representation: mean and deviation of F1 and average precision over folds."""
    ship(spark)
    rows = materialize(_detection(spark, sf, repeats=1), "detection")
    docs = table(spark, sf, "documents").select("doc_id", "text").join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    docs = materialize(docs, "detection-docs")
    ids = rows.select(F.col("doc_id").alias("doc"), "repeat", "fold", "label")
    parts = [model.train_fit_tfidf(representations.terms(docs, name), ids).withColumn("rep", F.lit(name)) for name in representations.REGISTRY]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    f = per_fold(logistic.sparse_scores(every))
    return f.groupBy("rep").agg(F.count("*").alias("n_folds"), *[r6(agg(c)).alias(f"{c}_{n}") for c in ("f1", "ap") for n, agg in (("mean", F.avg), ("std", F.stddev_pop))])


def per_fold(scores: DataFrame) -> DataFrame:
    """Per fold: n, n_pos, average precision by rank (ties by row) and F1 at one half."""
    w = Window.partitionBy("rep", "repeat", "fold").orderBy(F.col("score").desc(), "row_id").rowsBetween(Window.unboundedPreceding, 0)
    s = scores.withColumn("tp", F.sum("label").over(w)).withColumn("k", F.count("*").over(w))
    hit = lambda p, y: F.count_if(((F.col("score") >= 0.5) == F.lit(p)) & (F.col("label") == y))
    return s.groupBy("rep", "repeat", "fold").agg(
        F.count("*").alias("n"), F.sum("label").alias("n_pos"), (F.sum(F.when(F.col("label") == 1, F.col("tp") / F.col("k"))) / F.nullif(F.sum("label"), F.lit(0))).alias("ap"), M.f1(hit(True, 1), hit(True, 0), hit(False, 1)).alias("f1")
    )


# -- statistics ------------------------------------------------------------------------------------------------


@query
def spearman_p(spark: SparkSession, sf: str) -> DataFrame:
    """Spearman's rank correlation and the two-sided p of its t statistic."""
    s = S.spearman(line_shares(spark, sf))
    return s.select("n", r6("rho").alias("rho"), r6("p").alias("p"))


@query
def mcnemar_p(spark: SparkSession, sf: str) -> DataFrame:
    """The exact test per source: documents on which only one of two detectors is right."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("n"), F.col("text").rlike("[0-9]").alias("digits"))
    y = F.col("quality") == 1
    j = d.join(table(spark, sf, "labels"), "doc_id").select("source", ((F.col("n") > 1500) == y).alias("a"), (~F.col("digits") == y).alias("b"))
    m = S.mcnemar(j, by=("source",))
    # binary fractions end on half a place: a shift decides them alike everywhere
    return m.select("source", "n10", "n01", r6(F.col("p") + 1e-9).alias("p"))


@query
def corrected_t_p(spark: SparkSession, sf: str) -> DataFrame:
    """The corrected resampled t-test of two detectors with its p."""
    d = fold_metrics(spark, sf).select((F.col("a") - F.col("b")).alias("d"))
    return S.corrected_t(d, 0.25).select("j", r6("t").alias("t"), r6("p").alias("p"))


@query
def bootstrap_mean_ci_linear(spark: SparkSession, sf: str) -> DataFrame:
    """The interval of bootstrap_mean_ci with interpolated bounds."""
    g = table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("v"))
    b = S.bootstrap_mean(g.withColumn("v", F.round("v", 3)), "v", "source", linear=True)
    return b.select(r6("lo").alias("lo"), r6("hi").alias("hi"))


@query
def random_effort_cdf(spark: SparkSession, sf: str) -> DataFrame:
    """Closed form: the chance that a random reading order meets a hit in the first k lines, k = 0..30, over documents."""
    e = efforts(spark, sf).where("kind = 'top_down'").select("n_lines", "n_hits").groupBy("n_lines", "n_hits").agg(F.count("*").alias("c"))
    e = e.withColumn("p", M.random_order_cdf(F.col("n_lines"), F.col("n_hits"), 30)).select("c", F.posexplode("p").alias("k", "p"))
    return e.groupBy(big("k").alias("k")).agg(r6(F.sum(F.col("c") * F.col("p")) / F.sum("c")).alias("share"))


@query
def best_f1_grids(spark: SparkSession, sf: str) -> DataFrame:
    """The best-F1 threshold on three grids: distinct scores or 256 quantiles, or 200 inner quantiles, and scores rounded to three places."""
    s = quality_scores(spark, sf)
    parts = [match.best_f1_on(s, grid).select(F.lit(grid).alias("grid"), r6("threshold").alias("threshold"), r6("f1").alias("f1")) for grid in match.GRIDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def pair_order(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns in one total order, numbered without one task for all."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    n = S.numbered(c.withColumn("key", F.struct("role", "conv_id", "turn")), "key")
    return n.select("conv_id", "turn", big("place").alias("place"))


@query
def xml_paths(spark: SparkSession, sf: str) -> DataFrame:
    """XML documents read by path: an element per nation inside its region, their names, counts and attributes."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit('<nation key="'), x["n_nationkey"].cast("string"), F.lit('"><name>'), x["n_name"], F.lit("</name></nation>"))), "").alias("body")
    )
    x = n.select("n_regionkey", F.concat(F.lit('<region id="'), F.col("n_regionkey").cast("string"), F.lit('">'), F.col("body"), F.lit("</region>")).alias("xml"))
    return x.select(
        big("n_regionkey").alias("region"), F.array_join(F.xpath("xml", F.lit("/region/nation/name/text()")), ",").alias("names"), F.xpath_long("xml", F.lit("count(/region/nation)")).alias("n"),
        F.xpath_long("xml", F.lit("sum(/region/nation/@key)")).alias("key_sum"), F.xpath_boolean("xml", F.lit("/region/nation[@key='0']")).alias("has_first"),
    )
