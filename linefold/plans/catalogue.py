"""Queries over the standard tables: one function per query, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import metrics as M
from ..functions import text as T
from ..operators import code, folds, graph, match, model, nearest, regions
from ..operators import statistics as S
from ..runtime import materialize, ship, spread
from ..sources import readers
from ..streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Ids up to which a side is broadcast, by count.
BROADCAST_IDS = 500_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def docs_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs, regions.explode_lines(docs)


def pair_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents of pairs, their lines, pairs): what a pair query needs of the corpus, and no more.

    Pairs are a small table of ids, written before use; all further work is on the paired documents.
    """
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    pairs = materialize(regions.copy_pairs(docs), "pairs")
    ids = pairs.select(F.explode(F.array("x", "y")).alias("p_id")).distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    own = docs.join(ids, F.col("doc_id") == F.col("p_id"), "left_semi")
    return own, regions.explode_lines(own), pairs


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs with the texts ``before`` and ``after``."""
    return pairs.join(docs.select(F.col("doc_id").alias("x"), F.col("text").alias("before")), "x").join(docs.select(F.col("doc_id").alias("y"), F.col("text").alias("after")), "y")


def sink(tier: str = "all") -> Column:
    """Criterion lines: all, those with a comma; sparse, those with a digit."""
    return F.col("line").contains(",") if tier == "all" else F.col("line").rlike("[0-9]")


# -- filters, labels, scans -----------------------------------------------------------------


@query
def label_coercion_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Label predicates that are not complements of each other, per group key."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    v = F.col("toxic")
    return d.groupBy(F.coalesce(T.group_key(F.col("lang"), F.col("source")), F.lit("unlabeled")).alias("grp")).agg(
        F.count_if(T.is_positive(v)).alias("n_pos"), F.count_if(T.is_positive_text(v)).alias("n_pos_text"), F.count_if(T.is_negative(v)).alias("n_neg"), F.count_if(~T.is_positive(v)).alias("n_not_pos"), F.count_if(v.isNull()).alias("n_null")
    )


@query
def qualify_pairs_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Positive pairs with text on both sides that differ; the first 40 in input order (the cap is the operator)."""
    docs, _, pairs = pair_lines(spark, sf)
    j = with_texts(pairs, docs)
    j = j.join(table(spark, sf, "labels").select(F.col("doc_id").alias("x"), "quality"), "x")
    ok = j.where(T.is_positive(F.col("quality")) & T.has_text(F.col("after")) & (F.col("after") != F.col("before")))
    return ok.orderBy("x").limit(40).select("x", "y", big(F.length("before")).alias("n_before"), big(F.length("after")).alias("n_after"))


@query
def skip_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """Why a document yields no usable pair, counted per reason."""
    _, lines, pairs = pair_lines(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    deleted = regions.deleted_lines(lines, pairs).select(F.col("doc_id").alias("del_id")).distinct()
    j = docs.join(pairs, docs["doc_id"] == pairs["x"], "left").join(deleted, F.col("doc_id") == F.col("del_id"), "left")
    reason = F.when(~T.has_text(F.col("text")), "empty").when(F.col("x").isNull(), "no_pair").when(F.col("del_id").isNull(), "insertion_only").otherwise("used")
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query
def pair_by_key_text_differs(spark: SparkSession, sf: str) -> DataFrame:
    """A role's consecutive turns whose text differs; equal (before, after) texts once, the first one."""
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    p = c.select("conv_id", "role", "turn", "text", F.lead("text").over(w).alias("after")).where("text <> after")
    key = F.sha1(F.concat("text", F.lit("\0"), "after").cast("binary"))
    return p.groupBy(key.alias("pair_key")).agg(F.min(F.struct("conv_id", "turn")).alias("b"), F.count("*").alias("n")).select("pair_key", "b.conv_id", "b.turn", "n")


@query
def fingerprint_sha(spark: SparkSession, sf: str) -> DataFrame:
    """Content fingerprints, the first holder of each and how many share it."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


GATE_TABLES = ("customer", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")
GATE_MARKERS = [
    ("code", 1, "funcbefore"), ("code", 1, "funcafter"), ("code", 1, "vul"), ("text", 2, "text"), ("text", 2, "sentence"), ("text", 2, "lang"), ("text", 2, "html"),
    ("vector", 3, "embedding"), ("image", 4, "image"), ("image", 4, "pixels"), ("tabular", 5, "label"), ("tabular", 5, "quality"), ("tabular", 5, "cacctbal"),
]
GATE_REQUIRED = [
    ("code", "before", "funcbefore"), ("code", "label", "vul"), ("text", "text", "text"), ("text", "id", "docid"), ("text", "id", "itemid"), ("text", "order", "turn"), ("text", "order", "docid"),
    ("vector", "id", "vecid"), ("vector", "vector", "embedding"), ("vector", "group", "group"), ("tabular", "label", "quality"), ("tabular", "label", "cmktsegment"), ("tabular", "split", "split"),
]


@query
def schema_gate_modality(spark: SparkSession, sf: str) -> DataFrame:
    """Modality of each table by marker hits among its columns, and the required columns it lacks."""
    columns = [(t, c) for t in GATE_TABLES for c in readers.columns_of(spark, f"{sf}/{t}.parquet")]
    return readers.schema_gate(spark.createDataFrame(columns, "dataset string, col string"), spark.createDataFrame(GATE_MARKERS, "modality string, prio int, marker string"), spark.createDataFrame(GATE_REQUIRED, "modality string, need string, alias string"))


@query
def manifest_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Part names matched to brands' names but for case and punctuation."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", T.simple_name(F.col("p_brand")).alias("key"))
    return p.groupBy("key").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"), F.min("p_brand").alias("brand"))


@query
def regex_taxonomy_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by a cascade of patterns, with shares of all lines."""
    _, lines = docs_lines(spark, sf)
    line = F.col("line")
    kind = F.when(~line.rlike(r"\S"), "blank").when(line.rlike(r"(?i)licen[cs]e"), "license").when(line.rlike("[0-9]"), "digits").when(line.rlike(r"[|]"), "table").when(line.rlike(","), "clauses").otherwise("plain")
    g = lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return g.select("kind", "n", F.round(100 * F.col("n") / F.sum("n").over(S.everything()), 1).alias("pct"))


@query
def extract_ids_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Host names in a page: all matches, upper case, distinct, sorted."""
    p = table(spark, sf, "pages")
    ids = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"(?i)[a-z]+\.example\.(?:com|net|org)"), F.lit(0)), F.upper)))
    return p.select("page_id", F.array_join(ids, ",").alias("ids"), big(F.size(ids)).alias("n"))


# -- lines, identifiers, tokens ------------------------------------------------------------------


@query
def line_explode_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per document: mean, quartiles, shares over thresholds, per language."""
    d = table(spark, sf, "documents").select("lang", F.size(T.lines(F.col("text"))).alias("n"))
    d = materialize(d, "line-counts")
    q = S.grouped_quantiles(d, ["lang"], "n", [0.25, 0.5, 0.75]).withColumnRenamed("lang", "q_lang")
    g = d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean_lines"), (F.avg((F.col("n") >= 10).cast("double")) * 100).alias("pct10"))
    return g.join(q, F.col("lang").eqNullSafe(F.col("q_lang")), "left").select("lang", "n_docs", r6("mean_lines").alias("mean_lines"), *[r6(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], r6("pct10").alias("pct10"))


@query
def ident_sets_per_line(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct identifiers of each line, keywords left out, as a sorted list."""
    _, lines = docs_lines(spark, sf)
    keep = F.array_sort(F.array_except(F.array_distinct(T.idents(F.col("line"))), F.array(*map(F.lit, ("the", "of", "and", "to", "in", "a", "is")))))
    return lines.select("doc_id", "line_idx", big(F.size(keep)).alias("n"), F.md5(F.array_join(keep, " ").cast("binary")).alias("idents"))


@query
def lexer_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Code-lexer tokens by class and language."""
    d = table(spark, sf, "documents").select("lang", F.explode(T.code_tokens(F.col("text"))).alias("tok"))
    kind = F.when(F.col("tok").rlike("^[A-Za-z_]"), "word").when(F.col("tok").rlike("^[0-9]"), "number").otherwise("sign")
    return d.groupBy("lang", kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("tok").alias("n_distinct"))


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(T.code_tokens(F.col("text"))).alias("pos", "tok")).withColumn("pos", big("pos"))


@query
def vocab_topk_oov(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary of the training documents (top 500, ties by first appearance), ids and unknowns of the others."""
    toks = doc_tokens(spark, sf).withColumn("test", F.pmod(T.salt("oov", F.col("doc")), F.lit(5)) == 0)
    vocab = model.vocabulary(toks.where("not test"), 500)
    test = toks.where("test")
    ids = model.encode_ids(test, vocab, 16)
    oov = test.join(vocab, "tok", "left").groupBy("doc").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("rank").isNull()).alias("n_oov"))
    return oov.join(ids, "doc").select(F.col("doc").alias("doc_id"), "n_tokens", "n_oov", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query
def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 most frequent words and word pairs (a top-k report)."""
    w = table(spark, sf, "documents").select(T.words(F.col("text")).alias("w"))
    g = w.select(F.explode(F.concat("w", T.bigrams(F.col("w")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return g.orderBy(F.col("n").desc(), "gram").limit(50)


@query
def feature_bag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Feature bags: split at single spaces, case kept, EMPTYFEAT where nothing is left."""
    c = table(spark, sf, "conversations").select("role", F.explode(T.feature_tokens(F.col("text"))).alias("feat"))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("feat").alias("n_distinct"))


@query
def first_appearance_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Words numbered by first appearance in their document; the text in numbers."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(T.idents(F.col("text"))).alias("pos", "tok"))
    first = F.min("pos").over(Window.partitionBy("conv_id", "turn", "tok"))
    n = F.dense_rank().over(Window.partitionBy("conv_id", "turn").orderBy("first"))
    named = t.withColumn("first", first).withColumn("name", F.concat(F.lit("VAR"), n.cast("string")))
    s = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " ")
    return named.groupBy("conv_id", "turn").agg(s.alias("normalized"), F.count_distinct("name").alias("n_names"))


@query
def markup_feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Abstract features of markup: tags, attributes, characters given by name; those of a region only."""
    p = table(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", "<")).alias("line", "part"))
    tag = F.regexp_extract("part", "^([a-zA-Z][a-zA-Z0-9]*)", 1)
    attrs = F.transform(F.regexp_extract_all("part", F.lit(r"\s([a-z]+)="), F.lit(1)), lambda a: F.concat(F.lit("attr:"), a))
    feats = F.concat(F.when(tag != "", F.array(F.concat(F.lit("tag:"), tag))).otherwise(F.array().cast("array<string>")), attrs)
    long = p.select("page_id", (F.col("line")).alias("line"), F.explode(feats).alias("feat"))
    g = long.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("feat")), " ").alias("feats"), F.count("*").alias("n"), F.count_if((F.col("line") >= 1) & (F.col("line") <= 10)).alias("n_head"))
    return g


# -- diffs --------------------------------------------------------------------------------------------


@query
def multiset_line_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Line counts that differ between a document and its copy."""
    _, lines, pairs = pair_lines(spark, sf)
    m = regions.multiset_diff(lines, pairs)
    return m.groupBy("x", "y").agg(F.sum("n_deleted").alias("n_deleted"), F.sum("n_added").alias("n_added"), F.count("*").alias("n_lines"))


@query
def seq_diff_opcodes(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence-matcher diff of each pair: deleted and added lines, anchors, and fix identifiers."""
    ship(spark)
    docs, _, pairs = pair_lines(spark, sf)
    j = with_texts(pairs, docs).repartition("x", "y")
    j = j.withColumn("d", code.diff(F.col("before"), F.col("after")))
    # the lines are split outside of the lambdas, once per text
    ids = lambda c, at: F.flatten(F.transform(F.filter(T.lines(F.col(c)), lambda _, i: F.array_contains(at, i)), T.idents))
    fix = F.array_distinct(F.concat(ids("before", "d.deleted"), ids("after", "d.added")))
    fix = A.or_whole(fix, F.array_distinct(T.idents(F.col("before"))))
    return j.select("x", "y", big(F.size("d.deleted")).alias("n_deleted"), big(F.size("d.added")).alias("n_added"), big(F.size("d.anchors")).alias("n_anchors"), big(F.size(fix)).alias("n_fix_idents"))


# -- regions --------------------------------------------------------------------------------------------


def pair_measures(spark: SparkSession, sf: str, tier: str = "all") -> DataFrame:
    """Per pair with deleted lines: n, d, region size, hits, coverage and size ratio of the mention region."""
    _, lines, pairs = pair_lines(spark, sf)
    return measures(lines, regions.deleted_lines(lines, pairs), tier)


def measures(lines: DataFrame, deleted: DataFrame, tier: str) -> DataFrame:
    region = regions.mention_region(lines, sink(tier)).withColumn("in_region", F.lit(1))
    n = lines.groupBy("doc_id").agg(F.count("*").alias("n"))
    r = region.groupBy("doc_id").agg(F.count("*").alias("r"))
    d = deleted.join(region, ["doc_id", "line_idx"], "left").groupBy("doc_id").agg(F.count("*").alias("d"), F.count("in_region").alias("hit"))
    out = d.join(n, "doc_id").join(r, "doc_id", "left").withColumn("r", F.coalesce("r", F.lit(0)))
    return out.withColumn("cov", F.col("hit") / F.col("d")).withColumn("rsr", F.col("r") / F.col("n"))


@query
def region_mention_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage, size ratio, lift and concentration of mention regions, by fix size and criterion tier."""
    parts = []
    _, lines, pairs = pair_lines(spark, sf)
    deleted = materialize(regions.deleted_lines(lines, pairs), "deleted")
    for tier in ("all", "sparse"):
        parts.append(measures(lines, deleted, tier).withColumn("tier", F.lit(tier)))
    stratum = F.when(F.col("d") <= 1, "1").when(F.col("d") <= 5, "2-5").otherwise(">5")
    m = materialize(parts[0].unionByName(parts[1]).withColumn("stratum", stratum), "measures")
    median = S.grouped_quantiles(m, ["tier", "stratum"], "cov", [0.5])
    g = m.groupBy("tier", "stratum").agg(
        F.count("*").alias("n"), r6(F.avg("cov")).alias("mean_cov"), r6(F.avg("rsr")).alias("mean_rsr"), r6(F.avg("cov") / F.nullif(F.avg("rsr"), F.lit(0.0))).alias("concentration"), F.count_if(F.col("r") > 0).alias("n_region")
    )
    return g.join(median, ["tier", "stratum"]).select("stratum", "n", "mean_cov", r6(F.col("q")[0]).alias("median_cov"), "mean_rsr", "concentration", "n_region", "tier")


@query
def region_sink_window_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest window around sink lines that is as large as the sparse mention region."""
    _, lines = docs_lines(spark, sf)
    sizes = regions.mention_region(lines, sink("sparse")).groupBy("doc_id").agg(F.count("*").alias("target"))
    c = regions.calibrated_window(lines, sink("all"), sizes)
    return c.select("doc_id", "n_lines", "target", "k", "win_size")


@query
def region_unit_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Lines mapped to units of five lines, and back to spans."""
    _, lines = docs_lines(spark, sf)
    units = lines.select("doc_id", F.floor(F.col("line_idx") / 5).alias("unit")).distinct().select("doc_id", "unit", (F.col("unit") * 5).alias("lo"), (F.col("unit") * 5 + 4).alias("hi"))
    hit = regions.unit_mapping(regions.window_region(lines, sink("sparse"), 1), units)
    return hit.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum("unit").alias("unit_sum"))


@query
def region_tail_random_expect(spark: SparkSession, sf: str) -> DataFrame:
    """Tail regions and the exact expectation of random lines and random windows of the region's size."""
    _, lines, pairs = pair_lines(spark, sf)
    deleted = materialize(regions.deleted_lines(lines, pairs), "deleted")
    m = measures(lines, deleted, "all").where("r > 0").select("doc_id", "n", "d", F.col("r").alias("k"))
    j = deleted.join(m, "doc_id")
    i, n, k = F.col("line_idx"), F.col("n"), F.col("k")
    starts = F.least(i, n - k) - F.greatest(F.lit(0), i - k + 1) + 1
    g = j.groupBy("doc_id", "n", "d", "k").agg(F.count_if(i >= n - k).alias("tail"), F.sum(starts).alias("starts"))
    return g.select("doc_id", "k", r6(F.col("tail") / F.col("d")).alias("tail_cov"), r6(F.col("k") / F.col("n")).alias("random_cov"), r6(F.col("starts") / ((F.col("n") - F.col("k") + 1) * F.col("d"))).alias("window_cov"))


@query
def random_lines_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty seeded draws of k random lines per pair: mean coverage and share of draws that hit."""
    _, lines, pairs = pair_lines(spark, sf)
    deleted = materialize(regions.deleted_lines(lines, pairs), "deleted")
    m = measures(lines, deleted, "all").where("r > 0").select("doc_id", "d", F.col("r").alias("k"))
    draws = lines.select("doc_id", "line_idx").join(m, "doc_id").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19))))
    h = F.md5(F.concat_ws("/", "doc_id", "draw", "line_idx").cast("binary"))
    taken = draws.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "draw").orderBy(h))).where("rn <= k")
    hits = taken.join(deleted.withColumn("gone", F.lit(1)), ["doc_id", "line_idx"], "left").groupBy("doc_id", "draw", "d").agg(F.count("gone").alias("c"))
    return hits.groupBy("doc_id").agg(r6(F.avg(F.col("c") / F.col("d"))).alias("mean_cov"), r6(F.avg((F.col("c") > 0).cast("double"))).alias("hit_share"))


@query
def region_set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Two regions of a document: intersection, union, precision, recall, Jaccard, and the kept text."""
    docs, lines = docs_lines(spark, sf)
    as_array = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_idx")).alias(name))
    a, b = as_array(regions.mention_region(lines, sink("sparse")), "a"), as_array(regions.window_region(lines, sink("sparse"), 2), "b")
    j = docs.join(a, "doc_id").join(b, "doc_id", "left").withColumn("b", F.coalesce("b", F.array().cast("array<bigint>")))
    x, y = F.col("a"), F.col("b")
    return j.select(
        "doc_id", big(F.size(F.array_intersect(x, y))).alias("n_chop"), big(F.size(F.array_union(x, y))).alias("n_union"), big(F.size(F.array_except(x, y))).alias("n_only_a"),
        r6(T.ratio(A.overlap(x, y), F.size(x))).alias("prec"), r6(T.ratio(A.overlap(x, y), F.size(y))).alias("rec"), r6(A.jaccard(x, y)).alias("jac"),
        F.md5(A.region_text(T.lines(F.col("text")), x).cast("binary")).alias("text_md5"),
    )


@query
def text_scan_region(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a document that mention an identifier of the changed lines: size and share."""
    _, lines, pairs = pair_lines(spark, sf)
    own = lines.join(pairs.select(F.col("x").alias("doc_id")), "doc_id", "left_semi")
    region = regions.token_region(own, regions.changed_identifiers(lines, pairs)).groupBy("doc_id").agg(F.count("*").alias("r"))
    n = own.groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.join(region, "doc_id", "left").select("doc_id", F.coalesce("r", F.lit(0)).cast("bigint").alias("r"), r6(F.coalesce("r", F.lit(0)) / F.col("n")).alias("rsr"))


@query
def trivial_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """F1 of always positive and of a fair coin, per language."""
    j = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    g = j.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count("*").alias("n"))
    return g.select("lang", "pos", "n", r6(M.always_positive_f1(F.col("pos"), F.col("n"))).alias("always"), r6(M.random_guess_f1(F.col("pos"), F.col("n"))).alias("coin"))


@query
def closure_depth_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Least hops over a dependence graph of nations, from those of each region; strata 0, 1, 2, >=3, outside."""
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    step = n.select(k.alias("src"), F.explode(F.array(F.pmod(k * 2, F.lit(25)), F.pmod(k * 3 + 1, F.lit(25)))).alias("dst")).where("src % 3 <> 2")
    regs = table(spark, sf, "region").select(F.col("r_regionkey").alias("grp"))
    edges = step.join(F.broadcast(regs)).select("grp", "src", "dst")  # five regions by definition
    seeds = n.where("n_nationkey % 5 = n_regionkey").select(F.col("n_regionkey").alias("grp"), k.alias("node"))
    depth = regions.closure(edges, seeds).withColumnRenamed("grp", "g")
    every = n.join(F.broadcast(regs)).select("grp", k.alias("node"))
    j = every.join(depth, (F.col("grp") == F.col("g")) & (every["node"] == depth["node"]), "left")
    s = F.when(F.col("depth").isNull(), "outside").when(F.col("depth") >= 3, ">=3").otherwise(F.col("depth").cast("string"))
    return j.groupBy("grp", s.alias("stratum")).agg(F.count("*").alias("n")).withColumn("grp", big("grp"))


@query
def textual_reaching_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Each use of a word joined to its earlier lines, or to all of its lines if none is earlier."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.explode(F.array_distinct(T.idents(F.col("text")))).alias("tok"))
    use = c.where("role = 'user'").select("conv_id", "tok", F.col("turn").alias("at"))
    define = c.where("role <> 'user'").select("conv_id", "tok", F.col("turn").alias("def"))
    j = use.join(define, ["conv_id", "tok"])
    before = F.count_if(F.col("def") <= F.col("at")).over(Window.partitionBy("conv_id", "tok", "at"))
    kept = j.withColumn("nb", before).where("def <= at or nb = 0")
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("nb") == 0).alias("n_fallback"))


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, code): the table of functions that the slicing queries read."""
    from .study import order_functions

    return order_functions(spark, sf)


@query
def c_statement_units(spark: SparkSession, sf: str) -> DataFrame:
    """Statement units of code: lines, definitions, uses, sink reasons, enclosing predicates."""
    ship(spark)
    u = _functions(spark, sf).select("id", F.explode(code.statement_units(F.col("code"))).alias("u"))
    join = lambda c: F.array_join(c, ",")
    return u.select("id", big("u.sid").alias("sid"), big("u.start_line").alias("start_line"), big("u.end_line").alias("end_line"), join("u.defs").alias("defs"), join("u.uses").alias("uses"), join("u.reasons").alias("reasons"), "u.is_pred")


@query
def c_backward_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Slices of code under criterion tiers and dependence kinds, forward regions, depths and normal forms."""
    ship(spark)
    text = lambda a: F.array_join((F.col(a) if isinstance(a, str) else a).cast("array<string>"), ",")
    v = _functions(spark, sf).select("id", code.slice_views("code").alias("v"))
    return v.select("id", text("v.kept").alias("slice"), text("v.sinks").alias("sinks"), "v.status", text("v.memory").alias("memory_slice"), text("v.data").alias("data_slice"), text("v.forward").alias("forward"), text(F.array_intersect("v.forward", "v.kept")).alias("chop"), "v.norm")


# -- orders and effort ---------------------------------------------------------------------------------------


def efforts(spark: SparkSession, sf: str) -> DataFrame:
    _, lines, pairs = pair_lines(spark, sf)
    deleted = materialize(regions.deleted_lines(lines, pairs), "deleted")
    own = lines.join(pairs.select(F.col("x").alias("doc_id")), "doc_id", "left_semi")
    region = regions.mention_region(own, sink("sparse")).withColumn("in_r", F.lit(True))
    near = regions.nearest_sink(own, sink("sparse")).join(region, ["doc_id", "line_idx"], "left").select("doc_id", "line_idx", "dist", F.coalesce("in_r", F.lit(False)).alias("in_region"))
    parts = [regions.effort(regions.reading_order(near, kind), deleted).withColumn("kind", F.lit(kind)) for kind in ("top_down", "region_first", "sink_proximity")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def reading_order_effort(spark: SparkSession, sf: str) -> DataFrame:
    """Initial false alarms, effort and top-k of three reading orders, and what a random order expects."""
    e = efforts(spark, sf)
    n, d = F.col("n_lines"), F.col("n_hits")
    return e.groupBy("kind").agg(
        F.count("*").alias("n"), r6(F.avg("ifa")).alias("ifa"), r6(F.avg("effort")).alias("effort"), *[r6(F.avg(f"top{k}")).alias(f"top{k}") for k in (1, 3, 5, 10)],
        r6(F.avg(M.random_order_ifa(n, d))).alias("rnd_ifa"), r6(F.avg(M.random_order_effort(n, d))).alias("rnd_effort"), r6(F.avg(M.random_order_topk(n, d, 3))).alias("rnd_top3"),
    )


@query
def effort_cdf(spark: SparkSession, sf: str) -> DataFrame:
    """Share of documents whose first hit comes before line k, k = 0..30, per order."""
    e = efforts(spark, sf).select("kind", "ifa", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("k"))
    return e.groupBy("kind", big("k").alias("k")).agg(r6(F.avg((F.col("ifa") < F.col("k")).cast("double"))).alias("share"))


# -- aggregations ----------------------------------------------------------------------------------------------


@query
def strata_fix_size(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by number of lines (1, 2-5, more): means, medians."""
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("d"), F.avg("l_discount").alias("disc"), F.sum("l_quantity").alias("qty"))
    s = F.when(F.col("d") <= 1, "1").when(F.col("d") <= 5, "2-5").otherwise(">5")
    o = materialize(o.withColumn("stratum", s), "orders")
    q = S.grouped_quantiles(o, ["stratum"], "qty", [0.5])
    return o.groupBy("stratum").agg(F.count("*").alias("n"), r6(F.avg("disc")).alias("mean_disc")).join(q, "stratum").select("stratum", "n", "mean_disc", r6(F.col("q")[0]).alias("median_qty"))


@query
def strata_nearest_rank_quartile(spark: SparkSession, sf: str) -> DataFrame:
    """Length quartiles by floor nearest rank, bins closed above."""
    d = table(spark, sf, "documents").select("doc_id", big(F.length("text")).alias("n"))
    counts = d.groupBy("n").agg(F.count("*").alias("c"))
    upto = S.running(counts, ["n"], ["c"]).withColumnRenamed("c_upto", "upto").join(F.broadcast(counts.agg(F.sum("c").alias("total"))))  # one row
    cut = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total"))), F.col("n")))
    cuts = upto.agg(cut(0.25).alias("c1"), cut(0.5).alias("c2"), cut(0.75).alias("c3"))
    j = d.join(F.broadcast(cuts))  # one row
    b = F.when(F.col("n") <= F.col("c1"), 1).when(F.col("n") <= F.col("c2"), 2).when(F.col("n") <= F.col("c3"), 3).otherwise(4)
    return j.groupBy(big(b).alias("bin")).agg(F.count("*").alias("n_docs"), F.min("n").alias("lo"), F.max("n").alias("hi"))


@query
def quartile_digitize(spark: SparkSession, sf: str) -> DataFrame:
    """Linear quartiles and bins closed below, with means per bin."""
    line = table(spark, sf, "lineitem").select("l_extendedprice", "l_discount")
    q = S.grouped_quantiles(line, [], "l_extendedprice", [0.25, 0.5, 0.75])
    j = line.join(F.broadcast(q))  # one row
    x = F.col("l_extendedprice")
    b = F.when(x < F.col("q")[0], 0).when(x < F.col("q")[1], 1).when(x < F.col("q")[2], 2).otherwise(3)
    return j.groupBy(big(b).alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("l_discount")).alias("mean_disc"), r6(F.min(x)).alias("lo"))


@query
def quantile_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles and shares over thresholds of region coverage."""
    m = materialize(pair_measures(spark, sf), "measures")
    q = S.grouped_quantiles(m, [], "cov", [0.25, 0.5, 0.75])
    pct = lambda c: r6(F.avg(c.cast("double")) * 100)
    g = m.agg(F.count("*").alias("n"), pct(F.col("cov") >= 0.999).alias("full"), pct(F.col("cov") >= 0.9).alias("most"), pct(F.col("cov") <= 0.25).alias("little"))
    return g.join(F.broadcast(q), F.lit(True), "left").select("n", *[r6(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "full", "most", "little")


@query
def category_min_n_both_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with at least five labelled documents in either arm."""
    j = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    a, b = F.col("quality") == 1, F.col("quality") == 0
    g = j.groupBy("source").agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), r6(F.avg(F.when(a, F.col("n_chars")))).alias("mean_a"), r6(F.avg(F.when(b, F.col("n_chars")))).alias("mean_b"))
    return g.where("n_a >= 5 and n_b >= 5")


@query
def composition_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The eight largest sources with shares of all documents, and distinct counts (a top-k report)."""
    d = table(spark, sf, "documents")
    g = d.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("n_langs"))
    g = g.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(S.everything()), 1)).withColumn("n_sources", F.count("*").over(S.everything())).withColumn("largest", F.max("n").over(S.everything()))
    return g.orderBy(F.col("n").desc(), "source").limit(8)


@query
def commit_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of per-order means, and the plain mean."""
    line = table(spark, sf, "lineitem")
    per = line.groupBy("l_orderkey").agg(F.avg("l_discount").alias("m"), F.sum("l_discount").alias("s"), F.count("*").alias("c"))
    return per.agg(F.count("*").alias("n_orders"), r6(F.avg("m")).alias("weighted"), r6(F.sum("s") / F.sum("c")).alias("plain"))


@query
def pooled_and_grouped(spark: SparkSession, sf: str) -> DataFrame:
    """Per-region and pooled summaries in one pass: grouping sets."""
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = j.groupingSets([["r_name"], []], "r_name").agg(F.count("*").alias("n"), r6(F.avg("c_acctbal")).alias("mean_bal"))
    return g.select(F.coalesce("r_name", F.lit("pooled")).alias("grp"), "n", "mean_bal")


@query
def json_props_extract(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON property as a number and as a map, counted per key and type."""
    e = table(spark, sf, "events")
    m = F.from_json("props", "map<string,bigint>")
    long = e.select("event_type", "value", F.explode(m).alias("k", "v"))
    return long.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("most"), r6(F.avg("value")).alias("mean_value"))


@query
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: daily counts of events as a stream, equal to the batch result."""
    s = windows.run_available(spark, f"{sf}/events.parquet")
    return s.select("start", "event_type", "n", r6("total").alias("total"))


# -- deltas, matching, thresholds -----------------------------------------------------------------------------


def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """Per pair: word sets of before, after, and of the sparse region's lines."""
    docs, _, pairs = pair_lines(spark, sf)
    feats = docs.select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("f"))
    j = pairs.join(feats.select(F.col("doc_id").alias("x"), F.col("f").alias("before")), "x").join(feats.select(F.col("doc_id").alias("y"), F.col("f").alias("after")), "y")
    return j.withColumn("delta", F.array_except("after", "before"))


@query
def feature_delta_test_a(spark: SparkSession, sf: str) -> DataFrame:
    """Share of pairs with new features, and of those where the delta lies more in after than in before."""
    p = pair_features(spark, sf)
    grown = A.containment(F.col("delta"), F.col("after")) > A.containment(F.col("delta"), F.col("before"))
    some = F.size("delta") > 0
    return p.agg(F.count("*").alias("n"), F.count_if(some).alias("n_delta"), r6(F.avg(some.cast("double"))).alias("share"), F.count_if(some & grown).alias("n_grown"), r6(F.avg(F.size("delta"))).alias("mean_size"))


@query
def delta_negative_control(spark: SparkSession, sf: str) -> DataFrame:
    """The same test on pairs that delete no line, restricted to pairs both arms can use."""
    _, lines, pairs = pair_lines(spark, sf)
    gone = regions.deleted_lines(lines, pairs).select(F.col("doc_id").alias("x")).distinct()
    p = pair_features(spark, sf).where(F.size("before") > 0)
    arm = lambda df, name: df.agg(F.lit(name).alias("arm"), F.count("*").alias("n"), F.count_if(F.size("delta") > 0).alias("n_delta"))
    return arm(p.join(gone, "x", "left_semi"), "with_deletions").unionByName(arm(p.join(gone, "x", "left_anti"), "control"))


def benchmark_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's nearest benchmark item by containment, and whether it holds the item's text."""
    docs, items = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), table(spark, sf, "benchmark")
    words = F.array_distinct(T.words(F.col("text")))
    near = nearest.by_overlap(docs.select(F.col("doc_id").alias("q"), words.alias("feats")), items.select(F.col("item_id").alias("s"), words.alias("feats")))
    j = near.join(docs.select(F.col("doc_id").alias("q"), F.col("text").alias("dt")), "q").join(items.select(F.col("item_id").alias("s"), F.col("text").alias("it")), "s", "left")
    return j.select("q", "s", "score", F.coalesce(F.col("dt").contains(F.col("it")), F.lit(False)).alias("actual"))


TAUS = [i / 10 for i in range(1, 11)]


@query
def nearest_signature_tau_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Containment of the nearest signature as a detector: confusion and metrics per threshold."""
    s = match.tau_sweep(benchmark_scores(spark, sf).withColumn("score", F.round("score", 9)), TAUS)
    return s.select("tau", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("prec", "rec", "f1", "bal_acc", "mcc")])


@query
def best_tau_and_fp_reduction(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold of best F1, and how many false positives it saves against the lowest one."""
    s = match.tau_sweep(benchmark_scores(spark, sf).withColumn("score", F.round("score", 9)), TAUS)
    s = materialize(s, "sweep")
    b, low = match.best_tau(s), s.agg(F.max_by("fp", -F.col("tau")).alias("fp_low"), F.max_by(M.always_positive_f1(F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), -F.col("tau")).alias("always_f1"))
    return b.join(low).select("tau", r6("f1").alias("f1"), "fp", "fp_low", r6(T.ratio(F.col("fp_low") - F.col("fp"), F.col("fp_low"))).alias("fp_reduction"), r6("always_f1").alias("always_f1"))


@query
def nearest_jaccard_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark item's nearest document by Jaccard similarity of word sets."""
    words = lambda df, k, n: df.select(F.col(k).alias(n), F.array_distinct(T.words(F.col("text"))).alias("feats"))
    near = nearest.by_overlap(words(table(spark, sf, "benchmark"), "item_id", "q"), words(spread(table(spark, sf, "documents"), "doc_id"), "doc_id", "s"), jaccard=True)
    return near.select(F.col("q").alias("item_id"), r6("score").alias("score"))


@query
def nearest_jaccard_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest other vector of every vector whose id is divisible by 20, among all."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    near = nearest.by_angle(q, e.select(F.col("vec_id").alias("s"), F.col("embedding").alias("v")))
    return near.select(F.col("q").alias("vec_id"), F.round("score", 5).alias("score"))


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, up): the line graph of every document as arrays."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.withColumn("up", graph.later(F.col("text"), lambda line: line.rlike("[0-9]")))


@query
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Line graphs of documents: edges per kind of size."""
    total = lambda of: F.aggregate(F.transform("up", of), F.lit(0).cast("bigint"), lambda a, x: a + x)
    span = total(lambda own, i: F.aggregate(own, F.lit(0).cast("bigint"), lambda a, j: a + j - i))
    return _graph(spark, sf).select("doc_id", total(lambda own: F.size(own)).alias("n_edges"), span.alias("span")).where("n_edges > 0")


@query
def normalized_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the normalised adjacency, summed per document."""
    w = _graph(spark, sf).select("doc_id", F.flatten(graph.let(graph.around(F.col("up")), graph.weights)).alias("w")).where(F.size("w") > 0)
    return w.select("doc_id", big(F.size("w")).alias("n"), r6(F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).alias("weight"))


@query
def propagate_mean_max(spark: SparkSession, sf: str) -> DataFrame:
    """One propagation step of line lengths, pooled by mean and maximum."""
    lengths = F.transform(F.slice(T.lines(F.col("text")), 1, 80), lambda line: F.length(line).cast("double"))
    x = _graph(spark, sf).where(F.size("up") > 0).select("doc_id", graph.spread(graph.around(F.col("up")), lengths).alias("x"))
    return x.select("doc_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x"), 4).alias("mean_x"), F.round(F.array_max("x"), 4).alias("max_x"))


# -- statistics -----------------------------------------------------------------------------------------------------


def line_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Paired measures of documents: shares of lines with a comma (a) and of lines over 60 characters (b), in 1/1000."""
    _, lines = docs_lines(spark, sf)
    share = lambda c: big(F.floor(1000 * F.avg(c.cast("double")) + 1e-9))
    return lines.groupBy("doc_id").agg(share(sink("all")).alias("a"), share(F.length("line") > 60).alias("b"))


@query
def wilcoxon_w_z(spark: SparkSession, sf: str) -> DataFrame:
    w = S.wilcoxon(line_shares(spark, sf))
    return w.select("n", r6("w").alias("w"), r6("z").alias("z"))


@query
def cliffs_delta(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    c = S.cliffs_delta(j.where("quality = 1").select(F.col("n_chars").alias("v")), j.where("quality = 0").select(F.col("n_chars").alias("v")))
    return c.select("n", "m", r6("delta").alias("delta"))


@query
def spearman_rho(spark: SparkSession, sf: str) -> DataFrame:
    s = S.spearman(line_shares(spark, sf))
    return s.select("n", r6("rho").alias("rho"))


@query
def mcnemar_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Two detectors on the same labelled documents: who is right where."""
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), F.col("text").rlike("[0-9]").alias("digits"))
    j = d.join(table(spark, sf, "labels"), "doc_id").select(((F.col("n") > 1500) == (F.col("quality") == 1)).alias("a"), (~F.col("digits") == (F.col("quality") == 1)).alias("b"))
    return S.mcnemar(j).drop("p")


def fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """(repeat, fold, a, b): accuracy of two detectors per fold of six repeats."""
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), F.col("text").rlike("[0-9]").alias("digits"))
    j = d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    r = folds.repeated_folds(j, "quality", "doc_id", repeats=6)
    ok = lambda c: F.avg((c == (F.col("quality") == 1)).cast("double"))
    return r.groupBy("repeat", "fold").agg(ok(F.col("n") > 1500).alias("a"), ok(~F.col("digits")).alias("b"), F.count("*").alias("n_test"))


@query
def nb_corrected_t(spark: SparkSession, sf: str) -> DataFrame:
    d = fold_metrics(spark, sf).select((F.col("a") - F.col("b")).alias("d"))
    return S.corrected_t(d, 0.25).select("j", r6("mean").alias("mean"), r6("t").alias("t"))


@query
def holm_adjust(spark: SparkSession, sf: str) -> DataFrame:
    """Holm's correction of one p-value per source: twice the share of labelled documents that are bad; null where none is labelled."""
    j = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    p = j.groupBy("source").agg((F.count_if(F.col("toxic") == 1) / F.nullif(F.count("toxic") * F.lit(20.0), F.lit(0.0))).alias("p"))
    h = S.holm(p.select(F.col("source").alias("name"), "p"))
    return h.select("name", r6("p").alias("p"), r6("adjusted").alias("adjusted"))


@query
def mean_diff_ci(spark: SparkSession, sf: str) -> DataFrame:
    d = fold_metrics(spark, sf).select("repeat", (F.col("a") - F.col("b")).alias("d"))
    return S.mean_diff_ci(d, "d", ("repeat",)).select("repeat", *[r6(c).alias(c) for c in ("mean", "lo", "hi", "std_pop")])


@query
def per_fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and population deviation over folds, per repeat."""
    m = fold_metrics(spark, sf)
    return m.groupBy("repeat").agg(F.sum("n_test").alias("n"), r6(F.avg("a")).alias("mean_a"), r6(F.stddev_pop("a")).alias("std_a"), r6(F.avg("b")).alias("mean_b"), r6(F.stddev_pop("b")).alias("std_b"))


@query
def bootstrap_mean_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile interval of the mean of per-source means, 1000 resamples."""
    g = table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("v"))
    b = S.bootstrap_mean(g.withColumn("v", F.round("v", 3)), "v", "source")
    return b.select(r6("lo").alias("lo"), r6("hi").alias("hi"))


@query
def bootstrap_f1_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the F1 of a detector over labelled documents, 100 resamples."""
    d = table(spark, sf, "documents").select("doc_id", (~F.col("text").rlike("[0-9]")).alias("hat"))
    j = d.join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("y")), "doc_id")
    r = S.resamples(j, "doc_id", 100, "bootf1").groupBy("resample").agg(
        *[F.sum(F.when(c, F.col("times")).otherwise(0)).alias(n) for n, c in (("tp", F.col("hat") & F.col("y")), ("fp", F.col("hat") & ~F.col("y")), ("fn", ~F.col("hat") & F.col("y")))]
    )
    o = S.order_statistics(r.select(M.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1")), "f1", 100)
    return o.select(r6("lo").alias("lo"), r6("hi").alias("hi"))


# -- samples, folds, models ------------------------------------------------------------------------------------------


@query
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    """One positive to four negatives, by hash order (sampling is the operator)."""
    s = folds.balanced_sample(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 100)
    return s.select("doc_id", big("toxic").alias("toxic"))


@query
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    f = folds.stratified_folds(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")
    return f.select("doc_id", "fold")


@query
def repeated_folds(spark: SparkSession, sf: str) -> DataFrame:
    f = folds.repeated_folds(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")
    return f.groupBy("repeat", "fold", big("quality").alias("quality")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


@query
def grouped_folds_simple(spark: SparkSession, sf: str) -> DataFrame:
    f = folds.group_folds(table(spark, sf, "documents").select("doc_id", "source"), "source")
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_groups"))


@query
def grouped_folds_stratified(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy stratified group folds: no source is split."""
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    f = folds.stratified_group_folds(d, "source", "quality")
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_groups"), F.count_if(F.col("quality") == 1).alias("n_pos"))


@query
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    """TF-IDF of words, unit rows; per document the number of terms, the largest weight and the sum."""
    toks = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(T.words(F.col("text"))).alias("pos", "tok"))
    w = model.tfidf(toks)
    return w.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n_terms"), r6(F.max("weight")).alias("top"), F.round(F.sum("weight"), 5).alias("total"))


def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.length(F.regexp_replace("text", r"[^\p{L}]", "")).alias("l"), F.length("text").alias("n"))
    return d.join(table(spark, sf, "labels"), "doc_id").select(F.round(F.col("l") / F.greatest(F.col("n"), F.lit(1)), 2).alias("score"), (F.col("quality") == 1).alias("actual"))


@query
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return match.average_precision(quality_scores(spark, sf)).select(r6("ap").alias("ap"), "n_pos")


@query
def best_f1_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return match.best_f1_threshold(quality_scores(spark, sf)).select(r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query
def ranked_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Detectors ranked by F1, those without a value last."""
    j = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), F.col("text").rlike("[0-9]").alias("digits"), F.col("text").contains("|").alias("pipe")).join(table(spark, sf, "labels"), "doc_id")
    y = F.col("quality") == 1
    arms = {"length": F.col("n") > 1500, "no_digits": ~F.col("digits"), "no_pipe": ~F.col("pipe")}
    parts = [j.agg(*M.confusion(c, y)).select(F.lit(k).alias("name"), M.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1")) for k, c in arms.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(spark.createDataFrame([("unavailable", None)], "name string, f1 double"))
    rank = F.row_number().over(S.everything().orderBy(F.col("f1").desc_nulls_last(), "name"))
    return every.select(big(rank).alias("rank"), "name", r6("f1").alias("f1"))


def _detection(spark: SparkSession, sf: str, repeats: int = 2) -> DataFrame:
    """The detection set: a balanced sample of labelled documents with repeated stratified folds."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    s = folds.balanced_sample(labels.withColumn("label", 1 - F.col("label")), "label", "doc_id", 500)
    return folds.repeated_folds(s, "label", "doc_id", repeats=repeats)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return region_mention_coverage(spark, sf)


from . import joins, study  # noqa: E402, F401  (register their queries)
