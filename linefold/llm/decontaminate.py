"""Benchmark decontamination by template canonicalisation, native DataFrame operations only.

Words become templates: numbers -> #num, units -> #unit, capitalised names -> #name, the
rest lower case; unless strict, neighbouring names, or numbers, also count as one.  Windows of n template words of
the benchmark are hash-joined with those of the documents.  Matches of one item along one
alignment, a band of neighbouring diagonals, so that words may be inserted or left out
and sentences change places within it, are then checked for slot
consistency: a value of a slot in the item always stands for one value in the document, as
it does in a re-parameterised question; equal values on all slots mean a verbatim copy.

A document counts as contaminated by an item if, along one alignment, at least
min_share of the item's windows match (and not fewer than min(min_windows, all of them)),
and the slots are consistent.  Unless strict, windows of equal words in any case count
beside the templates and need no consistency, and an inconsistent slot costs only the
windows that have it; the queries use that.  Windows with fewer than min_literal plain words are no
evidence and are left out on the benchmark's side; an item with no other window is compared
as a whole: its words, in any case, must stand in the document one after the other.

Defined cases: null or empty texts match nothing; items shorter than n words are one window
of their whole length and match at that length; rows sharing a doc_id count as one
document; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

N = 8
#: Benchmark windows up to which the hash join is a broadcast; beyond, it is a shuffle join.
BROADCAST_WINDOWS = 500_000
# Unit words.
UNITS = (
    "mm cm dm km nm inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers mg kg gram grams kilogram kilograms "
    "tonne tonnes ton tons pound pounds ounce ounces ml litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months "
    "year years percent dollar dollars euro euros cent cents mph kmh watt watts volt volts joule joules degree degrees celsius fahrenheit"
).split()
PLACED = "array<struct<pos:int,hash:bigint>>"
PAIRS = "array<struct<i:string,d:string>>"
WORD = r"[\p{L}\p{N}]+(?:[.,'’-][\p{L}\p{N}]+)*"


def surfaces(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def template(word: Column, low: Column, of: Callable[[Column], Column] = lambda w: w) -> Column:
    """The template of one word, which must not be empty, or what of() makes of it; low: the word in lower case."""
    return (
        # byte order: "0" to "9" is all that lies between "0" and ":"
        F.when((word >= "0") & (word < ":"), of(F.lit("#num")))
        .when(low == word, F.when(word.isin(UNITS), of(F.lit("#unit"))).otherwise(of(word)))
        # one capital, then lower case: a name; words all in capitals are plain
        .when((F.substring(word, 2, 1_000_000) == F.substring(low, 2, 1_000_000)) & (F.length(word) > 1), of(F.lit("#name")))
        .otherwise(of(low))
    )


def _starts(tmpl: Column, name: Column, num: Column) -> Column:
    """Where tokens begin: a run of #name or of #num is one token; tmpl, templates or their hashes, must not be empty."""
    same = lambda i: (i > 0) & (F.get(tmpl, i) == F.get(tmpl, i - 1)) & ((F.get(tmpl, i) == name) | (F.get(tmpl, i) == num))
    return F.filter(F.sequence(F.lit(0), F.size(tmpl) - 1), lambda i: ~same(i))


def _low(texts: DataFrame, id_col: str) -> DataFrame:
    """(id, words, low): words as they stand and in lower case; texts without a word are left out."""
    t = texts.where(F.col("text").isNotNull()).select(id_col, surfaces(F.col("text")).alias("words")).where(F.size("words") > 0)
    return t.select(id_col, "words", F.transform("words", F.lower).alias("low"))


def _tokens(texts: DataFrame, id_col: str) -> DataFrame:
    """(id, low, tmpl, starts, tok): the templates of the words, where runs begin among them, and the templates with runs as one."""
    t = _low(texts, id_col)
    t = t.select(id_col, "low", F.zip_with("words", "low", lambda w, x: template(w, x)).alias("tmpl"))
    t = t.select(id_col, "low", "tmpl", _starts(F.col("tmpl"), F.lit("#name"), F.lit("#num")).alias("starts"))
    return t.select(id_col, "low", "tmpl", "starts", F.transform("starts", lambda i: F.get("tmpl", i)).alias("tok"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _coded(docs: DataFrame) -> DataFrame:
    """(doc_id, starts, codes, short, plain): hashes of the templates, of those with runs as one, and of the words; runs are found by hashes."""
    t = _low(docs, "doc_id")
    t = t.select("doc_id", F.zip_with("words", "low", lambda w, x: template(w, x, F.xxhash64)).alias("codes"), _hashed(F.col("low")).alias("plain"))
    t = t.select("doc_id", "codes", "plain", _starts(F.col("codes"), F.xxhash64(F.lit("#name")), F.xxhash64(F.lit("#num"))).alias("starts"))
    return t.select("doc_id", "starts", "codes", F.transform("starts", lambda i: F.get("codes", i)).alias("short"), "plain")


def _rolled(coded: DataFrame, codes: str, widths: list[int]) -> DataFrame:
    """coded with a column codes_w per width: hashes of the windows of w codes, in order.

    By doubling: a window's hash comes from those of two shorter ones that cover it, so a
    window costs a hash of two numbers per step.  Each step is a column of its own.
    """
    made = {1: codes}

    def of(w: int) -> str:
        nonlocal coded
        if w not in made:
            half = 1 << ((w - 1).bit_length() - 1)  # the largest power of two below w
            have = of(half)
            name = f"{codes}_{w}"
            coded = coded.withColumn(name, F.zip_with(have, F.slice(have, w - half + 1, F.greatest(F.size(have), F.lit(1))), lambda x, y: F.xxhash64(x, y)))
            coded = coded.withColumn(name, F.slice(name, 1, F.greatest(F.size(codes) - w + 1, F.lit(0))))
            made[w] = name
        return made[w]

    for w in widths:
        of(w)
    return coded


def _every(codes: str, width: int) -> Column:
    """Places and hashes of all windows; see _rolled()."""
    own = f"{codes}_{width}" if width > 1 else codes
    places = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1)).otherwise(F.array().cast("array<int>"))
    return F.arrays_zip(places.alias("pos"), F.col(own).alias("hash")).cast(PLACED)


def _runs(width: int) -> Column:
    """The same of the windows in which a run of names or numbers counts as one word; those without a run are left out."""
    own = f"short_{width}" if width > 1 else "short"
    spans = F.filter(F.sequence(F.lit(0), F.size("short") - width), lambda k: F.get("starts", k + width - 1) > F.get("starts", k) + width - 1)
    every = F.transform(spans, lambda k: F.struct(F.get("starts", k).alias("pos"), F.get(own, k).alias("hash")))
    return F.when((F.size("short") >= width) & (F.size("short") < F.size("plain")), every).otherwise(F.array().cast(PLACED))


def _windows(coded: DataFrame, shapes: dict[int, set[str]]) -> DataFrame:
    """(doc_id, pos, hash) of the windows of all widths and kinds, in one pass; pos counts words.

    Hashes of windows of different widths differ like those of different words.  They are
    those of _rolled(), but the widest, most of them, are made per place, where Spark
    compiles them: functions over arrays are not compiled, and took most of the time.
    Arrays hold the shorter ones, and parts of the widest beyond eight words, as the Java
    compiler leaves out methods that are too long.
    """
    widths = sorted(shapes)
    part = max(1, (1 << (widths[-1] - 1).bit_length()) // 8)
    held = sorted({*widths[:-1], part} - {1})
    source = {kind: codes for kind, codes in (("template", "codes"), ("words", "plain"), ("runs", "short")) if any(kind in kinds for kinds in shapes.values())}
    for codes in source.values():
        coded = _rolled(coded, codes, held)
    none = F.array().cast("array<bigint>")

    def joined(w: int) -> Column:
        """The hashes of w words of each kind, one kind behind the other, each as long as its words."""
        own = {codes: F.col(f"{codes}_{w}" if w > 1 else codes) for codes in source.values()}
        pad = lambda c: F.concat(own[c], F.array_repeat(F.lit(0).cast("bigint"), F.size(c) - F.size(own[c]))) if w > 1 else own[c]
        return F.concat(*[F.when(F.size("short") < F.size("plain"), pad(c)).otherwise(none) if c == "short" else pad(c) for c in source.values()])

    size = [F.when(F.size("short") < F.size("plain"), F.size("short")).otherwise(0) if c == "short" else F.size(c) for c in source.values()]
    ends = [reduce(Column.__add__, size[: k + 1]).alias(f"end_{k}") for k in range(len(size))]
    t = coded.select("doc_id", "starts", *ends, *[joined(w).alias(f"all_{w}") for w in (1, *held)])
    last = len(size) - 1
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col(f"end_{last}") - 1)).alias("j"))

    def by_kind(of: Callable[[int], Column]) -> Column:
        return reduce(lambda rest, k: F.when(F.col("j") < F.col(f"end_{k}"), of(k)).otherwise(rest), range(last - 1, -1, -1), of(last))

    kinds = list(source)
    at = by_kind(lambda k: F.col("j") - (F.col(f"end_{k - 1}") if k else F.lit(0)))

    def code(j: Column, w: int) -> Column:
        if w == 1 or w in held:
            return F.get(f"all_{w}", j)
        half = 1 << ((w - 1).bit_length() - 1)
        return F.xxhash64(code(j, half), code(j + (w - half), half))

    def stands(k: int, w: int) -> Column:
        """Whether the window lies within its kind; of the windows of tokens, only those with a run are new."""
        if kinds[k] not in shapes[w]:
            return F.lit(False)
        within = F.col("j") + w <= F.col(f"end_{k}")
        return within & (F.get("starts", F.col("at") + (w - 1)) > F.get("starts", "at") + (w - 1)) if kinds[k] == "runs" else within

    t = t.withColumn("at", at)
    hashes = [F.when(by_kind(lambda k, w=w: stands(k, w)), code(F.col("j"), w)) for w in widths]
    pos = by_kind(lambda k: F.get("starts", "at") if kinds[k] == "runs" else F.col("at"))
    return t.select("doc_id", pos.alias("pos"), (hashes[0] if len(hashes) == 1 else F.explode(F.array(*hashes))).alias("hash")).where(F.col("hash").isNotNull())


def benchmark_windows(benchmark: DataFrame, n: int = N, min_literal: int = 3, strict: bool = True) -> DataFrame:
    """(item_id, ipos, kind, width, hash, total, whole): all windows of an item that carry evidence.

    An item without any is whole: all windows of its lower-case words, which must all match.
    Unless strict, the other items also have lower-case words at the places with evidence.
    """
    t = _tokens(benchmark, "item_id").withColumn("width", F.least(F.size("low"), F.lit(n)))
    every = F.sequence(F.lit(0), F.size("low") - F.col("width"))
    plain = lambda i: F.size(F.filter(F.slice("tmpl", i + 1, F.col("width")), lambda w: ~w.startswith("#")))
    t = t.withColumn("ev", F.filter(every, lambda i: plain(i) >= F.least(F.lit(min_literal), F.col("width"))))
    t = t.withColumn("whole", F.size("ev") == 0).withColumn("places", F.when(F.col("whole"), every).otherwise(F.col("ev"))).withColumn("total", F.size("places").cast("bigint"))
    t = t.withColumns({"codes": _hashed(F.col("tmpl")), "short": _hashed(F.col("tok")), "plain": _hashed(F.col("low"))})
    t = materialize(t, "decon-items")
    shapes = []
    widths = sorted(x.width for x in t.select("width").distinct().collect())
    for codes in ("codes", "short", "plain"):
        t = _rolled(t, codes, widths)
    for w in widths:
        for kind, at in (("template", _every("codes", w)), ("runs", _runs(w)), ("words", _every("plain", w))):
            if strict and kind == "runs":
                continue
            own = t.where((F.col("width") == w) & (F.col("whole") | F.lit(not strict) if kind == "words" else ~F.col("whole")))
            own = own.select("item_id", "total", "whole", "places", F.explode(at).alias("w")).where(F.array_contains("places", F.col("w.pos")))
            shapes.append(own.select("item_id", F.col("w.pos").alias("ipos"), F.lit(kind).alias("kind"), F.lit(w).alias("width"), "w.hash", "total", "whole"))
    return reduce(DataFrame.unionByName, shapes) if shapes else benchmark.sparkSession.createDataFrame([], "item_id bigint, ipos int, kind string, width int, hash bigint, total bigint, whole boolean")


def matches(docs: DataFrame, benchmark: DataFrame, n: int = N, min_literal: int = 3, strict: bool = True) -> DataFrame:
    """(doc_id, item_id, group, total, whole, spots): matched windows (ipos, pos) of one alignment.

    An alignment is a diagonal pos - ipos, or a band of neighbouring ones as wide as words
    may be inserted or left out: bands overlap by half, so diagonals up to a quarter of the
    item's windows apart (n at least) always share one.
    """
    wins = materialize(benchmark_windows(benchmark, n, min_literal, strict), "decon-windows")
    count = wins.count()
    hint = F.broadcast if count <= BROADCAST_WINDOWS else (lambda x: x)
    coded = _coded(docs)
    shapes: dict[int, set[str]] = {}
    for width, kind in wins.select("width", "kind").distinct().collect():
        shapes.setdefault(width, set()).update({"words"} if kind == "words" else {"template"} if strict else {"template", "runs"})
    if not shapes:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, group struct<g:int,b:bigint>, total bigint, whole boolean, spots array<struct<ipos:int,pos:int>>")
    bench = wins.select("item_id", "ipos", F.col("hash").alias("b_hash"), "total", "whole")
    hits = _windows(coded, shapes).join(hint(bench), F.col("hash") == F.col("b_hash")).select("doc_id", "item_id", "total", "whole", "ipos", "pos")
    hits = hits.withColumn("diag", (F.col("pos") - F.col("ipos")).cast("bigint"))
    band = F.floor(F.col("diag") / F.greatest(F.lit(n), F.col("total") / 4))
    group = lambda g, b: F.struct(F.lit(g).alias("g"), b.alias("b"))
    bands = F.when(F.col("whole"), F.array(group(0, F.col("diag")))).otherwise(F.array(group(0, F.col("diag")), group(1, band), group(1, band - 1)))
    hits = hits.withColumn("group", F.explode(bands))
    # bounded by the item's length and the band's width
    return hits.groupBy("doc_id", "item_id", "group").agg(F.max("total").alias("total"), F.max("whole").alias("whole"), F.collect_set(F.struct("ipos", "pos")).alias("spots"))


def _texts(texts: DataFrame, id_col: str, name: str, p: str) -> DataFrame:
    """Per text the columns of _tokens() and the lower-case text of each token, prefixed."""
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("low"))
    said = F.transform("starts", lambda s, k: F.array_join(F.slice("low", s + 1, end(k) - s), " "))
    return _tokens(texts, id_col).select(F.col(id_col).alias(name), *[F.col(c).alias(p + c) for c in ("low", "tmpl", "starts", "tok")], said.alias(p + "said"))


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, min_windows: int = 5, min_share: float = 0.25, min_literal: int = 3, strict: bool = True) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_windows, share, start_word, verbatim.

    strict=False also counts windows of equal words in any case, whatever the slots say, and
    of the other windows those whose slots agree with most of the alignment; strict=True
    drops an alignment with any slot that stands for two values, and takes names in a run,
    or numbers, one by one.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    benchmark = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    m = matches(docs, benchmark, n, min_literal, strict)

    def enough(spots: str) -> Column:
        hit = F.size(F.array_distinct(F.transform(spots, lambda x: x["ipos"])))
        return (hit >= F.least(F.lit(min_windows), F.col("total"))) & (hit >= F.when(F.col("whole"), 1.0).otherwise(min_share) * F.col("total"))

    m = materialize(m.where(enough("spots")), "decon-matches")
    # words of the few documents and items that remain
    ids = m.select(F.col("doc_id").alias("m_id")).distinct()
    ids = F.broadcast(ids) if ids.limit(200_001).count() <= 200_000 else ids
    # written apart: the condition that a text has words would move below the join, and split all texts again
    some = materialize(docs.join(ids, F.col("doc_id") == F.col("m_id"), "left_semi"), "decon-texts")
    words = _texts(some, "doc_id", "w_id", "d_")
    items = _texts(benchmark, "item_id", "i_id", "i_")
    both = m.join(words, F.col("doc_id") == F.col("w_id")).join(items, F.col("item_id") == F.col("i_id"))

    def seen(x: Column) -> Column:
        """What stands at a match: equal words, equal templates, and the values of the slots."""
        width = F.least(F.size("i_low"), F.lit(n))
        run = lambda c, at, k: F.slice(c, F.greatest(at, F.lit(1)), k)
        lit = run("i_low", x["ipos"] + 1, width) == run("d_low", x["pos"] + 1, width)
        word = run("i_tmpl", x["ipos"] + 1, width) == run("d_tmpl", x["pos"] + 1, width)
        i, d = (F.array_position(c, x[p]).cast("int") for c, p in (("i_starts", "ipos"), ("d_starts", "pos")))
        runs = (i > 0) & (d > 0) & (i - 1 + width <= F.size("i_tok")) & (run("i_tok", i, width) == run("d_tok", d, width))
        same = word if strict else word | runs

        def slots(tmpl: str, said_i: str, said_d: str, i: Column, d: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), width - 1), lambda j: F.get(tmpl, i + j).startswith("#"))
            return F.transform(at, lambda j: F.struct(F.get(said_i, i + j).alias("i"), F.get(said_d, d + j).alias("d")))

        pairs = F.when(word, slots("i_tmpl", "i_low", "d_low", x["ipos"], x["pos"])).otherwise(slots("i_tok", "i_said", "d_said", i - 1, d - 1))
        return F.struct(x["ipos"].alias("ipos"), x["pos"].alias("pos"), lit.alias("lit"), same.alias("same"), F.when(same & ~F.col("whole") & (F.lit(strict) | ~lit), pairs).otherwise(F.array().cast(PAIRS)).alias("pairs"))

    # of rows that share a doc_id, only those whose words stand at the matched places count
    counts = lambda x: F.when(F.col("whole"), x["lit"]).otherwise(x["same"] if strict else x["same"] | x["lit"])
    both = both.withColumn("at", F.filter(F.transform("spots", seen), counts))
    both = both.withColumn("pairs", F.flatten(F.transform("at", lambda x: x["pairs"])))
    if strict:
        kinds = F.array_distinct("pairs")
        both = both.where(F.size(kinds) == F.size(F.array_distinct(F.transform(kinds, lambda x: x["i"]))))
    else:
        # each value stands for the one that most windows give it; windows that say otherwise go
        often = F.transform(F.array_distinct("pairs"), lambda u: F.struct(u["i"].alias("i"), F.size(F.filter("pairs", lambda y: y == u)).alias("k"), u["d"].alias("d")))
        both = both.withColumn("often", F.array_sort(often))
        # sorted by value and count: the last of each value
        last = F.filter("often", lambda u, j: F.coalesce(F.get("often", j + 1)["i"] != u["i"], F.lit(True)))
        both = both.withColumn("stands", F.transform(last, lambda u: F.struct(u["i"].alias("i"), u["d"].alias("d"))))
        both = both.withColumn("at", F.filter("at", lambda x: F.forall(x["pairs"], lambda y: F.array_contains("stands", y))))
    hit = F.size(F.array_distinct(F.transform("at", lambda x: x["ipos"]))).cast("bigint")
    first = F.array_min(F.transform("at", lambda x: F.struct(x["ipos"], x["pos"])))["pos"].cast("bigint")
    verbatim = F.forall("at", lambda x: F.forall(x["pairs"], lambda y: y["i"] == y["d"]))
    good = both.where(enough("at")).select("doc_id", "item_id", hit.alias("n_windows"), (hit / F.col("total")).alias("share"), first.alias("start_word"), verbatim.alias("verbatim"))
    best = F.max(F.struct("n_windows", (-F.col("start_word")).alias("s"), "share", "verbatim"))
    return good.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_windows", "b.share", (-F.col("b.s")).alias("start_word"), "b.verbatim")


def clean(docs: DataFrame, benchmark: DataFrame, **how: float | bool) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates; rows without doc_id are judged by their text alone."""
    bad = find(docs, benchmark, **how).select(F.col("doc_id").alias("bad_id")).distinct()
    bad = materialize(bad, "decon-bad")
    out = docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")
    nameless = docs.where(F.col("doc_id").isNull() & F.col("text").isNotNull())
    if nameless.isEmpty():
        return out
    digest = F.md5(F.col("text").cast("string").cast("binary"))
    found = find(nameless.select(digest.alias("doc_id"), "text").distinct(), benchmark, **how)
    found = materialize(found.select(F.col("doc_id").alias("bad_text")).distinct(), "decon-bad")
    return out.join(found, F.when(out["doc_id"].isNull(), digest) == found["bad_text"], "left_anti")
