"""Source code as rows: functions, statements, features, slices, profiles, diffs.

Arrow-batched Python where the semantics need a parser or the sequence matcher; equal
texts are parsed once per batch.  These never raise: odd code gives a status.
"""

from __future__ import annotations

import difflib
import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import csource as C
from ..functions.markup import xml_features
from ..runtime import ship

UNITS = "array<struct<sid:int,at:int,start_line:int,end_line:int,is_pred:boolean,defs:array<string>,uses:array<string>,reasons:array<string>,enclosing:array<int>>>"


def _each(kind: str, f: Callable) -> Callable[..., Column]:
    """A pandas UDF over one or more string columns that calls f per distinct row of a batch."""

    def batch(it: Iterator) -> Iterator:
        memo = functools.lru_cache(maxsize=4096)(f)
        for cols in it:
            cols = cols if isinstance(cols, tuple) else (cols,)
            found = [memo(*(x if isinstance(x, str) else "" for x in row)) for row in zip(*cols, strict=True)]
            yield pd.DataFrame(found) if kind.startswith("struct") else pd.Series(found, dtype=object)

    def call(*cols: Column) -> Column:
        # the hints that Spark reads: a series or a tuple of them, and a frame for structs
        batch.__annotations__ = {"it": Iterator[pd.Series if len(cols) == 1 else tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame if kind.startswith("struct") else pd.Series]}
        return F.pandas_udf(batch, kind)(*cols)

    return call


def _units(code: str) -> list[dict]:
    return [
        {"sid": u.sid, "at": u.at, "start_line": u.start_line, "end_line": u.end_line, "is_pred": u.is_pred, "defs": sorted(u.defs), "uses": sorted(u.uses), "reasons": sorted(u.reasons), "enclosing": list(u.enclosing)}
        for u in C.statements(code)
    ]


statement_units = _each(UNITS, _units)
parameter_names = _each("array<string>", C.parameters)
line_features = _each("array<struct<line:int,feat:string>>", lambda c: [{"line": a, "feat": b} for a, b in C.features(c)])
xml_line_features = _each("array<struct<line:int,feat:string>>", lambda x: [{"line": a, "feat": b} for a, b in xml_features(x)])
variable_profiles = _each("array<struct<variable:string,def:array<int>,use:array<int>,dvars:array<string>,pointers:array<string>,cfuncs:map<string,int>>>", C.profiles)
forward_region = _each("array<int>", C.forward_lines)
walk = _each("array<struct<step:int,line:int,uses:array<string>,added_data:array<int>,added_control:array<int>>>", C.trace)
normalized = _each("string", C.normalize)
file_functions = _each("array<struct<name:string,line:int,text:string>>", lambda c: [{"name": a, "line": b, "text": x} for a, b, x in C.functions(c)])


def backward_slice(tier: str = "all", kinds: tuple[str, ...] = ("data", "control")) -> Callable[..., Column]:
    def f(code: str) -> dict:
        kept, sinks, status = C.slice_lines(code, tier, kinds)
        return {"kept": kept, "sinks": sinks, "status": status}

    return _each("struct<kept:array<int>,sinks:array<int>,status:string>", f)


#: All measures of a function at once, so that it is read once; see csource.measures().
slice_measures = _each(
    "struct<n_lines:int,status:string,sinks:array<int>,kept:array<int>,data:array<int>,memory:array<int>,memory_status:string,depth:int,n_units:int>", C.measures
)


VIEWS = pa.struct([(c, pa.string() if c in ("status", "norm") else pa.list_(pa.int32())) for c in ("kept", "sinks", "status", "memory", "data", "forward", "norm")])


def _views(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    memo = functools.lru_cache(maxsize=1 << 14)(C.views)
    for codes in batches:
        found = [memo(C.nameless(c or "")) for c in codes.to_pylist()]
        yield pa.StructArray.from_arrays([pa.array([x[f.name] for x in found], f.type) for f in VIEWS], fields=list(VIEWS))


def slice_views(code: Column | str) -> Column:
    """All slices of a function, its forward region and its normal form, from one reading; functions that differ in their names only are read once."""
    kind = "struct<kept:array<int>,sinks:array<int>,status:string,memory:array<int>,data:array<int>,forward:array<int>,norm:string>"
    return F.arrow_udf(_views, kind)(code)


def slice_depths(code: Column) -> Column:
    """Per unit reached: its lines and the least hops from a sink."""

    def f(text: str) -> list[dict]:
        units = C.statements(text)
        d = C.depths(units, C.criteria(units) or [u.sid for u in units[-1:]])
        return [{"start_line": u.start_line, "end_line": u.end_line, "depth": d[u.sid]} for u in units if u.sid in d]

    return _each("array<struct<start_line:int,end_line:int,depth:int>>", f)(code)


def line_diff(before: str, after: str) -> dict:
    """Deleted and added lines, insertion anchors and inserted blocks, 0-based, of two texts."""
    a, b = before.splitlines(), after.splitlines()
    deleted, added, anchors, blocks = set(), set(), set(), []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag in ("replace", "delete"):
            deleted.update(range(i1, i2))
        if tag in ("replace", "insert"):
            added.update(range(j1, j2))
        if tag == "insert" and a:
            anchors.update({max(0, i1 - 1)} | ({i1} if i1 < len(a) else set()))
            blocks.append({"anchor": max(0, i1 - 1), "lines": b[j1:j2]})
    return {"deleted": sorted(deleted), "added": sorted(added), "anchors": sorted(anchors), "blocks": blocks}


#: The matcher is quadratic at worst; a pair is one row, so long pairs spread over tasks.
diff = _each("struct<deleted:array<int>,added:array<int>,anchors:array<int>,blocks:array<struct<anchor:int,lines:array<string>>>>", line_diff)


def functions_of(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, name, line, code) of files; the first definition of a name in a file counts."""
    ship(files.sparkSession)
    text = F.decode(F.col(content_col), "UTF-8") if dict(files.dtypes)[content_col] == "binary" else F.col(content_col)
    rows = files.select(F.col(path_col).alias("path"), F.posexplode(file_functions(text)).alias("pos", "f")).select("path", "pos", "f.name", "f.line", F.col("f.text").alias("code"))
    first = rows.groupBy("path", "name").agg(F.min(F.struct("pos", "line", "code")).alias("b"))
    return first.select("path", "name", F.col("b.line").alias("line"), F.col("b.code").alias("code"))


def slice_vector(code: Column) -> Column:
    """Of a function's profiles: sc, scvg, si, ss (profiles, covered lines, identifiers and line span, each over the number of lines)."""

    def f(text: str) -> list[float]:
        n = max(1, len(text.splitlines()))
        p = C.profiles(text)
        lines = {x for v in p for x in (*v["def"], *v["use"])}
        names = {v["variable"] for v in p} | {d for v in p for d in v["dvars"]}
        return [len(p) / n, len(lines) / n, len(names) / n, (max(lines) - min(lines) + 1) / n if lines else 0.0]

    return _each("array<double>", f)(code)


def versions_delta(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs with what a change does to the features of the slices: phi_before, phi_after, phi_removed, phi_added and phi_shared, how many stay.

    Both sides are sliced alike; features are those of the slices' lines, sorted.
    """
    sides = {"before": before, "after": after}
    out = pairs.withColumns({f"kept_{k}": slice_measures(F.col(c))["kept"] for k, c in sides.items()} | {f"feats_{k}": line_features(F.col(c)) for k, c in sides.items()})
    # slices count lines from 0, features from 1
    phi = lambda k: F.transform(F.filter(f"feats_{k}", lambda f: F.array_contains(f"kept_{k}", f["line"] - 1)), lambda f: f["feat"])
    out = out.withColumns({f"phi_{k}": F.array_sort(F.array_distinct(phi(k))) for k in sides}).drop(*[f"{p}_{k}" for p in ("kept", "feats") for k in sides])
    return out.withColumns(
        {"phi_removed": F.array_sort(F.array_except("phi_before", "phi_after")), "phi_added": F.array_sort(F.array_except("phi_after", "phi_before")), "phi_shared": F.size(F.array_intersect("phi_before", "phi_after"))}
    )


def profile_features(profiles: Column, variables: Column | None = None) -> Column:
    """Coarse features of profiles (cf:call, pt:, dv:, var:); of the given variables, or of all where none of them has a profile."""
    own = profiles if variables is None else F.filter(profiles, lambda p: F.array_contains(variables, p["variable"]))
    used = F.when(F.size(own) == 0, profiles).otherwise(own)
    tag = lambda t, xs: F.transform(xs, lambda x: F.concat(F.lit(t), x))
    each = F.transform(used, lambda p: F.flatten(F.array(tag("cf:", F.map_keys(p["cfuncs"])), tag("pt:", p["pointers"]), tag("dv:", p["dvars"]), F.array(F.concat(F.lit("var:"), p["variable"])))))
    return F.array_sort(F.array_distinct(F.flatten(each)))
