"""Column helpers on text: lines, identifiers, tokens, n-grams, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENT = "[A-Za-z_][A-Za-z0-9_]*"
CODE_TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
WORD = "[a-z0-9_]{2,}"
#: Line ends as Python's splitlines() has them.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Without white space at both ends (all of it, not only blanks)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def has_text(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def lines(c: Column) -> Column:
    """The lines of a text; a last, empty one behind a line end does not count."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def idents(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IDENT), F.lit(0))


def code_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CODE_TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def bigrams(tokens: Column) -> Column:
    return F.when(
        F.size(tokens) >= 2, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))
    ).otherwise(F.array().cast("array<string>"))


def feature_tokens(c: Column) -> Column:
    """A bag of features: split at single spaces, case kept; EMPTYFEAT where there is none."""
    return F.filter(F.split(F.coalesce(F.nullif(c, F.lit("")), F.lit("EMPTYFEAT")), " "), lambda t: t != "")


def simple_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def is_positive(c: Column) -> Column:
    """A label that is 1, "1" or true; 1.0 passes, the words true and True do not."""
    return F.coalesce(c.cast("string").isin("1", "1.0"), F.lit(False))


def is_positive_text(c: Column) -> Column:
    """The variant that goes by the printed value."""
    return F.coalesce(c.cast("string").isin("1", "True", "true"), F.lit(False))


def is_negative(c: Column) -> Column:
    """0, "0" or false: not the complement of is_positive(), as null is neither."""
    return F.coalesce(c.cast("string").isin("0", "0.0"), F.lit(False))


def group_key(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cs])


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b as double, and a defined value where b is 0."""
    out = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def salt(*parts: Column | str) -> Column:
    """A number from the md5 of the joined parts, equal in other engines: 32 bits."""
    cs = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat(*cs).cast("binary")), 1, 8), 16, 10).cast("bigint")


def miss_kind(line: Column, depends: Column) -> Column:
    """Why a deleted line is not in a region: a cascade of patterns over its code."""
    code = strip(line)
    return (
        F.when((code == "") | code.rlike(r"^(//|/\*|\*)") | code.rlike(r"^[{};()\s]*$"), "cosmetic")
        .when(code.rlike(r"^\}?\s*(if|else|for|while|do|switch|case|default|goto|return|break|continue)\b"), "control_structure_change")
        .when(code.rlike(r"^(const |static |unsigned |signed |struct |enum |union )*[A-Za-z_]\w*[\s*]+[A-Za-z_]\w*(\s*\[[^\]]*\])?\s*(=|;|,)") & ~depends, "declaration_type_change")
        .otherwise("outside_dependence_cone")
    )


def insertion_kind(line: Column) -> Column:
    code = strip(line)
    return (
        F.when(code.rlike(r"^\}?\s*(else\s+)?(if|while|switch)\b"), "absent_guard")
        .when(code.rlike(r"\b(free|close|release|unlock|put|destroy|goto|return)\b|\berr"), "error_handling_cleanup")
        .otherwise("other_insertion")
    )
