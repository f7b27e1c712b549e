"""A tolerant reader of C functions: tokens, statement units, definitions and uses, slices.

Plain Python without dependencies; operators.code wraps it for DataFrames.  It never
raises on odd input: what cannot be read as a statement becomes one unit, and a text
without a body is one block.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

# C keywords, words that begin a type, memory and string calls.
KEYWORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof "
    "static struct switch typedef union unsigned void volatile while _Bool bool true false NULL nullptr".split()
)
TYPE_WORDS = frozenset("auto char const double enum extern float inline int long register short signed static struct union unsigned void volatile _Bool bool".split())
MEMORY_CALLS = frozenset(
    "malloc calloc realloc free alloca memcpy memmove memset memcmp strcpy strncpy strcat strncat sprintf snprintf vsprintf vsnprintf gets fgets scanf sscanf fscanf "
    "read write recv send fread fwrite strlen strdup bcopy".split()
)
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
ARITH = frozenset("+ - * / % << >>".split())
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")

_TOKEN = re.compile(
    r"""(?P<ws>\s+|//[^\n]*|/\*.*?(?:\*/|$)|\\\n)
    |(?P<pp>(?:(?<=\n)|^)[ \t]*\#(?:[^\n\\]|\\.|\\\n)*)
    |(?P<str>L?"(?:[^"\\\n]|\\.)*"?|L?'(?:[^'\\\n]|\\.)*'?)
    |(?P<num>\.?[0-9](?:[eEpP][+-]|[0-9A-Za-z_.])*)
    |(?P<id>[A-Za-z_]\w*)
    |(?P<op>->|\+\+|--|<<=|>>=|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|\.\.\.|::|.)""",
    re.S | re.X,
)


_DIRECTIVE = re.compile(r"[ \t]*#(?:[^\n\\]|\\.|\\\n)*", re.S)
_CALLED = re.compile(r"\s*\(")
_ONE_SPACE, _BLANKS = re.compile(r"\s"), re.compile(r"[^\S\n]+")


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    line: int
    end_line: int


@dataclass
class Unit:
    """A statement: its lines, what it defines and uses, why it is a sink, and the predicates around it."""

    sid: int
    at: int
    start_line: int
    end_line: int
    is_pred: bool
    defs: set[str] = field(default_factory=set)
    uses: set[str] = field(default_factory=set)
    reasons: set[str] = field(default_factory=set)
    enclosing: tuple[int, ...] = ()


def tokens(code: str) -> list[Token]:
    """The tokens of a text; where none can go over a line's end, each line is read alone, and equal short lines once."""
    if "\\" in code or "/*" in code:
        return _scan(code)
    out, at = [], 0
    for n, line in enumerate(code.split("\n")):
        found = _line_tokens(line) if len(line) <= 200 else [(x.kind, x.text, x.at) for x in _scan(line)]
        out += [Token(kind, text, at + a, n, n) for kind, text, a in found]
        at += len(line) + 1
    return out


@functools.lru_cache(maxsize=1 << 14)
def _line_tokens(line: str) -> list[tuple[str, str, int]]:
    return [(x.kind, x.text, x.at) for x in _scan(line)]


def _scan(code: str) -> list[Token]:
    out, line = [], 0
    # a directive is matched at a line's start only; white space before it is eaten apart
    pos = 0
    while pos < len(code):
        start_of_line = pos == 0 or code[pos - 1] == "\n"
        if start_of_line and (m := _DIRECTIVE.match(code, pos)):
            kind = "pp"
        else:
            m = _TOKEN.match(code, pos)
            kind = m.lastgroup
            if kind == "ws" and (cut := m[0].find("\n")) >= 0 and not m[0].startswith(("/*", "//", "\\")):
                m = _ONE_SPACE.match(code, pos) if cut == 0 else _BLANKS.match(code, pos)
        n = m[0].count("\n")
        if kind != "ws":
            out.append(Token(kind, m[0].strip() if kind == "pp" else m[0], pos, line, line + n))
        line += n
        pos = m.end()
    return out


def _match(t: list[Token], i: int, end: int) -> int:
    """The index of the bracket that closes t[i], or end - 1."""
    depth = 0
    for j in range(i, end):
        x = t[j].text
        if x in _OPEN:
            depth += 1
        elif x in _CLOSE:
            depth -= 1
            if depth <= 0:
                return j
    return end - 1


def locate(t: list[Token]) -> tuple[int, int, int, int]:
    """(first, end) of the body's inner tokens and (first, end) of the parameters' (equal if none)."""
    n, i = len(t), 0
    while i < n:
        if t[i].kind == "op" and t[i].text == "(":
            j = _match(t, i, n)
            k = j + 1
            while k < n and t[k].kind == "id" and t[k].text not in KEYWORDS:
                k += 1  # attributes and macros behind the parameters
            if k < n and t[k].text == "{" and i and t[i - 1].kind == "id":
                return k + 1, _match(t, k, n), i + 1, j
            i = j
        elif t[i].kind == "op" and t[i].text == "{":
            return i + 1, _match(t, i, n), 0, 0
        i += 1
    return 0, n, 0, 0


def parameters(code: str) -> list[str]:
    return _parameters(tokens(code))


def _parameters(t: list[Token]) -> list[str]:
    _, _, a, b = locate(t)
    out, depth, last = [], 0, None
    for x in t[a:b] + [Token("op", ",", 0, 0, 0)]:
        if x.kind == "op" and x.text in "([":
            depth += 1
        elif x.kind == "op" and x.text in ")]":
            depth -= 1
        elif x.text == "," and depth == 0:
            if last:
                out.append(last)
            last = None
        elif x.kind == "id" and x.text not in KEYWORDS and (depth == 0 or last is None):
            last = x.text
    return out


def _is_declaration(t: list[Token]) -> int:
    """How many tokens of a statement are its type, 0 if it declares nothing."""
    i, n = 0, len(t)
    while i < n and t[i].kind == "id" and t[i].text in TYPE_WORDS:
        i += 2 if t[i].text in ("struct", "union", "enum") and i + 1 < n and t[i + 1].kind == "id" else 1
    if i:
        if i < n and t[i].kind == "id" and t[i].text not in KEYWORDS and i + 1 < n and (t[i + 1].kind == "id" or (t[i + 1].text == "*" and t[i - 1].text in ("const", "static", "register", "volatile", "extern"))):
            i += 1
        return i
    if n > 1 and t[0].kind == "id" and t[0].text not in KEYWORDS:
        j = 1
        while j < n and t[j].text == "*":
            j += 1
        if j < n and t[j].kind == "id" and t[j].text not in KEYWORDS and (j == 1 or (j + 1 < n and t[j + 1].text in "=;,[")):
            return 1
    return 0


def analyse(t: list[Token], unit: Unit) -> None:
    """Fill defs, uses and reasons of a unit from its tokens; equal short statements are judged once."""
    if len(t) > 64:
        _analyse(t, unit)
        return
    defs, uses, reasons = _analysed(tuple([(x.kind, x.text) for x in t]))
    unit.defs |= defs
    unit.uses |= uses
    unit.reasons |= reasons


@functools.lru_cache(maxsize=1 << 14)
def _analysed(words: tuple[tuple[str, str], ...]) -> tuple[set[str], set[str], set[str]]:
    u = Unit(0, 0, 0, 0, False)
    _analyse([Token(kind, text, 0, 0, 0) for kind, text in words], u)
    return u.defs, u.uses, u.reasons


def _analyse(t: list[Token], unit: Unit) -> None:
    plain: list[int] = []  # places of plain-identifier targets
    reread: set[str] = set()
    ids = {
        i for i, x in enumerate(t)
        if x.kind == "id" and x.text not in KEYWORDS and not (i and t[i - 1].text in (".", "->")) and not (i and t[i - 1].text in ("goto", "struct", "union", "enum"))
    }
    starts = {0} | {i + 1 for i, x in enumerate(t) if x.kind == "op" and x.text in ("{", "}", ";")} | {i + 2 for i, x in enumerate(t[:-1]) if x.text == "for" and t[i + 1].text == "("}
    declared: set[int] = set()
    stars: set[int] = set()
    for s in sorted(starts):
        end = next((j for j in range(s, len(t)) if t[j].kind == "op" and t[j].text in (";", "{", "}")), len(t))
        k = _is_declaration(t[s:end])
        if not k:
            continue
        for j in range(s, s + k):
            ids.discard(j)
        depth, head = 0, True
        for j in range(s + k, end):
            x = t[j]
            if x.kind == "op" and x.text in "([":
                depth += 1
            elif x.kind == "op" and x.text in ")]":
                depth -= 1
            elif x.text == "," and depth == 0:
                head = True
            elif x.text == "*" and head:
                stars.add(j)
            elif x.kind == "id" and head and x.text not in KEYWORDS and j in ids:
                unit.defs.add(x.text)
                declared.add(j)
                plain.append(j)
                head = False
                if j + 1 < end and t[j + 1].text == "[":
                    stars.add(j + 1)
    stop = {";", "{", "}", ",", "(", "[", "?", ":", "&&", "||", "return"} | ASSIGN
    for i, x in enumerate(t):
        if x.kind != "op":
            continue
        if x.text in ASSIGN:
            j, depth = i - 1, 0
            while j >= 0:
                if t[j].text in (")", "]"):
                    depth += 1
                elif t[j].text in ("(", "["):
                    if depth == 0:
                        break
                    depth -= 1
                elif depth == 0 and t[j].text in stop:
                    break
                j -= 1
            left = [m for m in range(j + 1, i) if m in ids]
            if left and left[0] not in declared:
                root = left[0]
                unit.defs.add(t[root].text)
                if i - j == 2:
                    plain.append(root)
                    if x.text != "=":
                        reread.add(t[root].text)
            depth = 0
            for m in range(i + 1, len(t)):
                if t[m].text in ("(", "["):
                    depth += 1
                elif t[m].text in (")", "]"):
                    depth -= 1
                if depth < 0 or (depth == 0 and t[m].text in (";", ",")):
                    break
                if m in ids:
                    reread.add(t[m].text)
        elif x.text in ("++", "--"):
            m = i + 1 if i + 1 in ids else next((j for j in range(i - 1, -1, -1) if j in ids), None)
            if m is not None:
                unit.defs.add(t[m].text)
                reread.add(t[m].text)
    targets = set(plain)
    unit.uses |= {t[i].text for i in ids if i not in targets} | reread
    for i, x in enumerate(t):
        nxt = t[i + 1].text if i + 1 < len(t) else ""
        prev = t[i - 1] if i else None
        value = prev is not None and (prev.kind in ("num", "str") or prev.text in (")", "]") or (prev.kind == "id" and prev.text not in KEYWORDS - {"NULL", "true", "false"}))
        if x.kind == "id" and x.text not in KEYWORDS and nxt == "(" and i not in declared:
            unit.reasons.add("call")
            if x.text in MEMORY_CALLS:
                unit.reasons.add("api")
        elif x.text == "[" and value and i not in stars:
            unit.reasons.add("subscript")
        elif x.text in ("*", "&") and x.kind == "op" and not value and i not in stars:
            unit.reasons.add("pointer")
        elif x.text == "->":
            unit.reasons.add("arrow")
        elif x.text in ARITH and value and i not in stars and (i - 1 in ids or i + 1 in ids or (prev is not None and prev.text in (")", "]") and any(j in ids for j in range(max(0, i - 8), i)))):
            unit.reasons.add("arith")


def statements(code: str) -> list[Unit]:
    """The statement units of a function, numbered in the order they are met."""
    return _statements(tokens(code))


def _statements(t: list[Token]) -> list[Unit]:
    first, end, _, _ = locate(t)
    units: list[Unit] = []

    def unit(a: int, b: int, enclosing: tuple[int, ...], is_pred: bool = False) -> Unit:
        part = t[a:b] or t[a : a + 1]
        u = Unit(len(units), part[0].at, part[0].line, part[-1].end_line, is_pred, enclosing=enclosing)
        analyse([x for x in part if x.kind != "pp"], u)
        units.append(u)
        return u

    def to_semicolon(i: int) -> int:
        depth = 0
        for j in range(i, end):
            x = t[j].text
            if x in _OPEN:
                depth += 1
            elif x in _CLOSE:
                depth -= 1
                if depth < 0:
                    return j
            elif x == ";" and depth == 0:
                return j + 1
        return end

    def skip(i: int) -> int:
        """Behind the statement at i, without units."""
        if i >= end:
            return end
        x = t[i].text
        if x == "{":
            return _match(t, i, end) + 1
        if x in ("if", "while", "for", "switch") and i + 1 < end and t[i + 1].text == "(":
            j = skip(_match(t, i + 1, end) + 1)
            return skip(j + 1) if x == "if" and j < end and t[j].text == "else" else j
        if x == "do":
            return to_semicolon(skip(i + 1))
        return to_semicolon(i)

    def block(i: int, stop: int, enclosing: tuple[int, ...], cases: bool = False) -> None:
        while i < stop:
            before = i
            i = one(i, stop, enclosing, cases)
            if i <= before:
                i = before + 1

    def one(i: int, stop: int, enclosing: tuple[int, ...], cases: bool = False) -> int:
        x = t[i]
        paren = i + 1 < stop and t[i + 1].text == "("
        if x.kind == "pp":
            if re.match(r"#\s*if", x.text):
                depth, j = 0, i
                while j < stop:
                    if t[j].kind == "pp":
                        depth += bool(re.match(r"#\s*if", t[j].text)) - bool(re.match(r"#\s*endif", t[j].text))
                        if depth == 0:
                            break
                    j += 1
                unit(i, min(j + 1, stop), enclosing)
                return j + 1
            unit(i, i + 1, enclosing)
            return i + 1
        if x.text == "{":
            j = _match(t, i, stop)
            block(i + 1, j, enclosing)
            return j + 1
        if x.text in (";", "}"):
            return i + 1
        if x.text == "if" and paren:
            j = _match(t, i + 1, stop)
            inner = (*enclosing, unit(i + 1, j + 1, enclosing, True).sid)
            j = one(j + 1, stop, inner) if j + 1 < stop else stop
            if j < stop and t[j].text == "else":
                k = min(stop, skip(j + 1))
                unit(j, k, inner)
                return k
            return j
        if x.text in ("while", "switch") and paren:
            j = _match(t, i + 1, stop)
            inner = (*enclosing, unit(i + 1, j + 1, enclosing, True).sid)
            if x.text == "switch" and j + 1 < stop and t[j + 1].text == "{":
                k = _match(t, j + 1, stop)
                block(j + 2, k, inner, True)
                return k + 1
            return one(j + 1, stop, inner) if j + 1 < stop else stop
        if x.text == "do":
            k = min(stop, skip(i + 1))
            if k + 1 < stop and t[k].text == "while" and t[k + 1].text == "(":
                j = _match(t, k + 1, stop)
                inner = (*enclosing, unit(k + 1, j + 1, enclosing, True).sid)
                one(i + 1, k, inner)
                return to_semicolon(j + 1)
            return one(i + 1, stop, enclosing) if i + 1 < stop else stop
        if x.text == "for" and paren:
            j = _match(t, i + 1, stop)
            k = min(stop, skip(j + 1))
            inner = (*enclosing, unit(i, k, enclosing, True).sid)
            semi = next((m for m in range(i + 2, j) if t[m].text == ";"), j)
            if semi > i + 2:
                unit(i + 2, semi, inner)
            if j + 1 < k:
                one(j + 1, k, inner)
            return k
        if cases and x.text in ("case", "default"):
            depth, j = 0, i + 1
            while j < stop:
                if t[j].kind == "op" and t[j].text in "([{":
                    depth += 1
                elif t[j].kind == "op" and t[j].text in ")]}":
                    depth -= 1
                elif depth == 0 and t[j].text in ("case", "default"):
                    break
                j += 1
            unit(i, j, enclosing)
            return j
        if x.kind == "id" and x.text not in KEYWORDS and i + 1 < stop and t[i + 1].text == ":" and not (i + 2 < stop and t[i + 2].text == ":"):
            return one(i + 2, stop, enclosing, cases) if i + 2 < stop else stop
        j = min(stop, to_semicolon(i))
        unit(i, max(j, i + 1), enclosing)
        return max(j, i + 1)

    block(first, end, ())
    return units


def split_lines(code: str) -> list[str]:
    return code.splitlines()


def criteria(units: list[Unit], tier: str = "all") -> list[int]:
    """Sink units. Tiers: all; memory (listed calls, subscripts, pointers); api (listed calls)."""
    wanted = {"all": {"call", "subscript", "pointer", "arrow", "arith"}, "memory": {"api", "subscript", "pointer"}, "api": {"api"}}[tier]
    return [u.sid for u in units if u.reasons & wanted]


def dependences(units: list[Unit], kinds: tuple[str, ...] = ("data", "control")) -> list[tuple[int, int, str]]:
    """(from, to, kind): a unit and one that it depends on. Textual reaching definitions, else all of them."""
    definers: dict[str, list[Unit]] = {}
    for u in units:
        for v in u.defs:
            definers.setdefault(v, []).append(u)
    out = []
    for u in units:
        if "data" in kinds:
            for v in sorted(u.uses):
                all_ = definers.get(v, [])
                for d in [d for d in all_ if d.at <= u.at] or all_:
                    out.append((u.sid, d.sid, "data"))
        if "control" in kinds:
            out += [(u.sid, p, "control") for p in u.enclosing]
    return out


def depths(units: list[Unit], seeds: list[int], kinds: tuple[str, ...] = ("data", "control")) -> dict[int, int]:
    """Least hops from the seeds, of every unit that a backward walk reaches."""
    to: dict[int, set[int]] = {}
    for a, b, _ in dependences(units, kinds):
        to.setdefault(a, set()).add(b)
    depth, front, d = {s: 0 for s in seeds}, list(seeds), 0
    while front:
        d += 1
        front = sorted({b for a in front for b in to.get(a, ()) if b not in depth})
        depth |= {b: d for b in front}
    return depth


def measures(code: str) -> dict:
    """Slices of a function under the criterion tiers and dependence kinds, and its deepest unit, from one reading."""
    n, units = len(split_lines(code)), statements(code)
    whole = list(range(n))
    out = {"n_lines": n, "status": "whole", "sinks": [], "kept": whole, "data": whole, "memory": whole, "memory_status": "whole", "depth": 0, "n_units": len(units)}
    if not units:
        return out
    spans = lambda ids: sorted({x for u in units if u.sid in ids for x in range(u.start_line, u.end_line + 1) if x < n})
    every, memory = criteria(units), criteria(units, "memory")
    last = [units[-1].sid]
    depth = depths(units, every or last)
    kept = spans(depth)
    out |= {"sinks": spans(every), "status": ("matched" if every else "fallback") if kept else "whole", "kept": kept or whole, "depth": max(depth.values())}
    out["data"] = spans(depths(units, every or last, ("data",))) or whole
    out["memory"] = spans(depths(units, memory or last)) or whole
    return out | {"memory_status": "matched" if memory else "fallback"}


def slice_lines(code: str, tier: str = "all", kinds: tuple[str, ...] = ("data", "control")) -> tuple[list[int], list[int], str]:
    """(0-based lines of the backward slice, lines of the sinks, status).

    Without a sink the last unit is the criterion; without units all lines are kept.
    """
    n = len(split_lines(code))
    units = statements(code)
    if not units:
        return list(range(n)), [], "whole"
    seeds = criteria(units, tier)
    status = "matched" if seeds else "fallback"
    keep = depths(units, seeds or [units[-1].sid], kinds)
    spans = lambda ids: sorted({x for u in units if u.sid in ids for x in range(u.start_line, u.end_line + 1) if x < n})
    kept = spans(set(keep))
    return (kept, spans(set(seeds)), status) if kept else (list(range(n)), spans(set(seeds)), "whole")


def functions(code: str) -> list[tuple[str, int, str]]:
    """(name, first line, text) of the function definitions of a file."""
    t, out, i = tokens(code), [], 0
    begin = 0
    while i < len(t):
        x = t[i]
        if x.kind == "op" and x.text == "(":
            j = _match(t, i, len(t))
            k = j + 1
            while k < len(t) and t[k].kind == "id" and t[k].text not in KEYWORDS:
                k += 1
            if k < len(t) and t[k].text == "{" and i and t[i - 1].kind == "id" and t[i - 1].text not in KEYWORDS:
                e = _match(t, k, len(t))
                out.append((t[i - 1].text, t[begin].line, code[t[begin].at : t[e].at + 1]))
                i = begin = e + 1
                continue
            i = j + 1
            continue
        if x.kind == "op" and x.text == "{":
            if any(y.text in ("extern", "namespace") for y in t[begin:i]):
                i = begin = i + 1
                continue
            i = _match(t, i, len(t)) + 1
            continue
        if x.text in (";", "}") or x.kind == "pp":
            begin = i + 1
        i += 1
    return out


def features(code: str) -> list[tuple[int, str]]:
    """Abstract features of code, (1-based line, feature): op lit ctrl type mod idx decl call callee."""
    t, out = tokens(code), []
    for i, x in enumerate(t):
        nxt, prev = (t[i + 1].text if i + 1 < len(t) else ""), (t[i - 1] if i else None)
        add = lambda f, line=x.line: out.append((line + 1, f))
        if x.kind == "num":
            add("lit:number")
        elif x.kind == "str":
            add("lit:" + ("char" if "'" in x.text[:2] else "string"))
        elif x.kind == "id":
            if x.text in ("NULL", "nullptr"):
                add("lit:null")
            elif x.text in ("true", "false"):
                add("lit:boolean")
            elif x.text in ("const", "static", "volatile", "extern", "register", "inline"):
                add("mod:" + x.text)
            elif x.text in TYPE_WORDS:
                add("type:" + x.text)
            elif x.text in ("if", "else", "for", "while", "do", "switch", "case", "default", "goto", "return", "break", "continue"):
                add("ctrl:" + x.text)
            elif x.text == "sizeof":
                add("op:sizeof")
            elif nxt == "(":
                add("call")
                add("callee:" + x.text)
            elif prev is not None and (prev.kind == "id" and prev.text not in KEYWORDS - TYPE_WORDS or prev.text == "*" and i > 1 and t[i - 2].kind == "id" and t[i - 2].text in TYPE_WORDS) and nxt in ("=", ";", ",", "["):
                add("decl")
        elif x.kind == "op":
            if x.text == "[":
                add("idx")
            elif x.text not in "(){}];,":
                add("op:" + x.text)
    return out


def profiles(code: str) -> list[dict]:
    """Forward profile of each variable: def and use lines (1-based), variables it flows into, pointer aliases, calls."""
    units = statements(code)
    t = tokens(code)
    names = sorted(set(parameters(code)) | {v for u in units for v in u.defs})
    calls: dict[str, dict[str, int]] = {}
    for i, x in enumerate(t):
        if x.kind == "id" and x.text not in KEYWORDS and i + 1 < len(t) and t[i + 1].text == "(":
            for y in t[i + 2 : _match(t, i + 1, len(t))]:
                if y.kind == "id" and y.text in names:
                    own = calls.setdefault(y.text, {})
                    own[x.text] = own.get(x.text, 0) + 1
    out = []
    for v in names:
        flows = {d for u in units if v in u.uses for d in u.defs if d != v}
        out.append({
            "variable": v,
            "def": sorted({u.start_line + 1 for u in units if v in u.defs}),
            "use": sorted({u.start_line + 1 for u in units if v in u.uses}),
            "dvars": sorted(flows),
            "pointers": sorted({d for u in units if v in u.uses and "pointer" in u.reasons for d in u.defs if d != v}),
            "cfuncs": calls.get(v, {}),
        })
    return out


def forward_lines(code: str) -> list[int]:
    """0-based lines of the forward closure from the parameters over the variables that units set from them.

    Without parameters, the variables defined up to the first line with a brace begin it.
    """
    t = tokens(code)
    return _forward(split_lines(code), _parameters(t), _statements(t))


def _forward(lines: list[str], names: list[str], units: list[Unit]) -> list[int]:
    seen = set(names)
    if not seen:
        brace = next((i + 1 for i, x in enumerate(lines) if "{" in x), 1)
        seen = {v for u in units if u.start_line < brace for v in u.defs}
    users: dict[str, list[Unit]] = {}
    for u in units:
        for v in u.uses:
            users.setdefault(v, []).append(u)
    front = list(seen)
    while front:
        for u in users.get(front.pop(), ()):
            new = u.defs - seen
            seen |= new
            front += new
    return sorted({u.start_line for u in units if u.start_line < len(lines) and not (seen.isdisjoint(u.defs) and seen.isdisjoint(u.uses))})


_HEAD = re.compile(r"[A-Za-z_][A-Za-z_0-9 *]*[ *]([A-Za-z_][A-Za-z_0-9]*)\(")


def nameless(code: str) -> str:
    """The text with its function called fn_: equal for functions that differ in their names only, and views() are the same.

    A name that stands elsewhere too, or that means something, stays.
    """
    m = _HEAD.match(code)
    if not m or m[1] in KEYWORDS or m[1] in MEMORY_CALLS or m[1].isupper() or "fn_" in code or code.count(m[1]) != 1:
        return code
    return f"{code[: m.start(1)]}fn_{code[m.end(1) :]}"


def views(code: str) -> dict:
    """The slices of slice_lines() for all criteria, memory criteria and data alone, forward_lines() and normalize(), from one reading."""
    lines, t = split_lines(code), tokens(code)
    n, units = len(lines), _statements(t)
    whole = list(range(n))
    out = {"kept": whole, "sinks": [], "status": "whole", "memory": whole, "data": whole, "forward": _forward(lines, _parameters(t), units), "norm": normalize(code)}
    if not units:
        return out
    spans = lambda ids: sorted({x for i in ids for x in range(units[i].start_line, units[i].end_line + 1) if x < n})
    every, memory, last = criteria(units), criteria(units, "memory"), [len(units) - 1]
    definers: dict[str, list[Unit]] = {}
    for u in units:
        for v in u.defs:
            definers.setdefault(v, []).append(u)
    data = []
    for u in units:
        to = set()
        for v in u.uses & definers.keys():
            to.update([d.sid for d in definers[v] if d.at <= u.at] or [d.sid for d in definers[v]])
        data.append(to)
    both = [to.union(u.enclosing) for to, u in zip(data, units, strict=True)]

    def reached(seeds: list[int], to: list[set[int]]) -> set[int]:
        seen, front = set(seeds), list(seeds)
        while front:
            new = to[front.pop()] - seen
            seen |= new
            front += new
        return seen

    kept = spans(reached(every or last, both))
    out["sinks"] = spans(every)
    out |= {"kept": kept, "status": "matched" if every else "fallback"} if kept else {}
    out["memory"] = (kept if memory == every else spans(reached(memory or last, both))) or whole
    out["data"] = spans(reached(every or last, data)) or whole
    return out


def trace(code: str) -> list[dict]:
    """The last-in-first-out walk of the slice: a row per unit taken, with what it adds and why."""
    units = statements(code)
    if not units:
        return []
    deps: dict[int, list[tuple[int, str]]] = {}
    for a, b, kind in dependences(units):
        deps.setdefault(a, []).append((b, kind))
    stack = criteria(units) or [units[-1].sid]
    seen, out = set(stack), []
    while stack:
        s = stack.pop()
        new = {"data": [], "control": []}
        for b, kind in deps.get(s, ()):
            if b not in seen:
                seen.add(b)
                stack.append(b)
                new[kind].append(units[b].start_line)
        out.append({"step": len(out), "line": units[s].start_line, "uses": sorted(units[s].uses), "added_data": new["data"], "added_control": new["control"]})
    return out


def normalize(code: str) -> str:
    """Identifiers as VARn and FUNn by first appearance; keywords, listed calls and capitals stay."""
    var: dict[str, str] = {}
    fun: dict[str, str] = {}

    def name(m: re.Match) -> str:
        w = m[0]
        if w in KEYWORDS or w in MEMORY_CALLS or (w.isupper() and len(w) > 1):
            return w
        table, kind = (fun, "FUN") if _CALLED.match(code, m.end()) else (var, "VAR")
        return table.setdefault(w, f"{kind}{len(table) + 1}")

    return re.sub(r"[A-Za-z_]\w*", name, code)
