"""Abstract features of source code from its XML markup, by element kind and line."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET

# Elements that control flow.
CONTROL = frozenset("if if_stmt else for while do switch case default break continue return goto label".split())


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _line(el: ET.Element) -> int:
    """The line at which an element starts, -1 where the markup does not say."""
    for k, v in el.attrib.items():
        if _name(k) == "start" and v.partition(":")[0].isdigit():
            return int(v.partition(":")[0])
    return -1


def xml_features(xml: str) -> list[tuple[int, str]]:
    """(line, feature) in document order: op:, lit:, ctrl:, type:, mod:, idx, decl, call and callee:; none of XML that is none.

    Names of variables give nothing.  A callee is the last name inside the first name of its call.
    """
    found: list[tuple[int, int, str]] = []
    open_: list[tuple[str, int, int]] = []  # name, line, place in document order
    named: set[int] = set()  # calls whose callee is known, by place
    try:
        for place, (event, el) in enumerate(ET.iterparse(io.BytesIO(xml.encode()), ("start", "end"))):
            name = _name(el.tag)
            if event == "start":
                open_.append((name, _line(el), place))
                continue
            _, line, at = open_.pop()
            around, its_line, its_place = open_[-1] if open_ else ("", -1, -1)
            said = (el.text or "").strip()
            if name == "operator" and said:
                found.append((at, line, f"op:{said}"))
            elif name == "literal":
                found.append((at, line, f"lit:{el.get('type') or '?'}"))
            elif name in CONTROL:
                found.append((at, line, f"ctrl:{name}"))
            elif name in ("index", "call", "decl_stmt"):
                found.append((at, line, {"index": "idx", "call": "call", "decl_stmt": "decl"}[name]))
            elif around == "type" and said and name in ("name", "modifier"):
                found.append((at, its_line, f"{'type' if name == 'name' else 'mod'}:{said}"))
            elif around == "call" and name == "name" and its_place not in named:
                named.add(its_place)
                inner = [x.text.strip() for x in el.iter() if _name(x.tag) == "name" and (x.text or "").strip()]
                if inner:
                    found.append((its_place, its_line, f"callee:{inner[-1]}"))
    except ET.ParseError:
        return []
    return [(line, feat) for _, line, feat in sorted(found, key=lambda x: (x[0], x[2].startswith("callee:")))]
