"""The strings of a small block of YAML, as notes have it at their head."""

from __future__ import annotations

import re

KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s\-?:,\[\]{}#&*!|>'"%@`][^:#]*?|[-?:](?=\S)[^:#]*?))\s*:(?=\s|$)""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "/": "/", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", " ": " ", "_": "\xa0", "N": "\x85", "L": "\u2028", "P": "\u2029"}
#: Plain scalars that are not strings.
OTHER = re.compile(r"~|null|Null|NULL|true|True|TRUE|false|False|FALSE|[-+]?\d+|0o[0-7]+|0x[0-9a-fA-F]+|[-+]?(?:\.\d+|\d+(?:\.\d*)?)(?:[eE][-+]?\d+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)|")


class Malformed(ValueError):
    pass


def _unescaped(text: str) -> str:
    def one(found):
        c = found[1]
        if c[0] in "xuU" and len(c) > 1:
            return chr(int(c[1:], 16))
        if c not in ESCAPES:
            raise Malformed(c)
        return ESCAPES[c]

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, text)


def _folded(lines: list[str]) -> str:
    """Lines of a flow scalar: a line's end is a space, empty lines are line ends."""
    out, gap = lines[0].rstrip(), 0
    for line in map(str.strip, lines[1:]):
        if not line:
            gap += 1
            continue
        out, gap = out + ("\n" * gap if gap else " ") + line, 0
    return out


def _block(kind: str, head: str, lines: list[str]) -> str:
    """A block scalar: ``|`` keeps line ends, ``>`` folds those between lines of no more indent; the head says what ends it."""
    said = re.fullmatch(r"([1-9]?)([+-]?)([1-9]?)\s*(?:\s#.*)?", head)
    if said is None:
        raise Malformed(head)
    depth = int(said[1] or said[3] or 0) or next((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), 0)
    rows = [x[depth:] if x.strip() else x[depth:] for x in lines]
    while rows and not rows[-1].strip():
        rows.pop()
    if kind == "|":
        text = "\n".join(rows)
    else:
        text, gap, last_more = "", 0, False
        for n, row in enumerate(rows):
            more = row[:1] in (" ", "\t")
            if not row:
                gap += 1
                continue
            if n:
                text += "\n" * (gap + 1) if more or last_more else "\n" * gap if gap else " " if text else ""
            elif gap:
                text += "\n" * gap
            text, gap, last_more = text + row, 0, more
    trailing = len(lines) - len(rows)
    return text + ("" if said[2] == "-" else "\n" * (1 + trailing) if said[2] == "+" else "\n" if text else "")


def _quoted(text: str) -> tuple[str, str] | None:
    """A quoted scalar at the beginning, and what follows it; None if it goes on."""
    if text[0] == '"':
        found = re.match(r'"((?:[^"\\]|\\.)*)"', text, re.S)
        return found and (found[1], text[found.end() :])
    found = re.match(r"'((?:[^']|'')*)'", text, re.S)
    return found and (found[1].replace("''", "'"), text[found.end() :])


def _value(text: str, lines: list[str]) -> str | None:
    """A value's string, None if it is of another kind; ``lines`` are the indented ones below."""
    own = re.sub(r"^(?:[!&]\S*\s+)+", "", text)  # tags and anchors
    if own[:1] in ("|", ">"):
        return _block(own[0], own[1:], lines)
    if own[:1] in ('"', "'"):
        whole = "\n".join([own, *lines])
        if (found := _quoted(whole)) is None or not re.fullmatch(r"\s*(?:\s#[^\n]*)?\s*", found[1]):
            raise Malformed(text)
        body = _folded(re.sub(r"\\\n[ \t]*", "", found[0]).split("\n"))
        return _unescaped(body) if own[0] == '"' else body
    if own[:1] in ("[", "{"):
        return None
    if own[:1] in ("%", "@", "`", "*"):
        if own[:1] == "*":
            return None
        raise Malformed(text)
    if own.startswith("#"):
        own = ""
    own = re.split(r"\s#", own)[0].strip()
    rest = [re.split(r"(?:^|\s)#", x)[0] for x in lines]
    if not own:
        rows = [x.strip() for x in rest if x.strip()]
        if not rows or rows[0][:2] == "- " or rows[0] == "-" or KEY.match(rows[0]) or rows[0][0] in "[{":
            return None
        return _value(rows[0], rest[[x.strip() for x in rest].index(rows[0]) + 1 :])
    if re.search(r":(?:\s|$)", own):
        raise Malformed(text)  # a mapping where none may be
    text = _folded([own, *rest]).rstrip("\n ")
    return None if OTHER.fullmatch(text) else text


def mapping(text: str) -> dict[str, str]:
    """The strings by key of a block that is one mapping, those of lists, mappings, numbers and such left out; empty if it is something else or malformed, a key twice say.

    Strings are plain, in single or double quotes, or block scalars.
    """
    rows, out, seen = text.split("\n"), {}, set()
    try:
        i = 0
        while i < len(rows):
            row = rows[i]
            i += 1
            if not row.strip() or row.lstrip().startswith("#"):
                continue
            if row[0] in " \t" or (found := KEY.match(row)) is None:
                return {}
            key = _unescaped(found[1]) if found[1] is not None else found[2].replace("''", "'") if found[2] is not None else found[3].strip()
            if key in seen:
                return {}
            seen.add(key)
            first = i
            while i < len(rows) and (not rows[i].strip() or rows[i][0] in " \t" or re.match(r"-(?:\s|$)", rows[i])):
                i += 1
            value = _value(row[found.end() :].strip(), rows[first:i])
            if value is not None:
                out[key] = value
    except Malformed:
        return {}
    return out
