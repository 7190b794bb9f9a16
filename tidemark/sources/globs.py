"""Globs over relative paths as regular expressions, in two dialects: of configuration, and of ignore files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alternatives of one glob's braces at most.
MOST_ALTERNATIVES = 1000


def _closing(glob: str, start: int, opening: str, closing: str) -> int:
    """Where the bracket that opens at ``start`` closes; -1 if it doesn't. Backslashes and classes are passed over."""
    depth, i = 0, start
    while i < len(glob):
        if glob[i] == "\\":
            i += 1
        elif glob[i] == opening:
            depth += 1
        elif glob[i] == closing:
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return -1


def _options(body: str, alone: bool) -> list[str] | None:
    """What a brace's inside stands for: parts between commas, or a range of numbers or letters; None if it isn't a brace at all."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(body[last:i])
            last = i + 1
    parts.append(body[last:])
    if len(parts) > 1 or alone:
        return parts
    steps = re.fullmatch(r"(-?\d+|[A-Za-z])\.\.(-?\d+|[A-Za-z])(?:\.\.(-?\d+))?", body)
    if steps is None or steps[1].isalpha() != steps[2].isalpha():
        return None
    a, b = (ord(x) if x.isalpha() else int(x) for x in (steps[1], steps[2]))
    step = max(1, abs(int(steps[3] or 1)))
    if abs(b - a) // step >= MOST_ALTERNATIVES:
        raise ValueError(f"a glob's braces stand for more than {MOST_ALTERNATIVES} names")
    values = range(a, b + (1 if b >= a else -1), step if b >= a else -step)
    if steps[1].isalpha():
        return [chr(v) for v in values]
    width = max(len(x.lstrip("-")) for x in (steps[1], steps[2]) if re.match(r"-?0\d", x)) if any(re.match(r"-?0\d", x) for x in (steps[1], steps[2])) else 0
    return [f"{'-' if v < 0 else ''}{abs(v):0{width}d}" for v in values]


def braces(glob: str, alone: bool = False) -> list[str]:
    """The globs that one with braces stands for; ``alone``: braces around a single part are braces too."""
    start = 0
    while (start := glob.find("{", start)) >= 0:
        if start and glob[start - 1] == "\\":
            start += 1
            continue
        end = _closing(glob, start, "{", "}")
        options = _options(glob[start + 1 : end], alone) if end > 0 else None
        if options is None:
            start += 1
            continue
        out = [glob[:start] + x + rest for o in options for x in braces(o, alone) for rest in braces(glob[end + 1 :], alone)]
        if len(out) > MOST_ALTERNATIVES:
            raise ValueError(f"a glob's braces stand for more than {MOST_ALTERNATIVES} names")
        return out
    return [glob]


def _class(glob: str, start: int) -> tuple[str, int] | None:
    """A character class from ``start`` as a regular expression, and where it ends; None if it doesn't end."""
    i = start + 1
    negated = glob[i : i + 1] in ("!", "^")
    i += negated
    out, first = "", True
    while i < len(glob):
        if glob[i] == "]" and not first:
            return f"(?!/)[{'^' if negated else ''}{out}]", i + 1
        first = False
        named = re.match(r"\[:(alnum|alpha|digit|lower|upper|punct|space|xdigit|blank|cntrl|graph|print):\]", glob[i:])
        if named:
            name = named[1]
            out, i = out + r"\p{%s}" % {"xdigit": "XDigit"}.get(name, name.capitalize() if name != "alnum" else "Alnum"), i + len(named[0])
        else:
            out, i = out + (glob[i] if glob[i] == "-" else re.escape(glob[i])), i + 1
    return None


def _segment(glob: str) -> str:
    """A part between slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c in "?*+@" and glob[i + 1 : i + 2] == "(" and (end := _closing(glob, i + 1, "(", ")")) > 0:
            inside, depth, last, parts = glob[i + 2 : end], 0, 0, []
            for j, x in enumerate(inside):
                depth += (x == "(") - (x == ")")
                if x == "|" and depth == 0:
                    parts.append(inside[last:j])
                    last = j + 1
            parts.append(inside[last:])
            out, i = f"{out}(?:{'|'.join(map(_segment, parts))}){'' if c == '@' else c}", end + 1
        elif c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (found := _class(glob, i)) is not None:
            out, i = out + found[0], found[1]
        else:
            out, i = out + re.escape(c), i + 1
    return out


def _body(glob: str) -> str:
    parts, out = glob.split("/"), ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last and i else ".*" if last else "(?:[^/]+/)*"
        else:
            out += ("(?=[^/])" if part[:1] in "*?[" else "") + _segment(part) + ("" if last else "/")
    return out


def glob_pattern(glob: str) -> str:
    """A glob of the configuration as a regular expression, from a path's beginning to its end.

    ``**`` as a whole part crosses folders; ``*`` and ``?`` don't, and match names that begin with
    a dot too. Classes ``[a-c]``, ``[!a]`` and ``[[:digit:]]``, braces ``{a,b}`` and ``{1..3}``, and
    groups ``@(a|b)``, ``?(a)``, ``*(a)``, ``+(a)`` are known. One that begins with ``!`` matches what
    the rest doesn't, one with ``#`` nothing. Backslashes are slashes.
    """
    own = glob.replace("\\", "/").lstrip("/")
    turned = len(own) - len(own.lstrip("!")) if not own.startswith("!(") else 0
    own = own[turned:]
    if own.startswith("#") and not turned:
        return r"^(?!)"
    body = "|".join(map(_body, braces(own)))
    return f"^(?!(?:{body})$)" if turned % 2 else f"^(?:{body})$"


def ignore_pattern(glob: str) -> str:
    """A glob of an ignore file as a regular expression: one without a slash but at its end holds at any depth, one for a folder holds for all in it. Braces may have a single part; a leading ``!`` is passed over."""
    out = []
    for own in braces(glob.strip().lstrip("!").replace("\\", "/"), alone=True):
        folder, anchored = own.endswith("/"), "/" in own.rstrip("/")
        own = own.strip("/")
        out.append(f"{'' if anchored else '(?:.*/)?'}{_body(own)}{'/.*' if folder else '(?:/.*)?'}")
    return f"^(?:{'|'.join(out)})$"


def excluded(path, globs: list[str]) -> Column:
    """Whether a path is turned away by one of ``globs``, read in either dialect."""
    p, out = F.col(path) if isinstance(path, str) else path, F.lit(False)
    for glob in globs:
        out = out | p.rlike(glob_pattern(glob)) | p.rlike(ignore_pattern(glob))
    return out
