"""What a pattern needs a text to hold: literals that rule most patterns out before any is run."""

from __future__ import annotations

import re

_CLOSE = {"(": ")", "[": "]"}
_QUANTIFIER = re.compile(r"[?*]|\{0")
#: Escapes that stand for one character which is not themselves.
_CLASSES = set("dDwWsSbBAZzGhHvVRXpPkQENuxctnrfae0123456789")


def _branches(pattern: str) -> list[str]:
    """The alternatives at the top level of a pattern."""
    out, depth, k, start = [], 0, 0, 0
    while k < len(pattern):
        ch = pattern[k]
        if ch == "\\":
            k += 1
        elif ch == "[":
            k = _end(pattern, k)
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and not depth:
            out.append(pattern[start:k])
            start = k + 1
        k += 1
    return [*out, pattern[start:]]


def _end(pattern: str, k: int) -> int:
    """Where the group or class that begins at k ends."""
    if pattern[k] == "[":
        k += 2 if pattern[k + 1 : k + 2] == "^" else 1
        k += pattern[k : k + 1] == "]"
        while pattern[k] != "]":
            k += 2 if pattern[k] == "\\" else 1
        return k
    depth = 0
    while True:
        if pattern[k] == "\\":
            k += 1
        elif pattern[k] == "[":
            k = _end(pattern, k)
        elif pattern[k] == "(":
            depth += 1
        elif pattern[k] == ")":
            depth -= 1
            if not depth:
                return k
        k += 1


def required_literals(pattern: str, least: int = 3) -> list[str] | None:
    """Literals of ``least`` characters or more of which every match of a pattern holds one; None if that cannot be told.

    The longest run of plain characters of each alternative; what stands in optional parts, in classes, or under flags
    does not count, and a group counts by its own alternatives if no quantifier makes it optional.
    """
    if re.search(r"\(\?[a-z]*[ix]", pattern) or "\\Q" in pattern:
        return None
    out: list[str] = []
    for branch in _branches(pattern):
        found: list[list[str]] = []
        run, k = "", 0
        try:
            while k < len(branch):
                ch, stop, plain = branch[k], k, None
                if ch == "\\":
                    stop = k + 1
                    plain = branch[stop] if branch[stop] not in _CLASSES else None
                elif ch in _CLOSE:
                    stop = _end(branch, k)
                elif ch not in ".^$":
                    plain = ch
                after = branch[stop + 1 :]
                optional, repeated = bool(_QUANTIFIER.match(after)), after[:1] in ("+", "{")
                if plain is not None and not optional:
                    run += plain
                if plain is None or optional or repeated:
                    found.append([run])
                    run = ""
                if ch == "(" and not optional and not branch.startswith(("(?!", "(?<!", "(?=", "(?<="), k):
                    inner = re.sub(r"^\?(:|<[A-Za-z]\w*>)", "", branch[k + 1 : stop])
                    inside = required_literals(inner, least) if not inner.startswith("?") else None
                    found.append(inside or [""])
                k = stop + 1
                if optional or repeated:
                    k += len(re.match(r"(?:[?*+]|\{[^}]*\})[?+]?", branch[k:])[0])
        except (IndexError, TypeError):
            return None
        best = max([*found, [run]], key=lambda x: min(map(len, x)))
        if min(map(len, best)) < least:
            return None
        out += best
    return sorted(set(out))


def any_of(literals: list[str]) -> str:
    """A pattern that finds the longest of the literals at a place, sharing what their beginnings share."""
    heads: dict[str, list[str]] = {}
    for x in literals:
        if x:
            heads.setdefault(x[0], []).append(x[1:])
    each = []
    for head, rest in sorted(heads.items()):
        inner = any_of(rest) if any(rest) else ""
        ends = "" in rest
        each.append(re.escape(head) + (f"(?:{inner})?" if inner and ends else f"(?:{inner})" if "|" in inner else inner))
    return "|".join(each)
