"""Expressions of JavaScript, TypeScript, Go, Java and Rust, for the patterns of tree rules.

These languages write calls, assignments and literals alike: words, points, brackets and strings. One pass over the
tokens pairs the brackets and walks each chain of names; no grammar is needed, and what does not parse is read as
far as it goes. Chains are written with points, whatever joins them (``a::b``, ``a?.b``), a call inside one as () and
an index as [], once for several in a row; of longer chains the last PARTS names count. Captures are those of Python's trees:

- call: callee, attr, arg0.., kw.<key> of an object written as an argument; a macro's name ends in !, and
  ``new`` is captured of a constructor
- literal: callee and kw.<key> of a composite value, ``tls.Config{Key: value}``
- assign: target and value of =, := and +=, of typed declarations, and of the keys of object literals
- import: module

Texts may have any length: a token is visited a bounded number of times, and the text of a capture is cut out when
a rule asks for it.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Callable, Iterator

LANGUAGES = ("JavaScript", "TypeScript", "Go", "Java", "Rust")
#: Names of a chain that are kept.
PARTS = 8
_SCRIPT = ("JavaScript", "TypeScript")
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_STRINGS = {
    "JavaScript": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*(?:`|\\?\Z)',
    "Go": r'"(?:\\.|[^"\\\n])*"|`[^`]*(?:`|\Z)|\'(?:\\.|[^\'\\\n])+\'',
    "Java": r'"""(?:\\.|[^\\])*?(?:"""|\\?\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "Rust": r'b?r#"(?:[^"]|"(?!#))*(?:"#|\Z)|b?r"[^"]*(?:"|\Z)|b?"(?:\\.|[^"\\])*(?:"|\\?\Z)|b?\'(?:\\[^\']+|[^\'\\\n])\'',
}
_STRINGS["TypeScript"] = _STRINGS["JavaScript"]
_OPERATORS = r"=>|===?|!==?|:=|\+=|::|->|\?\.|<=|>=|&&|\|\||\+\+|--|."
_TOKEN = {
    k: re.compile(rf"\s*+(?:(?P<c>{_COMMENT}|\Z)|(?P<s>{s})|(?P<n>\d[\w.]*)|(?P<w>[^\W\d][\w$]*|\$[\w$]*)|(?P<o>{_OPERATORS}))", re.S)
    for k, s in _STRINGS.items()
}
#: A pattern between slashes, where a value may begin.
_SLASHED = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_OPENING = set(_PAIRS.values())
_JOINTS = {".", "::", "?.", "->"}
_DEFINING = {"function", "func", "fn", "class", "interface", "struct", "enum", "trait", "impl", "package"}
_PREFIXES = {"await", "new", "typeof", "mut", "ref", "return", "throw", "yield", "go", "defer", "move", "else", "case", "in", "of", "const", "let", "var", "static", "final", "assert", "default", "delete", "void", "unsafe"}
_DECLARING = {"let", "var", "const", "static"}
_HEADS = {"if", "for", "while", "switch", "catch", "match", "loop", "do", "try", "import", "use", "from", "export", "as"} | _DEFINING | _PREFIXES
_CONSTANTS = {"true", "false", "null", "nil", "undefined", "None"}
_FORMATS = {"format", "Sprintf", "formatted", "format!", "Sprint"}


class Captures(dict):
    """Captures by name; each is (kind, text) or a span of tokens that is read when asked for."""

    def __init__(self, source: Source, given: dict):
        super().__init__(given)
        self.source = source

    def __getitem__(self, name: str) -> tuple[str, str]:
        got = super().__getitem__(name)
        if isinstance(got[0], int):
            got = self.source.value(*got)
            self[name] = got
        return got


class Source:
    def __init__(self, language: str, text: str):
        self.language, self.text = language, text
        self.kind: list[str] = []
        self.token: list[str] = []
        self.start: list[int] = []
        self.other: list[int] = []  # the bracket that closes or opens a token's own; -1 if none
        self.around: list[int] = []  # the innermost open bracket
        kinds, tokens, starts, other, around = self.kind, self.token, self.start, self.other, self.around
        find, at, plain, open_, inside = _TOKEN[language].match, 0, 0, [], -1
        while at < len(text):
            m = find(text, at)
            kind = m.lastgroup
            if kind == "c":
                at = m.end()
                continue
            token, (at, end), k = m[kind], m.span(kind), len(tokens)
            if token == "/" and kind == "o" and at >= plain and language in _SCRIPT and self._value_may_begin():
                slashed = _SLASHED.match(text, at)
                if slashed:
                    kind, token, end = "r", slashed[0], slashed.end()
                else:  # behind one that does not end, its line holds no other
                    plain = (text.find("\n", at) + 1 or len(text) + 1) - 1
            opened = -1
            if kind == "o" and token in _PAIRS and inside >= 0 and tokens[inside] == _PAIRS[token]:
                opened = open_.pop()
                other[opened] = k
                inside = open_[-1] if open_ else -1
            kinds.append(kind)
            tokens.append(token)
            starts.append(at)
            other.append(opened)
            around.append(inside)
            if kind == "o" and token in _OPENING:
                open_.append(k)
                inside = k
            at = end
        self.size = len(tokens)
        self.breaks = [m.end() for m in re.finditer("\n", text)]

    def _value_may_begin(self) -> bool:
        if not self.token:
            return True
        return self.token[-1] == "return" or (self.kind[-1] == "o" and self.token[-1] not in (")", "]", "}"))

    def is_op(self, k: int, token: str) -> bool:
        return 0 <= k < self.size and self.kind[k] == "o" and self.token[k] == token

    def is_word(self, k: int) -> bool:
        return 0 <= k < self.size and self.kind[k] == "w"

    def joins(self, k: int) -> bool:
        return 0 <= k < self.size and self.kind[k] == "o" and self.token[k] in _JOINTS

    def after(self, k: int) -> int:
        """The token behind k, or behind the bracket that closes k."""
        return self.other[k] + 1 if self.kind[k] == "o" and self.token[k] in ("(", "[", "{") and self.other[k] > k else k + 1

    def end(self, k: int) -> int:
        return self.start[k] + len(self.token[k])

    def place(self, k: int) -> tuple[int, int]:
        """(line, column) of a token, from 1."""
        at = self.start[k]
        line = bisect.bisect_right(self.breaks, at)
        return line + 1, at - (self.breaks[line - 1] if line else 0) + 1

    def cut(self, begin: int, end: int) -> str:
        return self.text[self.start[begin] : self.end(end - 1)] if end > begin else ""

    def parts(self, opener: int) -> Iterator[tuple[int, int]]:
        """Spans between the commas of a bracket."""
        stop = self.other[opener]
        begin = k = opener + 1
        while k < stop:
            if self.is_op(k, ","):
                if k > begin:
                    yield begin, k
                begin = k + 1
            k = self.after(k)
        if stop > begin:
            yield begin, stop

    def value(self, begin: int, end: int) -> tuple[str, str]:
        """(kind, text) of an expression; a string's text is what it holds."""
        while begin < end - 1:
            if self.is_op(begin, "(") and self.after(begin) == end:
                end -= 1
            elif self.token[begin] not in (("&", "*", "!", "-") if self.kind[begin] == "o" else _PREFIXES if self.kind[begin] == "w" else ()):
                break
            begin += 1
        if begin >= end:
            return "other", ""
        kind, token, text = self.kind[begin], self.token[begin], self.cut(begin, end)
        if end - begin == 1:
            if kind == "s":
                inner = re.sub(r"^(?:b?r?#?)(\"\"\"|[\"'`])(.*)\1#?$", r"\2", token, flags=re.S)
                return ("fstring" if token[0] == "`" and "${" in token and self.language in _SCRIPT else "str"), inner
            return ("number" if kind == "n" else "constant" if token in _CONSTANTS else "name" if kind == "w" else "other"), token
        points, plain, k, last, attr = False, True, begin, begin, ""
        while k < end:
            last = k
            if self.is_op(k, "+"):
                return "concat", text
            if self.is_word(k):
                attr = self.token[k] + ("!" if self.is_op(k + 1, "!") else "")
            points = points or self.joins(k)
            plain = plain and (self.kind[k] != "o" or self.joins(k) or self.token[k] in ("(", "[", "!"))
            k = self.after(k)
        if self.is_op(begin, "[") and self.after(begin) == end:
            return "list", text
        if self.is_op(begin, "{") and self.after(begin) == end:
            return "dict", text
        if not plain:
            return "other", text
        if self.is_op(last, "("):
            return ("format" if attr in _FORMATS else "call"), text
        if self.is_op(last, "["):
            return "subscript", text
        return ("attribute" if points else "other"), text

    def stop(self, begin: int) -> int:
        """Where the expression that begins at a token ends."""
        k = begin
        while k < self.size:
            if self.kind[k] == "o" and self.token[k] in (";", ",", ")", "]", "}", "=", ":=", "+="):
                break
            if self.kind[k] == "o" and self.token[k] in ("(", "[", "{") and self.other[k] < 0:  # never closed
                break
            if self.kind[k] == "w" and self.token[k] in _DECLARING and not (self.is_op(k - 1, "*") or self.is_op(k - 1, "'")):
                break
            if k > begin and "\n" in self.text[self.end(k - 1) : self.start[k]]:
                goes_on = self.kind[k - 1] == "o" and self.token[k - 1] not in (")", "]", "}")
                if not goes_on and not (self.kind[k] == "o" and self.token[k] not in ("(", "[", "{")):
                    break
            k = self.after(k)
        return min(k, self.size)

    def keys(self, opener: int) -> dict[str, tuple[int, int]]:
        """kw.<key> of the pairs in braces."""
        pairs = ((b, e) for b, e in self.parts(opener) if e > b + 2 and self.is_op(b + 1, ":") and self.kind[b] in "ws")
        return {f"kw.{self.token[b].strip(chr(34) + chr(39))}": (b + 2, e) for b, e in pairs}

    def arguments(self, opener: int) -> dict[str, tuple[int, int]]:
        got = {}
        for i, (b, e) in enumerate(self.parts(opener)):
            got[f"arg{i}"] = (b, e)
            if self.is_op(b, "{") and self.after(b) == e:
                got |= self.keys(b)
        return got

    def defines(self, first: int, opener: int) -> bool:
        """Is the name before a bracket a definition's, not a call's?"""
        before, behind = first - 1, self.after(opener)
        if self.is_word(before) and self.token[before] in _DEFINING:
            return True
        if self.language == "Go":  # a method's receiver
            return self.is_op(before, ")") and self.is_word(self.other[before] - 1) and self.token[self.other[before] - 1] == "func"
        if self.language == "Rust" or opener != first + 1:
            return False
        if self.is_op(behind, "{") or (self.is_word(behind) and self.token[behind] == "throws"):
            return not (self.is_word(before) and self.token[before] == "new")
        return self.language == "Java" and self.is_word(before) and self.token[before] not in _HEADS

    def nodes(self) -> Iterator[tuple[str, Captures, int, int]]:
        """(node, captures, first token, token behind the last)."""
        used = bytearray(self.size)
        for first in range(self.size):
            if self.kind[first] == "s" and self.kind[first + 1 : first + 2] == ["o"] and self.is_op(first + 1, ":"):
                yield from self.pair(first, self.value(first, first + 1)[1], first + 1)
                continue
            if self.kind[first] != "w" or used[first]:
                continue
            if self.token[first] in ("import", "use", "from"):
                yield from self.imports(first)
            if self.token[first] in _HEADS:
                continue
            names = ["?"] if self.joins(first - 1) else []
            k = first
            while True:
                names.append(self.token[k])
                used[k] = 1
                k += 1
                if self.language == "Rust" and self.is_op(k, "!") and (self.is_op(k + 1, "(") or self.is_op(k + 1, "[")):
                    names[-1] += "!"
                    k += 1
                while k < self.size and self.kind[k] == "o" and self.token[k] in ("(", "[") and self.other[k] > k:
                    if self.token[k] == "(" or names[-1].endswith("!"):
                        if not self.defines(first, k):
                            given = {"callee": ("name", ".".join(names[-PARTS:])), "attr": ("name", names[-1])}
                            if self.is_word(first - 1) and self.token[first - 1] == "new":
                                given["new"] = ("name", names[-1])
                            yield "call", Captures(self, given | self.arguments(k)), first, self.after(k)
                    mark = "()" if self.token[k] == "(" or names[-1].endswith("!") else "[]"
                    names[-1] += "" if names[-1].endswith(mark) else mark
                    k = self.after(k)
                if self.joins(k) and self.is_word(k + 1):
                    k += 1
                    names = names[-PARTS:]
                else:
                    break
            target = ".".join(names[-PARTS:])
            if self.is_op(k, "{") and self.is_word(k + 1) and self.is_op(k + 2, ":") and self.other[k] > k:
                yield "literal", Captures(self, {"callee": ("name", target), "attr": ("name", names[-1])} | self.keys(k)), first, self.after(k)
            elif self.is_op(k, ":") and self.is_word(first - 1) and (self.token[first - 1] in _DECLARING or (self.token[first - 1] == "mut" and self.is_word(first - 2))):
                typed = self.stop(k + 1)
                if self.is_op(typed, "="):
                    yield self.assigned(first, target, typed)
            elif self.is_op(k, ":"):
                yield from self.pair(first, target, k)
            elif k < self.size and self.kind[k] == "o" and self.token[k] in ("=", ":=", "+="):
                yield self.assigned(first, target, k)

    def assigned(self, first: int, target: str, sign: int) -> tuple[str, Captures, int, int]:
        end = max(self.stop(sign + 1), sign + 1)
        return "assign", Captures(self, {"target": ("name", target), "value": (sign + 1, end)}), first, end

    def pair(self, first: int, target: str, sign: int) -> Iterator[tuple[str, Captures, int, int]]:
        """The assignment of a key in braces."""
        if self.around[first] >= 0 and self.is_op(self.around[first], "{") and (self.is_op(first - 1, "{") or self.is_op(first - 1, ",")):
            yield self.assigned(first, target, sign)

    def imports(self, first: int) -> Iterator[tuple[str, Captures, int, int]]:
        if self.around[first] >= 0 or self.joins(first - 1):
            return
        k, token = first + 1, self.token[first]
        if token != "from" and self.is_op(k, "(") and self.language == "Go":
            for j in range(k + 1, max(self.other[k], k + 1)):
                if self.kind[j] == "s":
                    yield "import", Captures(self, {"module": (j, j + 1)}), j, j + 1
        elif k < self.size and self.kind[k] == "s" and token != "use":
            yield "import", Captures(self, {"module": (k, k + 1)}), first, k + 1
        elif self.language in ("Java", "Rust") and token != "from":
            k += self.is_word(k) and self.token[k] == "static"
            names = []
            while self.is_word(k):
                names.append(self.token[k])
                k += 2 if self.joins(k + 1) else 1
                if not self.joins(k - 1):
                    break
            if names:
                yield "import", Captures(self, {"module": ("name", ".".join(names))}), first, min(k, self.size)


def nodes(language: str, text: str) -> Iterator[tuple[str, Captures, int, int, Callable[[], str]]]:
    """(node, captures, line, column, what gives its text) in order of the text."""
    source = Source(language, text)
    for kind, got, first, end in source.nodes():
        line, column = source.place(first)
        yield kind, got, line, column, functools.partial(source.cut, first, min(end, source.size))
