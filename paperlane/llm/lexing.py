"""Reading source and configuration text into assignments of names to literals and other names.

One lexer knows strings (quoted, triple, back-quoted, with prefixes), comments, names, tags and assignment signs; what
stands left and right of each sign becomes an `Assignment`. The time is linear in the text, whatever stands in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

_STRING = r'''"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*+\'\'\'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+\''''
_NOTE = r"(?P<note>(?:(?<!\S)\#(?![ \t]*define\b)|(?<!:)//)[^\n]*|/\*(?:.*?\*/|.*)|<!--(?:.*?-->|.*))|"
_REST = rf"""
  (?P<define>(?<!\S)\#[ \t]*define(?=[ \t]+[A-Za-z_]))
 |(?P<tag><[A-Za-z_][\w.:-]*(?=[\s/>]))
 |(?P<string>(?<!\w)(?:[rRbBfFuU]{{1,2}}(?=["']))?(?:{_STRING})|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|`[^`\\]*+(?:\\.[^`\\]*+)*+`)
 |(?P<name>[$@%]?[A-Za-z_]\w*(?:(?:\.|->|::|-)\w+)*)
 |(?P<line>\n)
 |(?P<set>:=|=>|\+=|\?=|(?<![=!<>~*/%&^-])=(?![=~])|(?<!:):(?!:|//))
 |(?P<other>\d[\w.]*|\\.|\S)
"""
_CODE = re.compile(_NOTE + _REST, re.S | re.X)
_INNER = re.compile(_REST, re.S | re.X)  # in a comment, where signs of comments mean nothing more
_OPEN, _CLOSE = "([{", ")]}"
_JOIN = {"+", ".", "&", "~", "\\\n"}
_LEAD = {"export", "set", "env", "arg", "const", "let", "var", "local", "readonly", "-", "*"}
_ELSE = {"or", "else"}
_WRAP = {"str", "bytes", "bytearray", "String", "Secret", "SecretStr", "b64decode", "unquote", "strip", "trim"}
_REFERENCE = {True: re.compile(r"\{([A-Za-z_][\w.]*)[^{}]*\}"), False: re.compile(r"[$#]\{([A-Za-z_][\w.]*)[^{}]*\}")}
_BLOCK = re.compile(r"[ \t]*[|>][+-]?\d?[+-]?[ \t]*\n")
_BARE = re.compile(r"[^\s\"'`()\[\]{}]+")


@dataclass(frozen=True)
class Assignment:
    """`name` gets one of `values`; each value is a row of parts: (`literal` or `bare`, start, end) or (`name`, name).

    A bare part is a word without quotes: names joined by `+` if all of them are known, a literal otherwise.
    `adds`: the value is put behind the one the name has.
    """

    name: str
    values: tuple[tuple[tuple, ...], ...]
    adds: bool = False


def assignments(text: str) -> tuple[list[Assignment], list[Assignment]]:
    """Assignments of the code and of its comments, each in order of their signs."""
    code = _Reader(text, 0, len(text), _CODE)
    notes = [a for _, start, end in code.notes for a in _Reader(text, start, end, _INNER).read()]
    return list(code.read()), notes


class _Reader:
    def __init__(self, text: str, start: int, end: int, pattern: re.Pattern) -> None:
        self.text, self.end = text, end
        found = [(m.lastgroup, *m.span()) for m in pattern.finditer(text, start, end)]
        self.notes = [t for t in found if t[0] == "note"]
        if pattern is _INNER:  # the comment's own sign
            signs = next((i for i, t in enumerate(found) if t[0] != "other" or text[t[1]] not in "#/*<!-"), len(found))
            found = found[signs:]
        self.tokens = [t for t in found if t[0] != "note"]
        self.match: dict[int, int] = {}
        opened: list[int] = []
        for i, (kind, a, b) in enumerate(self.tokens):
            if kind == "other" and b - a == 1:
                if text[a] in _OPEN:
                    opened.append(i)
                elif text[a] in _CLOSE and opened:
                    self.match[opened.pop()] = i

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else "end"

    def word(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]] if 0 <= i < len(self.tokens) else ""

    def read(self) -> Iterator[Assignment]:
        before = -1  # the assignment sign seen last
        for i, (kind, _, _) in enumerate(self.tokens):
            if kind == "set":
                found = self.target(i, before)
                before = i
                if found:
                    name, first = found
                    values = self.block(i) or self.bare(i, first) or self.values(i + 1)
                    if values:
                        yield Assignment(name, values, self.word(i) == "+=")
            elif kind == "define":
                values = self.values(i + 2) or self.bare(i + 1, i)
                if values:
                    yield Assignment(self.word(i + 1), values)
            elif kind == "tag":
                yield from self.element(i)

    def target(self, i: int, before: int) -> tuple[str, int] | None:
        """Name left of sign `i` and the token it begins at."""
        kind, word = self.kind(i - 1), self.word(i - 1)
        if self.word(i) == "=" and self.word(before) == ":" and self.kind(before - 1) == "name":  # name: type = value
            between = range(before + 1, i)
            if between and all(self.kind(j) == "name" or self.word(j) in {"[", "]", "|", ",", "?"} for j in between):
                return self.word(before - 1).lstrip("$@%"), before - 1
        if kind == "name":
            return word.lstrip("$@%"), i - 1
        if kind == "string":
            return self.inside(i - 1), i - 1
        if word == "]" and self.word(i - 3) == "[" and self.kind(i - 2) in ("string", "name"):  # settings["name"] = value
            return (self.inside(i - 2) if self.kind(i - 2) == "string" else self.word(i - 2)), i - 3
        return None

    def inside(self, i: int) -> str:
        a, b = self.body(i)
        return self.text[a:b]

    def body(self, i: int) -> tuple[int, int]:
        """Start and end of what stands between the quotes of string `i`."""
        _, a, b = self.tokens[i]
        while self.text[a] not in "\"'`":
            a += 1
        n = 3 if b - a >= 6 and self.text[a : a + 3] in ('"""', "'''") else 1
        return a + n, b - n

    def parts(self, i: int) -> list[tuple]:
        """String `i` as literals and the names that are put into it."""
        a, b = self.body(i)
        start = self.tokens[i][1]
        formatted = "f" in self.text[start:a].lower()
        out, at = [], a
        if formatted or self.text[a - 1] != "'":
            for m in _REFERENCE[formatted].finditer(self.text, a, b):
                out += [("literal", at, m.start())] * (m.start() > at) + [("name", m.group(1))]
                at = m.end()
        return [*out, *[("literal", at, b)] * (b > at)]

    def block(self, i: int) -> tuple | None:
        """Lines of a block scalar after sign `i`, each a value of its own."""
        if self.word(i) != ":":
            return None
        head = _BLOCK.match(self.text, self.tokens[i][2], self.end)
        if not head:
            return None
        start = self.text.rfind("\n", 0, self.tokens[i][1]) + 1
        own = len(self.text[start : self.tokens[i][1]]) - len(self.text[start : self.tokens[i][1]].lstrip(" \t-"))
        lines, at = [], head.end()
        while at < self.end:
            stop = self.text.find("\n", at, self.end)
            stop = self.end if stop < 0 else stop
            line = self.text[at:stop]
            if line.strip():
                indent = len(line) - len(line.lstrip())
                if indent <= own:
                    break
                lines.append((("literal", at + indent, at + len(line.rstrip())),))
            at = stop + 1
        return tuple(lines)

    def bare(self, i: int, first: int) -> tuple | None:
        """A word without quotes that fills the line after sign `i`, if the name at `first` begins it."""
        if self.kind(first - 1) == "name" or self.word(first - 1) in _LEAD:
            if self.word(first - 1).lower() not in _LEAD:
                return None
            first -= 1
        if self.kind(first - 1) not in ("line", "end"):
            return None
        at = self.tokens[i][2]
        stop = self.text.find("\n", at, self.end)
        line = re.split(r"[ \t](?:#|//|;|/\*|<!--)", self.text[at : self.end if stop < 0 else stop], maxsplit=1)[0]
        m = _BARE.fullmatch(line.strip().rstrip(",;"))
        if not m:
            return None
        at += len(line) - len(line.lstrip())
        return ((("bare", at, at + m.end()),),)

    def values(self, j: int) -> tuple:
        """Values of the expression at token `j`: strings and names in a row, lists, and what stands behind `or`, `else`, `?`."""
        out, row, depth, listed = [], [], 0, []
        last, quoted, condition = "", False, False  # what was seen last: "", "term" or "join"
        while True:
            kind, word = self.kind(j), self.word(j)
            if kind in ("end", "define", "tag"):
                break
            if kind == "line":
                if depth == 0 and last != "join" and not (self.word(j + 1) in {"+", "."} and last == "term"):
                    break
            elif kind == "set":
                if word != ":" or not out:  # the second branch of a choice goes on
                    break
                out.append(row)
                row, last = [], ""
            elif kind == "string":
                if last == "term" and not (row and self.kind(j - 1) in ("string", "line", "other")):
                    break
                row += self.parts(j)
                last, quoted = "term", True
            elif kind == "name" and (word in _ELSE or word == "if" and quoted):
                if not condition:
                    out.append(row)
                row, last, condition = [], "", word == "if"
            elif kind == "name":
                call = self.word(j + 1) in ("(", "[") and self.tokens[j + 1][1] == self.tokens[j][2]
                short = re.split(r"\.|->|::", word)[-1]
                if last == "term":
                    row = row if quoted else []
                    break
                if call and not (short in _WRAP and self.word(j + 1) == "("):
                    if self.word(j + 1) == "[" and self.kind(j + 2) == "string" and self.word(j + 3) == "]":
                        row.append(("name", self.inside(j + 2)))
                    if j + 1 not in self.match:
                        break
                    j = self.match[j + 1]
                    last = "term"
                elif not call:
                    row.append(("name", word.lstrip("$@%")))
                    last = "term"
            elif word in _JOIN:
                last = "join"
            elif word in ("|", "?"):
                out.append(row)
                row, last = [], ""
            elif word in ("(", "["):
                if last == "term":
                    break
                depth += 1
                listed.append(word == "[")
            elif word in (")", "]"):
                if depth == 0:
                    break
                depth -= 1
                listed.pop()
                last = "term"
            elif word == "," and depth and listed[-1]:
                out.append(row)
                row, last = [], ""
            else:
                break
            j += 1
        return tuple(tuple(r) for r in [*out, row] if r)

    def element(self, i: int) -> Iterator[Assignment]:
        """`<name>literal</name>`, and elements that give name and value as attributes."""
        given: dict[str, int] = {}
        j = i + 1
        while True:
            if self.kind(j) == "line":
                j += 1
            elif self.kind(j) == "name" and self.word(j + 1) == "=" and self.kind(j + 2) == "string":
                given[self.word(j).lower()] = j + 2
                j += 3
            else:
                break
        label = next((self.inside(given[k]) for k in ("name", "key", "id") if k in given), self.word(i)[1:])
        if "value" in given and self.inside(given["value"]):
            yield Assignment(label, ((("literal", *self.body(given["value"])),),))
        if self.word(j) == ">":
            a = self.tokens[j][2]
            b = self.text.find("<", a, self.end)
            held = self.text[a:b] if b >= 0 else ""
            if held.strip() and self.text.startswith("</", b):
                yield Assignment(label, ((("literal", a + len(held) - len(held.lstrip()), a + len(held.rstrip())),),))
