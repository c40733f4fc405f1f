"""One text as tokens, by modes: code, templates, and elements of JSX, one inside the other to any depth.

What a sign means depends on where it stands: a brace may end a block or the
``${`` of a template, ``<`` may compare, hold types or begin an element.  So a
stack tells what is open; a text is read once, from left to right.
"""

from __future__ import annotations

from bisect import bisect_right

import regex

#: tok, line, col (bytes, from 1), level, step, place of the other bracket (None), place of the bracket around (0).
Token = tuple[str, int, int, int, int, int | None, int]

#: Comes before what is text and no name: pieces of templates, JSX text, names of attributes.
TEXT = "\u0001"
#: Brackets of a whole element.
ELEMENT, END = "⟨", "⟩"

_CODE = regex.compile(
    r"(?P<skip>\s++|//[^\n]*+|(?s:/\*.*?(?:\*/|$)))"
    r"|(?P<string>\"[^\"\\\n]*+(?:\\(?s:.)[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'|`(?:[^`\\$]++|\\(?s:.)|\$(?!\{))*+`)"
    r"|(?P<name>#?[\p{L}_$][\p{L}\p{N}_$]*+)|(?P<number>[0-9][0-9A-Za-z_.]*+)"
    r"|(?P<sign>=>|\?\.(?![0-9])|\.\.\.|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|>=|[-+*/%&|^]=|\+\+|--|&&|\|\||\?\?|(?s:.))"
)
_PATTERN = regex.compile(r"/(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+")
_PIECE = regex.compile(r"(?:[^`\\$]++|\\(?s:.)|\$(?!\{))*+")
_SPACE = regex.compile(r"(?:\s++|/\*(?s:.*?)\*/|//[^\n]*+)*+")
_TAG_NAME = regex.compile(r"[\p{L}_$][\p{L}\p{N}_$-]*+")
_JSX_TEXT = regex.compile(r"[^<{]++")
_JSX_STRING = regex.compile(r"\"[^\"]*+\"|'[^']*+'")
_BEGINS_ELEMENT = regex.compile(r"<(?:>|[\p{L}_$])")
_GENERIC = regex.compile(r"<\s*[\p{L}_$][\p{L}\p{N}_$]*\s*(?:,|extends\b)")
#: Behind these a value begins: a pattern between slashes, an element, or a function's type parameters.
_VALUE = frozenset("( , = : [ ! & | ? { } ; => && || ?? + - * / % < > ~ ^ == === != !== <= >= += -= ... return typeof case in of delete void throw new else do default yield await async export".split()) | {"${"}
_TYPES = regex.compile(r"[\w$.,\s|\[\]?:;-]++|&(?!&)|=>|\"[^\"\n]*+\"|'[^'\n]*+'")
_BEHIND_TYPES = regex.compile(r"\s*+(?:[(){},;=>|&\[\]:`]|$|(?:extends|implements|is)\b)")


def _types(text: str, at: int) -> int:
    """End of the type arguments that begin at ``<``; 0 if what follows is none.  Any depth; signs that no type holds end the search."""
    depth, nested = 0, []
    while at < len(text):
        sign = text[at]
        if sign == "<":
            depth += 1
        elif sign == ">":
            depth -= 1
            if not depth:
                return at + 1 if not nested else 0
        elif sign in "({":
            nested.append(sign)
        elif sign in ")}":
            if not nested or nested.pop() != {")": "(", "}": "{"}[sign]:
                return 0
        else:
            m = _TYPES.match(text, at)
            if not m or (";" in m[0] and not nested):
                return 0
            at = m.end() - 1
        at += 1
    return 0


class _Reader:
    """Reads a text; ``out`` has its tokens, ``balanced`` tells whether all brackets close."""

    def __init__(self, text: str, jsx: bool) -> None:
        self.text, self.jsx, self.at = text, jsx, 0
        self.ascii = text.isascii()
        self.lines = [0]
        at = text.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = text.find("\n", at + 1)
        self.out: list[list] = []
        self.open: list[int] = []  # places of brackets that are open
        self.parents: list[int] = []  # how many were open at elements whose children are being read
        self.balanced = True

    def add(self, tok: str, at: int, step: int = 0) -> None:
        line = bisect_right(self.lines, at)
        begin = self.lines[line - 1]
        col = (at - begin if self.ascii else len(self.text[begin:at].encode())) + 1
        place = len(self.out) + 1
        if step < 0:
            if self.open:
                opened = self.open.pop()
                self.out[opened - 1][5] = place
                self.out.append([tok, line, col, len(self.open) + 1, step, opened, self.open[-1] if self.open else 0])
                return
            self.balanced, step = False, 0  # a bracket that closes nothing is a sign like others
        self.out.append([tok, line, col, len(self.open) + (step > 0), step, None, self.open[-1] if self.open else 0])
        if step > 0:
            self.open.append(place)

    def kind(self) -> str:
        """The innermost open bracket."""
        return self.out[self.open[-1] - 1][0] if self.open else ""

    def run(self) -> None:
        modes = [self.code]
        while self.at < len(self.text):
            go = modes[-1]()
            if go is None:
                modes.pop()
                if not modes:
                    modes = [self.code]
            elif go is not True:
                modes.append(go)
        self.balanced = self.balanced and not self.open
        for place in self.open:  # brackets that nothing closes are signs too
            self.out[place - 1][4] = 0

    def code(self):
        """One token; gives the mode to go into, None to leave this one, True to stay."""
        text, at = self.text, self.at
        before = self.out[-1][0] if self.out else None
        sign = text[at]
        if sign == "/" and (before is None or before in _VALUE) and (m := _PATTERN.match(text, at)):
            self.at = m.end()
            self.add(m[0], at)
            return True
        if sign == "<" and (end := self.angle(at, before)):
            if end < 0:
                return self.element()
            self.at = end
            self.add(text[at:end], at)
            return True
        m = _CODE.match(text, at)
        self.at = m.end()
        if m.lastgroup == "skip":
            return True
        tok = m[0]
        if tok == "`":
            self.add(tok, at, 1)
            return self.template
        if tok in ("{", "(", "["):
            self.add(tok, at, 1)
        elif tok in ("}", ")", "]"):
            held = tok == "}" and self.kind() == "${"
            self.add(tok, at, -1)
            if held:
                return None
        else:
            self.add(tok, at)
        return True

    def angle(self, at: int, before: str | None) -> int:
        """Where the types end that begin here; -1 for an element, 0 for a sign."""
        value = before is None or before in _VALUE
        if value and self.jsx and _BEGINS_ELEMENT.match(self.text, at) and not _GENERIC.match(self.text, at):
            return -1
        if not value and not (before[0] == "_" or before[0] in "#$" or before[0].isalpha()):
            return 0
        end = _types(self.text, at)
        if not end:
            return 0
        if value:
            return end if _SPACE.match(self.text, end).end() < len(self.text) and self.text[_SPACE.match(self.text, end).end()] == "(" else 0
        return end if _BEHIND_TYPES.match(self.text, end) else 0

    def template(self):
        """Text up to a ``${`` or the end."""
        m = _PIECE.match(self.text, self.at)
        if m[0]:
            self.add(TEXT + m[0], self.at)
        self.at = m.end()
        if self.text.startswith("${", self.at):
            self.add("${", self.at, 1)
            self.at += 2
            return self.code
        if self.at < len(self.text):
            self.add("`", self.at, -1)
            self.at += 1
        return None

    def element(self):
        self.add(ELEMENT, self.at, 1)
        self.at += 1
        self.tag_name()
        return self.tag

    def tag_name(self) -> None:
        while m := _TAG_NAME.match(self.text, self.at):
            self.add(m[0] if "-" not in m[0] else TEXT + m[0], self.at)
            self.at = m.end()
            if self.at < len(self.text) and self.text[self.at] == "." and _TAG_NAME.match(self.text, self.at + 1):
                self.add(".", self.at)
                self.at += 1
            elif self.at < len(self.text) and self.text[self.at] == ":":
                self.at += 1
            else:
                break
        if self.at < len(self.text) and self.text[self.at] == "<" and (end := _types(self.text, self.at)):
            self.at = end  # type arguments of a component tell nothing

    def tag(self):
        """An element: attributes up to the end of the opening tag, then children up to the closing one."""
        text = self.text
        if self.parents and self.parents[-1] == len(self.open):
            return self.children()
        self.at = _SPACE.match(text, self.at).end()
        if self.at >= len(text):
            return None
        sign = text[self.at]
        if text.startswith("/>", self.at):
            self.add(END, self.at, -1)
            self.at += 2
            return None
        if sign == ">":
            self.at += 1
            self.parents.append(len(self.open))
            return True
        if sign == "{":
            self.add("${", self.at, 1)
            self.at += 1
            return self.code
        if sign == "<":
            return self.element()
        if m := _JSX_STRING.match(text, self.at):
            self.at = m.end()
        elif m := _TAG_NAME.match(text, self.at):
            self.add(TEXT + m[0], self.at)
            self.at = m.end()
        else:
            self.at += 1  # = or : between names
        return True

    def children(self):
        text = self.text
        if m := _JSX_TEXT.match(text, self.at):
            if m[0].strip():
                self.add(TEXT + m[0], self.at)
            self.at = m.end()
            return True
        if text[self.at] == "{":
            self.add("${", self.at, 1)
            self.at += 1
            return self.code
        if text.startswith("</", self.at):
            self.add(TEXT + "/", self.at)
            self.at += 2
            self.at = _SPACE.match(text, self.at).end()
            self.tag_name()
            end = text.find(">", self.at)
            self.parents.pop()
            self.add(END, end if end >= 0 else self.at, -1)
            self.at = end + 1 if end >= 0 else len(text)
            return None
        return self.element()


def lex(text: str, jsx: bool = True) -> tuple[list[Token], bool]:
    """The tokens of a text without comments and white space, and whether all brackets close.

    ``jsx``: whether ``<name`` in place of a value begins an element.  An element
    stands between ``⟨`` and ``⟩``; names of attributes, text and pieces of templates begin
    with U+0001, which no name does.  Never fails: what is no token is a sign.
    """
    reader = _Reader(text, jsx)
    reader.run()
    return [tuple(t) for t in reader.out], reader.balanced
