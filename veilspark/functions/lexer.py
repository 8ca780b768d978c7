"""Code cut into pieces by a lexer with a stack: code inside templates is code, and a slash is a pattern or a division by what
stands before it. A small helper for the Arrow UDFs in `operators.source`; the pieces of a text always make it up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Piece(NamedTuple):
    """kind: comment, specifier, string, identifier, quote, number, pattern, mark or space; a quote is what delimits strings, or an escape."""

    kind: str
    text: str
    start: int


BREAK = re.compile(r"[^\n]*+")
#: Where one line ends without the closing quote, the quote stands alone.
QUOTES = {q: re.compile(rf"{q}[^{q}\\\n]*+(?:\\[\s\S][^{q}\\\n]*+)*+{q}") for q in "'\""}
PATTERN = re.compile(r"/(?![*/])[^\\/\[\n]*+(?:(?:\\[^\n]|\[[^\]\\\n]*+(?:\\[^\n][^\]\\\n]*+)*+\])[^\\/\[\n]*+)*+/[A-Za-z]*+")
ESCAPE = re.compile(r"(\\(?:u\{[^{}\n]{0,8}\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|\r\n|[\s\S]))")
MARKS = r"=>|[=!]==?|\*\*=?|\+\+|--|&&=?|\|\|=?|\?\?=?|\?\.(?![0-9])|\.\.\.|[-+*/%&|^<>]=|[\s\S]"
SPACE, NUMBER = r"\s++", r"\.?[0-9](?:[eE][+-][0-9]|[\w.])*+"
COMMENT = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\Z)"
CODE = re.compile(rf"(?P<space>{SPACE})|(?P<comment>{COMMENT}|\A#![^\n]*+)|(?P<number>{NUMBER})|(?P<identifier>(?:[^\W\d]|\$)(?:\w|\$)*+)|(?P<mark>{MARKS})")
#: Dashes belong to names, numbers signs begin comments, and texts may run to a word of the author's choice.
HCL_CODE = re.compile(
    rf"(?P<space>{SPACE})|(?P<comment>{COMMENT}|\#[^\n]*+)|(?P<number>{NUMBER})|(?P<identifier>[^\W\d][\w-]*+)|(?P<heredoc><<-?[^\W\d][\w-]*+[ \t]*\r?\n)|(?P<mark>{MARKS})"
)
#: What runs up to an interpolation or the end of a template.
TEMPLATE = re.compile(r"[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*+)*+")
HCL_TEMPLATE = re.compile(r'[^"\\$%]*+(?:(?:\\[\s\S]|\$\$\{|%%\{|[$%](?!\{))[^"\\$%]*+)*+')
HEREDOC = re.compile(r"[^\n$%]*+(?:(?:\$\$\{|%%\{|[$%](?!\{))[^\n$%]*+)*+")

#: Words after which a value begins, words whose parentheses stand before a statement, and words that are no names.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())
HEADS = frozenset("if while for with".split())
WORDS = BEFORE_VALUE | HEADS | frozenset(
    "break catch class const continue debugger default enum export extends false finally function import let null super switch this true try var async static undefined".split()
)
#: Calls whose first text names a module.
MODULE_CALLS = frozenset(
    "require import require.resolve jest.mock jest.unmock jest.doMock jest.dontMock jest.requireActual jest.requireMock jest.setMock import.meta.resolve".split()
)


def fragments(text: str, start: int, kind: str = "string") -> Iterator[Piece]:
    """The inside of a string: what stands between escapes, and the escapes."""
    for i, part in enumerate(ESCAPE.split(text)):
        if part:
            yield Piece("quote" if i % 2 else kind, part, start)
            start += len(part)


BRACKETS = frozenset("()[]{}")


class Lexer:
    """One text. `last` holds the marks, names and values read last, without space and comments; six say all that is asked."""

    def __init__(self, text: str, hcl: bool = False):
        self.text, self.hcl, self.at = text, hcl, 0
        self.code, self.template = (HCL_CODE, HCL_TEMPLATE) if hcl else (CODE, TEMPLATE)
        self.last: list[tuple[str, str]] = []
        self.open: list[tuple[str, object]] = []  # brackets and templates that are open
        self.alone = {"'": 0, '"': 0, "/": 0}  # up to where each of them opens nothing
        self.ends_statement = False  # whether the bracket closed last was a head or a block

    def before(self, n: int = 1) -> tuple[str, str]:
        return self.last[-n] if len(self.last) >= n else ("", "")

    def after_value(self) -> bool:
        kind, text = self.before()
        if kind == "identifier":
            return text not in BEFORE_VALUE or self.before(2)[1] in (".", "?.")
        if kind == "mark":
            return text == "]" or text in (")", "}") and not self.ends_statement or text in ("++", "--")
        return kind != ""

    def names_module(self) -> bool:
        """Whether a text that begins here names a module."""
        kind, text = self.before()
        if kind == "identifier" and text in ("from", "import"):
            return self.before(2)[1] not in (".", "?.")
        if text != "(":
            return False
        name = [t for _, t in self.last[-6:-1]]
        return any("".join(name[-n:]) in MODULE_CALLS and "".join(name[-n - 1 : -n]) not in (".", "?.") for n in (1, 3, 5) if len(name) >= n)

    def emit(self, kind: str, end: int) -> Piece:
        piece = Piece(kind, self.text[self.at : end], self.at)
        self.at = end
        if kind not in ("space", "comment"):
            self.last.append((kind, piece.text))
            if len(self.last) > 600:
                del self.last[:-6]
        return piece

    def bracket(self, mark: str) -> bool:
        """Keeps the stack; true where a brace takes a template up again."""
        if mark == "(":
            self.open.append(("(", self.before()[1] in HEADS and self.before(2)[1] not in (".", "?.")))
        elif mark == "[":
            self.open.append(("[", False))
        elif mark == "{":
            kind, text = self.before()
            block = kind == "" or kind == "mark" and text in (")", "{", "}", ";", "=>") or text in ("else", "do", "try", "finally")
            self.open.append(("{", block))
        elif mark in ")]":
            self.ends_statement = False
            if self.open and self.open[-1][0] == {")": "(", "]": "["}[mark]:
                self.ends_statement = bool(self.open.pop()[1])
        elif mark == "}":
            self.ends_statement = False
            while self.open and self.open[-1][0] in "([":
                self.open.pop()
            if self.open:
                if self.open[-1][0] == "$":
                    return True
                self.ends_statement = bool(self.open.pop()[1])
        return False

    def templated(self) -> Iterator[Piece]:
        """From where the text of a template begins or goes on, up to the next interpolation or its end."""
        closing, kind = self.open[-1][1]
        if closing in ("`", '"'):
            end = self.template.match(self.text, self.at).end()
            if kind == "specifier" and self.text[end : end + 1] != closing:
                kind = "string"  # what is put together names no module that could be read
            yield from fragments(self.text[self.at : end], self.at, kind)
        else:  # a heredoc: lines up to its word
            end = self.at
            while end < len(self.text):
                line = BREAK.match(self.text, end).end()
                if self.text[end:line].strip() == closing and self.text[end - 1] == "\n":
                    break
                end = HEREDOC.match(self.text, end).end()
                if end < line:
                    break
                end = min(line + 1, len(self.text))
            if end > self.at:
                yield Piece("string", self.text[self.at : end], self.at)
        self.at = end
        if self.text[end : end + 2] in ("${", "%{"):
            self.open[-1] = ("$", (closing, "string"))
            yield self.emit("quote", end + 2)
            self.last.append(("mark", "("))
            return
        self.open.pop()
        if end < len(self.text):
            yield self.emit("quote", end + 1 if closing in ("`", '"') else BREAK.match(self.text, end).end())

    def pieces(self) -> Iterator[Piece]:
        text, size, match, last, new = self.text, len(self.text), self.code.match, self.last, tuple.__new__
        apart = frozenset('"' if self.hcl else "`'\"/")  # where something other than code may begin
        while self.at < size:
            first = text[self.at]
            if first not in apart:  # most pieces: as emit does, without its calls
                found = match(text, self.at)
                kind, piece = found.lastgroup, found[0]
                if kind in ("identifier", "space", "number", "comment") or kind == "mark" and piece not in BRACKETS:
                    yield new(Piece, (kind, piece, self.at))
                    self.at = found.end()
                    if kind != "space" and kind != "comment":
                        last.append((kind, piece))
                        if len(last) > 600:
                            del last[:-6]
                    continue
            if first == ("\"" if self.hcl else "`"):
                self.open.append(("$", (first, "specifier" if self.names_module() else "string")))
                yield self.emit("quote", self.at + 1)
                yield from self.templated()
                continue
            if first in QUOTES and not self.hcl or first == "/" and not self.hcl and not self.after_value() and self.before()[1] != "<":
                found = (QUOTES.get(first) or PATTERN).match(self.text, self.at) if self.at >= self.alone[first] else None
                if found:
                    module = first != "/" and self.names_module()
                    if module or first == "/":
                        yield self.emit("specifier" if module else "pattern", found.end())
                    else:
                        start, inside = self.at, self.text[self.at + 1 : found.end() - 1]
                        self.emit("string", found.end())
                        yield Piece("quote", first, start)
                        yield from fragments(inside, start + 1)
                        yield Piece("quote", first, found.end() - 1)
                    continue
                if self.text[self.at : self.at + 2] not in ("//", "/*"):
                    self.alone[first] = BREAK.match(self.text, self.at).end()
            found = self.code.match(self.text, self.at)
            if found.lastgroup == "heredoc":
                word = found[0].strip().lstrip("<").removeprefix("-")
                self.open.append(("$", (word, "string")))
                yield self.emit("quote", found.end())
                yield from self.templated()
            elif found.lastgroup == "mark" and found[0] in "()[]{}" and self.bracket(found[0]):
                yield self.emit("quote", found.end())
                yield from self.templated()
            else:
                yield self.emit(found.lastgroup, found.end())


KEPT = frozenset(("comment", "specifier", "string", "identifier"))


def nodes(text: str, hcl: bool = False) -> Iterator[Piece]:
    """Comments, specifiers, strings and identifiers, and between them, as one piece of kind other, all else."""
    begin = end = 0
    for piece in Lexer(text, hcl).pieces():
        if piece.kind in KEPT:
            if begin < end:
                yield Piece("other", text[begin:end], begin)
            yield piece
            begin = piece.start + len(piece.text)
        end = piece.start + len(piece.text)
    if begin < end:
        yield Piece("other", text[begin:end], begin)


#: Marks that end a value.
ENDS = frozenset((",", ";", "=", ")", "]", "}"))


class Flow:
    """What flows where in one text: (src, dst, kind), each once, in order of first sight.

    Reads declarations, assignments (also by destructuring), calls of plain functions and exports off the pieces; a value
    that is a function of its own gives nothing. Nothing is known of scopes.
    """

    def __init__(self, text: str):
        self.found: dict[tuple[str, str, str], None] = {}
        self.tokens: list[tuple[str, str]] = []
        self.breaks: set[int] = set()  # numbers of the tokens that begin a line
        self.pairs: dict[int, int] = {}  # brackets of both sides
        opened: list[int] = []
        parts: list[str] | None = None  # of the string that is being read
        for p in Lexer(text).pieces():
            kind, found, _ = p
            if kind == "identifier":
                self.tokens.append((kind, found))
                continue
            if kind in ("space", "comment"):
                if "\n" in found:
                    self.breaks.add(len(self.tokens))
                continue
            if p.kind == "specifier":
                self.tokens.append(("string", p.text.strip("'\"")))
            elif p.kind == "string" or p.kind == "quote" and p.text[0] == "\\":
                parts = (parts or []) + [p.text]
            elif p.kind == "quote" and p.text in ("${", "}"):  # a template's code stands like an operand
                if parts:
                    self.tokens.append(("string", "".join(parts)))
                parts = None
                self.tokens.append(("mark", "+"))
            elif p.kind == "quote":
                if parts is not None:
                    self.tokens.append(("string", "".join(parts)))
                parts = None
            else:
                self.tokens.append((p.kind, p.text))
                if p.kind == "mark" and p.text in "([{":
                    opened.append(len(self.tokens) - 1)
                elif p.kind == "mark" and p.text in ")]}":
                    if opened and self.tokens[opened[-1]][1] + p.text in ("()", "[]", "{}"):
                        self.pairs[len(self.tokens) - 1] = opened[-1]
                        self.pairs[opened.pop()] = len(self.tokens) - 1
        self.read()

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == "mark" and self.tokens[i][1] in texts

    def name(self, i: int) -> str | None:
        """The variable that token i is, if it is one: no word of the language, no member, no key."""
        if not 0 <= i < len(self.tokens) or self.tokens[i][0] != "identifier" or self.tokens[i][1] in WORDS:
            return None
        if self.is_(i - 1, ".", "?.") or self.is_(i + 1, ":") and self.is_(i - 1, "{", ","):
            return None
        return self.tokens[i][1]

    def add(self, src: str | None, dst: str, kind: str) -> None:
        if src and src != dst:
            self.found.setdefault((src, dst, kind))

    def ends_of_values(self) -> list[int]:
        """For each token, the one behind the value that begins there: a comma, a semicolon, an equals sign, a closing bracket, or one on a new line that goes not on."""
        n = len(self.tokens)
        ends = [n] * (n + 1)
        tokens, pairs, breaks = self.tokens, self.pairs, self.breaks
        for i in range(n - 1, -1, -1):
            kind, text = tokens[i]
            if kind == "mark" and text in ENDS:
                ends[i] = i
                continue
            after = pairs.get(i, i) + 1
            ends[i] = after if after >= n or after in breaks and self.stops(after) else ends[after]
        return ends

    def stops(self, i: int) -> bool:
        """Whether token i, first of its line, begins something new."""
        goes_on = self.tokens[i][0] == "mark" and self.tokens[i][1] not in ("{", "++", "--", "!", "~", "@")
        return not goes_on and (self.tokens[i - 1][0] != "mark" or self.is_(i - 1, ")", "]", "}", "++", "--"))

    def item(self, i: int) -> tuple[str, str | None] | None:
        """What token i brings into a value: a node, and its kind where it does not follow from the value."""
        kind, text = self.tokens[i]
        if kind == "string":
            return "str:" + text, "literal"
        if kind == "identifier" and self.is_(i - 1, ".", "?.") and self.is_(i - 3, ".") and self.tokens[i - 2][1] == "env" and self.tokens[i - 4 : i - 3] == [("identifier", "process")]:
            return "env:" + text, "env"
        name = self.name(i)
        return (name, None) if name else None

    def items(self, begin: int, end: int) -> dict[tuple[str, str | None], None]:
        """The items of a range, those in its brackets by what is known of them: no token is read once more for each bracket around it."""
        out: dict[tuple[str, str | None], None] = {}
        i = begin
        while i < end:
            if i in self.inside and self.pairs[i] < end:
                out.update(self.inside[i])
                i = self.pairs[i]
            elif found := self.item(i):
                out.setdefault(found)
            i += 1
        return out

    def into(self, items: dict[tuple[str, str | None], None], kind: str, dst: str) -> None:
        for src, own in items:
            self.add(src, dst, own or kind)

    def flow(self, begin: int, end: int, dst: str) -> None:
        while begin < end and (self.is_(begin, "(") and self.pairs.get(begin) == end - 1 or self.tokens[begin][1] == "await"):
            begin, end = begin + 1, end - (self.is_(begin, "("))
        if begin >= end:
            return
        first = self.tokens[begin]
        arrow = self.pairs.get(begin, begin) + 1 if self.is_(begin, "(") else begin + 1
        if first[0] == "identifier" and first[1] in ("function", "class", "async") or self.is_(arrow, "=>"):
            return
        if first == ("identifier", "new"):
            self.add(self.name(begin + 1), dst, "construct")
        elif first == ("identifier", "require") and self.is_(begin + 1, "(") and begin + 2 < end and self.tokens[begin + 2][0] == "string":
            self.add("str:" + self.tokens[begin + 2][1], dst, "require")
        else:
            call = first[0] == "identifier" and self.is_(end - 1, ")")
            self.into(self.items(begin, end), "alias" if end - begin == 1 else "call-result" if call else "expr", dst)

    def targets(self, i: int) -> list[str]:
        """The names that a declaration's pattern binds: with a key, the name behind it; with a default, the name before it."""
        if i not in self.pairs:
            return [n for n in [self.name(i)] if n]
        return [n for j in range(i + 1, self.pairs[i]) if (n := self.name(j)) and not self.is_(j - 1, "=")]

    def declaration(self, i: int) -> None:
        while i < len(self.tokens):
            names, j = self.targets(i), self.pairs.get(i, i) + 1
            while self.is_(j, ":", "!") or j > i + 1 and j < len(self.tokens) and self.is_(i + 1, ":", "!") and self.tokens[j] not in DECLARING and not self.is_(j, "=", ";", ",", ")", "}"):
                j = self.pairs.get(j, j) + 1 if self.is_(j, "(", "[", "{") else j + 1  # a type
            if self.is_(j, "="):
                self.declared.add(j)
                end = self.ends[j + 1]
                for n in names:
                    self.flow(j + 1, end, n)
                j = end
            if not self.is_(j, ","):
                return
            i = j + 1

    def assignment(self, i: int) -> None:
        """Token i is a plain equals sign that no declaration has read."""
        end, left = self.ends[i + 1], i - 1
        if left in self.pairs and self.is_(left, "]", "}"):
            begin = self.pairs[left]
            if self.is_(left, "}") or begin == 0 or self.is_(begin - 1, ";", "(", ",", "}", "{"):
                for n in self.targets(begin):
                    self.flow(i + 1, end, n)
            return
        if left < 0 or self.tokens[left][0] != "identifier":
            return
        if not self.is_(left - 1, ".", "?."):
            if n := self.name(left):
                self.flow(i + 1, end, n)
            return
        begin = left - 2
        while begin > 1 and self.tokens[begin][0] == "identifier" and self.is_(begin - 1, ".", "?."):
            begin -= 2
        owner = "".join(t for _, t in self.tokens[max(begin, 0) : left - 1])
        member = f"member:{owner}.{self.tokens[left][1]}"
        self.flow(i + 1, end, member)
        self.add(member, owner, "member-of")
        if owner in ("module", "exports") and "exports" in (owner, self.tokens[left][1]) or owner == "module.exports":
            for n, kind in self.items(i + 1, end):
                if kind is None:
                    self.add(n, "export:" + n, "export")

    def read(self) -> None:
        self.declared: set[int] = set()
        self.ends = self.ends_of_values()
        self.inside: dict[int, dict[tuple[str, str | None], None]] = {}  # by opening bracket
        for close, begin in sorted(self.pairs.items()):
            if begin < close:
                self.inside[begin] = self.items(begin + 1, close)
        for i, (kind, text) in enumerate(self.tokens):
            if kind == "identifier":
                if (kind, text) in DECLARING and not self.is_(i - 1, ".", "?."):
                    self.declaration(i + 1)
            elif kind == "mark" and text == "=" and i not in self.declared:
                self.assignment(i)
            elif kind == "mark" and text == "(" and i in self.pairs and self.name(i - 1) and self.tokens[i - 2 : i - 1] != [("identifier", "function")] and self.tokens[i - 1][1] != "require":
                self.into({(n, None): None for n, _ in self.inside[i]}, "arg", self.tokens[i - 1][1])


DECLARING = frozenset(("identifier", w) for w in ("const", "let", "var"))
