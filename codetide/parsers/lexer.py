"""A lexer for brace languages: words, strings, directives and punctuation, with matched brackets.

Comments and white space are left out, and nothing inside a string or comment
counts as code.  What is not closed runs to the end of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

OPENING = {"(": ")", "[": "]", "{": "}"}
_CLOSING = set(OPENING.values())
_PAIRS = ("&&", "||", "=>", "->", "::", "...", "?.", "??")
#: After these a slash begins a pattern where a language has such literals.
_BEFORE_PATTERN = set("(,=:[!&|?{};+-*%<>~^") | {"&&", "||", "??", "=>", "...", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}


@dataclass(frozen=True)
class Lexicon:
    """What sets a language's tokens apart."""

    #: Quotes of strings with escapes, on one line.
    quotes: str = "\"'"
    #: Quotes of strings over several lines without escapes, tried first.
    blocks: tuple[str, ...] = ()
    #: Quotes of strings over several lines with escapes and ``${}``.
    templates: str = ""
    #: Lines that begin with ``#`` are directives.
    directives: bool = False
    #: ``/x/`` may be a pattern, and types may hold braces: ``T<{a: U}>``.
    patterns: bool = False
    #: ``@"x""y"`` is a string without escapes.
    verbatim: bool = False
    #: ``R"tag(x)tag"`` is a string without escapes.
    tagged: bool = False


class Tokens:
    """Three parallel lists, and what closes each bracket.

    ``kinds`` are w (word or number), s (string), d (directive) and p (punctuation);
    ``texts`` hold a string's content without its quotes; ``starts`` are offsets.
    """

    def __init__(self, text: str, lexicon: Lexicon):
        self.text = text
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.starts: list[int] = []
        self.close: dict[int, int] = {}
        self._breaks = [i for i, c in enumerate(text) if c == "\n"]
        self._read(lexicon)
        self._match()
        self.angles: dict[int, int] = {}
        self._match_angles(lexicon.patterns)

    def __len__(self) -> int:
        return len(self.texts)

    def line(self, token: int) -> int:
        """The line a token stands on, from 1; the last line past the end."""
        at = self.starts[token] if token < len(self) else max(0, len(self.text) - 1)
        return bisect_right(self._breaks, at - 1) + 1

    def is_word(self, token: int) -> bool:
        return 0 <= token < len(self) and self.kinds[token] == "w"

    def after(self, token: int) -> int:
        """The token after this one, or after its group if it opens one."""
        return self.close.get(token, token) + 1

    def source(self, start: int, end: int) -> str:
        """The tokens as they stand, with single spaces for white space and comments."""
        out, last = [], None
        for i in range(start, end):
            here = self.starts[i]
            if last is not None and here > last:
                out.append(" ")
            out.append(self.texts[i])
            last = here + len(self.texts[i])
        return "".join(out)

    def _add(self, kind: str, text: str, start: int) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.starts.append(start)

    def _read(self, lex: Lexicon) -> None:
        text, n, i = self.text, len(self.text), 0
        word = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|\d(?:'?[\w.])*" if lex.tagged else r"[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*")
        while i < n:
            c = text[i]
            if c.isspace():
                i += 1
            elif text.startswith("//", i):
                i = _find(text, "\n", i)
            elif text.startswith("/*", i):
                i = _find(text, "*/", i + 2) + 2
            elif c == "#" and lex.directives and text[text.rfind("\n", 0, i) + 1 : i].isspace() | (i == 0 or text[i - 1] == "\n"):
                end = _find(text, "\n", i)
                while end < n and text[end - 1] == "\\":
                    end = _find(text, "\n", end + 1)
                self._add("d", text[i:end], i)
                i = end
            elif (end := self._string(lex, i)) is not None:
                i = end
            elif found := word.match(text, i):
                self._add("w", found[0], i)
                i = found.end()
            else:
                pair = next((p for p in _PAIRS if text.startswith(p, i)), c)
                self._add("p", pair, i)
                i += len(pair)

    def _string(self, lex: Lexicon, i: int) -> int | None:
        """Read the string or pattern that begins here, if one does, and say where it ends."""
        text, c = self.text, self.text[i]
        for q in lex.blocks:
            if text.startswith(q, i):
                return self._until(i, i + len(q), _find(text, q, i + len(q)), len(q))
        if lex.verbatim and c in "@$" and (lead := re.compile(r'(?:@\$|\$@|@)"').match(text, i)):
            end = lead.end()
            while (end := _find(text, '"', end)) < len(text) and text.startswith('""', end):
                end += 2
            return self._until(i, lead.end(), end, 1)
        if lex.tagged and c == "R" and (lead := re.compile(r'R"([^()\\\s]{0,16})\(').match(text, i)):
            closing = f'){lead[1]}"'
            return self._until(i, lead.end(), _find(text, closing, lead.end()), len(closing))
        if c in lex.templates:
            end = _template_end(text, i)
            return self._until(i, i + 1, max(i + 1, end - 1), 1)
        if c in lex.quotes:
            return self._until(i, i + 1, _unescaped(text, c, i + 1), 1)
        if c == "/" and lex.patterns and (not self.texts or self.texts[-1] in _BEFORE_PATTERN):
            end, inside = i + 1, False
            while end < len(text) and text[end] != "\n" and (text[end] != "/" or inside):
                inside = text[end] == "[" or inside and text[end] != "]"
                end += 2 if text[end] == "\\" else 1
            return self._until(i, i + 1, min(end, len(text)), 1)
        return None

    def _until(self, start: int, first: int, end: int, closing: int) -> int:
        self._add("s", self.text[first:end], start)
        return min(len(self.text), end + closing)

    def _match(self) -> None:
        """Pair brackets; a closing one without its partner closes what is open inside its own kind."""
        stack: list[int] = []
        open_of = {c: 0 for c in _CLOSING}
        for i, t in enumerate(self.texts):
            if self.kinds[i] != "p":
                continue
            if t in OPENING:
                stack.append(i)
                open_of[OPENING[t]] += 1
            elif t in _CLOSING and open_of[t]:
                found = ""
                while found != t:
                    found = OPENING[self.texts[stack[-1]]]
                    open_of[found] -= 1
                    self.close[stack.pop()] = i if found == t else i - 1
        for o in stack:
            self.close[o] = len(self.texts)

    def _match_angles(self, tight: bool) -> None:
        """Pair ``<`` and ``>`` within a statement and a bracket, as around type arguments.

        ``tight`` ones stand right behind a word and may hold braces.
        """
        stack: list[int] = []
        outer: list[list[int]] = []
        for i, t in enumerate(self.texts):
            if self.kinds[i] != "p":
                continue
            if t == "<":
                if not tight or i and self.starts[i] == self.starts[i - 1] + len(self.texts[i - 1]):
                    stack.append(i)
            elif t == ">" and stack:
                self.angles[stack.pop()] = i
            elif t in OPENING:
                outer.append(stack)
                stack = []
            elif t in _CLOSING:
                stack = outer.pop() if outer else []
            if t == ";" or not tight and t in "{}":
                stack = []


def _find(text: str, what: str, start: int) -> int:
    at = text.find(what, start)
    return len(text) if at < 0 else at


def _unescaped(text: str, quote: str, i: int) -> int:
    """Where a one-line string ends: at its quote, or at the end of the line."""
    while i < len(text) and text[i] not in (quote, "\n"):
        i += 2 if text[i] == "\\" else 1
    return min(i, len(text))


def _template_end(text: str, i: int) -> int:
    """The offset after a template and the templates in its ``${}``."""
    modes = [-1]  # -1 in a template, else how many braces are open in the code of a ``${}``
    i += 1
    while i < len(text) and modes:
        c = text[i]
        if modes[-1] < 0:
            if c == "\\":
                i += 1
            elif c == "`":
                modes.pop()
            elif text.startswith("${", i):
                modes.append(0)
                i += 1
        elif c == "`":
            modes.append(-1)
        elif c in "\"'":
            i = _unescaped(text, c, i + 1)
        elif c == "{":
            modes[-1] += 1
        elif c == "}" and modes[-1]:
            modes[-1] -= 1
        elif c == "}":
            modes.pop()
        i += 1
    return min(i, len(text))
