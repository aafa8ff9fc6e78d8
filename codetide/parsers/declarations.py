"""Structure of brace languages from their tokens: types, methods, functions and imports.

A text is read declaration by declaration.  A declaration's *head* is what stands
before its ``{`` or ``;``.  A head with a word such as ``class`` declares a type,
one with a parameter list behind a name declares a method or function, and any
other block (a namespace, a loop) is read for the types within it.

Cyclomatic complexity is one more than the branch tokens of a body.  Cognitive
complexity and nesting are not measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .base import Class, Method, Parser, Structure, parameter
from .lexer import Lexicon, Tokens

#: Words before a parameter-like group that declare nothing.
CONTROL = frozenset("if else for foreach while do switch case catch try finally return throw new delete typeof sizeof using lock fixed synchronized with when yield await decltype alignas noexcept requires static_assert __attribute__ __declspec throws where assert super this function get set".split())


@dataclass(frozen=True)
class Language:
    lexicon: Lexicon
    #: The words that declare types, and the tag of types that are no classes.
    types: dict[str, str]
    branches: frozenset[str]
    #: Reads one parameter: its tokens from ``start`` to ``end``.
    parameter: Callable[[Tokens, int, int], list[dict]]
    imports: Callable[[Tokens], Iterator[str]]
    #: ``a ? b : c`` branches.
    ternary: bool = True
    #: Methods and functions have a type or modifier before their name, unless they construct.
    typed: bool = True
    #: Functions stand outside types.
    functions: bool = False
    #: The word that functions begin with, where they have one.
    function_word: str = ""
    #: Functions may be named by the sign they overload.
    operators: bool = False
    #: Statements may end with their line.
    by_line: bool = False
    modifiers: frozenset[str] = frozenset()
    constructors: frozenset[str] = frozenset()
    #: Constructors are listed first, and all of them; of other methods with one name the first counts.
    constructors_first: bool = False
    base_words: frozenset[str] = frozenset({"extends", "implements", ":"})
    #: Words among the bases that name none.
    not_bases: frozenset[str] = field(default=frozenset("public protected private virtual".split()))


# --- heads --------------------------------------------------------------------


def heads(t: Tokens, start: int, end: int) -> Iterator[tuple[int, int]]:
    """``(first, stop)`` of the declarations in a block; ``stop`` is its ``{``, or ``;`` or the end where it has no body."""
    first = i = start
    while i < end:
        here = t.texts[i] if t.kinds[i] == "p" else ""
        if here == "{" and not _is_initializer(t, first, i, end):
            yield first, i
            first = i = t.after(i)
        elif here in (";", "}"):
            yield first, i
            first = i = i + 1
        elif t.kinds[i] == "d":
            first = i = i + 1
        elif here == "<":
            i = max(i + 1, skip_angles(t, i, end))
        else:
            i = t.after(i)
    if first < end:
        yield first, end


def _is_initializer(t: Tokens, first: int, i: int, end: int) -> bool:
    """``x{1}`` in ``: x{1}, y{2} {``: a list of members that a constructor sets."""
    after = t.after(i)
    if not t.is_word(i - 1) or after >= end or t.texts[after] not in (",", "{"):
        return False
    return any(t.texts[k] == ":" and t.texts[k - 1] == ")" for k in range(first + 1, i))


def skip_angles(t: Tokens, i: int, end: int) -> int:
    """The token after a ``<...>`` group that begins here; this one if there is none."""
    closing = t.angles.get(i, end)
    return closing + 1 if closing < end else i


def top_level(t: Tokens, start: int, end: int) -> Iterator[int]:
    """The tokens of a head, without annotations and what stands inside ``()``, ``[]``, ``{}`` and ``<>``."""
    i = start
    while i < end:
        if t.texts[i] == "@" and t.is_word(i + 1) and t.texts[i + 1] != "interface":
            i += 2
            while i + 1 < end and t.texts[i] == ".":
                i += 2
            if i < end and t.texts[i] == "(":
                i = t.after(i)
        elif t.texts[i] == "<" and t.kinds[i] == "p" and (after := skip_angles(t, i, end)) > i:
            i = after
        else:
            yield i
            i = t.after(i)


def type_head(lang: Language, t: Tokens, first: int, stop: int) -> tuple[str, int] | None:
    """The word and the name's token, if the head declares a type."""
    for i in top_level(t, first, stop):
        if t.kinds[i] == "p" and t.texts[i] in ("(", "=") and not lang.by_line:
            return None
        if t.is_word(i) and t.texts[i] in lang.types and t.is_word(i + 1) and t.texts[i - 1] not in (".", "enum") and i + 1 < stop:
            if lang.by_line and not _begins(lang, t, first, i):
                continue
            name = i + 1
            if t.texts[name] in lang.types:  # enum class X
                name += 1
            return (t.texts[i], name) if t.is_word(name) else None
    return None


def bases(lang: Language, t: Tokens, name: int, stop: int) -> list[str]:
    """What follows ``extends``, ``implements`` or a colon: parts of a comma list, without access words and arguments."""
    out: list[str] = []
    part: list[str] = []
    reading = False
    for i in [*top_level(t, name + 1, stop), stop]:
        text = t.texts[i] if i < stop else ","
        text = "," if text == "where" else text
        if text in lang.base_words or text == ",":
            if part:
                out.append("".join(part))
            if i < stop and t.texts[i] == "where":
                break
            part, reading = [], reading and text == "," or text in lang.base_words
        elif reading and text not in lang.not_bases and text != "(":
            part.append(text)
    return out


def callable_head(lang: Language, t: Tokens, first: int, stop: int, owner: str | None) -> tuple[str, int, int] | None:
    """``(name, name's token, parameter group)``, if the head declares a method or function."""
    if lang.operators and (found := _operator(t, first, stop)):
        return found
    groups = [i for i in top_level(t, first, stop) if t.texts[i] == "(" and t.kinds[i] == "p"]
    for group in reversed(groups) if lang.by_line else groups:
        at = group - 1
        if t.texts[at] == ">" and t.kinds[at] == "p":  # name<T>(
            while at > first and t.texts[at] != "<":
                at -= 1
            at -= 1
        if at < first or not t.is_word(at) or t.texts[at] in CONTROL and t.texts[at] not in ("get", "set") or t.texts[at][0].isdigit():
            continue
        if at > first and t.texts[at - 1] in ("@", ".", "new", "->", "="):
            if t.texts[at - 1] == "@":
                continue
            return None
        name, before = t.texts[at], at - 1
        if before >= first and t.texts[before] == "~":
            name, before = "~" + name, before - 1
        while before > first and t.texts[before] == "::":  # Type::name
            name, before = f"{t.texts[before - 1]}::{name}", before - 2
        if lang.by_line:
            if _begins(lang, t, first, at) and _plain_trailer(t, t.after(group), stop):
                return name, at, group
            continue
        if any(t.texts[i] == "=" and t.kinds[i] == "p" for i in top_level(t, first, at)):
            return None
        constructs = owner is not None and name.lstrip("~") == owner or "::" in name and name.split("::")[-1].lstrip("~") == name.split("::")[-2]
        if lang.typed and not constructs and not any(t.is_word(i) and t.texts[i] not in CONTROL for i in range(first, before + 1)):
            return None
        if not all(t.texts[i] not in ("=", "=>", "else", "return") for i in range(t.after(group), stop)):
            return None
        return name, at, group
    return None


def _operator(t: Tokens, first: int, stop: int) -> tuple[str, int, int] | None:
    """``operator+(`` and the like, whose name is made of signs."""
    at = next((i for i in top_level(t, first, stop) if t.texts[i] == "operator" and t.kinds[i] == "w"), None)
    if at is None:
        return None
    group = t.after(at + 1) if t.texts[at + 1] == "(" else next((i for i in range(at + 1, stop) if t.texts[i] == "("), stop)
    name = "operator" + "".join(t.texts[at + 1 : group])
    return (name, at, group) if group < stop and t.texts[group] == "(" else None


def _begins(lang: Language, t: Tokens, first: int, at: int) -> bool:
    """Whether a name has only modifiers before it on its line, or since its statement began."""
    i = at - 1
    while i >= first and (t.texts[i] in lang.modifiers or t.texts[i] in ("*", "#")) and (t.line(i) == t.line(at) or i == first):
        i -= 1
    return i < first or t.line(i) < t.line(i + 1) and t.texts[i] not in (".", ",", "=", "=>", "(", "?", "&&", "||")


def _plain_trailer(t: Tokens, start: int, stop: int) -> bool:
    """Nothing, or a return type, stands between parameters and body."""
    return start == stop or t.texts[start] == ":" and all(t.texts[i] not in ("=", ";") for i in range(start, stop))


# --- bodies -------------------------------------------------------------------


def complexity(lang: Language, t: Tokens, start: int, end: int) -> int:
    n = 1
    for i in range(start, min(end, len(t))):
        text = t.texts[i]
        if t.kinds[i] == "w":
            n += text in lang.branches and t.texts[i - 1] not in (".", "?.")
        elif t.kinds[i] == "p":
            n += text in ("&&", "||") or text == "?" and lang.ternary and _is_ternary(t, i, end)
    return n


def _is_ternary(t: Tokens, i: int, end: int) -> bool:
    """A question mark that a colon answers before the statement or its group ends."""
    if t.texts[i + 1 : i + 2] in ([":"], [","], [")"], [">"], ["="], ["["]) and t.texts[i + 1 : i + 2] != ["["]:
        return False
    k = i + 1
    while k < min(end, len(t)) and t.texts[k] not in (";", ")", "]", "}", ","):
        if t.texts[k] == ":":
            return True
        k = t.after(k)
    return False


def method(lang: Language, t: Tokens, name: str, at: int, group: int, body: int, constructs: bool) -> Method:
    end = t.close.get(body, len(t))
    line, last = t.line(at), t.line(end)
    lines = last - t.line(body) + 1
    return Method(name, line, max(last, line), lines, parameters(lang, t, group), complexity(lang, t, body + 1, end), is_constructor=constructs)


def parameters(lang: Language, t: Tokens, group: int) -> list[dict]:
    out: list[dict] = []
    end = t.close.get(group, len(t))
    first = i = group + 1
    while i <= end:
        if i == end or t.texts[i] == "," and t.kinds[i] == "p":
            if first < i:
                out += lang.parameter(t, first, i)
            first = i = i + 1
        elif t.texts[i] == "<" and (after := skip_angles(t, i, end)) > i:
            i = after
        else:
            i = min(t.after(i), end)
    return [p for p in out if p["name"]]


class Reader:
    """Reads one text into a :class:`Structure`."""

    def __init__(self, lang: Language, t: Tokens):
        self.lang, self.t = lang, t
        self.classes: list[Class] = []
        self.functions: list[tuple[int, Method]] = []

    def read(self) -> Structure:
        self.block(0, len(self.t))
        for c in self.classes:
            first = [m for m in c.methods if m.is_constructor and self.lang.constructors_first]
            named = {m.name: m for m in reversed(c.methods) if m not in first}
            c.methods = first + [m for m in c.methods if named.get(m.name) is m]
        imports = sorted({x for x in self.lang.imports(self.t) if x.strip()})
        return Structure(sorted(self.classes, key=lambda c: c.line), self.free_functions(), imports)

    def free_functions(self) -> list[Method]:
        return [m for _, m in sorted(self.functions, key=lambda x: x[0])]

    def block(self, start: int, end: int) -> None:
        """All declarations between two tokens, and within them."""
        lang, t = self.lang, self.t
        # Blocks to read, the class they belong to, and whether functions may stand there.
        due: list[tuple[int, int, Class | None, bool]] = [(start, end, None, True)]
        while due:
            start, end, owner, free = due.pop()
            for first, stop in heads(t, start, end):
                if stop >= end or t.texts[stop] != "{":
                    continue
                close = t.close.get(stop, len(t))
                if declared := type_head(lang, t, first, stop):
                    made = self.type(*declared, stop, close)
                    if not made.decorators:
                        due.append((stop + 1, close, made, False))
                    continue
                found = callable_head(lang, t, first, stop, owner.name if owner else None)
                if found and owner is not None:
                    name, at, group = found
                    constructs = name in lang.constructors or lang.typed and name == owner.name
                    owner.methods.append(method(lang, t, name, at, group, stop, constructs))
                    due.append((stop + 1, close, None, False))
                elif found and lang.functions and free and (not lang.function_word or lang.function_word in t.texts[first : found[1]]):
                    name, at, group = found
                    self.functions.append((at, method(lang, t, name, at, group, stop, False)))
                    due.append((stop + 1, close, None, bool(lang.function_word)))
                else:
                    plain = found is None and not self._is_statement(first, stop)
                    due.append((stop + 1, close, None, free and (bool(lang.function_word) or plain)))

    def _is_statement(self, first: int, stop: int) -> bool:
        return any(self.t.texts[i] in CONTROL or self.t.texts[i] == "=" for i in range(first, stop))

    def type(self, word: str, name: int, stop: int, close: int) -> Class:
        t, tag = self.t, self.lang.types[word]
        found = Class(t.texts[name], t.line(name), t.line(close), t.line(close) - t.line(name) + 1, bases=bases(self.lang, t, name, stop), decorators=[tag] if tag else [])
        self.classes.append(found)
        return found


# --- parameters ---------------------------------------------------------------


def _cut(t: Tokens, start: int, end: int) -> tuple[int, bool]:
    """Where a default value begins, and whether there is one."""
    at = next((i for i in top_level(t, start, end) if t.texts[i] == "="), None)
    return (end, False) if at is None else (at, True)


def name_last(words: frozenset[str]) -> Callable[[Tokens, int, int], list[dict]]:
    """``Type name = value``, without annotations and the given words before the type."""

    def read(t: Tokens, start: int, end: int) -> list[dict]:
        end, has_default = _cut(t, start, end)
        while end > start and t.texts[end - 1] == "]":  # name[]
            end = next((i for i in range(end - 1, start - 1, -1) if t.close.get(i) == end - 1), start)
        at = next((i for i in range(end - 1, start - 1, -1) if t.is_word(i)), None)
        if at is None or at == start and t.texts[at] == "void" and not has_default:
            return []
        i = start
        while i < at and (t.texts[i] in words or t.texts[i] in ("@", "[")):
            i = t.after(i) if t.texts[i] == "[" else i + 1 + 1 * (t.texts[i] == "@")
            if t.texts[i] == "(":
                i = t.after(i)
        return [parameter(t.texts[at], t.source(i, at).replace("...", "").strip(), has_default)]

    return read


def name_first(t: Tokens, start: int, end: int) -> list[dict]:
    """``name: Type = value``, ``...rest``, and the names of ``{a, b}``; access words are left out."""
    stop, has_default = _cut(t, start, end)
    while start < stop and (t.texts[start] in _ACCESS and start + 1 < stop and t.is_word(start + 1) or t.texts[start] in ("...", "@")):
        start += 1 + (t.texts[start] == "@")
    if start >= stop:
        return []
    if t.texts[start] in ("{", "["):
        inner = range(start + 1, t.close.get(start, stop))
        return [parameter(t.texts[i], "", has_default) for i in inner if t.is_word(i) and t.texts[i - 1] in ("{", "[", ",", "...")]
    colon = next((i for i in range(start, stop) if t.texts[i] == ":"), stop)
    optional = colon > start and t.texts[colon - 1] == "?"
    return [parameter(t.texts[start], t.source(colon + 1, stop), has_default or optional)] if t.is_word(start) else []


def name_then_type(t: Tokens, start: int, end: int) -> list[dict]:
    """``name Type``."""
    return [parameter(t.texts[start], t.source(start + 1, end))]


_ACCESS = frozenset("public private protected readonly override".split())


# --- imports ------------------------------------------------------------------


def dotted(word: str, skip: str) -> Callable[[Tokens], Iterator[str]]:
    """The first part of ``word [skip] a.b.c;``."""

    def read(t: Tokens) -> Iterator[str]:
        for i in range(len(t)):
            if t.texts[i] == word and t.kinds[i] == "w":
                first = i + 1 + (t.texts[i + 1 : i + 2] == [skip])
                end = first
                while end < len(t) and (t.is_word(end) or t.texts[end] in (".", "*")):
                    end += 1
                if first < end < len(t) and t.texts[end] == ";" and t.is_word(first) and t.texts[first + 1] in (".", ";"):
                    yield t.texts[first]

    return read


def modules(t: Tokens) -> Iterator[str]:
    """The first path segment of ``import ... from "a/b"`` and ``require("a/b")``."""
    for i in range(1, len(t)):
        if t.kinds[i] != "s":
            continue
        if t.texts[i - 1] == "from" and t.kinds[i - 1] == "w":
            k = i - 2
            while k >= 0 and t.texts[k] not in ("import", "export", ";"):
                k -= 1
            if k >= 0 and t.texts[k] == "import":
                yield t.texts[i].split("/")[0]
        elif t.texts[i - 1] == "(" and t.texts[i - 2] == "require":
            yield t.texts[i].split("/")[0]


def included(stem: Callable[[str], str], words: tuple[str, ...] = ("include",)) -> Callable[[Tokens], Iterator[str]]:
    """What ``#include <a/b.h>`` names."""

    def read(t: Tokens) -> Iterator[str]:
        for kind, text in zip(t.kinds, t.texts, strict=True):
            word, _, rest = text[1:].strip().partition(" ") if kind == "d" else ("", "", "")
            if kind == "d" and not rest:  # no space, as in #include<a>
                word, _, rest = (x for x in text[1:].strip().replace("<", " <", 1).replace('"', ' "', 1).partition(" "))
            name = rest.strip()
            if word in words and name[:1] in ("<", '"'):
                yield stem(name[1:].split(">" if name[0] == "<" else '"')[0])

    return read


# --- Go -----------------------------------------------------------------------


def _go_imports(t: Tokens) -> Iterator[str]:
    for i in range(len(t) - 1):
        if t.texts[i] == "import" and t.kinds[i] == "w":
            end = t.close.get(i + 1, i + 1) if t.texts[i + 1] == "(" else min(i + 2, len(t) - 1)
            yield from (t.texts[k].rsplit("/", 1)[-1] for k in range(i + 1, end + 1) if k < len(t) and t.kinds[k] == "s" and (t.texts[i + 1] == "(" or t.line(k) == t.line(i)))


def go(text: str) -> Structure:
    """Structs and interfaces; methods stand outside and name their struct as receiver."""
    lang, out = GO, Structure()
    t = Tokens(text, lang.lexicon)
    by_type: dict[str, list[Method]] = {}
    i = 0
    while i < len(t):
        if t.kinds[i] == "w" and t.texts[i] == "func":
            i = _go_func(t, i + 1, by_type, out)
        elif t.is_word(i) and t.is_word(i + 1) and t.texts[i + 1] in lang.types and t.texts[i + 2 : i + 3] == ["{"] and t.texts[i - 1] in ("type", "(", ";", "}"):
            close = t.close[i + 2]
            tag = lang.types[t.texts[i + 1]]
            out.classes.append(Class(t.texts[i], t.line(i), t.line(close), t.line(close) - t.line(i) + 1, decorators=[tag] if tag else []))
            i = close + 1
        elif t.texts[i] == "(" and t.texts[i - 1] == "type":
            i += 1
        else:
            i = t.after(i)
    for c in out.classes:
        c.methods = [] if c.decorators else by_type.get(c.name, [])
    out.imports = sorted({x for x in lang.imports(t) if x.strip()})
    return out


def _go_func(t: Tokens, i: int, by_type: dict[str, list[Method]], out: Structure) -> int:
    """Read a function after its word, and say where to go on."""
    receiver = None
    if t.texts[i : i + 1] == ["("]:
        close = t.close[i]
        receiver = next((t.texts[k] for k in top_level_reversed(t, i + 1, close) if t.is_word(k)), "")
        i = close + 1
    if not t.is_word(i):
        return i
    name, group = i, i + 1
    if t.texts[group : group + 1] == ["["]:  # type parameters
        group = t.after(group)
    if t.texts[group : group + 1] != ["("]:
        return group
    body = t.after(group)
    while body < len(t) and (t.texts[body] != "{" or t.texts[body - 1] in ("interface", "struct")) and t.line(body) == t.line(t.after(body - 1) - 1 if body - 1 in t.close else body - 1):
        body = t.after(body)
    if t.texts[body : body + 1] != ["{"]:
        return body
    made = method(GO, t, t.texts[name], name, group, body, False)
    (out.functions if receiver is None else by_type.setdefault(receiver, [])).append(made)
    return t.after(body)


def top_level_reversed(t: Tokens, start: int, end: int) -> list[int]:
    """The tokens outside ``[]``, last first: the type of ``(s *Stack[T])`` comes first."""
    out, i = [], start
    while i < end:
        out.append(i)
        i = t.after(i)
    return out[::-1]


# --- Objective-C --------------------------------------------------------------


def objective_c(text: str) -> Structure:
    """Interfaces and implementations of a name are one class; categories are ``Name(Category)``, protocols ``Name (protocol)``."""
    lang, out = OBJC, Structure()
    t = Tokens(text, lang.lexicon)
    by_name: dict[str, Class] = {}
    outside: list[tuple[int, int]] = []
    i = last = 0
    while i + 2 < len(t):
        if t.texts[i] != "@" or t.texts[i + 1] not in ("interface", "implementation", "protocol") or not t.is_word(i + 2):
            i += 1
            continue
        end = next((k for k in range(i + 3, len(t) - 1) if t.texts[k] == "@" and t.texts[k + 1] == "end"), len(t))
        after = i + 3
        if t.texts[i + 1] == "protocol":
            if t.texts[after : after + 1] in ([";"], [","], [")"]):  # only named
                i += 3
                continue
            name = f"{t.texts[i + 2]} (protocol)"
        else:
            name = t.texts[i + 2]
            if t.texts[after : after + 1] == ["("]:
                inner = t.source(after + 1, t.close.get(after, len(t))).strip()
                name, after = f"{name}({inner})" if inner else name, t.after(after)
        found = by_name.get(name)
        if found is None:
            found = by_name[name] = Class(name, t.line(i), t.line(end), t.line(end) - t.line(i) + 1, decorators=["protocol"] if name.endswith(" (protocol)") else ["category"] if "(" in name else [])
            out.classes.append(found)
        if t.texts[after : after + 1] == [":"] and t.is_word(after + 1) and t.texts[after + 1] not in found.bases:
            found.bases.append(t.texts[after + 1])
        _objc_methods(t, after, end, found)
        outside.append((last, i))
        i = last = min(end + 2, len(t))
    outside.append((last, len(t)))
    plain = Reader(lang, t)
    for start, end in outside:
        plain.block(start, end)
    out.functions = plain.free_functions()
    out.imports = sorted({x for x in lang.imports(t) if x.strip()})
    return out


def _objc_methods(t: Tokens, start: int, end: int, owner: Class) -> None:
    """``- (T)a:(U)x b:(V)y {`` is named ``a:b:`` and takes x and y; without a body it is only declared."""
    i = start
    while i < end:
        if t.texts[i] in ("-", "+") and t.texts[i + 1 : i + 2] == ["("] and t.is_word(t.after(i + 1)):
            k = first = t.after(i + 1)
            labels, params = [], []
            while k < end and t.texts[k] not in ("{", ";"):
                if t.texts[k] == ":" and t.is_word(k - 1):
                    labels.append(t.texts[k - 1])
                    kind = t.source(k + 2, t.close[k + 1]) if t.texts[k + 1] == "(" else ""
                    k = t.after(k + 1) if t.texts[k + 1] == "(" else k + 1
                    params.append(parameter(t.texts[k], kind))
                k = t.after(k)
            if k < end and t.texts[k] == "{":
                name = "".join(f"{x}:" for x in labels) or t.texts[first]
                made = method(OBJC, t, name, first, first, k, name.startswith("init") or name == "dealloc")
                made.parameters = params
                owner.methods.append(made)
                k = t.close.get(k, end)
            i = k + 1
        else:
            i = t.after(i)


# --- languages ----------------------------------------------------------------

_SCRIPT_BRANCHES = frozenset("if for while case catch".split())
_SCRIPT_MODIFIERS = frozenset("async static get set export default function".split())
_C_FAMILY = Lexicon(directives=True, tagged=True)
_stem = lambda x: x.rsplit("/", 1)[-1].rsplit(".", 1)[0]

LANGUAGES = {
    "java": Language(
        Lexicon(blocks=('"""',)), {"class": "", "interface": "", "enum": ""}, _SCRIPT_BRANCHES, name_last(frozenset({"final"})), dotted("import", "static"), constructors_first=True
    ),
    "javascript": Language(
        Lexicon(templates="`", patterns=True), {"class": ""}, _SCRIPT_BRANCHES, name_first, modules, typed=False, functions=True, function_word="function", by_line=True,
        modifiers=_SCRIPT_MODIFIERS, constructors=frozenset({"constructor"}), base_words=frozenset({"extends"}),
    ),
    "typescript": Language(
        Lexicon(templates="`", patterns=True), {"class": "", "interface": "interface", "enum": "enum"}, _SCRIPT_BRANCHES, name_first, modules, typed=False, functions=True, function_word="function", by_line=True,
        modifiers=_SCRIPT_MODIFIERS | frozenset("public private protected readonly abstract override declare const".split()), constructors=frozenset({"constructor"}), base_words=frozenset({"extends", "implements"}),
    ),
    "cpp": Language(_C_FAMILY, {"class": "", "struct": ""}, _SCRIPT_BRANCHES, name_last(frozenset()), included(_stem), functions=True, operators=True),
    "csharp": Language(
        Lexicon(blocks=('"""',), directives=True, verbatim=True), {"class": "", "interface": "", "struct": "", "enum": ""}, _SCRIPT_BRANCHES | {"foreach"}, name_last(frozenset("ref out in params this".split())),
        dotted("using", "static"), constructors_first=True,
    ),
}
GO = Language(Lexicon(blocks=("`",)), {"struct": "", "interface": "interface"}, frozenset("if for case select".split()), name_then_type, _go_imports, ternary=False)
OBJC = Language(_C_FAMILY, {}, _SCRIPT_BRANCHES, name_last(frozenset()), included(lambda x: x.split("/")[0].rsplit(".", 1)[0], ("include", "import")), functions=True, operators=True)


def parser(language: str) -> Parser:
    if language == "objectivec":
        return objective_c
    if language == "go":
        return go
    return lambda text: Reader(LANGUAGES[language], Tokens(text, LANGUAGES[language].lexicon)).read()
