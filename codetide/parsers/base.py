"""What all language parsers share, and the registry that picks one by suffix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import PurePosixPath


@dataclass
class Method:
    name: str
    line: int
    end_line: int
    lines: int
    parameters: list[dict] = field(default_factory=list)
    cyclomatic: int = 1
    cognitive: int = 0
    nesting: int = 0
    is_constructor: bool = False
    docstring: str | None = None
    decorators: list[str] = field(default_factory=list)


@dataclass
class Class:
    name: str
    line: int
    end_line: int
    lines: int
    methods: list[Method] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)
    docstring: str | None = None
    decorators: list[str] = field(default_factory=list)


@dataclass
class Structure:
    classes: list[Class] = field(default_factory=list)
    functions: list[Method] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)


def parameter(name: str, annotation: str = "", has_default: bool = False) -> dict:
    return {"name": name, "annotation": annotation, "has_default": has_default}


Parser = Callable[[str], Structure]


class Registry:
    """Parsers by language and suffix; what is registered later wins, anything else has no structure."""

    def __init__(self):
        self._by_suffix: dict[str, tuple[str, Parser]] = {}

    def register(self, language: str, suffixes: tuple[str, ...], parser: Parser) -> None:
        for s in suffixes:
            self._by_suffix[s] = (language, parser)

    def get(self, suffix: str) -> tuple[str, Parser]:
        """Raises KeyError for a suffix that nothing was registered for."""
        return self._by_suffix[suffix]

    def for_path(self, path: str) -> tuple[str, Parser]:
        found = self._by_suffix.get(PurePosixPath(path).suffix)
        return found or ("generic", lambda text: Structure())

    def languages(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for suffix, (language, _) in self._by_suffix.items():
            out.setdefault(language, []).append(suffix)
        return {k: sorted(v) for k, v in sorted(out.items())}


def default_registry() -> Registry:
    from ..functions.languages import PARSED
    from . import declarations, python

    registry = Registry()
    registry.register("python", PARSED["python"], python.parse)
    for language in PARSED:
        if language != "python":
            registry.register(language, PARSED[language], declarations.parser(language))
    return registry
