"""Languages by file name, and names that a scan leaves out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as X
from .formats import glob_regex, lookup

# Suffixes, their language and what begins a comment line in it.
GENERIC = {
    ".sh": ("shell", ("#",)), ".bash": ("shell", ("#",)), ".zsh": ("shell", ("#",)), ".rb": ("ruby", ("#",)), ".pl": ("perl", ("#",)), ".pm": ("perl", ("#",)), ".r": ("r", ("#",)), ".R": ("r", ("#",)),
    ".yml": ("yaml", ("#",)), ".yaml": ("yaml", ("#",)), ".toml": ("toml", ("#",)), ".ini": ("ini", (";", "#")), ".cfg": ("ini", (";", "#")), ".conf": ("config", ("#",)), ".properties": ("properties", ("#",)),
    ".makefile": ("makefile", ("#",)), ".mk": ("makefile", ("#",)), ".cmake": ("cmake", ("#",)), ".dockerfile": ("dockerfile", ("#",)), ".tf": ("terraform", ("#",)), ".sql": ("sql", ("--",)), ".lua": ("lua", ("--",)),
    ".hs": ("haskell", ("--",)), ".elm": ("elm", ("--",)), ".erl": ("erlang", ("%",)), ".ex": ("elixir", ("#",)), ".exs": ("elixir", ("#",)), ".clj": ("clojure", (";",)), ".lisp": ("lisp", (";",)), ".scm": ("scheme", (";",)),
    ".m": ("matlab", ("%",)), ".f90": ("fortran", ("!",)), ".f95": ("fortran", ("!",)), ".html": ("html", ()), ".htm": ("html", ()), ".xml": ("xml", ()), ".css": ("css", ()), ".scss": ("scss", ()), ".less": ("less", ()),
    ".json": ("json", ()), ".md": ("markdown", ()), ".rst": ("restructuredtext", ()), ".txt": ("text", ()), ".csv": ("csv", ()), ".svg": ("svg", ()), ".proto": ("protobuf", ("//",)), ".gradle": ("gradle", ("//",)),
    ".swift": ("swift", ("//",)), ".kt": ("kotlin", ("//",)), ".kts": ("kotlin", ("//",)), ".scala": ("scala", ("//",)), ".groovy": ("groovy", ("//",)), ".dart": ("dart", ("//",)), ".v": ("v", ("//",)), ".zig": ("zig", ("//",)),
    ".nim": ("nim", ("#",)), ".jl": ("julia", ("#",)),
}

# Suffixes of the languages whose structure is parsed.
PARSED = {
    "python": (".py", ".pyi"), "java": (".java",), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "typescript": (".ts", ".tsx"), "cpp": (".cpp", ".cxx", ".cc", ".c", ".hpp", ".hxx", ".h", ".hh"),
    "csharp": (".cs",), "go": (".go",), "objectivec": (".m", ".mm"),
}
NAMES = {"makefile": "makefile", "gnumakefile": "makefile", "dockerfile": "dockerfile"}

# Suffixes and names that are never source text.
BINARY = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".tiff", ".tif", ".psd", ".ai", ".eps", ".mp3", ".mp4", ".wav", ".ogg", ".flac", ".avi", ".mov", ".mkv", ".wmv", ".m4a", ".m4v", ".aac", ".wma",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".dmg", ".iso", ".pkg", ".deb", ".rpm", ".o", ".obj", ".so", ".dylib", ".dll", ".a", ".lib", ".exe", ".class", ".jar", ".war", ".ear", ".whl", ".egg",
    ".ttf", ".otf", ".woff", ".woff2", ".eot", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".sqlite", ".db", ".sqlite3", ".mdb", ".ccz", ".pvr", ".tps", ".pes", ".fnt", ".plist",
    ".DS_Store", "Thumbs.db", ".bin", ".dat", ".pyc", ".pyo",
)
ALWAYS_EXCLUDED = (".git", "__pycache__", "*.pyc")
DEFAULT_EXCLUDED = (".git", "__pycache__", "node_modules", ".venv", "venv", "*.pyc", ".mypy_cache", ".ruff_cache", ".pytest_cache")


def suffix_languages() -> dict[str, str]:
    """Language by suffix; parsed languages win over generic ones."""
    return {s: name for s, (name, _) in GENERIC.items()} | {s: name for name, suffixes in PARSED.items() for s in suffixes}


def supported_languages() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for s, name in suffix_languages().items():
        out.setdefault(name, []).append(s)
    return {k: sorted(v) for k, v in sorted(out.items())}


def comment_prefixes(name: str, suffix: str) -> tuple[str, ...]:
    if name == "python":
        return ("#",)
    if name in PARSED:
        return ("//",)
    return GENERIC.get(suffix, ("", ("#",)))[1]


def language_of(path: Column) -> Column:
    """The language of a path by its suffix, else by its name, else generic."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.coalesce(lookup(X.suffix(path), suffix_languages()), lookup(name, NAMES), F.lit("generic"))


def excluded(path: Column, patterns: tuple[str, ...] = DEFAULT_EXCLUDED) -> Column:
    """Whether a scan leaves a path out: by suffix or name, or because it or a part of it matches a pattern."""
    regex = glob_regex(tuple(dict.fromkeys((*ALWAYS_EXCLUDED, *patterns))))
    name = F.element_at(F.split(path, "/"), -1)
    binary = F.lower(X.suffix(path)).isin(*BINARY) | name.isin(*BINARY)
    return binary | path.rlike(regex) | F.exists(F.split(path, "/"), lambda part: part.rlike(regex))
