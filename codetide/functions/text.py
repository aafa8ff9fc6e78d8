"""Text metrics of source code as column expressions.

Regular expressions carry ``(?U)``, so that word borders and classes follow
Unicode, as the metrics are defined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The tokens that the metrics count.
CYCLOMATIC = r"\b(?:if|else\s+if|elif|for|foreach|while|case|catch|except)\b|&&|\|\|"
COGNITIVE = r"\b(?:if|elif|else\s+if|for|foreach|while|catch|except)\b"
ELSE = r"\b(?:else|finally)\b"
BOOLEAN = r"&&|\|\||\band\b|\bor\b"
TODO = r"\b(?:TODO|FIXME|HACK|XXX|BUG)\b"
OPERATORS = r"(?:[+\-*/%]=?|==|!=|<=?|>=?|&&|\|\||!|~|\^|&|\||<<|>>|\.|\->|::|=>|\?|:|\bas\b|\bin\b|\bnot\b|\band\b|\bor\b)"
OPERANDS = r"\b(?:[a-zA-Z_]\w*|\d+(?:\.\d+)?)\b"

#: What ends a line besides LF and CRLF.
_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: White space as text stripping knows it.
_SPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _count(text: Column, pattern: str, flags: str = "U") -> Column:
    return F.regexp_count(text, F.lit(f"(?{flags}){pattern}")).cast("long")


def lines(text: Column) -> Column:
    """The lines of a text; a final line end starts no further line, an empty text has none."""
    unified = F.regexp_replace(text, f"\r\n|[{_LINE_ENDS}]", "\n")
    parts = F.split(F.regexp_replace(unified, r"\n\z", ""), "\n")
    return F.slice(parts, 1, F.when(text == "", 0).otherwise((1 << 31) - 1))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def loc_counts(text: Column, prefixes: tuple[str, ...]) -> Column:
    """A struct of total, blank, comment and code lines; a comment line starts with one of the prefixes.

    Select the struct first and its fields from it after, or it is computed for each field.
    """
    zero = F.lit(0).cast("long")
    one = lambda condition: F.when(condition, 1).otherwise(0)

    def step(acc: Column, line: Column) -> Column:
        comment = reduce(Column.__or__, (line.startswith(p) for p in prefixes)) if prefixes else F.lit(False)
        return F.struct((acc["total_lines"] + 1).alias("total_lines"), (acc["blank_lines"] + one(line == "")).alias("blank_lines"), (acc["comment_lines"] + one((line != "") & comment)).alias("comment_lines"))

    start = F.struct(zero.alias("total_lines"), zero.alias("blank_lines"), zero.alias("comment_lines"))
    done = lambda acc: F.struct(acc["total_lines"].alias("total_lines"), acc["blank_lines"].alias("blank_lines"), acc["comment_lines"].alias("comment_lines"), (acc["total_lines"] - acc["blank_lines"] - acc["comment_lines"]).alias("code_lines"))
    return F.aggregate(F.transform(lines(text), strip), start, step, done)


def comment_ratio(comment: Column, total: Column) -> Column:
    return F.when(total > 0, comment / total).otherwise(F.lit(0.0))


def todo_count(text: Column) -> Column:
    return _count(text, TODO, "iU")


def cyclomatic(text: Column) -> Column:
    """One more than the branch tokens of the text."""
    return _count(text, CYCLOMATIC) + 1


def cognitive(text: Column) -> Column:
    """Per line: each branch counts one more than the brace depth, else and finally one, boolean operators one."""
    zero = F.struct(F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("depth"))

    def step(acc: Column, line: Column) -> Column:
        braces = F.length(F.regexp_replace(line, r"[^{]", "")) - F.length(F.regexp_replace(line, r"[^}]", ""))
        depth = F.greatest(F.lit(0).cast("long"), acc["depth"] + braces)
        boolean = F.when(line.rlike(f"(?U){BOOLEAN}"), 1).otherwise(0)
        score = acc["score"] + _count(line, COGNITIVE) * (depth + 1) + _count(line, ELSE) + boolean
        return F.struct(score.cast("long").alias("score"), depth.cast("long").alias("depth"))

    return F.aggregate(F.transform(lines(text), strip), zero, step, lambda acc: acc["score"])


def nesting_depth(text: Column) -> Column:
    """The largest brace depth; closing braces without an open one count for nothing."""
    zero = F.struct(F.lit(0).cast("long").alias("most"), F.lit(0).cast("long").alias("depth"))

    def step(acc: Column, brace: Column) -> Column:
        depth = F.greatest(F.lit(0).cast("long"), acc["depth"] + F.when(brace == "{", 1).otherwise(-1))
        return F.struct(F.greatest(acc["most"], depth).alias("most"), depth.cast("long").alias("depth"))

    return F.aggregate(F.regexp_extract_all(text, F.lit("([{}])"), F.lit(1)), zero, step, lambda acc: acc["most"])


def halstead(text: Column) -> dict[str, Column]:
    """Distinct and total operators and operands, and the measures made from them."""
    operators = F.regexp_extract_all(text, F.lit(f"(?U){OPERATORS}"), F.lit(0))
    operands = F.regexp_extract_all(text, F.lit(f"(?U){OPERANDS}"), F.lit(0))
    n1, n2 = (F.size(F.array_distinct(x)).cast("long") for x in (operators, operands))
    big1, big2 = (F.size(x).cast("long") for x in (operators, operands))
    vocabulary, length = n1 + n2, big1 + big2
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary.cast("double"))).otherwise(F.lit(0.0))
    difficulty = F.when(n2 > 0, (n1 / F.lit(2.0)) * (big2 / n2)).otherwise(F.lit(0.0))
    return {"n1": n1, "n2": n2, "total_n1": big1, "total_n2": big2, "vocabulary": vocabulary, "length": length, "volume": volume, "difficulty": difficulty, "effort": volume * difficulty}


def normalised_lines(text: Column) -> Column:
    """Lines as duplication compares them: stripped, in lower case, without blank ones."""
    return F.filter(F.transform(lines(text), lambda x: F.lower(strip(x))), lambda x: x != "")


def shingles(items: Column, n: int) -> Column:
    """Every run of ``n`` items, joined by line ends; fewer items give none.

    ``items`` should be a plain column: it is read anew for each run.
    """
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), "\n"))


def extension(path: Column) -> Column:
    """The text after the last dot of a path, in lower case; none if it has no dot."""
    return F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def suffix(path: Column) -> Column:
    """The file name's suffix with its dot, as it is written; none for dot files and bare names."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"(?s)^\.*[^.].*\.[^.]+$"), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")


def parent_module(path: Column) -> Column:
    """The folder of a path, ``(root)`` for files at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("(root)")
