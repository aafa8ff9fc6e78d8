"""Parsers of recorded text: commit logs, numstat lines, diffs, trees, blame and LCOV.

All are DataFrame operators over a text column ``value``, so they scale with the
number of records and can be fed by any reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import commits as C
from ..operators.carry import carry, numbered

FIELDS = ("sha", "author_name", "author_email", "authored", "committer_name", "committer_email", "committed", "message", "body", "stats")


def iso_instant(text: Column) -> Column:
    """The instant of an ISO date with offset; what is no date is the epoch."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(F.lit(0)))


def iso_local(text: Column) -> Column:
    """The wall clock that an ISO date shows, without its offset."""
    return F.coalesce(F.regexp_replace(text, r"(?:Z|[+-]\d\d:?\d\d)$", "").try_cast("timestamp_ntz"), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))


def parse_log(records: DataFrame) -> DataFrame:
    """Commits from log records of ten NUL-separated fields, the last of which holds numstat lines.

    Records with fewer fields are left out.  Changes stay an array in the order
    of the log; lines that are no numstat are passed over.  Other columns stay.
    """
    parts = F.split(F.col("value"), "\0", 10)
    others = [c for c in records.columns if c != "value"]
    rows = records.select(parts.alias("p"), *others).filter(F.size("p") >= 10).select(*(F.col("p")[i].alias(n) for i, n in enumerate(FIELDS)), *others)
    changes = C.numstat_changes(F.split("stats", "\n"))
    out = rows.select(
        "sha", "author_name", "author_email", iso_instant(F.col("authored")).alias("authored_at"), iso_local(F.col("authored")).alias("authored_ts"),
        "committer_name", "committer_email", iso_instant(F.col("committed")).alias("committed_at"), iso_local(F.col("committed")).alias("committed_ts"), "message", changes.alias("changes"), *others,
    )
    zero = F.lit(0).cast("long")

    def total(name: str) -> Column:
        return F.aggregate("changes", zero, lambda s, c: s + c[name])

    return out.withColumns({n: total(n) for n in ("insertions", "deletions")})


def parse_diff(diffs: DataFrame) -> DataFrame:
    """Numbered lines of unified diffs ``(diff_id, value)``.

    Gives ``(diff_id, path, hunk, old_start, new_start, position, line_type, content,
    old_line, new_line)``; file headers and marks on missing line ends are no lines.
    """
    return diff_lines(numbered(diffs, "diff_id"))


def diff_lines(lines: DataFrame) -> DataFrame:
    """The same for lines ``(diff_id, block, position, line)``, by :func:`carry`."""
    header = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    line = F.col("line")
    is_hunk = line.rlike(header)
    start = lambda group: F.when(is_hunk, F.regexp_extract("line", header, group).cast("long"))
    kind = F.when(line.startswith("+"), "add").when(line.startswith("-"), "delete").when(line.startswith(" ") | (line == ""), "context")
    # All lines between a line of a hunk and the hunk's header are lines of it, so counts need not know where hunks end.
    state = carry(
        lines, ["diff_id"],
        last={"path": F.when(line.startswith("+++ b/"), F.substring("line", 7, 1 << 30)), "inside": F.when(is_hunk, True).when(line.startswith("diff --git "), False), "old_start": start(1), "new_start": start(3)},
        total={"hunk": is_hunk},
        since={"old": (F.coalesce(kind != "add", F.lit(False)), is_hunk), "new": (F.coalesce(kind != "delete", F.lit(False)), is_hunk)},
    )
    state = state.withColumn("line_type", F.when(F.col("inside") & ~is_hunk, kind))
    known = F.col("line_type").isNotNull()
    old, new = (F.col(f"{n}_start") + F.col(n) - 1 for n in ("old", "new"))
    return state.filter(known).select(
        "diff_id", "path", "hunk", "old_start", "new_start", "position", "line_type", F.substring("line", 2, 1 << 30).alias("content"),
        F.when(F.col("line_type") != "add", old).alias("old_line"), F.when(F.col("line_type") != "delete", new).alias("new_line"),
    )


def parse_tree(listing: DataFrame) -> DataFrame:
    """Entries of a tree listing; sizes that are not given are -1."""
    pattern = r"^(\d+) (\w+) ([0-9a-f]+)\s+(-|\d+)\t(.+)$"
    mode, kind, sha, size, path = (F.regexp_extract("value", pattern, i) for i in range(1, 6))
    rows = listing.filter(F.col("value").rlike(pattern))
    return rows.select(mode.alias("mode"), kind.alias("entry_type"), sha.alias("sha"), F.when(size == "-", F.lit(-1)).otherwise(size.try_cast("long")).cast("long").alias("size"), path.alias("path"))


def submodules(entries: DataFrame) -> DataFrame:
    return entries.filter("entry_type = 'commit'")


def parse_blame(porcelain: DataFrame) -> DataFrame:
    """Lines of blame in porcelain form ``(path, value)``: author, address, time and commit of each."""
    return blame_lines(numbered(porcelain, "path"))


def blame_lines(lines: DataFrame) -> DataFrame:
    """The same for lines ``(path, block, position, line)``, by :func:`carry`.

    What a commit's header does not say stays as the line before had it; at the start
    names are empty, numbers 0 and the time the epoch.
    """
    header = r"^([0-9a-f]{40}) \d+ (\d+)"
    line = F.col("line")
    rest = lambda n: F.substring("line", n, 1 << 30)
    seconds = F.when(line.rlike(r"^author-time \d+$"), rest(13).try_cast("long"))
    # What a line says is read before lines are dealt out, so that their text need not go along.
    says = {
        "commit_sha": F.when(line.rlike(header), F.regexp_extract("line", header, 1)), "line_number": F.when(line.rlike(header), F.regexp_extract("line", header, 2).cast("long")),
        "author_name": F.when(line.startswith("author "), rest(8)), "author_email": F.when(line.startswith("author-mail "), F.regexp_replace(rest(13), "[<>]", "")), "seconds": seconds,
    }
    read = lines.select("path", "block", "position", line.startswith("\t").alias("shown"), *(c.alias(n) for n, c in says.items()))
    state = carry(read, ["path"], last={n: F.col(n) for n in says})
    said = lambda n, value: F.coalesce(n, F.lit(value)).alias(n)
    return state.filter("shown").select("path", said("commit_sha", ""), said("line_number", 0), said("author_name", ""), said("author_email", ""), F.timestamp_seconds(F.coalesce("seconds", F.lit(0))).alias("ts"))


def parse_lcov(lines: DataFrame, key: str = "path") -> DataFrame:
    """``(key, record, file, covered, total, ratio)``: a row for each record of LCOV traces ``(key, block, position, line)``.

    A record goes from its file's name to its end mark or the next name; the last of a
    trace counts only with its end.  Line counts outside records count for none.
    """
    line = F.col("line")
    hit = r"^DA:(\d+),(\d+)"
    # What a line says is read before lines are dealt out, so that their text need not go along.
    read = lines.select(
        key, "block", "position", F.when(line.rlike("^SF:."), F.substring("line", 4, 1 << 30)).alias("file"), line.rlike(r"^\s*end_of_record\s*$").alias("ended"),
        line.rlike(hit).alias("counts"), F.when(line.rlike(hit), F.regexp_extract("line", hit, 2).cast("decimal(38,0)") > 0).alias("hit"),
    )
    named = F.col("file").isNotNull()
    state = carry(read, [key], last={"file": F.col("file"), "open": F.when(named, True).when(F.col("ended"), False)}, total={"record": named})
    # A record has one file, so it can be a key of its groups.
    records = state.filter("record > 0").groupBy(key, "record", "file").agg(
        F.count_if(F.expr("open and counts and hit")).alias("covered"), F.count_if(F.expr("open and counts")).alias("total"), F.count_if("ended").alias("ends"),
    )
    most = records.groupBy(F.col(key).alias("most_key")).agg(F.max("record").alias("most"))
    whole = records.join(most, F.col(key).eqNullSafe(F.col("most_key"))).filter("record < most or ends > 0")
    ratio = F.when(F.col("total") > 0, F.bround(F.col("covered") / F.col("total"), 4)).otherwise(F.lit(0.0))
    return whole.select(key, "record", "file", "covered", "total", ratio.alias("ratio"))
