"""Git histories as tables.

``GitSource`` is a Python data source: ``spark.read.format("git")`` with options
``path``, ``kind`` and, for the log, ``since`` and ``limit``, which git applies.
The log is split by commit ranges, blame by files; each partition runs its own
git process on the machine that holds the repository.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import graph as G
from ..shipping import ship
from . import logs

RECORD, FIELD = "\x01", "\x00"
FORMAT = "%x01%H%x00%an%x00%ae%x00%aI%x00%cn%x00%ce%x00%cI%x00%s%x00%x00"
#: Seconds that one git process may take.
TIMEOUT = 120
#: Branches that git itself compares with the target, a process each; more are compared in one pass over the graph.
FEW_BRANCHES = 30
#: Commits for each partition of the log.
PER_PARTITION = 20_000

SCHEMAS = {
    "log": "value string, ordinal long",
    "branches": "name string, is_remote boolean, sha string, committed string, author string",
    "tags": "name string, sha string, created string, message string, is_annotated boolean",
    "stashes": "ordinal long, message string, created string",
    "worktrees": "path string, head string, branch string",
    "notes": "commit_sha string, message string",
    "parents": "sha string, parent string, tree string",
    "tree": "value string",
    "blame": "path string, value string",
    "diff": "diff_id string, value string",
}


class GitError(RuntimeError):
    pass


def git(root: str, *args: str, timeout: int = TIMEOUT) -> str:
    """Output of a git command; raises GitError if it fails or takes too long."""
    try:
        done = subprocess.run(["git", "-c", "core.quotepath=off", "-C", root, *args], capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise GitError(f"git {args[0]}: {e}") from e
    if done.returncode:
        raise GitError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def _or_empty(root: str, *args: str) -> str:
    try:
        return git(root, *args)
    except GitError:
        return ""


class Slice(InputPartition):
    def __init__(self, *args: str, first: int = 0):
        self.args, self.first = args, first


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.kind = options["path"], options.get("kind", "log")
        self.options = options
        if self.kind not in SCHEMAS:
            raise ValueError(f"unknown kind {self.kind!r}; known: {', '.join(SCHEMAS)}")

    def _limits(self) -> list[str]:
        return [f"--since={self.options['since']}"] if self.options.get("since") else []

    def partitions(self) -> list[Slice]:
        if self.kind == "log":
            most = int(self.options.get("limit", "0"))
            counted = int(git(self.root, "rev-list", "--count", *self._limits(), self.options.get("ref", "HEAD")).strip() or 0)
            total = min(counted, most) if most else counted
            return [Slice(f"--skip={k}", f"-n{min(PER_PARTITION, total - k)}", first=k) for k in range(0, total, PER_PARTITION)] or [Slice(first=-1)]
        if self.kind == "blame":
            paths = self.options["paths"].split("\n")
            return [Slice(*paths[k : k + 20]) for k in range(0, len(paths), 20)]
        return [Slice()]

    def read(self, part: Slice) -> Iterator[tuple]:
        yield from getattr(self, f"_{self.kind}")(part)

    def _log(self, part: Slice) -> Iterator[tuple]:
        if part.first >= 0:
            text = git(self.root, "log", f"--format={FORMAT}", "--numstat", *self._limits(), *part.args, self.options.get("ref", "HEAD"))
            yield from ((record, part.first + k) for k, record in enumerate(text.split(RECORD)[1:]))

    def _branches(self, part: Slice) -> Iterator[tuple]:
        for line in git(self.root, "for-each-ref", "--format=%(refname:short)%00%(objectname)%00%(committerdate:iso-strict)%00%(authorname)", "refs/heads").splitlines():
            name, sha, committed, author = line.split(FIELD)
            yield name, False, sha, committed, author or "Unknown"

    def _tags(self, part: Slice) -> Iterator[tuple]:
        for line in _or_empty(self.root, "for-each-ref", "--sort=-creatordate", "--format=%(refname:short)%00%(objecttype)%00%(*objectname)%00%(objectname)%00%(creatordate:iso-strict)%00%(contents:subject)", "refs/tags").splitlines():
            name, kind, target, own, created, message = line.split(FIELD)
            yield name, target or own, created, message or None, kind == "tag"

    def _stashes(self, part: Slice) -> Iterator[tuple]:
        for k, line in enumerate(_or_empty(self.root, "stash", "list", "--format=%gs%x00%cI").splitlines()):
            message, created = line.split(FIELD)
            yield k, message, created

    def _worktrees(self, part: Slice) -> Iterator[tuple]:
        for block in _or_empty(self.root, "worktree", "list", "--porcelain").split("\n\n"):
            found = dict(x.partition(" ")[::2] for x in block.splitlines())
            if "worktree" in found:
                yield found["worktree"], found.get("HEAD", ""), found["branch"].removeprefix("refs/heads/") if "branch" in found else None

    def _notes(self, part: Slice) -> Iterator[tuple]:
        for line in _or_empty(self.root, "notes", "list").splitlines():
            note, _, commit = line.partition(" ")
            yield commit, _or_empty(self.root, "cat-file", "-p", note).strip()

    def _parents(self, part: Slice) -> Iterator[tuple]:
        for line in git(self.root, "log", "--all", "--format=%H%x00%P%x00%T").splitlines():
            sha, parents, tree = line.split(FIELD)
            for parent in parents.split() or [None]:
                yield sha, parent, tree

    def _tree(self, part: Slice) -> Iterator[tuple]:
        yield from ((line,) for line in git(self.root, "ls-tree", "-r", "-l", self.options.get("ref", "HEAD")).splitlines())

    def _blame(self, part: Slice) -> Iterator[tuple]:
        for path in part.args:
            yield path, _or_empty(self.root, "blame", "--line-porcelain", "--", path)

    def _diff(self, part: Slice) -> Iterator[tuple]:
        span = self.options["range"]
        yield span, git(self.root, "diff", span) if ".." in span else git(self.root, "show", "--format=", span)


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "log")]

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))


def read(spark: SparkSession, root: str, kind: str, **options: str) -> DataFrame:
    git(root, "rev-parse", "--git-dir")  # a folder without history fails here, not in a task
    ship(spark)
    spark.dataSource.register(GitSource)
    return spark.read.format("git").options(path=root, kind=kind, **options).load()


def commits(spark: SparkSession, root: str, since: str | None = None, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Commits and their changes, newest first by ``ordinal``."""
    options = {"limit": str(limit)} | ({"since": since} if since else {})
    raw = read(spark, root, "log", **options)
    parsed = logs.parse_log(raw.select("value", "ordinal"))
    rows = parsed.select("sha", "author_name", "author_email", "authored_ts", "committed_ts", "authored_at", "committed_at", "committer_name", "committer_email", "message", "insertions", "deletions", F.size("changes").cast("long").alias("files"), "ordinal")
    changes = parsed.select("sha", F.posexplode("changes").alias("change_ordinal", "c")).select("sha", F.col("change_ordinal").cast("long").alias("change_ordinal"), "c.*")
    return rows, changes


def merged_branches(root: str, target: str) -> set[str]:
    return {x.strip() for x in _or_empty(root, "branch", "--format=%(refname:short)", "--merged", target).splitlines()}


def ahead_behind(root: str, branch: str, target: str) -> tuple[int, int]:
    """Commits that only the branch has, and only the target has; zeros where git fails."""
    found = _or_empty(root, "rev-list", "--left-right", "--count", f"{branch}...{target}").split()
    return (int(found[0]), int(found[1])) if len(found) == 2 else (0, 0)


def branches(spark: SparkSession, root: str, default: str, target: str | None = None) -> DataFrame:
    """``(name, sha, author, ahead, behind, merged, last_commit)`` of local branches but the default one."""
    target = target or default
    merged = merged_branches(root, default) | merged_branches(root, target)
    refs = read(spark, root, "branches").collect()
    listed = [r for r in refs if r["name"] != default]
    if len(listed) > FEW_BRANCHES and target in {r["name"] for r in refs}:
        tips = spark.createDataFrame([(r["name"], r["sha"]) for r in refs], "tip string, node string")
        named = spark.createDataFrame([(r["name"], r["sha"], r["committed"], r["author"], r["name"] in merged) for r in listed], "name string, sha string, committed string, author string, merged boolean")
        found = named.join(standing(spark, root, tips, target).select(F.col("tip").alias("name"), "ahead", "behind"), "name")
        return found.select("name", "sha", "author", "ahead", "behind", "merged", logs.iso_instant(F.col("committed")).alias("last_commit")).orderBy("name")
    rows = [(r["name"], r["sha"], r["committed"], r["author"], *ahead_behind(root, r["name"], target), r["name"] in merged) for r in listed]
    frame = spark.createDataFrame(rows, "name string, sha string, committed string, author string, ahead long, behind long, merged boolean")
    return frame.withColumn("last_commit", logs.iso_instant(F.col("committed"))).drop("committed").orderBy("name")


def default_branch(root: str) -> str:
    names = {x.strip() for x in git(root, "branch", "--format=%(refname:short)").splitlines()}
    return next((n for n in ("main", "master") if n in names), current_branch(root))


def current_branch(root: str) -> str:
    return git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()


def has_remote(root: str) -> bool:
    return bool(_or_empty(root, "remote").strip())


def tracking_branch(root: str, branch: str) -> str | None:
    return _or_empty(root, "rev-parse", "--abbrev-ref", f"{branch}@{{upstream}}").strip() or None


def commit_graph(spark: SparkSession, root: str) -> G.Graph:
    """The graph of all commits that any ref reaches."""
    return G.graph(read(spark, root, "parents").select(F.col("sha").alias("node"), "parent"))


def standing(spark: SparkSession, root: str, tips: DataFrame, target: str) -> DataFrame:
    """``(tip, ahead, behind, merged)`` of ``tips(tip, node)`` against one of them, for all at once."""
    return G.ahead_behind(G.reach(commit_graph(spark, root), tips), F.lit(target))


def is_squash_merged(root: str, branch: str, target: str, depth: int = 20) -> bool:
    """Whether the tree of the branch merged into its base is among the target's newest trees."""
    base = _or_empty(root, "merge-base", branch, target).strip()
    tree = _or_empty(root, "rev-parse", f"{branch}^{{tree}}").strip()
    if not base or not tree:
        return False
    return tree in _or_empty(root, "log", f"-n{depth}", "--format=%T", target).split()


def changed_files(root: str, ref: str) -> set[str]:
    return set(_or_empty(root, "diff", "--name-only", ref).splitlines())
