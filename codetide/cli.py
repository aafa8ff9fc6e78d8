"""Command line: analyse, branches, gitlog, init-hooks."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from . import analysis, config
from .operators import branches as O, history as H, rules as R
from .session import session
from .sinks import ci, exports
from .sources import git

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codetide", description="Repository analytics on Spark")
    p.add_argument("--version", action="version", version=VERSION)
    loud = p.add_mutually_exclusive_group()
    loud.add_argument("--verbose", action="store_true")
    loud.add_argument("--quiet", action="store_true")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)

    a = sub.add_parser("analyse", help="analyse files and history")
    a.add_argument("root", nargs="?", default=".")
    a.add_argument("--config")
    a.add_argument("--format", action="append", choices=[*exports.EXPORTERS, "terminal", "tables"], default=None)
    a.add_argument("--output", default=None)
    a.add_argument("--ci", choices=sorted(ci.ADAPTERS))
    a.add_argument("--diff", metavar="REF")
    a.add_argument("--exclude", action="append", default=None)
    a.add_argument("--lang", action="append", default=None, metavar="LANGUAGE", help="only files in this language; may be repeated")
    a.add_argument("--max-commits", type=int, default=None)
    a.add_argument("--since", default=None)
    a.add_argument("--top", type=int, default=None)
    a.add_argument("--sort", choices=sorted(exports.SORTS), default=None)
    a.add_argument("--fail-on-violations", action="store_true", default=None)
    a.add_argument("--watch", action="store_true")

    b = sub.add_parser("branches", help="report on branches")
    b.add_argument("root", nargs="?", default=".")
    b.add_argument("--config")
    b.add_argument("--target", default=None)
    b.add_argument("--stale-days", type=int, default=None)
    b.add_argument("--show", choices=("all", "merged", "stale", "abandoned"), default="all")
    b.add_argument("--generate-script", metavar="FILE")

    g = sub.add_parser("gitlog", help="break the history down")
    g.add_argument("root", nargs="?", default=".")
    g.add_argument("--config")
    g.add_argument("--max-commits", type=int, default=None)
    g.add_argument("--since", default=None)

    h = sub.add_parser("init-hooks", help="write a pre-commit file")
    h.add_argument("root", nargs="?", default=".")
    h.add_argument("--force", action="store_true")
    return p


def _settings(args: argparse.Namespace, table: dict) -> config.Settings:
    drop_none = lambda d: {k: drop_none(v) if isinstance(v, dict) else v for k, v in d.items() if v is not None and v != {}}
    return config.load(args.config, over=drop_none(table))


def analyse(args: argparse.Namespace) -> int:
    settings = _settings(args, {"exclude": args.exclude, "max_commits": args.max_commits, "since": args.since, "fail_on_violations": args.fail_on_violations, "output": {"formats": args.format, "folder": args.output, "top_n": args.top, "sort": args.sort}})
    spark = session(args.master)
    status = 0

    def once() -> None:
        nonlocal status
        report = analysis.analyse(spark, args.root, settings, languages=tuple(args.lang or ()))
        found = analysis.violations(report, settings)
        if args.diff:
            changed = spark.createDataFrame([(p,) for p in sorted(git.changed_files(args.root, args.diff))], "path string")
            found = R.delta_violations(found, changed)
        found = found.cache()
        for kind in settings.output.formats:
            if kind == "terminal":
                if not args.quiet:
                    print(exports.terminal_text(report, settings.output.top_n, settings.output.sort), end="")
            elif kind == "tables":
                exports.write_tables(report, settings.output.folder)
            else:
                exports.EXPORTERS[kind](report, settings.output.folder)
        if args.ci:
            print(ci.emit(args.ci, found), end="")
            ci.write_report(args.ci, found, settings.output.folder)
        counts = {r["severity"]: r["n"] for r in found.groupBy("severity").agg(F.count("*").alias("n")).collect()}
        if counts and settings.fail_on_violations:
            print(f"{counts.get('error', 0)} errors, {counts.get('warning', 0)} warnings", file=sys.stderr)
            status = 1
        spark.catalog.clearCache()

    if not args.watch:
        once()
        return status
    from .streaming.watch import watch

    query = watch(spark, Path(args.root).resolve(), once)
    try:
        while query.isActive:
            time.sleep(0.1)
    except KeyboardInterrupt:
        query.stop()
    return status


def branches(args: argparse.Namespace) -> int:
    settings = _settings(args, {"branches": {"target": args.target, "stale_days": args.stale_days}})
    spark = session(args.master)
    default = git.default_branch(args.root)
    b = settings.branches
    report = O.branch_report(git.branches(spark, args.root, default, b.target or None), F.current_timestamp(), b.protected, b.stale_days, b.abandoned_days).cache()
    for r in O.show_branches(report, args.show, default).orderBy("name").collect():
        print(f"{r['name']:<40} {r['status']:<10} {r['merge_type']:<13} +{r['ahead']} -{r['behind']} {r['score']:>6} {r['category']}")
    totals = O.branch_totals(report).first()
    print(f"{totals['total']} branches, {totals['stale']} stale, {totals['abandoned']} abandoned, {totals['safe']} safe to delete")
    if args.generate_script:
        Path(args.generate_script).write_text(exports.cleanup_script(report), encoding="utf-8")
    return 0


def gitlog(args: argparse.Namespace) -> int:
    settings = _settings(args, {"max_commits": args.max_commits, "since": args.since})
    spark = session(args.master)
    commits, _ = git.commits(spark, args.root, settings.since or None, settings.max_commits)
    enriched = H.enrich(commits).cache()
    counts = H.commit_breakdown(enriched).first()
    print("  ".join(f"{k}={v}" for k, v in counts.asDict().items()))
    for r in H.newest_commits(enriched).collect():
        print(f"{r['sha'][:8]} {r['authored_ts']} {r['author_name']:<20} {r['size_category']:<9} {r['message']}")
    return 0


def init_hooks(args: argparse.Namespace) -> int:
    file = Path(args.root) / ".pre-commit-config.yaml"
    if file.exists() and not args.force:
        print(f"{file} exists; use --force to replace it", file=sys.stderr)
        return 1
    file.write_text(exports.precommit_yaml(), encoding="utf-8")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return {"analyse": analyse, "branches": branches, "gitlog": gitlog, "init-hooks": init_hooks}[args.command](args)
    except (git.GitError, FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
