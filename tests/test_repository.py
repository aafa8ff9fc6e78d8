"""End to end on small repositories."""

import json
import sqlite3
import subprocess

import pytest

from codetide import analysis, cli, config
from codetide.operators import rules as R
from codetide.sinks import ci, exports
from codetide.sources import coverage, git, logs, scan


def run(root, *args, **env):
    base = {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "ann@x", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "ann@x", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(root)}
    subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=base | env)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run(root, "init", "-q", "-b", "main")
    (root / "lib").mkdir()
    (root / "lib/core.py").write_text("import os\n\nclass Core:\n    def run(self, a):\n        if a:\n            return 1\n        return 0\n")
    (root / "app.js").write_text("function go(x) {\n  return x;\n}\n")
    (root / ".gitignore").write_text("# c\n*.log\n\n")
    (root / "x.log").write_text("no")
    (root / "pic.png").write_bytes(b"\x89PNG")
    run(root, "add", "lib", "app.js", ".gitignore")
    run(root, "commit", "-qm", "feat: start", GIT_AUTHOR_DATE="2024-01-01T10:00:00+02:00", GIT_COMMITTER_DATE="2024-01-01T10:00:00+02:00")
    run(root, "checkout", "-qb", "old/it's-done")
    (root / "lib/core.py").write_text("import os\nimport core\n\nclass Core:\n    pass\n")
    run(root, "commit", "-qam", "fixup! start", GIT_AUTHOR_NAME="Bob", GIT_AUTHOR_EMAIL="bob@x", GIT_AUTHOR_DATE="2024-02-01T10:00:00Z", GIT_COMMITTER_DATE="2024-02-01T10:00:00Z")
    run(root, "checkout", "-q", "main")
    run(root, "merge", "-q", "--no-ff", "-m", "Merge old", "old/it's-done", GIT_AUTHOR_DATE="2024-02-02T10:00:00Z", GIT_COMMITTER_DATE="2024-02-02T10:00:00Z")
    run(root, "checkout", "-qb", "open")
    (root / "app.js").write_text("function go(x) {\n  return x && 1;\n}\n")
    run(root, "commit", "-qam", "work", GIT_AUTHOR_DATE="2024-03-01T10:00:00Z", GIT_COMMITTER_DATE="2024-03-01T10:00:00Z")
    run(root, "checkout", "-q", "main")
    run(root, "tag", "v1.0.0")
    run(root, "tag", "-a", "v1.1.0-rc1", "-m", "second")
    return root


def test_scan(spark, repo):
    seen = []
    paths = {r["path"] for r in scan.scan(spark, repo, observers=[lambda n, p: seen.append(p)]).collect()}
    assert paths == {"lib/core.py", "app.js", ".gitignore"} and "x.log" in seen
    with pytest.raises(FileNotFoundError):
        scan.scan(spark, repo / "none")


def test_history(spark, repo):
    commits, changes = git.commits(spark, str(repo))
    rows = {r["message"]: r for r in commits.collect()}
    assert set(rows) == {"feat: start", "fixup! start", "Merge old"}
    assert str(rows["feat: start"]["authored_ts"]) == "2024-01-01 10:00:00" and rows["feat: start"]["files"] == 3 and rows["fixup! start"]["author_name"] == "Bob"
    assert rows["Merge old"]["ordinal"] == 0
    assert changes.filter("path = 'lib/core.py'").count() == 2
    assert git.commits(spark, str(repo), limit=1)[0].count() == 1
    assert git.commits(spark, str(repo), since="2024-01-15")[0].count() == 2


def test_refs(spark, repo):
    rows = {r["name"]: r for r in git.branches(spark, str(repo), "main").collect()}
    assert rows["old/it's-done"]["merged"] and not rows["open"]["merged"] and (rows["open"]["ahead"], rows["open"]["behind"]) == (1, 0)
    tags = {r["name"]: r for r in git.read(spark, str(repo), "tags").collect()}
    assert tags["v1.1.0-rc1"]["is_annotated"] and not tags["v1.0.0"]["is_annotated"] and tags["v1.0.0"]["sha"] == tags["v1.1.0-rc1"]["sha"]
    tips = spark.createDataFrame([("tag", tags["v1.0.0"]["sha"])] + [(n, r["sha"]) for n, r in rows.items()], "tip string, node string")
    standing = {r["tip"]: r["merged"] for r in git.standing(spark, str(repo), tips, "tag").collect()}
    assert standing == {"tag": True, "old/it's-done": True, "open": False}
    assert git.read(spark, str(repo), "worktrees").count() == 1 and git.read(spark, str(repo), "stashes").count() == 0 and git.read(spark, str(repo), "notes").count() == 0
    assert git.current_branch(str(repo)) == git.default_branch(str(repo)) == "main" and not git.has_remote(str(repo)) and git.tracking_branch(str(repo), "main") is None
    assert not git.is_squash_merged(str(repo), "open", "main") and git.changed_files(str(repo), "open") == {"app.js"}
    with pytest.raises(git.GitError):
        git.git(str(repo), "log", "nowhere")


def test_many_branches_are_compared_in_one_pass(spark, repo, monkeypatch):
    few = git.branches(spark, str(repo), "main")
    monkeypatch.setattr(git, "FEW_BRANCHES", 0)
    many = git.branches(spark, str(repo), "main")
    key = ["name", "sha", "author", "ahead", "behind", "merged", "last_commit"]
    assert [tuple(r) for r in few.select(key).collect()] == [tuple(r) for r in many.select(key).collect()]


def test_blame_tree_diff(spark, repo):
    lines = logs.parse_blame(git.read(spark, str(repo), "blame", paths="lib/core.py\napp.js")).filter("path = 'lib/core.py'").collect()
    assert {r["author_email"] for r in lines} == {"ann@x", "bob@x"} and sorted(r["line_number"] for r in lines) == list(range(1, 6))
    assert logs.parse_tree(git.read(spark, str(repo), "tree")).count() == 3
    diff = logs.parse_diff(git.read(spark, str(repo), "diff", range="main..open")).orderBy("position").collect()
    assert [r["line_type"] for r in diff if r["line_type"] != "context"] == ["delete", "add"]


def test_analysis_and_exports(spark, repo, tmp_path):
    settings = config.Settings()
    report = analysis.analyse(spark, repo, settings)
    assert report.problems == [] and {r["language"] for r in report["languages"].collect()} == {"python", "javascript", "generic"}
    assert {r["name"] for r in report["patterns"].collect()} >= {"unsquashed_fixups"}
    assert report["contributors"].count() == 2
    for name, exporter in exports.EXPORTERS.items():
        assert all(p.stat().st_size for p in exporter(report, tmp_path / name)), name
    full = json.loads((tmp_path / "json/report.json").read_text())
    assert {f["path"] for f in full["files"]} == {"lib/core.py", "app.js", ".gitignore"} and full["commits"][0]["authored_ts"]
    assert json.loads((tmp_path / "json/summary.json").read_text())["total_files"] == 3
    assert (tmp_path / "csv/files.csv").read_text().startswith("path,language")
    assert 'name="lib/core.py"' in (tmp_path / "junit/junit.xml").read_text()
    page = (tmp_path / "dashboard/dashboard.html").read_text()
    chunk = page.split('id="chunk-files">')[1].split("<")[0]
    assert len(exports.decompress(chunk)) == 3
    assert "lib/core.py" in exports.terminal_text(report) and "lib/core.py" in exports.terminal_text(report, sort="complexity")
    script = exports.cleanup_script(report["branches"])
    assert "git branch -d -- 'old/it'\"'\"'s-done'" in script and "open" not in script
    assert exports.data_uri(repo / "app.js").startswith("data:text/javascript;base64,")
    report.register_views("t_")
    assert spark.sql("select count(*) from t_files").first()[0] == 3
    found = analysis.violations(report, config.build(settings, {"thresholds": {"max_file_lines": 2}}))
    assert {r["path"] for r in found.collect()} == {"lib/core.py", "app.js", ".gitignore"}
    for name in ci.ADAPTERS:
        assert ci.write_report(name, found, tmp_path / name).stat().st_size
    with pytest.raises(ValueError):
        ci.emit("none", found)


def test_without_history(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    report = analysis.analyse(spark, tmp_path)
    assert report.problems and "commits" not in report and report["files"].count() == 1


def test_ci_formats(spark):
    rows = spark.createDataFrame([("max_x", "error", "a.py", 0, "f'[1]", 12.0, 10.0), ("min_y", "warning", "", 0, "", 0.5, 0.8)], R.VIOLATION)
    issue = json.loads(ci.emit("gitlab", rows))[0]
    assert issue["severity"] == "major" and issue["location"]["lines"]["begin"] == 1
    text = ci.emit("github", rows).splitlines()
    assert text[0] == "::error file=a.py,title=max_x::f'[1] is 12, limit 10" and text[1] == "::warning title=min_y::repository is 0.5, limit 0.8"
    assert "f|'|[1|]" in ci.emit("teamcity", rows) and ci.emit("teamcity", rows).count("buildProblem") == 1
    assert ci.emit("jenkins", rows).count("<failure") == 2
    assert "No violations" in ci.step_summary([]) and "| r | error | 2 |" in ci.step_summary([("r", "error", 2)])


def test_coverage_files(spark, tmp_path):
    assert coverage.read(spark, tmp_path).count() == 0
    (tmp_path / "lcov.info").write_text("SF:a.py\nDA:1,1\nDA:2,1\nDA:3,0\nDA:4,9\nend_of_record\n")
    assert tuple(coverage.read(spark, tmp_path).first()) == ("a.py", 3, 4, 0.75)
    with sqlite3.connect(tmp_path / ".coverage") as db:
        db.execute("create table file (id integer, path text)")
        db.execute("create table line_bits (file_id integer, numbits blob)")
        db.execute("insert into file values (1, 'b.py')")
        db.execute("insert into line_bits values (1, ?), (1, ?)", (b"\xff\x0f", b"\xff"))
    assert tuple(coverage.read(spark, tmp_path).first()) == ("b.py", 12, 12, 1.0)


def test_settings(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('max_commits = 5\n[thresholds]\nmax_parameters = 9\n[branches]\nprotected = ["a"]\n')
    s = config.load(file, {"CODETIDE_THRESHOLDS__MAX_PARAMETERS": "7", "CODETIDE_FAIL_ON_VIOLATIONS": "true", "OTHER": "x"}, {"since": "2024"})
    assert (s.max_commits, s.thresholds.max_parameters, s.fail_on_violations, s.since, s.branches.protected) == (5, 7, True, "2024", ("a",))
    for bad in ({"CODETIDE_NOPE": "1"}, {"CODETIDE_MAX_COMMITS": "many"}, {"CODETIDE_FAIL_ON_VIOLATIONS": "perhaps"}):
        with pytest.raises(ValueError):
            config.load(None, bad)


def test_command_line(spark, repo, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master: spark)
    assert cli.main(["analyse", str(repo), "--format", "terminal", "--top", "2"]) == 0
    assert "lib/core.py" in capsys.readouterr().out
    monkeypatch.setenv("CODETIDE_THRESHOLDS__MAX_FILE_LINES", "1")
    assert cli.main(["analyse", str(repo), "--format", "terminal", "--lang", "python", "--lang", "java"]) == 0
    assert "lib/core.py" in (out := capsys.readouterr().out) and "app.js" not in out
    assert cli.main(["analyse", str(repo), "--format", "json", "--output", str(tmp_path), "--ci", "github", "--diff", "open", "--fail-on-violations"]) == 1
    assert "file=app.js" in (out := capsys.readouterr().out) and "core.py" not in out
    script = tmp_path / "clean.sh"
    assert cli.main(["branches", str(repo), "--show", "merged", "--generate-script", str(script)]) == 0
    assert "old/it's-done" in capsys.readouterr().out and script.exists()
    assert cli.main(["gitlog", str(repo), "--max-commits", "2"]) == 0
    assert "commits=2" in capsys.readouterr().out
    assert cli.main(["init-hooks", str(tmp_path)]) == 0 and cli.main(["init-hooks", str(tmp_path)]) == 1
    assert cli.main(["gitlog", str(tmp_path)]) == 2
