import datetime as dt

from pyspark.sql import functions as F

from codetide.operators import branches as O, duplication as D, history as H, ordering, rules as R, structure as S

COMMITS = "sha string, author_name string, author_email string, authored_ts timestamp_ntz, committed_ts timestamp_ntz, message string, insertions long, deletions long, files long, ordinal long"


def commits(spark, rows):
    out = []
    for k, r in enumerate(rows):
        at = r.get("at", dt.datetime(2024, 1, 1 + k % 28, 10))
        out.append((r.get("sha", f"s{k}"), r.get("name", "A"), r.get("email", "a@x"), at, r.get("committed", at), r.get("message", "update the thing"), r.get("ins", 1), r.get("dels", 0), r.get("files", 1), k))
    return spark.createDataFrame(out, COMMITS)


def changes(spark, rows):
    return spark.createDataFrame(rows, "sha string, path string, insertions long, deletions long")


def test_churn(spark):
    rows = H.file_churn(changes(spark, [("1", "a.py", 10, 5), ("2", "a.py", 2, 1), ("2", "b.py", 0, 0)])).collect()
    assert {(r["path"], r["commit_count"], r["churn_score"]) for r in rows} == {("a.py", 2, 18), ("b.py", 1, 0)}
    assert H.file_churn(changes(spark, [])).count() == 0


def test_timelines_ignore_input_order_and_break_ties(spark):
    at = dt.datetime(2024, 1, 2, 3)
    frame = commits(spark, [{"ins": 50, "dels": 20, "at": at}, {"ins": 100, "dels": 0, "at": dt.datetime(2024, 1, 1)}, {"ins": 1, "at": at}])
    for f in (frame, frame.orderBy(F.desc("ordinal"))):
        assert [r["value"] for r in H.loc_timeline(f).orderBy("authored_ts", "ordinal").collect()] == [100, 130, 131]
    points = H.language_timeline(frame, changes(spark, [("s0", "m.py", 10, 2), ("s0", "x.js", 5, 1), ("s1", "a.py", 100, 0), ("s2", "Makefile", 1, 0)])).collect()
    assert {(r["ext"], r["sha"], r["value"]) for r in points} == {("py", "s1", 100), ("py", "s0", 108), ("js", "s0", 4), ("", "s2", 1)}
    grown = H.team_growth(commits(spark, [{"email": e} for e in ("alice", "bob", "alice")])).orderBy("authored_ts").collect()
    assert [r["value"] for r in grown] == [1, 2, 2]


def test_streaks_and_percentiles(spark):
    days = [1, 2, 3, 4, 5, 7, 8]
    frame = commits(spark, [{"email": "a", "at": dt.datetime(2024, 3, d, 23)} for d in days] + [{"email": "a", "at": dt.datetime(2024, 3, 5, 1)}, {"email": "b"}])
    assert {r["author_email"]: r["streak"] for r in H.commit_streaks(frame).collect()} == {"a": 5, "b": 1}
    got = {r["sha"]: r["percentile"] for r in H.churn_percentiles(commits(spark, [{"ins": 1}, {"ins": 80}, {"ins": 300}, {"ins": 80}])).collect()}
    assert got == {"s0": 0.0, "s1": 0.25, "s3": 0.5, "s2": 0.75}


def test_aliases(spark):
    frame = commits(spark, [{"name": "Ann", "email": "one"}, {"name": "ANN", "email": "two"}, {"name": "ann", "email": "two"}, {"name": "Bob", "email": "b"}, {"name": "Tie", "email": "t1"}, {"name": "Tie", "email": "t2"}])
    aliases = {r["email"]: r["canonical"] for r in H.alias_map(frame).collect()}
    assert aliases == {"one": "two", "two": "two", "t1": "t1", "t2": "t1"}
    rows = {r["email"]: r for r in H.contributors(frame, changes(spark, [("s0", "x", 1, 0), ("s1", "x", 1, 0), ("s2", "y", 1, 0)]), H.alias_map(frame)).collect()}
    assert rows["two"]["commit_count"] == 3 and rows["two"]["aliases"] == "one" and rows["two"]["files_touched"] == 2 and rows["two"]["active_days"] == 3
    assert rows["b"]["files_touched"] == 0 and rows["b"]["aliases"] == ""


def test_work_patterns(spark):
    frame = commits(spark, [{"at": dt.datetime(2024, 1, 1, 9)}, {"at": dt.datetime(2024, 1, 2, 9)}, {"at": dt.datetime(2024, 1, 7, 14)}])
    hours = H.work_hours(frame).first()["hours"]
    assert (hours[9], hours[14], sum(hours)) == (2, 1, 3)
    assert list(H.work_weekdays(frame).first()["weekdays"]) == [1, 1, 0, 0, 0, 0, 1]


def test_coupling(spark):
    files = spark.createDataFrame([("lib/core.py", 0), ("app/main.py", 1)], "path string, ordinal long")
    edges = S.import_edges(spark.createDataFrame([("app/main.py", "core"), ("app/main.py", "main"), ("app/main.py", "os")], "path string, imported string"), S.import_map(files))
    rows = {r["module"]: r for r in S.coupling(files.select(F.regexp_replace("path", "/.*", "").alias("module")), edges).collect()}
    assert tuple(rows["app"])[1:] == (0, 1, 1.0, 0.0, 0.0)
    assert tuple(rows["lib"])[1:] == (1, 0, 0.0, 0.0, 1.0)


def test_import_names_follow_the_last_file(spark):
    files = spark.createDataFrame([("a/util.py", 0), ("b/util.py", 1), ("top.py", 2)], "path string, ordinal long")
    assert {r["name"]: r["module"] for r in S.import_map(files).collect()} == {"a": "a", "b": "b", "util": "b", "top": "(root)"}


def test_duplicates(spark):
    block = "one\ntwo\nthree\nfour\n"
    sources = spark.createDataFrame([("a", block + "x\ny\n"), ("b", "p\nq\n" + block.upper())], "path string, text string")
    assert D.duplicate_blocks(sources, 3).count() == 2
    r = D.duplication_ratio(sources, 3).first()
    assert (r["duplicated_lines"], r["ratio"]) == (6, 0.5)
    assert D.duplicate_blocks(sources, 6).count() == 0
    same = spark.createDataFrame([("a", "x\n" * 7)], "path string, text string")
    pairs = {(r["line_a"], r["line_b"]) for r in D.duplicate_blocks(same, 3).collect()}
    assert pairs == {(1, 4), (1, 5), (2, 5)}
    assert D.duplication_ratio(same, 3).first()["duplicated_lines"] == 9
    empty = D.duplication_ratio(sources.limit(0), 3).first()
    assert (empty["duplicated_lines"], empty["ratio"]) == (0, 0.0)


def fired(spark, rows, ch=()):
    return {r["name"]: r for r in R.detect(commits(spark, rows), changes(spark, list(ch))).collect()}


def test_rules(spark):
    plain = [{} for _ in range(10)]
    assert fired(spark, []) == {}
    assert set(fired(spark, plain)) == {"single_file_commits"}
    assert "wip_in_main" in fired(spark, [{"message": "WIP: x"}])
    assert fired(spark, [{"ins": 501}])["large_commits"]["hits"] == 1
    assert "large_commits" not in fired(spark, [{"ins": 500}])
    late = dt.datetime(2024, 1, 1)
    assert "possible_rebase" in fired(spark, [{"at": late, "committed": late + dt.timedelta(seconds=86_401)}])
    assert "possible_rebase" not in fired(spark, [{"at": late, "committed": late + dt.timedelta(seconds=86_400)}])
    assert "empty_commits" in fired(spark, [{"files": 0}])
    assert "unsquashed_fixups" in fired(spark, [{"message": "fixup! x"}])
    chain = [{"message": 'Revert "x"'}, {"message": 'Revert "Revert "x""'}]
    assert "revert_chains" in fired(spark, chain) and "revert_chains" not in fired(spark, chain[:1] * 2)
    sunday, night = dt.datetime(2024, 1, 7, 12), dt.datetime(2024, 1, 3, 4)
    assert "weekend_warrior" in fired(spark, [{"at": sunday}] * 3 + [{"at": dt.datetime(2024, 1, 3, 12)}] * 7)
    assert "night_owl" in fired(spark, [{"at": night}] * 2 + plain[:8]) and "night_owl" not in fired(spark, [{"at": night}] * 2)
    assert "merge_heavy" in fired(spark, [{"message": "Merge x"}] * 3 + plain[:7])
    assert "short_messages" in fired(spark, [{"message": "  fix  "}] + [{}] * 4)
    assert "inconsistent_conventional" in fired(spark, [{"message": "feat: a long one"}] * 5 + plain[:5])
    assert "inconsistent_conventional" not in fired(spark, [{"message": "feat: a long one"}] * 10)
    hot = fired(spark, plain, [(f"s{k}", "hot.py", 1, 0) for k in range(4)] + [("s1", "x.PNG", 0, 0)])
    assert hot["hotspot_files"]["hits"] == 1 and hot["binary_files"]["hits"] == 1
    assert (hot["hotspot_files"]["evidence"], hot["hotspot_files"]["affected_files"]) == ("hot.py (4x)", ["hot.py"])
    assert (hot["binary_files"]["evidence"], hot["binary_files"]["affected_files"]) == ("1 binary file(s) committed", ["x.PNG"])
    assert hot["single_file_commits"]["evidence"] == "10/10 commits (100%) touch one file" and hot["single_file_commits"]["affected_files"] == []


def test_rules_say_what_they_saw(spark):
    wip = fired(spark, [{"message": "a long message"}, {"message": "WIP: x"}, {"message": "wip y", "ins": 700}])
    assert wip["wip_in_main"]["evidence"] == "2 WIP commit(s): s1..." and wip["wip_in_main"]["description"] == "WIP commits found on protected branch"
    assert wip["large_commits"]["evidence"].startswith("1 large commit(s), largest: 70")
    rows = [{}] * 10
    busy = fired(spark, rows, [(f"s{k}", f"f{j}.py", 1, 0) for j in range(7) for k in range(4 + j % 3)])
    assert busy["hotspot_files"]["hits"] == 7 and busy["hotspot_files"]["affected_files"] == ["f2.py", "f5.py", "f1.py", "f4.py", "f0.py"]
    assert busy["hotspot_files"]["evidence"] == "f2.py (6x); f5.py (6x); f1.py (5x); f4.py (5x); f0.py (4x)"


def test_own_rules_can_be_added(spark):
    extra = R.Rule("all_night", "high", "night", lambda hits, n, ratio: ratio >= 1.0)
    rows = R.detect(commits(spark, [{"at": dt.datetime(2024, 1, 1, 2)}]), changes(spark, []), [*R.RULES, extra]).collect()
    assert rows[-1]["name"] == "all_night" and rows[-1]["ordinal"] == len(R.RULES)


def test_gates(spark):
    methods = spark.createDataFrame([("a.py", 3, "f", 51, 11, 16, 6, 5), ("a.py", 9, "g", 50, 10, 15, 5, 4)], "path string, line long, name string, lines long, cyclomatic long, cognitive long, parameters long, nesting long")
    files = spark.createDataFrame([("a.py", 501, 16), ("b.py", 500, 15)], "path string, total_lines long, imports long")
    classes = spark.createDataFrame([("a.py", 1, "C", 301, 21)], "path string, line long, name string, lines long, methods long")
    ratios = spark.createDataFrame([(0.051, 0.79)], "duplication double, coverage double")
    out = R.gate_violations(methods, files, classes, ratios)
    assert sorted((r["rule"], r["severity"]) for r in out.collect()) == sorted([("max_file_lines", "warning"), ("max_imports", "warning"), ("max_class_lines", "warning"), ("max_class_methods", "warning"), ("max_duplication_pct", "error"), ("min_test_coverage", "error"), *((r, s) for r, _, s in R.METHOD_GATES)])
    changed = spark.createDataFrame([("b.py",)], "path string")
    assert {r["rule"] for r in R.delta_violations(out, changed).collect()} == {"max_duplication_pct", "min_test_coverage"}
    unknown = spark.createDataFrame([(None, None)], "duplication double, coverage double")
    assert R.gate_violations(methods.limit(0), ratios=unknown).count() == 0


def test_blame_and_coverage(spark):
    blame = spark.createDataFrame([("f", "Alice"), ("f", "Alice"), ("f", "Bob"), ("g", "C")], "path string, author string")
    shares = O.blame_shares(blame)
    assert {(r["path"], r["author"], r["percentage"]) for r in shares.collect()} == {("f", "Alice", 66.67), ("f", "Bob", 33.33), ("g", "C", 100.0)}
    assert {r["path"]: r["bus_factor"] for r in O.bus_factor(shares).collect()} == {"f": 1, "g": 1}
    even = O.blame_shares(spark.createDataFrame([("f", "A"), ("f", "B")], "path string, author string"))
    assert O.bus_factor(even).first()["bus_factor"] == 2
    cov = O.coverage(spark.createDataFrame([("f", 1), ("f", 0), ("f", 2), ("f", 5)], "path string, hits long"))
    assert tuple(cov.first()) == ("f", 3, 4, 0.75)
    assert O.overall_coverage(cov.limit(0)).first()["ratio"] == 0.0


def test_reports(spark):
    frame = spark.createDataFrame([("a", "10"), ("b", "x"), ("c", "2")], "k string, v string")
    assert [r["k"] for r in S.typed_order(frame, "v", "integer", True).collect()] == ["a", "c", "b"]
    assert [r["k"] for r in S.search_rows(frame, "X").collect()] == ["b"]
    assert len(ordering.attributes()) == 70 and ordering.by_key("file.code_lines").default_descending
    assert not ordering.by_key("method.line").default_descending and len(ordering.entity_names()) == 12
    files = spark.createDataFrame([("a", 3), ("b", 9)], "path string, code_lines long")
    assert [r["path"] for r in ordering.order_by(files, "file.code_lines").collect()] == ["b", "a"]
    methods = spark.createDataFrame([], "path string, cyclomatic long")
    assert S.average_cc(methods).first()["average_cc"] == 0.0


def test_timeline_views(spark):
    t = spark.createDataFrame([(dt.datetime(2024, 1, 6, 1), 1, 1), (dt.datetime(2024, 1, 7, 1), 2, 2), (dt.datetime(2024, 1, 13, 9), 3, 3), (dt.datetime(2024, 2, 1), 4, 4)], "authored_ts timestamp_ntz, ordinal long, value long")
    weeks = {str(r["bucket"]): r["value"] for r in H.timeline_buckets(t, "week").collect()}
    assert weeks == {"2023-12-31": 1, "2024-01-07": 3, "2024-01-28": 4}
    assert {str(r["bucket"]): r["value"] for r in H.timeline_buckets(t, "month").collect()} == {"2024-01-01": 3, "2024-02-01": 4}
    assert H.timeline_range(t, 0).count() == 4 and H.timeline_range(t, 1).count() == 4
    days = H.activity_days(t, F.to_date(F.lit("2024-02-01")), 30).collect()
    assert len(days) == 30 and max(r["level"] for r in days) == 4 and sum(r["n"] for r in days) == 4
