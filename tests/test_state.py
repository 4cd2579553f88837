"""State tables: one case per branch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilscan.operators import access as ac
from veilscan.operators import evidence as ev
from veilscan.operators import lifecycle as lc
from veilscan.operators import policies as po
from veilscan.operators import rule_admin as ra
from veilscan.operators import scoring as sc
from veilscan.operators.rank import value_at
from veilscan.plans import inspect as pl
from veilscan.sources.documents import load_manifest, load_policies, paged
from veilscan.sources.rules import Rule

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("state,thin,rank,blocked,expected,event", [
    ("released", 1, 2, False, "released_then_flagged", "deep_scan_hit_after_release"),
    ("failed_open", 1, 3, False, "released_then_flagged", "deep_scan_hit_after_release"),
    ("released_by_analyst", 2, 2, True, "released_then_flagged", "deep_scan_hit_after_release"),
    ("held", 1, 2, False, "held", "deep_scan_hit"), ("held", 1, 3, False, "blocked", "deep_scan_hit"),
    ("denied_by_analyst", 1, 2, False, "held", "deep_scan_hit"), ("blocked", 1, 2, True, "held", "deep_scan_hit"),
    ("held", 1, 1, False, "released", "deep_scan_clear"), ("held", 1, 0, True, "held", "deep_scan_clear"),
    ("released", 1, 1, False, "released", "deep_scan_clear"), ("held", 0, 0, False, "held", None), ("released", 0, 3, False, "released", None),
])
def test_deferred_tier(spark, state, thin, rank, blocked, expected, event):
    row = (1, state, "log", 0.4, "old", thin, blocked, rank, "why", 0.9)
    df = spark.createDataFrame(
        [row], "job_id int, state string, action string, score double, reason string, thin int, blocked boolean, ocr_rank int, ocr_reason string, ocr_score double"
    )
    out = lc.resolve_deferred(df).first()
    assert (out.state, out.event) == (expected, event)
    assert out.score == (0.9 if thin else 0.4)


def test_merge_picks_action_then_severity_then_score_then_order(spark):
    rows = [
        (1, 1, 0, "A", 9, "log", 1, 1.0), (1, 2, 1, "B", 3, "hold", 4, 0.8), (1, 1, 2, "C", 3, "hold", 2, 0.8), (2, 1, 0, "D", 1, "allow", 1, 0.7),
    ]
    hits = spark.createDataFrame(rows, "job_id int, page int, rule_pos int, rule_name string, severity int, action string, count bigint, score double")
    got = {r.job_id: r for r in ev.decide_rules(hits).collect()}
    assert got[1].reason == "C (2x, score 0.80) and 2 other rules" and got[1].score == 1.0 and got[1]["rank"] == 2
    assert got[2].reason == "D (1x, score 0.70)"
    nested = hits.groupBy("job_id").agg(F.collect_list(F.struct("page", "rule_pos", "rule_name", "severity", "action", "count", "score")).alias("h"))
    assert {r.job_id: r.reason for r in ev.decide_in_row(nested, "h", ("job_id",)).collect()} == {k: v.reason for k, v in got.items()}


def test_inspection_of_pages_equals_single_page_form(spark):
    rules = [Rule("k", "Key", r"key\d", base_confidence=0.9, action="hold", severity=5), Rule("l", "Log", r"note", base_confidence=0.9)]
    policy = "struct<deep_scan_required:boolean,fail_mode:string,on_unreadable:string,rule_tags:array<string>>"
    strict, loose = (True, "open", "log", ["*"]), (False, "open", "log", ["*"])
    rows = [(1, 1, "a long sentence with key1 inside of it", strict), (2, 1, "@@@@ #### %%%% 1234 5678 ----", strict), (3, 1, "@@@@ #### %%%% 1234 5678 ----", loose),
            (4, 1, "please note this ordinary sentence here", strict), (5, 1, "nothing to see in this sentence", loose), (6, 1, "### key2 ###", strict)]
    pages = spark.createDataFrame(rows, f"job_id bigint, page int, text string, policy {policy}")
    single = {tuple(r) for r in pl.inspect(pages, rules, single_page=True).verdicts.collect()}
    paged_form = {tuple(r) for r in pl.inspect(pages, rules).verdicts.collect()}
    assert single == paged_form
    states = {r[0]: (r[1], r[2], r[5]) for r in single}
    assert states[1] == ("hold", "held", "text") and states[4] == ("log", "released", "text") and states[5] == ("allow", "released", "text")
    assert states[2] == ("hold", "held", "ocr_pending") and states[3] == ("allow", "released", "ocr_pending") and states[6] == ("hold", "held", "ocr_pending")


def test_purge_takes_the_oldest_first_and_keeps_metadata(spark):
    rows = [(n, T0 + timedelta(days=n), f"k{n}", None if n != 2 else T0) for n in range(6)]
    jobs = spark.createDataFrame(rows, "job_id int, purge_after timestamp_ntz, archive_key string, purged_at timestamp_ntz")
    now = F.lit(T0 + timedelta(days=4)).cast("timestamp_ntz")
    after, gone = lc.purge(jobs, now, limit=2)
    assert sorted(r.job_id for r in gone.collect()) == [0, 1]
    assert {r.job_id: r.archive_key for r in after.collect()} == {0: "", 1: "", 2: "k2", 3: "k3", 4: "k4", 5: "k5"}
    assert sorted(r.job_id for r in lc.purge(jobs, now, limit=None)[1].collect()) == [0, 1, 3]


def test_several_grants_are_used_one_read_at_a_time(spark):
    def at(minutes):
        return T0 + timedelta(minutes=minutes)

    jobs = spark.createDataFrame([(1, "released", None), (2, "held", None), (3, "released", T0)], "job_id int, state string, purged_at timestamp_ntz")
    grants = spark.createDataFrame(
        [(10, 1, "ann", "approved", at(120), at(0), None), (11, 1, "ann", "approved", at(180), at(60), None), (12, 1, "bob", "approved", at(120), at(0), None),
         (13, 3, "ann", "approved", at(120), at(0), None), (14, 1, "cyd", "pending", at(120), None, None)],
        "request_id int, job_id int, requester string, status string, expires_at timestamp_ntz, decided_at timestamp_ntz, used_at timestamp_ntz",
    )
    reads = spark.createDataFrame(
        [(1, 1, "ann", "text", at(70)), (2, 1, "ann", "content", at(80)), (3, 1, "ann", "content", at(90)), (4, 1, "ann", "content", at(100)), (5, 1, "ann", "text", at(101)),
         (6, 1, "bob", "content", at(130)), (7, 2, "bob", "preview", at(5)), (8, 1, "bob", "preview", at(6)), (9, 3, "ann", "content", at(5)), (10, 1, "cyd", "text", at(5)), (11, 1, "bob", "content", at(7)), (12, 1, "bob", "text", at(8))],
        "read_id int, job_id int, actor string, kind string, at timestamp_ntz",
    )
    got = {r.read_id: (r.outcome, r.request_id) for r in ac.read(jobs, grants, reads).collect()}
    no = ("approval required", None)
    assert got == {1: ("allowed", 10), 2: ("allowed", 10), 3: ("allowed", 11), 4: no, 5: no, 6: no, 7: ("allowed", None), 8: ("allowed", 12), 9: ("purged", None),
                   10: no, 11: ("allowed", 12), 12: no}


def test_policy_changes_let_the_mode_win_over_old_values(spark):
    stored = spark.createDataFrame([("q", True, "closed", "hold", ["pii"])], "queue string, deep_scan_required boolean, fail_mode string, on_unreadable string, rule_tags array<string>")
    change = spark.createDataFrame(
        [("q", "update", "ann", 1, "monitor", None, None, None, None)],
        "queue string, change string, actor string, at int, mode string, deep_scan_required boolean, fail_mode string, on_unreadable string, rule_tags array<string>",
    )
    none = spark.createDataFrame([], "queue string, state string")
    row = po.apply_changes(stored, change, none)[0].first()
    assert (row.deep_scan_required, row.fail_mode, row.on_unreadable, row.rule_tags) == (False, "closed", "log", ["pii"])
    held = spark.createDataFrame([("q", "held")], "queue string, state string")
    after, log = po.apply_changes(stored, change.withColumn("change", F.lit("delete")), held)
    assert after.count() == 1 and log.first().outcome == "jobs held"
    assert po.apply_changes(stored, change.withColumn("change", F.lit("delete")), none)[0].count() == 0


def test_latency_takes_the_upper_median(spark):
    for values in ([5], [1, 9], [1, 2, 3], [4, 1, 1, 7, 9, 9]):
        row = sc.latency(spark.createDataFrame([(v,) for v in values], "inline_ms int")).first()
        assert (row.median_ms, row.max_ms) == (sorted(values)[len(values) // 2], max(values))


def test_title_matching_takes_the_newest_title_that_contains_the_stem(spark):
    jobs = spark.createDataFrame([(1, "Word - plan.docx", 1), (2, "plan", 5), (3, "a floor-plan-2024 draft", 3), (4, None, 9)], "job_id int, title string, created_at int")
    cases = spark.createDataFrame(
        [("a", "plan.pdf"), ("b", "floor-plan-2024.pdf"), ("c", "nowhere.pdf"), ("d", "a.pdf")], "name string, file string"
    )
    assert {r.name: r.job_id for r in sc.match_jobs(cases, jobs).collect()} == {"a": 2, "b": 3, "c": None, "d": 2}


def test_sources(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("default: {fail_mode: closed}\nqueues:\n  a: {on_unreadable: hold}\n  b:\n")
    got = {r.queue: (r.fail_mode, r.on_unreadable, r.rule_tags) for r in load_policies(spark, str(tmp_path / "p.yaml")).collect()}
    assert got == {"a": ("closed", "hold", ["*"]), "b": ("closed", "log", ["*"])}
    (tmp_path / "m.json").write_text('[{"name": "x", "file": "x.pdf", "expect": "hold", "scanned": true}, {"name": "y", "file": "y.pdf", "expect": "allow", "scanned": false}]')
    assert load_manifest(spark, str(tmp_path / "m.json")).count() == 2
    pages = paged(spark.createDataFrame([(1, "a\fb\f\fc")], "job_id int, text string"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "a"), (2, "b"), (3, ""), (4, "c")]


def replayed(stored, log):
    """One rule after another, the plain way."""
    table, outcomes = {k: dict(v) for k, v in stored.items()}, []
    for at, rule, change, name, severity in sorted(log, key=lambda x: x[0]):
        here = rule in table
        if change == "create" and here or change != "create" and not here:
            outcomes.append((at, "exists" if here else "unknown rule"))
        elif change in ("create", "update") and severity is not None and not 0 <= severity <= 10:
            outcomes.append((at, "bad severity"))
        else:
            outcomes.append((at, "applied"))
            if change == "delete":
                del table[rule]
                continue
            row = table.setdefault(rule, {"name": None, "severity": None, "enabled": True})
            if change in ("enable", "disable"):
                row["enabled"] = change == "enable"
            else:
                row["name"] = row["name"] if name is None else name
                row["severity"] = row["severity"] if severity is None else severity
                row["enabled"] = True if row["enabled"] is None else row["enabled"]
    return table, sorted(outcomes)


def test_rule_changes_are_folded_in_the_order_of_time(spark):
    rng = random.Random(4)
    stored = {f"r{k}": {"name": f"n{k}", "severity": k, "enabled": k % 2 == 0} for k in range(6)}
    log = [
        (n, f"r{rng.randrange(9)}", rng.choice(["create", "update", "enable", "disable", "delete"]),
         rng.choice([None, f"new {n}"]), rng.choice([None, 3, 99])) for n in range(300)
    ]
    rules = spark.createDataFrame([(k, v["name"], v["severity"], v["enabled"]) for k, v in stored.items()], "id string, name string, severity int, enabled boolean")
    rng.shuffle(log)
    changes = spark.createDataFrame(log, "at int, id string, change string, name string, severity int").withColumns(
        {"actor": F.lit("a"), "enabled": F.lit(None).cast("boolean")}).repartition(4)
    after, revisions = ra.apply_changes(rules, changes, ("name", "severity", "enabled"))
    table, outcomes = replayed(stored, log)
    assert {r.id: {"name": r.name, "severity": r.severity, "enabled": r.enabled} for r in after.collect()} == table
    assert sorted((r.at, r.outcome) for r in revisions.collect()) == outcomes


def test_value_at_any_rank(spark):
    rng = random.Random(6)
    for span in (1, 40, 10**6, 2**62):
        values = [rng.randrange(-span, span) for _ in range(300)] + [0] * 50
        df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(3)
        for k in (0, 175, 349):
            assert value_at(df, "v", k, min(values), max(values)) == sorted(values)[k]
    none = spark.createDataFrame([(None,)], "inline_ms bigint")
    assert tuple(sc.latency(none).first()) == (None, None)


def test_stems_meet_titles_by_the_run_fewest_titles_have(spark):
    """Every title has the run ``document``, which only one stem has; the newest job wins."""
    jobs = spark.createDataFrame(
        [(n, f"document {n:04d} of all", T0 + timedelta(days=n)) for n in range(300)], "job_id int, title string, created_at timestamp")
    cases = spark.createDataFrame(
        [("a", "document 0007 of.pdf"), ("b", "document.pdf"), ("c", "no such document.pdf"), ("d", "004.pdf"), ("e", ".pdf")], "name string, file string")
    assert {r.name: r.job_id for r in sc.match_jobs(cases, jobs).collect()} == {"a": 7, "b": 299, "c": None, "d": 49, "e": 299}


def test_a_log_is_dealt_to_tasks_by_its_length(spark, monkeypatch):
    """Left to the sizes of the shuffle, the 3,000 changes would be folded in one task."""
    from veilscan.operators import changelog
    from veilscan.operators.policies import apply_changes

    monkeypatch.setattr(changelog, "TASK_CHANGES", 250)
    changes = spark.range(3000).selectExpr(
        "concat('q', id % 500) AS queue", "if(id < 500, 'create', 'update') AS change", "'a' AS actor", "id AS at", "null AS mode",
        "id % 3 = 0 AS deep_scan_required", "string(null) AS fail_mode", "string(null) AS on_unreadable", "cast(null AS array<string>) AS rule_tags")
    stored = spark.createDataFrame([], "queue string, deep_scan_required boolean, fail_mode string, on_unreadable string, rule_tags array<string>")
    jobs = spark.createDataFrame([], "queue string, state string")
    after, log = apply_changes(stored, changes, jobs)
    tasks = log.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("queue").alias("queues"), F.count("*").alias("n"))
    found = tasks.collect()
    assert len(found) > 6 and max(r.n for r in found) < 1000 and sum(r.queues for r in found) == 500 and sum(r.n for r in found) == 3000
    assert {r.queue: r.deep_scan_required for r in after.collect()} == {f"q{n}": (2500 + n) % 3 == 0 for n in range(500)}


def test_grants_are_read_once_and_walked_only_where_someone_holds_several(spark, capsys):
    """The grants' own work (a shuffle here) is not part of the plan of the judged reads."""
    jobs = spark.createDataFrame([(n, "released", None) for n in range(4)], "job_id bigint, state string, purged_at timestamp_ntz")
    grants = spark.createDataFrame(
        [(n, n, "ann", "approved", T0 + timedelta(hours=2), T0, None) for n in range(3)],
        "request_id bigint, job_id bigint, requester string, status string, expires_at timestamp_ntz, decided_at timestamp_ntz, used_at timestamp_ntz").distinct()
    reads = spark.createDataFrame([(n, n, "ann", "content", T0) for n in range(4)], "read_id bigint, job_id bigint, actor string, kind string, at timestamp_ntz")
    got = ac.read(jobs, grants, reads)
    assert {r.read_id: r.request_id for r in got.collect()} == {0: 0, 1: 1, 2: 2, 3: None}
    capsys.readouterr()
    got.explain()
    plan = capsys.readouterr().out
    assert "CoGroup" not in plan and "used_at" not in plan
