import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veilscan.session import shared_dir
from veilscan.sources.rules import Rule, rules_table
from veilscan.streaming import feeds


def test_rule_changes_are_in_force_from_the_next_batch(spark, tmp_path):
    """Two files arrive one after the other; the rules table changes in between."""
    folder, out = str(tmp_path / "in"), shared_dir(spark, "test-feed")
    policy = F.struct(F.lit(False).alias("deep_scan_required"), F.lit("open").alias("fail_mode"), F.lit("log").alias("on_unreadable"), F.array(F.lit("*")).alias("rule_tags"))
    rules = {"now": rules_table(spark, [Rule("one", "One", "alpha", base_confidence=0.9)]).withColumn("updated_at", F.lit(1))}
    watch = feeds.RuleWatch(lambda: rules["now"])

    def run():
        q = feeds.inspection_feed(
            feeds.table_stream(spark, folder, "*.parquet"), lambda rows: rows.withColumn("policy", policy), watch.current, out, f"{out}/checkpoint"
        )
        q.awaitTermination()

    def arrive(n, text):
        spark.createDataFrame([(n, 1, text)], "job_id bigint, page int, text string").coalesce(1).write.mode("append").parquet(folder)

    arrive(1, "alpha beta in an ordinary sentence")
    run()
    assert watch.seen == (1, 1)
    rules["now"] = rules_table(spark, [Rule("two", "Two", "beta", base_confidence=0.9, action="hold")]).withColumn("updated_at", F.lit(2))
    arrive(2, "alpha beta in an ordinary sentence")
    run()
    states = {r.job_id: (r.action, r.reason) for r in spark.read.parquet(f"{out}/verdicts").collect()}
    assert states == {1: ("log", "One (1x, score 0.90)"), 2: ("hold", "Two (1x, score 0.90)")}


def test_transitions():
    walk = "inspecting"
    for kind, expected in (("release", "inspecting"), ("hold", "held"), ("read", "held"), ("deny", "denied_by_analyst"), ("release", "denied_by_analyst"),
                           ("allow", "released"), ("flag", "released_then_flagged"), ("block", "blocked")):
        walk = feeds.next_state(walk, kind)
        assert walk == expected


def run(stream, mode, out):
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(
        lambda rows, n: feeds.write_batch(rows, f"{out}/rows", n)).start().awaitTermination()


def test_lifecycle_does_not_depend_on_the_cut_into_batches(spark, tmp_path):
    rng, start = random.Random(7), datetime(2024, 1, 1)
    kinds = ["allow", "log", "hold", "block", "release", "deny", "flag", "read"]
    events = [(n % 12, start + timedelta(seconds=rng.randrange(3000)), n, rng.choice(kinds)) for n in range(400)]
    expected = {}
    for job, _, _, kind in sorted(events, key=lambda e: (e[1], e[2])):
        state, seen = expected.get(job, ("inspecting", 0))
        expected[job] = (feeds.next_state(state, kind), seen + 1)
    schema = "job_id bigint, at timestamp, event_id bigint, kind string"
    for cut, files in enumerate((1, 6)):
        rng.shuffle(events)
        folder, out = str(tmp_path / f"in{cut}"), shared_dir(spark, "test-lifecycle")
        for k in range(files):
            spark.createDataFrame(events[k::files], schema).coalesce(1).write.mode("append").parquet(folder)
        run(feeds.lifecycle_states(feeds.table_stream(spark, folder, "*.parquet", 1)), "update", out)
        updates = spark.read.parquet(f"{out}/rows")
        assert {r.job_id: (r.state, r.events) for r in feeds.latest_states(updates).collect()} == expected


def test_purges_fire_once_when_their_deadline_has_passed(spark, tmp_path):
    """Jobs arrive in three batches, two of them after the clock has moved on."""
    start = datetime(2024, 1, 1)
    folder, clock, out = str(tmp_path / "jobs"), str(tmp_path / "clock"), shared_dir(spark, "test-purge")

    def step(jobs, now):
        rows = [(j, start + timedelta(hours=due), purged) for j, due, purged in jobs]
        spark.createDataFrame(rows, "job_id bigint, purge_after timestamp, purged boolean").coalesce(1).write.mode("append").parquet(folder)
        spark.createDataFrame([(start + timedelta(hours=now),)], "at timestamp").coalesce(1).write.mode("append").parquet(clock)
        due = feeds.purges_due(feeds.table_stream(spark, folder, "*.parquet"), feeds.table_stream(spark, clock, "*.parquet"))
        run(due, "append", out)
        return sorted(r.job_id for r in spark.read.parquet(f"{out}/rows").collect())

    assert step([(1, 2, False), (2, 9, False), (3, 1, True)], 3) == [1]
    assert step([(4, 1, False), (5, 30, False)], 4) == [1, 4]
    assert step([(6, 40, False)], 20) == [1, 2, 4]


def test_a_table_is_a_file_or_a_folder_of_files(spark, tmp_path):
    rows = spark.range(40).withColumnRenamed("id", "doc_id")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for name in ("many", "one"):
        spark.range(5).selectExpr("id AS other").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = shared_dir(spark, "test-table")
        run(feeds.table_stream(spark, str(tmp_path / name), "documents.parquet", 1), "append", out)
        assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/rows").collect()) == list(range(40))


def test_a_batch_of_timers_takes_a_call_a_key_and_not_a_job(spark, tmp_path):
    """20,000 jobs on 16 keys: ids beyond 2^53, repeats with another deadline, ids and deadlines missing."""
    start, big = datetime(2024, 1, 1), 1 << 60
    jobs = spark.range(20_000).selectExpr(f"id + {big} AS job_id", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id) AS purge_after", "id % 10 = 9 AS purged")
    odd = spark.createDataFrame(
        [(None, start, False), (None, start + timedelta(days=1), False), (3, None, False), (big + 15_000, start, False)],
        "job_id bigint, purge_after timestamp, purged boolean")
    folder, clock, out = str(tmp_path / "jobs"), str(tmp_path / "clock"), shared_dir(spark, "test-timers")
    jobs.union(odd).write.parquet(folder)
    due = []
    for seconds in (10_000, 10_000, 90_000):
        spark.createDataFrame([(start + timedelta(seconds=seconds),)], "at timestamp").write.mode("append").parquet(clock)
        run(feeds.purges_due(feeds.table_stream(spark, folder, "*.parquet"), feeds.table_stream(spark, clock, "*.parquet"), keys=16), "append", out)
        due.append({(r.job_id, r.purge_after) for r in spark.read.parquet(f"{out}/rows").collect()})
    kept = [n for n in range(20_000) if n % 10 != 9]
    first = {(big + n, start + timedelta(seconds=n)) for n in kept if n < 10_000} | {(None, start), (big + 15_000, start)}
    later = {(big + n, start + timedelta(seconds=n)) for n in kept if 10_000 <= n and n != 15_000}
    assert due == [first, first, first | later]
    assert spark.read.parquet(f"{out}/rows").count() == len(first | later)
