import datetime as dt
import random
import subprocess
import sys
import textwrap
from pathlib import Path

from conftest import ROOT, rows

from sparkwitness.streaming import overlap, transitions
from sparkwitness.streaming.sinks import drain, drain_and_report, land_in_order, stateful_session

DAY = dt.datetime(2024, 1, 1)
CONTEXT = "context_set string, observed_at timestamp, sequence long, repository string, revision string, work string, path string"
EVIDENCE = "evidence_id string, context_set string, repository string, revision string, work string, scope_mode string, scope_path string"
WORK = "snapshot_id string, id string, is_current boolean, path string, seen_at timestamp"


def _stream(spark, folder, schema, *batches, per_trigger=1):
    """A stream of one file per batch, in the order given."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(str(folder))


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def move(hours, revision, who="s", sequence=0):
    return (who, at(hours), sequence, "r", revision, None, None)


def follow(spark, folder, *batches, per_trigger=1, **given):
    session = stateful_session(spark)
    evidence = session.createDataFrame([("e", "s", "r", "v1", None, None, None), ("f", "t", None, "v1", None, None, None)], EVIDENCE)
    stream = _stream(session, folder, CONTEXT, *batches, per_trigger=per_trigger)
    return rows(drain(transitions.status_transitions(stream, evidence, **given), "t", into=spark), "evidence_id", "observed_at", "before", "after")


def compared(moves, until, expire_days=30):
    """The stated rule over all rows in event time: applies at v1, unknown at None, else invalid."""
    out = []
    for who, name in (("s", "e"), ("t", "f")):
        last = None
        for _, when, _, _, revision, _, _ in sorted((m for m in moves if m[0] == who), key=lambda m: (m[1], m[2])):
            if when > until:
                break
            status = {"v1": "applies", None: "unknown"}.get(revision, "invalid")
            if last and last[1] != status and when - last[0] <= dt.timedelta(days=expire_days):
                out.append((name, when, last[1], status))
            last = (when, status)
    return sorted(out, key=repr)


def test_transitions_do_not_depend_on_triggers_or_on_the_order_of_files(spark, tmp_path):
    choice = random.Random(4)
    moves = [move(h / 4, choice.choice(["v1", "v2", None, "v1"]), choice.choice("st"), h) for h in range(120)]
    moves += [move(30, "v1", "x")]  # evidence of another set; the newest rows are not decided yet
    expected = compared(moves, at(30) - dt.timedelta(hours=5))
    assert len(expected) > 20
    parts = [moves[k * 20:k * 20 + 20] for k in range(6)] + [moves[120:]]
    shuffled = [parts[k] for k in (1, 0, 3, 2, 5, 4, 6)]  # at most 5 hours late; a file holds 5 hours
    backwards = [choice.sample(p, len(p)) for p in parts]
    for n, (files, per_trigger) in enumerate([(parts, 99), (backwards, 3), (shuffled, 2)]):
        assert follow(spark, tmp_path / str(n), *files, per_trigger=per_trigger, delay="5 hours") == expected, n


def test_only_rows_behind_the_watermark_are_late(spark, tmp_path):
    found = follow(
        spark, tmp_path, [move(2, "v1"), move(1, "v2"), move(1, None, "t")], [move(4, "v2"), move(3, None)],
        # 2.5 h is inside the hour that the watermark of 3 h leaves after the newest row of the first two files; 1.5 h is late.
        [move(3.5, "v1"), move(1.5, "v9"), move(6, "v1", "t")], [move(9, "v1", "x")],
    )
    expected = [
        ("e", at(2), "invalid", "applies"), ("e", at(3), "applies", "unknown"), ("e", at(3.5), "unknown", "applies"),
        ("e", at(4), "applies", "invalid"), ("f", at(6), "unknown", "applies"),
    ]
    assert found == sorted(expected, key=repr)


def test_a_status_is_forgotten_after_its_time(spark, tmp_path):
    moves = [move(0, "v1"), move(10, "v2"), move(24 * 3, "v1"), move(24 * 3 + 1, "v2"), move(24 * 9, "v1"), move(24 * 20, "v1", "x")]
    expected = compared(moves, at(24 * 19), expire_days=2)
    assert [when for _, when, _, _ in expected] == [at(10), at(73)]
    for n, per_trigger in enumerate((1, 99)):
        assert follow(spark, tmp_path / str(n), *[[m] for m in moves], per_trigger=per_trigger, expire_days=2) == expected


def test_the_stateful_step_needs_no_package_on_workers(tmp_path):
    """Started from another folder; workers inherit no path to this library."""
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r}); sys.path.insert(0, {str(ROOT / 'tests')!r})
        from sparkwitness.plans.session import build_session
        import test_streaming as t
        from pathlib import Path
        spark = build_session("away", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
        found = t.follow(spark, Path({str(tmp_path)!r}) / "in", [t.move(1, "v1"), t.move(2, "v2")], [t.move(9, "v1", "x")])
        print("FOUND", [(r[0], r[2], r[3]) for r in found])
    """))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "FOUND [('e', 'applies', 'invalid')]" in done.stdout, done.stderr[-2000:]


def test_overlap_is_reported_once_and_within_the_window(spark, tmp_path):
    day = lambda n: DAY + dt.timedelta(days=n)
    stream = _stream(
        spark, tmp_path, WORK, [("s", "#1", True, "a", day(0)), ("s", "#2", False, "a", day(1))],
        [("s", "#3", False, "a", day(3)), ("s", "#2", False, "b", day(2)), ("s", "#2", False, "a", day(2))],
        [("s", "#4", False, "a", day(40)), ("q", "#5", False, "a", day(1))],
    )
    found = drain(overlap.overlap_stream(stream, window="10 days", delay="5 days"), "o")
    assert rows(found, "current_id", "other_id", "path") == [("#1", "#2", "a"), ("#1", "#3", "a")]


def test_overlap_is_the_same_for_one_and_eight_triggers_and_its_state_is_bounded(spark):
    choice = random.Random(7)
    work = [
        (f"s{choice.randrange(3)}", f"#{choice.randrange(12)}", choice.random() < 0.3, choice.choice("abcd"), DAY + dt.timedelta(hours=choice.randrange(24 * 400)))
        for _ in range(1600)
    ]
    near = dt.timedelta(days=10)
    expected = sorted({(a[0], a[1], b[1], a[3]) for a in work for b in work if a[2] and not b[2] and (a[0], a[3]) == (b[0], b[3]) and abs(a[4] - b[4]) <= near}, key=repr)
    kept = {}
    for files in (1, 8):
        landed = land_in_order(spark.createDataFrame(work, WORK), "seen_at", files)
        stream = spark.readStream.schema(WORK).option("maxFilesPerTrigger", 1).parquet(landed)
        found, report = drain_and_report(overlap.overlap_stream(stream, window="10 days"), f"o{files}")
        assert rows(found.distinct(), "snapshot_id", "current_id", "other_id", "path") == expected
        assert len([r for r in report if r[1]]) == files
        kept[files] = [r[2] for r in report]
    # A file holds 50 days of rows, the window 10 on both sides: older rows are gone when the next file is in.
    assert max(kept[8]) < max(kept[1]) / 2
    assert max(kept[8][4:]) < 1.5 * max(kept[8][:4])


def test_files_land_in_event_time_order(spark):
    frame = spark.createDataFrame([("s", str(k), True, "a", None if k == 3 else DAY + dt.timedelta(minutes=(k * 37) % 100)) for k in range(100)], WORK)
    landed = land_in_order(frame, "seen_at", 4)
    files = sorted(Path(landed).glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    last = None
    for f in files:
        times = [r.seen_at for r in spark.read.parquet(str(f)).where("seen_at IS NOT NULL").collect()]
        assert last is None or min(times) > last
        last = max(times)
    assert len(files) == 4 and spark.read.parquet(landed).count() == 100


def test_landing_in_order_sorts_no_range(spark, monkeypatch):
    """A task that cuts the table keeps no rows; the files still follow each other in time."""
    from pyspark.sql import functions as F

    from sparkwitness.streaming import sinks

    seen = []
    monkeypatch.setattr(sinks, "discard", lambda _, folder: seen.append(folder))
    given = spark.range(1000).select("id", F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.col("id") * 7919 % 1000)).alias("at"))
    landed = spark.read.parquet(land_in_order(given, "at", 2)).select("id", "at", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("m"))
    files = landed.groupBy("f", "m").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).orderBy("m").collect()
    assert len(files) == 2 and sum(r.n for r in files) == 1000 and files[0].high <= files[1].low
    assert len(spark.read.parquet(seen[0]).inputFiles()) > 2  # many tasks cut it


def test_large_ranges_land_in_equally_many_files(spark, monkeypatch):
    """no task lands a whole range; a trigger still takes exactly one range, also where ties leave one short of rows."""
    from pyspark.sql import functions as F

    from sparkwitness.streaming import sinks

    monkeypatch.setattr(sinks, "FILE_ROWS", 100)
    low = F.least(F.col("id"), F.lit(900))  # the last range holds one time
    given = spark.range(1000).select("id", F.timestamp_seconds(low).alias("at"))
    folder = land_in_order(given, "at", 2)
    n = sinks.per_range(spark, folder, 2)
    files = sorted(Path(folder).glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert n >= 5 and len(files) == 2 * n and spark.read.parquet(folder).count() == 1000
    ranges = [spark.read.schema("id long, at timestamp").parquet(*map(str, part)).agg(F.min("at"), F.max("at")).first() for part in (files[:n], files[n:])]
    assert ranges[0][1] < ranges[1][0]


def test_evidence_shares_state_and_timers(spark, tmp_path):
    """many evidences of one bucket are compared each by itself, and forgotten after their time; one bucket or many, the rows agree."""
    choice = random.Random(5)
    sets = [f"s{k}" for k in range(12)]
    moves = [(choice.choice(sets), at(24 * h / 4), h, "r", choice.choice(["v1", "v2", None]), None, None) for h in range(200)] + [move(24 * 60, "v1", "x")]
    found = []
    for buckets in (1, 1000):
        session = stateful_session(spark)
        evidence = session.createDataFrame([(f"e{s}", s, "r", "v1", None, None, None) for s in sets], EVIDENCE)
        stream = _stream(session, tmp_path / str(buckets), CONTEXT, *[moves[k:k + 70] for k in (0, 70, 140)])
        done, report = drain_and_report(transitions.status_transitions(stream, evidence, expire_days=2, buckets=buckets), f"b{buckets}", into=spark)
        found.append(rows(done, "evidence_id", "observed_at", "before", "after"))
        if buckets == 1:
            assert report[-1][2] < 12  # what is 2 days old is gone
    expected = []
    for s in sets:
        mine = sorted((m for m in moves if m[0] == s), key=lambda m: m[1])
        name = {"v1": "applies", None: "unknown"}
        for a, b in zip(mine, mine[1:]):
            before, after = (name.get(m[4], "invalid") for m in (a, b))
            if before != after and b[1] - a[1] <= dt.timedelta(days=2):
                expected.append((f"e{s}", b[1], before, after))
    assert found[0] == found[1] == sorted(expected, key=repr) and len(expected) > 10
