from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperlane.streaming import intake


def run(frame, name, mode, path, spark):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_watched_folder_and_duplicates(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("a.pdf", b"1"), ("b.pdf", b"1"), ("c.PNG", b"2"), (".hidden.pdf", b"3"), ("~t.pdf", b"4"), ("n.txt", b"5")):
        (folder / name).write_bytes(data)
    seen = intake.marked_duplicates(intake.watched_folder(spark, str(folder)))
    rows = run(seen, "marked", "append", tmp_path, spark)
    assert sorted((p.rsplit("/", 1)[1], o) for _, p, o in rows) == [("a.pdf", "new"), ("b.pdf", "duplicate"), ("c.PNG", "new")]


def journal(spark, folder):
    start = datetime(2024, 1, 1)
    rows = [("d", "b", f"p{i}", f"{i:064x}", "done" if i < 3 else "pending", f"doc{i}", None, start + timedelta(seconds=s), start + timedelta(seconds=s)) for i, s in enumerate((0, 59, 119, 600))]
    spark.createDataFrame(rows, intake.JOURNAL).coalesce(1).write.parquet(str(folder))


def test_sessions_progress_and_states(spark, tmp_path):
    journal(spark, tmp_path / "j")
    stream = lambda: intake.journal_stream(spark, str(tmp_path / "j"))
    sessions = run(intake.sessions(stream(), late="0 seconds"), "sessions", "append", tmp_path, spark)
    assert sorted(n for *_, n in sessions) in ([1, 2], [1, 1, 2])
    run(intake.batch_progress(stream()), "progress", "append", tmp_path, spark)
    assert [tuple(r) for r in intake.batch_counts(spark.table("progress")).collect()] == [("b", 4, 3, "processing")]
    assert len(run(intake.last_states(stream()), "states", "complete", tmp_path, spark)) == 4


def test_scopes_and_limit(spark):
    events = spark.createDataFrame([("a", "document.1.status"), ("b", "matches.changed")], "company_id string, topic string")
    assert intake.events_for(events, "a").count() == 1 and intake.events_for(events, None, "matches").count() == 1
    pages = spark.createDataFrame([("a", "pending"), ("a", "pending"), ("b", "done")], "company_id string, status string")
    assert {r["company_id"]: r["accepted"] for r in intake.within_limit(pages, 1).select("company_id", F.col("accepted")).collect()} == {"a": False, "b": True}
