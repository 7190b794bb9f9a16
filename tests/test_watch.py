import threading

import pytest

from tidemark.plans.engine import Engine
from tidemark.streaming.watch import kept_up, watch_files


def test_a_failed_file_is_indexed_by_the_next_run(spark, tmp_path):
    """A scan at first; a batch that fails is taken up by the following one, after a restart too; a failed scan leads to a scan."""
    files = {"src/a.cs": "class A {}"}
    engine, inbox = Engine(spark, str(tmp_path / "index")), tmp_path / "inbox"
    broken, told, asked = set(), [], []

    def run(paths):
        wanted = None if paths is None else sorted(r["path"] for r in paths.collect())
        asked.append(wanted)
        if "scan" in broken and wanted is None or broken & {*(wanted or [])}:
            raise RuntimeError("no")
        engine.index(spark.createDataFrame([("code", p, t) for p, t in files.items()], "source string, path string, text string"))

    def observer(event):
        told.append(event)
        raise ValueError("ignored")

    def once(*paths):
        if paths:
            spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1).write.mode("append").parquet(str(inbox))
        events = spark.readStream.schema("path string").parquet(str(inbox))
        watch_files(events, run, str(tmp_path / "watch"), observer=observer, once=True).awaitTermination(120)

    once("src/a.cs")
    assert asked == [None, ["src/a.cs"]] and [(e["ok"], e["scan"], e["retried"]) for e in told] == [(True, True, 0), (True, False, 0)]
    files["src/b.cs"] = "class Late {}"
    broken |= {"src/b.cs", "scan"}
    del asked[:], told[:]
    once("src/b.cs")  # the scan fails, and the batch becomes a scan, which fails too
    assert asked == [None, None] and [(e["ok"], e["scan"], e["retried"]) for e in told] == [(False, True, 0), (False, True, 1)]
    assert engine.exact("Late").count() == 0
    broken.discard("scan")
    del asked[:], told[:]
    once("src/c.cs")
    assert asked == [None, ["src/c.cs"]] and told[0]["retried"] == 1 and told[1]["retried"] == 0
    assert engine.exact("Late").count() == 1
    del asked[:], told[:]
    broken.add("src/d.cs")
    once("src/d.cs")
    assert asked == [None, ["src/d.cs"]] and told[1]["ok"] is False
    broken.clear()
    del asked[:], told[:]
    once("src/e.cs")
    assert asked == [None, ["src/e.cs"]] and told[0]["retried"] == 1


def test_safety_scans_come_by_themselves(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    seen, done = [], threading.Event()

    def run(paths):
        seen.append(paths is None)
        if len(seen) > 2:
            done.set()

    events = spark.readStream.schema("path string").parquet(str(tmp_path / "inbox"))
    query = watch_files(events, run, str(tmp_path / "watch"), safety_seconds=2, milliseconds=250)
    assert done.wait(90)
    query.stop()
    assert all(seen)
    with pytest.raises(ValueError):
        watch_files(events, run, str(tmp_path / "other"), milliseconds=10)


def test_a_stream_that_fails_is_started_again():
    class Query:
        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self, seconds):
            if self.fails:
                raise RuntimeError("gone")
            return True

        def stop(self):
            pass

    runs, told = iter([Query(True), Query(True), Query(False)]), []
    assert kept_up(lambda: next(runs), threading.Event(), seconds=0, observer=told.append) == 3 and len(told) == 2
