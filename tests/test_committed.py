"""Committed batches, kept history numbers and bounded de-duplication: kills, retries, late rows."""
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deckscope.operators.history import NumberedHistory
from deckscope.sources import sinks as SK
from deckscope.sources.committed import CommittedTable, Manifests, ResultFiles
from deckscope.streaming.seen import SeenKeys
from deckscope.streaming.watch import start_scoring


def _files(df):
    return df._jdf.queryExecution().analyzed().toString(), df.inputFiles()


def test_killed_writer_leaves_no_rows_and_a_retry_adds_none(spark, tmp_path, monkeypatch):
    t = CommittedTable(spark, str(tmp_path / "t"), ["g"])
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], "v long, g string")
    assert t.read() is None
    with monkeypatch.context() as m:
        m.setattr(Manifests, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.append(df, "one")
    assert list((tmp_path / "t" / "data").rglob("*.parquet")) and t.read() is None      # files without a manifest
    assert t.append(df, "one") and not t.append(df.filter("v = 1"), "one")
    assert t.append(df.filter("v = 1"), "two/with odd:id")
    assert sorted(r.v or 0 for r in t.read().collect()) == [0, 1, 1, 2]
    assert [m["batch"] for m in t.manifests.all()] == ["one", "two/with odd:id"]
    assert sorted(r.v for r in t.read().filter("g = 'b'").collect()) == [2]
    assert t.append(df.limit(0), "empty") and t.read().count() == 4


def test_append_history_twice_adds_once(spark, tmp_path):
    df = spark.createDataFrame([("d", datetime(2024, 1, 2, 3), 5.0)], "deck_name string, timestamp timestamp_ntz, composite_score double")
    for _ in range(2):
        SK.append_history(df, str(tmp_path / "h"), batch_id="b1")
    rows = CommittedTable(spark, str(tmp_path / "h"), ["analysis_date"]).read().collect()
    assert [(r.deck_name, r.analysis_date) for r in rows] == [("d", date(2024, 1, 2))]


def test_result_files_read_one_bucket(spark, tmp_path):
    f = ResultFiles(spark, str(tmp_path / "r"), buckets=8)
    df = spark.range(200).selectExpr("concat('deck/', id) as deck_name", "id * 1.0D as score")
    assert f.document("x") is None
    f.append(df, 0)
    f.append(df, 0)
    f.append(spark.createDataFrame([("deck/7", 70.0)], "deck_name string, score double"), 1)
    got = f.document("deck/7")
    assert sorted(r.score for r in got.collect()) == [7.0, 70.0] and f.document("none").count() == 0
    assert len([p for p in (tmp_path / "r" / "data").rglob("*.csv")]) <= 8 + 1          # files by bucket, not by document
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def _history(n, seed=1, days=90):
    rng = random.Random(seed)
    return [(datetime(2024, 1, 1) + timedelta(days=rng.randrange(days), hours=rng.randrange(24)), f"d{rng.randrange(9)}", i, float(rng.randrange(10)), 1.0, 2.0, "c" if i % 5 else None) for i in range(n)]


HIST = "timestamp timestamp_ntz, deck_name string, analysis_id long, market_potential double, traction_strength double, composite_score double, category string"


@pytest.mark.parametrize("pattern", ["yyyy-MM-dd", "yyyy-MM"])
def test_history_in_batches_equals_one_run(spark, tmp_path, pattern):
    rows = sorted(_history(240, days=40))
    h = NumberedHistory(spark, str(tmp_path / "h"), ("timestamp", "deck_name", "analysis_id"), pattern)
    assert h.numbered() is None and h.timeline() is None
    late = [r for r in rows if r[2] % 11 == 0 and r[0] < datetime(2024, 1, 9)]
    on_time = [r for r in rows if r not in late]
    for name, part in (("a", on_time[:120]), ("b", on_time[120:]), ("late", late)):
        df = spark.createDataFrame(part, HIST)
        assert h.append(df, name) and not h.append(df, name)
    got = h.numbered()
    assert got.columns == [c.split()[0] for c in HIST.split(", ")] + ["analysis_number"]
    assert [r.analysis_id for r in sorted(got.collect(), key=lambda r: r.analysis_number)] == [r[2] for r in sorted(rows, key=lambda r: r[:3])]
    assert sorted(r.analysis_number for r in got.collect()) == list(range(1, 241))
    days = sorted({r[0].date().isoformat() for r in rows})
    latest = {}
    for r in sorted(rows, key=lambda r: r[:3]):
        latest[r[0].date().isoformat(), r[1]] = r
    want = {(days.index(d) + 1, d, k, r[3], r[4], r[5], r[6]) for (d, k), r in latest.items()}
    assert {tuple(r) for r in h.timeline().collect()} == want


def test_history_does_not_read_the_past(spark, tmp_path, monkeypatch):
    """A new period reads nothing; a late row reads its own period; a range of periods reads only those."""
    h = NumberedHistory(spark, str(tmp_path / "h"), ("timestamp", "deck_name", "analysis_id"), "yyyy-MM")
    read, plain = [], NumberedHistory._read
    monkeypatch.setattr(NumberedHistory, "_read", lambda self, periods: read.append(sorted(periods)) or plain(self, periods))
    rows = _history(120)
    for month in (1, 2, 3):
        h.append(spark.createDataFrame([r for r in rows if r[0].month == month], HIST), month)
    assert read == []
    h.append(spark.createDataFrame([(datetime(2024, 2, 3), "late", 999, 1.0, 1.0, 1.0, "c")], HIST), "late")
    assert read == [["2024-02"]]
    march = h.numbered(first="2024-03")
    assert read[-1] == ["2024-03"] and all("period=2024-03" in f for f in march.inputFiles())
    assert min(r.analysis_number for r in march.collect()) == 1 + sum(r[0].month < 3 for r in rows) + 1
    with pytest.raises(Exception, match="needs a time"):
        h.append(spark.createDataFrame([(None, "x", 1, 1.0, 1.0, 1.0, "c")], HIST), "bad")
    assert h.numbered().count() == 121


def test_seen_keys(spark, tmp_path):
    seen, day = SeenKeys(spark, str(tmp_path / "s"), "k", days=3, buckets=4), date(2024, 5, 10)
    def df(*rows):
        return spark.createDataFrame(rows, "k string, t long, x string")
    def go(batch, i, today):
        new = seen.new_rows(batch, i, today, order=["t"])
        out = sorted(map(tuple, new.collect()), key=str)
        seen.remember(new, i, today)
        return out
    assert go(df(("a", 2, "late"), ("a", 1, "z"), ("a", 1, "b"), (None, 1, "n"), (None, 1, "n")), 0, day) == [("a", 1, "b"), (None, 1, "n"), (None, 1, "n")]
    assert go(df(("a", 5, "again"), ("b", 1, "x")), 1, day) == [("b", 1, "x")]
    assert go(df(("a", 5, "again"), ("b", 1, "x")), 1, day) == [("b", 1, "x")]           # retry of batch 1: it does not see itself
    assert go(df(("b", 1, "x"), ("c", 1, "x")), 2, day + timedelta(days=2)) == [("c", 1, "x")]
    assert go(df(("a", 9, "new again"), ("c", 1, "y")), 3, day + timedelta(days=3)) == [("a", 9, "new again")]  # a's day is past its time to live


def test_seen_keys_read_does_not_grow(spark, tmp_path):
    """Files read for one key stay those of its bucket and of the window, however many days have passed."""
    seen, day, sizes = SeenKeys(spark, str(tmp_path / "s"), "k", days=2, buckets=16), date(2024, 1, 1), []
    for i in range(6):
        seen.remember(spark.range(i * 100, i * 100 + 100).select(F.col("id").cast("string").alias("k")), i, day + timedelta(days=i))
        table = seen.table.read(lambda m: m["day"] > (day + timedelta(days=i - 2)).isoformat())
        sizes.append(len(table.inputFiles()))
    assert sizes[1:] == [sizes[1]] * 5
    plan = seen.new_rows(spark.createDataFrame([("5",)], "k string"), 9, day + timedelta(days=5))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_committed_stream_with_restart_and_retry(spark, tmp_path, monkeypatch):
    src = tmp_path / "in"
    schema = "doc_id long, deck_name string, text string"
    long = "Our revenue grew and the team was led by a former director with years of experience. " * 3
    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    def run():
        start_scoring(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), schema, unique_key="doc_id", committed=True, per_document_csv=True).awaitTermination()
    put([(1, "a", long), (1, "a", long), (2, "b", "short")])
    plain = CommittedTable.append
    with monkeypatch.context() as m:      # dies after the results are committed and before the keys are
        m.setattr(CommittedTable, "append", lambda self, df, b, **n: (_ for _ in ()).throw(RuntimeError("killed")) if n else plain(self, df, b, **n))
        with pytest.raises(Exception):
            run()
    run()
    put([(1, "a", long), (3, "c", long)])
    run()
    got = CommittedTable(spark, str(tmp_path / "out/results"), ["batch_id"]).read()
    assert sorted((r.doc_id, r.batch_id) for r in got.collect()) == [(1, 0), (3, 1)]
    assert [r.doc_id for r in CommittedTable(spark, str(tmp_path / "out/errors"), ["batch_id"]).read().collect()] == [2]
    assert ResultFiles(spark, str(tmp_path / "out/per_document")).document("a").count() == 1
