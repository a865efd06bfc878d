"""Streams with late, expired and replayed rows, and the versioned table under them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reelspan.streaming import expiring as ex, logs
from reelspan.streaming.versioned import VersionedTable

FEEDBACK = "id long, project_id long, clip_id long, moment_id long, action string, user_rating int, created_at timestamp"
KEYS = ["project_id", "candidate_key"]


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def putter(spark, path, schema):
    return lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upserts_equal_batch_with_late_rows(spark, tmp_path):
    src, put = str(tmp_path / "in"), putter(spark, str(tmp_path / "in"), FEEDBACK)
    put([(1, 1, 1, 1, "accept", None, at(0, 5)), (2, 1, 2, None, "reject", None, at(0, 6))])
    for more in ([(3, 1, 1, 1, "reject", None, at(0, 4)), (4, 1, 2, None, "accept", None, at(0, 7)), (5, 1, 3, 3, "rendered", None, at(0, 9)), (6, 1, 4, 4, "accept", 1, at(0, 9))], []):
        logs.upsert_table(logs.latest_decisions(logs.read_log(spark, src, FEEDBACK)), str(tmp_path / "t"), str(tmp_path / "c"), KEYS, 2).awaitTermination()
        if more:
            put(more)
    # the late reject loses, rendered and rule-breaking rows never count
    assert rows(logs.current_table(spark, str(tmp_path / "t"), KEYS), "candidate_key", "id") == [(1, 1), (2, 4)]


def table(spark, tmp_path, **k):
    return VersionedTable(spark, str(tmp_path / "t"), ["k"], **k)


def frame(spark, *data):
    return spark.createDataFrame(list(data), "k long, v string, gone boolean")


def test_replay_and_crash_leave_the_same_rows(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, compact_every=3, gone="gone")
    with pytest.raises(ValueError):
        t.read()
    assert t.commit(frame(spark, (1, "a", None), (2, "a", None), (None, "a", None)), 0)
    assert t.commit(frame(spark, (1, "b", None)), 1)
    want = [(1, "b"), (2, "a")]
    assert not t.commit(frame(spark, (1, "x", None), (9, "x", None)), 1)  # replayed

    def dies(self, m):
        raise OSError("gone before the manifest")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", dies)
        with pytest.raises(OSError):
            t.commit(frame(spark, (2, "c", True)), 2)  # the third batch: its data and the snapshot are written, no manifest
    assert rows(t.read().where("k is not null"), "k", "v") == want and t.manifest()["batch"] == 1
    assert t.commit(frame(spark, (2, "c", True)), 2)
    m = t.manifest()
    assert m["tail"] == [] and m["snapshot"] and rows(t.read().where("k is not null"), "k", "v") == [(1, "b")]
    assert t.read().where("k is null").count() == 1
    assert rows(t.read(2).where("k is not null"), "k", "v") == want  # an older version is still there
    assert t.commit(frame(spark, (2, "d", None)), 5)
    assert rows(t.read().where("k is not null"), "k", "v") == [(1, "b"), (2, "d")]
    assert t.vacuum(1) == 5 and t.versions() == [4]  # three batches, two of them written twice
    assert rows(t.read().where("k is not null"), "k", "v") == [(1, "b"), (2, "d")]


def test_two_writers_of_one_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.commit(frame(spark, (1, "a", None)), 0)
    with pytest.raises(Exception, match="(?i)exist"):
        t._publish({**t.manifest(), "batch": 7})
    assert t.manifest()["batch"] == 0


@pytest.mark.parametrize("compact_every", [1, 2, 9])
def test_groups_are_replaced_whole(spark, tmp_path, compact_every):
    t = table(spark, tmp_path, compact_every=compact_every)
    t.commit(frame(spark, (1, "a", None), (1, "b", None), (2, "c", None)), 0, frame(spark, (1, "", None), (2, "", None)))
    t.commit(frame(spark, (1, "d", None)), 1, frame(spark, (1, "", None)))
    assert rows(t.read(), "k", "v") == [(1, "d"), (2, "c")]
    t.commit(frame(spark), 2, frame(spark, (2, "", None)))  # touched, nothing found
    assert rows(t.read(), "k", "v") == [(1, "d")]


def test_state_expires_and_late_rows_go_aside(spark, tmp_path):
    put, schema = putter(spark, str(tmp_path / "in"), FEEDBACK), FEEDBACK
    batches = [
        [(1, 1, 1, 1, "accept", None, at(0)), (2, 1, 2, 2, "accept", None, at(0)), (3, 1, 3, 3, "reject", None, at(1))],
        [(4, 1, 1, 1, "reject", None, at(8)), (5, 1, 3, 3, "rendered", None, at(8))],
        [(6, 1, 2, 2, "reject", None, at(2)), (7, 1, 1, 1, "accept", None, at(7))],  # 6: behind the clock (day 6); 7: older than 4
        [(8, 1, 9, 9, "accept", None, at(20)), (9, 1, 9, 9, "accept", None, None)],
        [(10, 1, 3, 3, "accept", None, at(21))],
    ]
    base, sizes = str(tmp_path / "out"), []
    for b in batches:
        put(b)
        d = ex.expiring_decisions(logs.read_log(spark, str(tmp_path / "in"), schema), "2 days", 10 * 86_400)
        q = ex.write_decisions(d, base, str(tmp_path / "c"), compact_every=2)
        q.awaitTermination()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    live = rows(ex.decisions_table(spark, base).read(), "candidate_key", "id")
    late = rows(spark.read.parquet(f"{base}/late"), "candidate_key", "id")
    assert live == [(3, 10), (9, 8)] and late == [(2, 6)]
    assert sizes[-1] < max(sizes)  # expired candidates have left the state
    # for live keys the stream equals the batch query
    everything = [r for b in batches for r in b if r[4] != "rendered" and r[6] is not None]
    newest = {}
    for r in sorted(everything, key=lambda r: (r[6], r[0])):
        newest[r[2]] = r
    assert live == sorted((k, r[0]) for k, r in newest.items() if r[6] > at(21) - dt.timedelta(days=12))
