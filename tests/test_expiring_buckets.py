"""Decisions that expire share the state of their bucket; changes are those of a state per candidate."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelspan.streaming import expiring as ex, logs

FEEDBACK = "id long, project_id long, clip_id long, moment_id long, action string, user_rating int, created_at timestamp"
DAY = 86_400_000_000


def at(day, us=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, microseconds=us)


def micros(t):
    return int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def expected(batches, delay, ttl):
    """What a state and a timer per candidate say, batch by batch; the clock of a batch follows from those before it."""
    held, clock, told = {}, 0, Counter()
    for b in batches:
        for again in (True, False):  # Spark moves the clock once more in a batch without rows
            fresh = set()
            for i, project, clip, _, action, rating, t in sorted(b, key=lambda r: r[0]) if again else ():
                k, v = (project, clip), (micros(t), i, action, rating)
                if v[0] < clock:
                    told[(*k, *v, ex.LATE)] += 1
                elif k not in held or v[:2] > held[k][:2]:
                    held[k] = v
                    fresh.add(k)
            told.update((*k, *held[k], ex.SET) for k in fresh)
            for k in [k for k, v in held.items() if -(-(v[0] + ttl) // 1000) <= clock // 1000]:
                told[(*k, *held.pop(k), ex.GONE)] += 1
            clock = max([clock, *((micros(r[6]) - delay) // 1000 * 1000 for r in b)])
    return told


@pytest.mark.parametrize("buckets", [1, 4096])
def test_changes_are_those_of_a_state_per_candidate(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(ex, "BUCKETS", buckets)
    ids = iter(range(1, 10_000))
    first = [(next(ids), p, c, c, "accept", None, at(0, 1000 * c)) for p in (1, None) for c in range(40)]
    batches = [
        first,
        [(next(ids), 1, c, c, "reject", None, at(9, c)) for c in range(0, 40, 2)],
        [(next(ids), 1, 3, 3, "accept", None, at(2)), (next(ids), 1, 5, 5, "reject", None, at(8)), (next(ids), 2, 1, 1, "edited", 4, at(8))],
        [(next(ids), 2, 2, 2, "accept", None, at(12, 20_000))],  # the clock comes to when one of the first ends, past some
        [(next(ids), None, 7, 7, "accept", None, at(12, 21_000)), (next(ids), 1, 0, 0, "accept", None, at(15))],
        [(next(ids), 2, 3, 3, "accept", None, at(22))],
    ]
    base, seen = str(tmp_path / "out"), []
    for n, b in enumerate(batches):
        spark.createDataFrame(b, FEEDBACK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        d = ex.expiring_decisions(logs.read_log(spark, str(tmp_path / "in"), FEEDBACK), "2 days", 10 * 86_400)
        q = d.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(
            lambda f, i: seen.extend(tuple(r) for r in f.collect()))
        name = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(name)
        spark.conf.set(name, ex.ROCKSDB)
        try:
            q = q.trigger(availableNow=True).start()
        finally:
            spark.conf.set(name, before)
        q.awaitTermination()
        held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        if n == 0 and buckets < 4096:
            assert held <= 2 * buckets  # before: a state per candidate, 80 of them
    assert Counter(seen) == expected(batches, 2 * DAY, 10 * DAY)
    assert {r[-1] for r in seen} == {ex.SET, ex.GONE, ex.LATE}
