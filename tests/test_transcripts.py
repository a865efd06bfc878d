"""Transcript files read by segment."""

import json

import pytest

from reelspan.sources import files as fl


@pytest.fixture()
def folder(tmp_path):
    docs = {
        "a": {"project_id": "a", "language": "ru", "segments": [
            {"id": 0, "start": 0, "end": 1.5, "text": "ÐŸÑ€Ð¸Ð²ÐµÑ‚", "speaker": None, "words": [{"word": "hi", "start": 0, "end": 1}], "extra": {"x": [1]}},
            {"id": 1, "start": "soon", "end": 3.0, "text": "plain"}, {"id": 2, "start": 3, "end": 4, "text": None, "words": []}]},
        "a2": {"project_id": "a", "first": 3, "segments": [{"start": 4.0, "end": 5.0, "text": "later"}]},
        "b": {"project_id": "b", "segments": []}, "c": {"project_id": "c"}, "d": {"project_id": "d", "segments": {"start": 1}}, "e": {"segments": [{"text": ""}]},
    }
    for name, d in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, ensure_ascii=False, indent=1), encoding="utf-8")
    return str(tmp_path)


def test_segments_are_rows(spark, folder):
    scan = fl.scan_transcripts(spark, folder)
    assert scan.count() == 6
    got = {(r.project_id, r.pos): r for r in fl.segment_rows(scan).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("a", 3), (None, 0)}
    assert got["a", 0].words[0].word == "hi" and got["a", 1].start is None and got["a", 1].words is None and got["a", 2].text is None
    assert [got["a", i].changed for i in (1, 2, 3)] == [False] * 3
    raw = {(r.project_id, r.pos): r.text for r in fl.segment_rows(scan, repair=False).collect()}
    assert got["a", 0].changed == (raw["a", 0] != got["a", 0].text)
    docs = {r.project_id: r for r in fl.transcript_documents(fl.segment_rows(scan)).collect()}
    assert (docs["a"].segments, docs["a"].words, docs["a"].duration) == (4, 1, 5.0)


def test_a_long_recording_is_many_rows(spark, tmp_path):
    segs = [{"start": i, "end": i + 1, "text": f"s{i}"} for i in range(20_000)]
    (tmp_path / "x.json").write_text(json.dumps({"project_id": "x", "segments": segs}))
    d = fl.segment_rows(fl.scan_transcripts(spark, str(tmp_path)))
    assert d.count() == 20_000 and d.agg({"pos": "max"}).first()[0] == 19_999


def test_no_documents(spark, tmp_path):
    (tmp_path / "x.json").write_text("")
    assert fl.segment_rows(fl.scan_transcripts(spark, str(tmp_path))).count() == 0
