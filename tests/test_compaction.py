import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandlake.operators import compaction
from strandlake.operators.compaction import SnapshotConflict, compact, current_snapshot, part_files, read_store
from strandlake.session import scratch_path

SCHEMA = "file_id long, embeddingpath string, run_index long, ext string, size_bytes long, payload binary, modified_at timestamp_ntz, dir string"


def files(spark, rows):
    at = lambda m: None if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    return spark.createDataFrame([(i, d, r, e, n, p, at(m), "clash") for i, d, r, e, n, p, m in rows], SCHEMA)


ROWS = [
    (1, "a/b", 1, ".emb", 2, b"xx", 1),
    (2, "./a//b/", 1, ".emb", 2, b"yy", 2),
    (3, "a/b", 1, ".emb", 3, b"zz", 3),  # wrong length
    (4, "a/b", 2, ".part", 2, b"zz", 3),  # unfinished
    (5, "c", 1, ".emb", 2, b"cc", None),
    (6, "c", 1, ".emb", 2, b"cd", None),  # a tie: the greater file
    (7, None, None, ".emb", 1, b"n", 1),
    (8, "c", 3, ".emb", 0, b"", 1),
    (9, "c", 4, None, None, None, None),
]


def test_content_and_repeated_rows(spark):
    store = scratch_path(spark, "t")
    report = compact(spark, store, files(spark, ROWS + ROWS[:2]))
    assert report.parts_rewritten == 1 and report.files_after == 1
    got = {r.file_id: bytes(r.payload) for r in read_store(spark, store).collect()}
    assert got == {2: b"yy", 6: b"cd", 7: b"n"}
    assert current_snapshot(spark, store)["version"] == 1


def test_only_crowded_parts_are_rewritten(spark):
    store = scratch_path(spark, "t")
    rows = [(k, f"d{k % 7}", k, ".emb", 40, bytes(40), k) for k in range(200)]
    compact(spark, store, files(spark, rows), target_bytes=1000, small_bytes=100_000)
    before = {r.path for r in part_files(spark, store).collect()}
    assert len(before) > 4
    again = compact(spark, store, files(spark, [(900, "d1", 900, ".emb", 1, b"q", 1)]), small_bytes=100_000)
    after = {r.path for r in part_files(spark, store).collect()}
    assert again.parts_rewritten == 1 and len(before - after) == 1 and len(after) == len(before)
    assert read_store(spark, store).count() == 201
    third = compact(spark, store, small_bytes=100_000)
    assert third.parts_rewritten == 0 and third.version == again.version


def test_parts_below_the_limit_keep_their_small_files(spark):
    store = scratch_path(spark, "t")
    for k in range(3):
        compact(spark, store, files(spark, [(k, "a", 1, ".emb", 1, b"%d" % k, k)]), max_small_files=5)
    assert part_files(spark, store).count() == 3
    assert [r.file_id for r in read_store(spark, store).collect()] == [2]
    compact(spark, store, max_small_files=1)
    assert part_files(spark, store).count() == 1 and [r.file_id for r in read_store(spark, store).collect()] == [2]


def test_a_hot_directory_is_spread(spark):
    store = scratch_path(spark, "t")
    rows = [(k, "hot", k, ".emb", 40, bytes(40), k) for k in range(200)]
    compact(spark, store, files(spark, rows), target_bytes=2000)
    assert part_files(spark, store).select("part_id").distinct().count() > 2
    assert read_store(spark, store).select("run_index").distinct().count() == 200


def test_conflict(spark, monkeypatch):
    store = scratch_path(spark, "t")
    compact(spark, store, files(spark, ROWS))
    seen = compaction.current_snapshot(spark, store)
    compact(spark, store, files(spark, [(50, "a", 9, ".emb", 1, b"q", 1)]))
    real, calls = compaction.current_snapshot, []
    monkeypatch.setattr(compaction, "current_snapshot", lambda *a: calls.append(1) or (seen if len(calls) == 1 else real(*a)))
    with pytest.raises(SnapshotConflict):
        compact(spark, store, files(spark, [(51, "a", 10, ".emb", 1, b"q", 1)]))
    monkeypatch.undo()
    assert read_store(spark, store).where(F.col("file_id") == 50).count() == 1


def test_empty(spark):
    store = scratch_path(spark, "t")
    compact(spark, store, files(spark, []))
    assert read_store(spark, store).collect() == []


def good_records(*arrivals):
    """Of each record the copy modified last."""
    best = {}
    for rows in arrivals:
        for i, d, r, e, n, p, m in rows:
            if e == ".emb" and n and p is not None and len(p) == n:
                key = (None if d is None else "/".join(s for s in d.split("/") if s not in ("", ".")), r)
                best[key] = max(best.get(key, (-1, -1)), (-1 if m is None else m, i))
    return sorted(i for _, i in best.values())


def held(spark, store):
    return sorted(r.file_id for r in read_store(spark, store).select("file_id").collect())


def test_a_directory_that_outgrows_its_part(spark):
    """Small with the first arrival, large with the second: no record stays behind in the old part."""
    store = scratch_path(spark, "t")
    first = [(k, f"d{k % 4}", k, ".emb", 20, bytes(20), 1) for k in range(40)]
    second = [(100 + k, "d1", k, ".emb", 60, bytes(60), 2) for k in range(40)]
    compact(spark, store, files(spark, first), target_bytes=1000)
    assert part_files(spark, store).select("part_id").distinct().count() == 1
    report = compact(spark, store, files(spark, second), target_bytes=1000)
    assert report.parts_rewritten > 1 and part_files(spark, store).select("part_id").distinct().count() > 3
    assert held(spark, store) == good_records(first, second)
    third = [(200 + k, "d1", k, ".emb", 9, bytes(9), 3) for k in range(0, 40, 7)]
    compact(spark, store, files(spark, third), target_bytes=1000)
    assert held(spark, store) == good_records(first, second, third)


def test_a_store_that_grows(spark):
    """Many directories that stay small: parts are filled one after the other, and overfull ones are split."""
    store, arrivals = scratch_path(spark, "t"), []
    for step in range(4):
        arrivals.append([(1000 * step + k, f"d{k % (5 + 9 * step)}", k * (step + 1), ".emb", 30, bytes(30), step) for k in range(60 * (step + 1))])
        compact(spark, store, files(spark, arrivals[-1]), target_bytes=1500)
        assert held(spark, store) == good_records(*arrivals)
    sizes = read_store(spark, store).groupBy().sum("size_bytes").first()[0]
    parts = part_files(spark, store).select("part_id").distinct().count()
    assert sizes / 1500 / 2 < parts < 4 * sizes / 1500


def test_readers_keep_their_snapshot_and_vacuum(spark):
    store = scratch_path(spark, "t")
    compact(spark, store, files(spark, ROWS))
    reader = read_store(spark, store)
    compact(spark, store, files(spark, [(60, "c", 1, ".emb", 1, b"n", 9)]))
    assert sorted(r.file_id for r in reader.collect()) == [2, 6, 7] and held(spark, store) == [2, 7, 60]
    assert compaction.vacuum(spark, store, keep=2, least_age_seconds=0) == 0
    assert compaction.vacuum(spark, store, keep=1, least_age_seconds=0) == 1
    assert held(spark, store) == [2, 7, 60]


def test_a_writer_that_died_blocks_nobody(spark, monkeypatch):
    store = scratch_path(spark, "t")
    compact(spark, store, files(spark, ROWS))
    fs, path = compaction._fs(spark, f"{store}/snapshots/v00000002.json")
    fs.create(path, False).close()
    assert current_snapshot(spark, store)["version"] == 1
    more = files(spark, [(61, "c", 1, ".emb", 1, b"n", 9)])
    with pytest.raises(SnapshotConflict):
        compact(spark, store, more)
    monkeypatch.setattr(compaction, "CLAIM_SECONDS", -60)
    assert compact(spark, store, more).version == 2 and held(spark, store) == [2, 7, 61]


def test_files_that_vanish_are_noticed(spark, monkeypatch):
    store = scratch_path(spark, "t")
    compact(spark, store, files(spark, ROWS))
    monkeypatch.setattr(compaction, "_listed", lambda *a, real=compaction._listed: real(*a) if len(a) > 2 else real(*a).limit(0))
    with pytest.raises(SnapshotConflict):
        compact(spark, store, files(spark, [(62, "c", 1, ".emb", 1, b"n", 9)]))
