"""Merged batch folders: bounded reads, repeated batches, and merges that stop half-way."""

import pytest

from tidemark.streaming import folders as B


@pytest.fixture
def log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FAN", 3)
    return B.BatchFolders(spark, str(tmp_path / "log"), "id long, ok int", partition_by=("ok",))


def put(log, batch):
    log.write(log.spark.range(batch * 10, batch * 10 + 10).selectExpr("id", "int(id % 2) AS ok"), batch)
    log.add(batch)


def ids(log):
    return sorted(r["id"] for r in log.read().collect())


def test_reads_touch_few_folders(log, tmp_path):
    for batch in range(14):
        put(log, batch)
    live = [r for r in log.manifest()[1] if r[3]]
    # 9 + 3 + 1 + 1 batches
    assert [(r[0], r[1], r[2]) for r in live] == [(0, 12, 12), (0, 13, 13), (1, 9, 11), (2, 0, 8)]
    assert ids(log) == list(range(140))
    put(log, 14)  # folders that went out of use are deleted one commit later
    assert len(list((tmp_path / "log" / "rows").iterdir())) <= 8


def test_number_of_folders_after_many_batches():
    """The manifest alone, over 1,000 batches."""
    kept, written = [], []
    log = B.BatchFolders(None, "r", "id long", merge=lambda rows: rows)
    log.manifest = lambda: (len(written), list(kept))
    log._delete = lambda path: None
    log._rows = lambda paths: paths
    log.write = lambda rows, first, last=None: written.append(len(rows))
    log._commit = lambda version, rows: kept.__setitem__(slice(None), rows)
    for batch in range(1000):
        log.add(batch)
    assert sum(r[3] for r in kept) <= (B.FAN - 1) * 4 and max(written) == B.FAN


def test_repeated_batches_change_nothing(log):
    for batch in range(4):
        put(log, batch)
    put(log, 3)
    put(log, 1)  # merged since
    assert ids(log) == list(range(40))


def test_a_merge_that_stops_loses_nothing(log, monkeypatch):
    for batch in range(2):
        put(log, batch)
    commit = log._commit

    def stop(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(log, "_commit", stop)
    with pytest.raises(RuntimeError):
        put(log, 2)
    assert ids(log) == list(range(20))
    monkeypatch.setattr(log, "_commit", commit)
    put(log, 2)
    assert ids(log) == list(range(30)) and [r[:3] for r in log.manifest()[1] if r[3]] == [(1, 0, 2)]
