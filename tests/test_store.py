"""The store: durable puts, edits that are checked and committed whole, pruned reads, compaction."""

import os
import random
import signal
import subprocess
import sys
import zlib

import pytest

from siltstone.operators import wal
from siltstone.operators.compaction import CompactionOptions
from siltstone.operators.edits import EditRefused, ManifestCorrupt, State, Table, VersionEdit, decode, encode
from siltstone.store import LogCorrupt, Poisoned, Store

SMALL = CompactionOptions(max_levels=4, l0_trigger=2, level_limits=(400, 4000), target_sizes=(300, 300, 300, 300))


def items(store):
    return {bytes(r[0]): bytes(r[1]) for r in store.scan(b"", b"\xff").collect()}


def test_killed_process_loses_no_acknowledged_put(spark, tmp_path):
    """Another process puts and is killed without warning; what it acknowledged is there."""
    code = f"""
import os, sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
from siltstone.store import Store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
s = Store.open(spark, "file://{tmp_path}/s")
for i in range(40):
    s.put(b"k%d" % (i % 30), b"v%d" % i * 200)
s.remove(b"k5")
print("ACK", flush=True)
os.kill(os.getpid(), {int(signal.SIGKILL)})
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "ACK" in done.stdout and done.returncode == -signal.SIGKILL
    s = Store.open(spark, f"file://{tmp_path}/s")
    want = {b"k%d" % (i % 30): b"v%d" % i * 200 for i in range(40)}
    del want[b"k5"]
    assert items(s) == want and s.put(b"next", b"") == 42
    # Opened again without a flush: the log was rewritten, nothing is lost or doubled.
    again = Store.open(spark, f"file://{tmp_path}/s")
    assert items(again) == want | {b"next": b""} and again.get(b"k5") is None
    again.close()
    assert not list(tmp_path.glob("s/wal-*")) and items(Store.open(spark, f"file://{tmp_path}/s")) == want | {b"next": b""}


def logged(n=12):
    data = wal.file_header(7, 1)
    ends = []
    for i in range(n):
        data += wal.encode(b"key%d" % i, b"v" * (900 * i), i % 2, i + 1, len(data))
        ends.append(len(data))
    return data, ends


def test_log_bytes_round_trip_and_every_torn_tail():
    data, ends = logged()
    whole = wal.decode(data, 7)
    assert whole.corruption is None and whole.end == len(data)
    assert whole.records == [(b"key%d" % i, b"v" * (900 * i), i % 2, i + 1) for i in range(12)]
    for cut in (0, 5, 39, 40, *(e + d for e in ends[:-1] for d in (0, 1, 21, 23, 400))):
        got = wal.decode(data[:cut], 7)
        assert got.corruption is None and len(got.records) == sum(e <= cut for e in ends)


def test_log_damage_stops_the_reader():
    data, ends = logged()
    flip = lambda at: data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    for at in (ends[3] + 30, ends[3] + 2, ends[3] + 10):  # payload, checksum, sequence
        got = wal.decode(flip(at), 7)
        assert got.corruption == "bad_checksum" and len(got.records) == 4 and got.end == ends[3]
    assert wal.decode(flip(ends[3] + 8), 7).corruption in ("bad_fragment", "bad_checksum")
    assert wal.decode(flip(20), 7).corruption == wal.decode(data, 8).corruption == "bad_header"


def test_bytes_are_those_of_the_dataframe_operators(spark):
    data, _ = logged()
    rows = [(1, 7, i + 1, i % 2, bytearray(b"key%d" % i), bytearray(b"v" * (900 * i))) for i in range(12)]
    df = spark.createDataFrame(rows, "db_id bigint, wal_id bigint, seq_num bigint, type int, key_entry binary, value_entry binary")
    frags = wal.to_fragments(df, ["seq_num"]).collect()
    assert len(frags) > 12
    for f in frags:
        at, n = f["offset"], len(f["payload"])
        assert data[at + 22 : at + 22 + n] == bytes(f["payload"])
        assert int.from_bytes(data[at : at + 4], "little") == f["checksum"] == zlib.crc32(data[at + 4 : at + 22 + n])


def test_damaged_log_is_refused_on_open(spark, tmp_path):
    s = Store.open(spark, f"file://{tmp_path}/s")
    for i in range(5):
        s.put(b"k%d" % i, b"v" * 50)
    (log,) = tmp_path.glob("s/wal-*.log")
    data = bytearray(log.read_bytes())
    data[150] ^= 4
    log.write_bytes(data)
    with pytest.raises(LogCorrupt) as e:
        Store.open(spark, f"file://{tmp_path}/s")
    assert 0 < len(e.value.recovered.records) < 5


def table(no, level=1, lo="61", hi="66", seqs=(1, 2)):
    return Table(no, level, f"t{no}", lo, hi, *seqs, 1, 0, 10)


def test_edits_are_applied_deletes_first_and_refused_whole():
    one = VersionEdit((table(3, 0), table(8, 0), table(4), table(5, 1, "67", "7a")), next_seq=9).apply(State())
    assert (one.next_table_id, one.next_seq) == (9, 9)
    assert [t.table_id for t in one.level(0)] == [8, 3] and [t.table_id for t in one.level(1)] == [4, 5]
    moved = VersionEdit((table(9, 1, "61", "65"),), ((4, 1),)).apply(one)
    assert {t.table_id for t in moved.tables} == {3, 8, 5, 9} and {t.table_id for t in one.tables} == {3, 8, 4, 5}
    bad = {
        "reserved": VersionEdit((table(0),)), "no level": VersionEdit((table(20, 9),)), "begins after": VersionEdit((table(20, 2, "62", "61"),)),
        "begins  after": VersionEdit((table(20, 2, seqs=(3, 1)),)), "exists": VersionEdit((table(8, 2),)), "overlaps": VersionEdit((table(20, 1, "7a", "7b"),)),
        "not live": VersionEdit((), ((4, 2),)), "not  live": VersionEdit((), ((77, 0),)), "deleted twice": VersionEdit((), ((4, 1), (4, 1))),
        "goes back": VersionEdit(next_seq=8), "goes  back": VersionEdit(wal_id=0), "not above": VersionEdit((table(20, 3),), next_table_id=20),
    }
    for why, edit in bad.items():
        with pytest.raises(EditRefused, match=" ".join(why.split())):
            edit.apply(one)


def test_versions_round_trip_torn_and_damaged():
    edit = VersionEdit((table(3, 0),), (), wal_id=2)
    data = encode(5, edit, edit.apply(State()))
    assert decode(data) == (5, edit, edit.apply(State()))
    assert all(decode(data[:n]) is None for n in (0, 1, 40, len(data) - 2))
    with pytest.raises(ManifestCorrupt):
        decode(data.replace(b"wal_id", b"wal_ix", 1))
    with pytest.raises(ManifestCorrupt):
        decode(b"no numbers\n{}")


def test_recovery_skips_a_torn_version_and_refuses_a_damaged_one(spark, tmp_path):
    s = Store.open(spark, f"file://{tmp_path}/s")
    s.put(b"a", b"1")
    s.flush()
    (v,) = tmp_path.glob("s/version-*.json")
    whole = v.read_bytes()
    (tmp_path / "s/version-2.json").write_bytes(whole[:50])
    again = Store.open(spark, f"file://{tmp_path}/s")
    assert items(again) == {b"a": b"1"}
    again.put(b"b", b"2")
    again.flush()  # a new version beyond the torn one
    assert items(Store.open(spark, f"file://{tmp_path}/s")) == {b"a": b"1", b"b": b"2"}
    (tmp_path / "s/version-9.json").write_bytes(whole.replace(b"table_id", b"table_ix", 1))
    with pytest.raises(ManifestCorrupt):
        Store.open(spark, f"file://{tmp_path}/s")


def test_failed_publish_poisons_the_object(spark, tmp_path, monkeypatch):
    s = Store.open(spark, f"file://{tmp_path}/s")
    s.put(b"a", b"1")

    def broken(*_):
        raise OSError("disk")

    monkeypatch.setattr(s._folder, "publish_bytes", broken)
    with pytest.raises(Poisoned):
        s.flush()
    with pytest.raises(Poisoned):
        s.put(b"b", b"2")
    s.close()
    assert items(Store.open(spark, f"file://{tmp_path}/s")) == {b"a": b"1"}


def test_compaction_keeps_levels_in_order_and_removes_inputs(spark, tmp_path):
    rnd, want = random.Random(3), {}
    s = Store.open(spark, f"file://{tmp_path}/s", options=SMALL)
    for step in range(5):
        for _ in range(25):
            k = b"k%02d" % rnd.randrange(40)
            if rnd.random() < 0.25:
                s.remove(k)
                want.pop(k, None)
            else:
                s.put(k, b"v" * rnd.randrange(20))
                want[k] = None
        s.flush()
        while s.should_compact():
            assert s.compact()
        assert set(items(s)) == set(want)
    for n in (1, 2, 3):
        level = s._state.level(n)
        assert all(a.largest < b.smallest for a, b in zip(level, level[1:], strict=False))
    assert len({t.level for t in s.catalog()}) > 1 and max(t.file_size for t in s.catalog() if t.level) < 1200
    s.compact_range(b"k00", b"k05")
    assert set(items(s)) == set(want) and {t.level for t in s.catalog() if t.meets(b"k00".hex(), b"k05".hex())} <= {max(t.level for t in s.catalog())}
    s.compact_range()
    bottom = s.catalog()
    assert {t.level for t in bottom} == {max(t.level for t in bottom)} and sum(t.tombstone_count for t in bottom) == 0
    named = {t.folder.partition("/")[0] for t in bottom}
    assert named <= {p.name for p in tmp_path.glob("s/tables-*")} and len(list(tmp_path.glob("s/tables-*"))) <= len(named) + 8
    assert set(items(Store.open(spark, f"file://{tmp_path}/s", options=SMALL))) == set(want)


def test_point_reads_leave_out_tables(spark, tmp_path, monkeypatch):
    s = Store.open(spark, f"file://{tmp_path}/s")
    for k in (b"a", b"m", b"z"):
        s.put(k, k)
        s.flush()
    read = []
    records = s.records
    monkeypatch.setattr(s, "records", lambda tables=None: read.append([t.smallest for t in tables]) or records(tables))
    assert s.get(b"m") == b"m" and s.get(b"q") is None and read == [[b"m".hex()]]
    s.put(b"m", b"new")
    assert s.get(b"m") == b"new" and len(read) == 1  # memory has the newest


def test_iterator(spark, tmp_path):
    s = Store.open(spark, f"file://{tmp_path}/s")
    for i in range(12):
        s.put(b"k%02d" % i, b"%d" % i)
    s.flush()
    s.remove(b"k03")
    s.put(b"", b"empty")
    it, seen = s.iterator(), []
    while it.has_next():
        assert it.has_next()
        seen.append(it.next())
    assert seen == [(b"", b"empty"), *((b"k%02d" % i, b"%d" % i) for i in range(12) if i != 3)]
    with pytest.raises(StopIteration):
        it.next()
    assert [k for k, _ in s.iterator(b"k05", b"k08")] == [b"k05", b"k06", b"k07"]


def test_full_log_is_flushed_and_tables_open_by_number(spark, tmp_path):
    s = Store.open(spark, f"file://{tmp_path}/s", log_bytes=2000)
    for i in range(35):
        s.put(b"k%02d" % i, b"v" * 100)
    assert len(s.catalog()) == 2 and len(list(tmp_path.glob("s/wal-*.log"))) == 1
    first = min(t.table_id for t in s.catalog())
    assert 10 < s.table(first).count() < 20 and len(items(s)) == 35
    with pytest.raises(KeyError):
        s.table(99)
