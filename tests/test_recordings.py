import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.sources import recordings as rec
from mensura.sources.storage import open_input


class Counted:
    """Counts the bytes that are read from a file."""

    def __init__(self, file):
        self.file, self.bytes = file, 0

    def seek(self, at):
        self.file.seek(at)

    def read(self, size):
        data = self.file.read(size)
        self.bytes += len(data)
        return data


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("recordings"))
    rng = np.random.default_rng(3)
    data = {(f"u{f}", c): rng.integers(rec.LOWEST, rec.HIGHEST + 1, 16 * (5 + f)) for f in range(3) for c in ("Fz", "Cz", "Oz", "status")}
    data["u0", "Fz"][:3] = [rec.LOWEST, rec.HIGHEST, -1]
    rows = [(f, c, s, int(v)) for (f, c), x in data.items() for s, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "file string, channel string, sample bigint, value int")
    rec.write_recordings(frame.orderBy(F.rand(1)), folder, rate=16)
    return folder, data


def test_three_byte_values():
    values = np.array([0, 1, -1, 255, 256, -256, rec.LOWEST, rec.HIGHEST, 65536, -65537])
    assert rec.decode(rec.encode(values)).tolist() == values.tolist()
    assert rec.encode(np.array([-2])) == b"\xfe\xff\xff"
    with pytest.raises(ValueError, match="24 bits"):
        rec.encode(np.array([rec.HIGHEST + 1]))


@pytest.mark.parametrize("range_bytes", [1, 400, 1 << 20])
def test_read_back_equal(spark, written, range_bytes):
    folder, data = written
    rows = rec.read_recordings(spark, folder, range_bytes=range_bytes).collect()
    assert {(r.file, r.channel, r.sample): r.value for r in rows} == {(f, c, s): v for (f, c), x in data.items() for s, v in enumerate(x)}
    assert len(rows) == sum(map(len, data.values()))


def test_only_the_chosen_bytes_are_read(written):
    folder, data = written
    with open_input(f"{folder}/u1.bdf") as file:
        header = rec.read_header(file)
        assert (header.channels, header.samples, header.records) == (["Cz", "Fz", "Oz", "status"], [16] * 4, 6)
        counted = Counted(file)
        got = rec.read_records(counted, header, 2, 5, [0, 3])
        assert counted.bytes == 3 * 3 * 16 * 2  # three records of two channels
        assert got[0].tolist() == data["u1", "Cz"][32:80].tolist() and got[3].tolist() == data["u1", "status"][32:80].tolist()
        counted.bytes = 0
        rec.read_records(counted, header, 0, 6, [0, 1, 2, 3])
        assert counted.bytes == 6 * header.record_bytes


def test_windows_and_channels(spark, written):
    folder, data = written
    windows = spark.createDataFrame([("u0", 3, 40), ("u0", 30, 33), ("u2", 100, 10_000), ("nobody", 0, 5), ("u1", 500, 600)], "file string, window_start bigint, stop bigint")
    rows = rec.read_recordings(spark, folder, ["Oz", "Fz"], windows, range_bytes=100).collect()
    want = {(f, c, s, w): data[f, c][s] for f, w, stop in (("u0", 3, 40), ("u0", 30, 33), ("u2", 100, 112)) for c in ("Oz", "Fz") for s in range(w, stop)}
    assert {(r.file, r.channel, r.sample, r.window_start): r.value for r in rows} == want and len(rows) == len(want)
    with pytest.raises(Exception, match="lacks the channels"):
        rec.read_recordings(spark, folder, ["Pz"]).collect()


def test_physical_values(spark, written):
    folder, data = written
    rows = rec.read_recordings(spark, f"{folder}/u0.bdf", ["Fz"], physical=True).collect()
    got = np.array([r.value for r in sorted(rows, key=lambda r: r.sample)])
    assert got[:2].tolist() == [-262144.0, 262144.0]
    assert np.allclose(got, (data["u0", "Fz"] + 0.5) * 2 * 262144 / (2**24 - 1))


def test_gaps_and_other_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", s, s) for s in (0, 1, 3)], "file string, channel string, sample bigint, value int")
    with pytest.raises(Exception, match="gap"):
        rec.write_recordings(rows, str(tmp_path), rate=2)
    (tmp_path / "text.bdf").write_bytes(b"0" * 600)
    with pytest.raises(Exception, match="not a 24-bit recording"):
        rec.read_recordings(spark, str(tmp_path / "text.bdf")).collect()


def test_last_record_is_filled(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", s, s + 1) for s in range(5)], "file string, channel string, sample bigint, value int")
    rec.write_recordings(rows, str(tmp_path / "new"), rate=4)
    got = sorted((r.sample, r.value) for r in rec.read_recordings(spark, str(tmp_path / "new")).collect())
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (6, 0), (7, 0)]


@pytest.mark.parametrize("rows_a_batch", [1, 4, 10_000])
def test_records_are_written_as_arrays_and_windows_gathered(spark, tmp_path, monkeypatch, rows_a_batch):
    monkeypatch.setattr(rec, "HELD_SAMPLES", 10)
    data = {(f, c, k): [100.0 * k + s + len(c) for s in range(3 if k < 4 else 2)] for f in ("a", "b", "c") for c in ("x", "yy", "zzz") for k in range(5)}
    rows = spark.createDataFrame([(f, c, k, v) for (f, c, k), v in data.items()], "file string, channel string, record int, values array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        rec.write_records(rows.orderBy(F.rand(2)), str(tmp_path / "all"), rate=3)
        got = {(r.file, r.channel, r.sample): r.value for r in rec.read_recordings(spark, str(tmp_path / "all")).collect()}
        for wrong in (rows.filter("record <> 1 or file <> 'b'"), rows.filter("record <> 1 or file <> 'b' or channel <> 'yy'"),
                      rows.withColumn("values", F.expr("if(record = 2, slice(values, 1, 2), values)")), rows.withColumn("values", F.expr("if(record = 2, array(1, null, 2D), values)"))):
            with pytest.raises(Exception, match="gap|lacks a value"):
                rec.write_records(wrong, str(tmp_path / "wrong"), rate=3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(f, c, 3 * k + s): v for (f, c, k), values in data.items() for s, v in enumerate([*values, 0.0][:3])}
    assert got == want
