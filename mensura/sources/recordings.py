"""Recordings with interleaved 24-bit channels (the public BDF layout): a scan by byte ranges and a sink.

A file is a header and equal records; a record holds a stretch of every channel,
one after the other.  The scan turns headers into record ranges, Spark deals the
ranges to tasks, and a task reads the bytes of the wanted channels only.  Windows
are matched with ranges before a byte is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mensura.sources.storage import listed, new_file, open_input

#: bytes of wanted channels that a task reads at once
RANGE_BYTES = 8 << 20
#: samples of windows that a task gathers before it hands them on
HELD_SAMPLES = 1 << 16
#: Field widths of the file header and of its channel part.
FILE_FIELDS = {"version": 8, "subject": 80, "recording": 80, "date": 8, "time": 8, "header_bytes": 8, "reserved": 44, "records": 8, "seconds": 8, "channels": 4}
CHANNEL_FIELDS = {"label": 16, "transducer": 80, "unit": 8, "physical_min": 8, "physical_max": 8, "digital_min": 8, "digital_max": 8, "filter": 80, "samples": 8, "reserved": 32}
VERSION = b"\xffBIOSEMI"
LOWEST, HIGHEST = -(1 << 23), (1 << 23) - 1


@dataclass
class Header:
    channels: list[str]
    samples: list[int]  # per record
    header_bytes: int
    records: int
    seconds: float
    scale: list[float]
    offset: list[float]

    @property
    def record_bytes(self) -> int:
        return 3 * sum(self.samples)


def read_header(file) -> Header:
    file.seek(0)
    head = file.read(256)
    if head[:8] != VERSION:
        raise ValueError("not a 24-bit recording")
    at, fields = 0, {}
    for name, width in FILE_FIELDS.items():
        fields[name] = head[at : at + width]
        at += width
    n = int(fields["channels"])
    rest, at, columns = file.read(256 * n), 0, {}
    for name, width in CHANNEL_FIELDS.items():
        columns[name] = [rest[at + i * width : at + (i + 1) * width].decode("ascii", "replace").strip() for i in range(n)]
        at += n * width
    number = lambda name: [float(v) for v in columns[name]]
    scale = [(b - a) / (d - c) for a, b, c, d in zip(*map(number, ("physical_min", "physical_max", "digital_min", "digital_max")))]
    offset = [a - c * s for a, c, s in zip(number("physical_min"), number("digital_min"), scale)]
    return Header(columns["label"], [int(v) for v in columns["samples"]], int(fields["header_bytes"]), int(fields["records"]), float(fields["seconds"]), scale, offset)


def decode(data: bytes) -> np.ndarray:
    """Signed values of little-endian three-byte groups."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
    value = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
    return value - ((value & 0x800000) << 1)


def encode(values: np.ndarray) -> bytes:
    if len(values) and (values.min() < LOWEST or values.max() > HIGHEST):
        raise ValueError("a value does not fit in 24 bits")
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def read_records(file, header: Header, first: int, last: int, wanted: list[int]) -> dict[int, np.ndarray]:
    """Values of the channels ``wanted`` in the records ``first`` to ``last`` - 1; neighbours are read together."""
    starts = np.concatenate([[0], np.cumsum(header.samples)]) * 3
    runs: list[list[int]] = []
    for c in sorted(wanted):
        if runs and runs[-1][-1] == c - 1:
            runs[-1].append(c)
        else:
            runs.append([c])
    parts: dict[int, list[bytes]] = {c: [] for c in wanted}
    whole = len(runs) == 1 and len(runs[0]) == len(header.samples)
    for record in [first] if whole else range(first, last):
        for run in runs:
            size = header.record_bytes * (last - first) if whole else int(starts[run[-1] + 1] - starts[run[0]])
            file.seek(header.header_bytes + record * header.record_bytes + int(starts[run[0]]))
            data = file.read(size)
            if len(data) < size:
                raise ValueError("the recording is shorter than its header says")
            for base in range(0, size, header.record_bytes if whole else size):
                for c in run:
                    low = base + int(starts[c] - starts[run[0]])
                    parts[c].append(data[low : low + 3 * header.samples[c]])
    return {c: decode(b"".join(held)) for c, held in parts.items()}


def _wanted(header: Header, channels: list[str] | None, path: str) -> list[int]:
    if channels is None:
        return list(range(len(header.channels)))
    lacking = sorted(set(channels) - set(header.channels))
    if lacking:
        raise ValueError(f"{path} lacks the channels {lacking}")
    return [i for i, c in enumerate(header.channels) if c in set(channels)]


def recording_ranges(spark: SparkSession, paths: str | list[str], channels: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path``, ``file``, record range ``first`` to ``last`` - 1 and ``rate`` (samples of a channel in a record)."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                with open_input(path) as file:
                    header = read_header(file)
                wanted = _wanted(header, channels, path)
                rates = {header.samples[c] for c in wanted}
                if len(rates) != 1:
                    raise ValueError(f"the chosen channels of {path} have different rates: choose those of one rate")
                each = max(1, range_bytes // (3 * sum(header.samples[c] for c in wanted)))
                name = path.rpartition("/")[2].rpartition(".")[0]
                rows += [(path, name, r, min(header.records, r + each), *rates) for r in range(0, header.records, each)]
            names = ["path", "file", "first", "last", "rate"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return listed(spark, paths).select("path").mapInArrow(ranges, "path string, file string, first bigint, last bigint, rate bigint")


def read_recordings(
    spark: SparkSession, paths: str | list[str], channels: list[str] | None = None, windows: DataFrame | None = None,
    range_bytes: int = RANGE_BYTES, physical: bool = False,
) -> DataFrame:
    """``file``, ``channel``, ``sample``, ``value`` of recordings, and ``window_start`` with ``windows``.

    ``windows`` has ``file``, ``window_start`` and ``stop`` (samples, half open):
    only records that a window touches are read, and overlapping windows repeat
    their samples.  Values are digital unless ``physical``.
    """
    ranges = recording_ranges(spark, paths, channels, range_bytes)
    low, high = F.col("first") * F.col("rate"), F.col("last") * F.col("rate")
    if windows is None:
        planned = ranges.withColumn("window_start", low).withColumn("stop", high)
    else:
        inside = (F.col("window_start") < high) & (F.col("stop") > low)
        planned = ranges.join(windows.select("file", "window_start", "stop"), "file").filter(inside)
    planned = planned.select("path", "file", "first", "last", "rate", "window_start", "stop").repartition("path", "first")
    kind = pa.float64() if physical else pa.int32()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, object, Header, list[int]] | None = None
        parts: list[tuple[str, str, int, np.ndarray, int]] = []  # file, channel, first sample, values, window

        def handed_on() -> pa.RecordBatch:
            sizes = np.array([len(p[3]) for p in parts])
            repeated = lambda i, kind: pa.array([p[i] for p in parts], kind).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out = pa.RecordBatch.from_arrays([
                repeated(0, pa.string()), repeated(1, pa.string()), pa.array(np.repeat([p[2] for p in parts], sizes) + within),
                pa.array(np.concatenate([p[3] for p in parts]), kind), repeated(4, pa.int64()),
            ], names=["file", "channel", "sample", "value", "window_start"])
            parts.clear()
            return out

        waiting = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held[0] != row["path"]:
                    if held:
                        held[1].close()
                    file = open_input(row["path"])
                    header = read_header(file)
                    held = row["path"], file, header, _wanted(header, channels, row["path"])
                _, file, header, wanted = held
                rate = row["rate"]
                start, stop = max(row["window_start"], row["first"] * rate), min(row["stop"], row["last"] * rate)
                first, last = start // rate, -(-stop // rate)
                for c, values in read_records(file, header, first, last, wanted).items():
                    values = values[start - first * rate : stop - first * rate]
                    if physical:
                        values = values * header.scale[c] + header.offset[c]
                    parts.append((row["file"], header.channels[c], start, values, row["window_start"]))
                    waiting += len(values)
                if waiting >= HELD_SAMPLES:
                    yield handed_on()
                    waiting = 0
        if parts:
            yield handed_on()
        if held:
            held[1].close()

    found = planned.mapInArrow(scan, f"file string, channel string, sample bigint, value {'double' if physical else 'int'}, window_start bigint")
    return found.drop("window_start") if windows is None else found


def _header_bytes(channels: list[str], rate: int, records: int, seconds: float, limit: float) -> bytes:
    text = lambda value, width: f"{value:<{width}}"[:width].encode("ascii", "replace")
    size = 256 * (len(channels) + 1)
    values = {"header_bytes": size, "reserved": "24BIT", "records": records, "seconds": f"{seconds:g}", "channels": len(channels)}
    head = VERSION + b"".join(text(values.get(k, ""), w) for k, w in list(FILE_FIELDS.items())[1:])
    one = {"physical_min": f"{-limit:g}", "physical_max": f"{limit:g}", "digital_min": LOWEST, "digital_max": HIGHEST, "samples": rate}
    return head + b"".join(text(c if k == "label" else one.get(k, ""), w) for k, w in CHANNEL_FIELDS.items() for c in channels)


def write_recordings(rows: DataFrame, folder: str, rate: int, seconds: float = 1.0, limit: float = 262144.0) -> None:
    """One file per ``file`` from ``file``, ``channel``, ``sample``, ``value``; samples count from 0 without gaps.

    A record's samples of a channel are brought together first; the last record
    is filled with zeros.
    """
    record = F.floor(F.col("sample") / rate).cast("bigint")
    parts = rows.groupBy("file", "channel", record.alias("record")).agg(
        F.sort_array(F.collect_list(F.struct("sample", F.col("value").cast("bigint").alias("value")))).alias("held"))
    gapless = F.forall(
        F.transform("held", lambda h, i: h["sample"] == F.col("record") * rate + i), lambda ok: F.coalesce(ok, F.lit(False)))
    # a gap leaves the part empty, which no record is
    write_records(parts.select("file", "channel", "record", F.when(gapless, F.col("held.value")).otherwise(F.array().cast("array<bigint>")).alias("values")),
                  folder, rate, seconds, limit)


def write_records(records: DataFrame, folder: str, rate: int, seconds: float = 1.0, limit: float = 262144.0) -> None:
    """One file per ``file`` from ``file``, ``channel``, ``record``, ``values``; records count from 0 without gaps.

    Only the last record may be short of ``rate`` values; it is filled with
    zeros.  A task writes the records it has at a time, never a whole file.
    """
    whole = Window.partitionBy("file")
    # the window needs no further sort, since files are together already
    ordered = records.filter("file is not null").select(
        "file", "record", "channel", F.transform("values", lambda v: v.cast("bigint")).alias("values")
    ).repartition("file").sortWithinPartitions("file", "record", "channel").select(
        "*", (F.max("record").over(whole) + 1).alias("records"), F.size(F.collect_set("channel").over(whole)).alias("n_channels"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, stream, context, names, due, open_file = [], None, None, [], 0, None
        left: list[pa.RecordBatch] = []  # the parts of a record that is not yet complete

        def put(table: pa.Table) -> None:
            """Write rows of whole records of one file."""
            nonlocal stream, context, names, due, open_file
            file, n_records, n_channels = (table.column(c)[0].as_py() for c in ("file", "records", "n_channels"))
            if file != open_file:
                if context is not None:
                    context.__exit__(None, None, None)
                context = new_file(f"{folder}/{file}.bdf")
                stream, due, open_file = context.__enter__(), 0, file
                names = table.column("channel")[:n_channels].to_pylist()
                stream.write(_header_bytes(names, rate, n_records, seconds, limit))
                made.append(file)
            record = table.column("record").to_numpy()
            if (record != due + np.arange(len(record)) // n_channels).any() or table.column("channel").to_pylist() != names * (len(record) // n_channels):
                raise ValueError(f"recording {file} has a gap at record {due}")
            lists = table.column("values").combine_chunks()
            if lists.null_count or lists.flatten().null_count:
                raise ValueError(f"recording {file} lacks a value")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            if (sizes != rate).any():
                wrong = (sizes < 1) | (sizes > rate) | (sizes < rate) & (record < n_records - 1)
                if wrong.any():
                    raise ValueError(f"recording {file} has a gap in record {record[wrong][0]} of {names[int(np.argmax(wrong)) % n_channels]}")
                filled = np.zeros((len(sizes), rate), dtype=np.int64)
                filled[np.arange(rate)[None, :] < sizes[:, None]] = values
                values = filled.ravel()
            stream.write(encode(values))
            due += len(record) // n_channels

        def files(table: pa.Table) -> None:
            code = table.column("file").combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for low, high in zip(cuts, cuts[1:]):
                put(table.slice(low, high - low))

        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            record = batch.column("record").to_numpy(zero_copy_only=False)
            # the batch's last record may go on in the next one
            ends = np.flatnonzero((code[1:] != code[:-1]) | (record[1:] != record[:-1])) + 1
            same = not left or left[-1].column("file")[-1].as_py() == batch.column("file")[0].as_py() and left[-1].column("record")[-1].as_py() == record[0]
            if not same or len(ends):
                cut = int(ends[-1]) if len(ends) else 0
                head = [*left, batch.slice(0, cut)] if cut else left
                files(pa.Table.from_batches(head))
                left = []
                batch = batch.slice(cut)
            left.append(batch)
        if left:
            files(pa.Table.from_batches(left))
        if context is not None:
            context.__exit__(None, None, None)
        yield pa.RecordBatch.from_pydict({"file": pa.array(made, pa.string())})

    ordered.mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()
