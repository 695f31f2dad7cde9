"""Scans with declared schemas, multi-file loads with identity checks, protocols."""

from __future__ import annotations

import csv
import ctypes
import ctypes.util
import hashlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from mensura.operators.guards import nan_to_null
from mensura.session import cut_lineage, scratch
from mensura.sources.storage import listed


#: threads that look into files for their first line
HEADER_READERS = 16
#: files that the driver looks into or names one by one; of more, tasks find the first lines
HEADER_FILES = 256
#: tasks for each core that do so
HEADER_TASKS = 4


def _first_line(spark: SparkSession, path: str) -> str:
    """First line of a file in any storage that Spark reads, compressed or not; only its first buffer is fetched."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        opened = codec.createInputStream(stream) if codec else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(opened, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def _column_names(line: str, sep: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep), []))


def headers(spark: SparkSession, files: list[str], sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Files by the column names of their first line; empty files are left out."""
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        lines = pool.map(lambda f: _first_line(spark, f), files)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, line in sorted(zip(files, lines)):
        names = _column_names(line, sep)
        if names:
            layouts.setdefault(names, []).append(file)
    return layouts


def _heads(lines: DataFrame) -> DataFrame:
    """``path`` and first line, ``head``, of the files of a text scan, found by tasks; files without a byte have none."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # a task reads the start of a file in one go
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("path"))
            starts = np.concatenate([[0], runs.run_ends.to_numpy()[:-1]])
            names = runs.values
            if names[0].as_py() == before:
                starts = starts[1:]
            before = names[-1].as_py()
            yield batch.take(pa.array(starts, pa.int64()))

    starting = lines.filter(F.col("_metadata.file_block_start") == 0).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("head"))
    # Spark deals few files to a task; so many tasks of Python would take longer than the files
    few = HEADER_TASKS * lines.sparkSession.sparkContext.defaultParallelism
    return starting.coalesce(few).mapInArrow(firsts, "path string, head string")


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",", optional: Iterable[str] = (),
    unit_pattern: str | None = None, nested: bool = False,
) -> DataFrame:
    """Delimited text, columns found by the header of each file; NaN and empty cells become null.

    Files may have the declared columns in any order, and others, which are not
    parsed.  A declared column that a file lacks is an error that names the
    file, unless it is ``optional``: then it is null there.  Files of one layout
    form one scan, in which Spark compares every file's header with the layout
    again.  Beyond ``HEADER_FILES`` files the tasks of a text scan find the
    headers and no list of files passes through the driver: if there is one
    layout, one scan covers ``path``, otherwise a layout of many files is one
    scan joined with its files.  With ``nested`` the files of all folders below
    are read and no folder's name is parsed, which takes Spark long for many
    folders.  ``unit_pattern`` adds ``file_unit``, its first group in the file's path.
    """
    wanted = spark.createDataFrame([], schema).schema
    types = {f.name: f.dataType for f in wanted}
    extra = T.StructType([T.StructField("file_unit", T.StringType())] if unit_pattern else [])
    lines = spark.read.option("recursiveFileLookup", nested).text(path)
    folders = nested or len(lines.columns) > 1  # the names of partition folders are no columns of the files

    def scan(names: tuple[str, ...], files: str | list[str], by_place: bool = False) -> DataFrame:
        found = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        reader = spark.read.schema(found).option("header", True).option("sep", sep).option("enforceSchema", by_place)
        return reader.option("recursiveFileLookup", folders and files is path).csv(files)

    def checked(names: tuple[str, ...], file: str) -> None:
        twice = sorted({n for n in names if [x.lower() for x in names].count(n.lower()) > 1})
        lacking = sorted(set(types) - set(names) - set(optional))
        if twice or lacking:
            what = f"repeats the columns {twice}" if twice else f"lacks the columns {lacking}"
            raise ValueError(f"the header of {file} {what}")

    frames: list[tuple[tuple[str, ...], DataFrame]] = []
    listing = lines._jdf.inputFiles()
    if len(listing) <= HEADER_FILES:
        for names, files in headers(spark, list(listing), sep).items():
            checked(names, files[0])
            frames.append((names, scan(names, files)))
    else:
        heads = _heads(lines)
        layouts: dict[tuple[str, ...], list] = {}
        for r in heads.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("file")).orderBy("file").collect():
            layouts.setdefault(_column_names(r["head"], sep), []).append(r)
        for names, found in layouts.items():
            if not names:
                continue
            checked(names, found[0]["file"])
            those = heads.filter(F.col("head").isin([r["head"] for r in found])).select(F.col("path").alias("_path"))
            if len(layouts) == 1:
                frames.append((names, scan(names, path)))
            elif sum(r["n"] for r in found) <= HEADER_FILES:
                frames.append((names, scan(names, [unquote(r[0]) for r in those.collect()])))
            else:  # all files are read by place, and those of other layouts left out
                every = scan(names, path, by_place=True).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata"))
                frames.append((names, every.join(those, "_path", "left_semi")))
    parts = []
    for names, frame in frames:
        columns = [(F.col(f"`{n}`") if n in names else F.lit(None).cast(t)).alias(n) for n, t in types.items()]
        if unit_pattern:
            columns.append(F.regexp_extract(F.col("_metadata.file_path"), unit_pattern, 1).alias("file_unit"))
        parts.append(frame.select(*columns))
    if not parts:
        return spark.createDataFrame([], T.StructType([*wanted.fields, *extra.fields]))
    return nan_to_null(reduce(DataFrame.unionByName, parts))


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_participants(spark: SparkSession, path: str, schema: T.StructType | str | None, key: str, cohort: list) -> DataFrame:
    """Participant sheet (parquet when no schema is given) restricted to a cohort."""
    frame = spark.read.parquet(path) if schema is None else read_csv(spark, path, schema)
    return frame.filter(F.col(key).isin(cohort))


def read_protocol(spark: SparkSession, path: str, frozen_status: str) -> dict:
    """A nested JSON protocol as a dict; refused unless its status is the frozen one."""
    row = spark.read.option("multiLine", True).json(path).first()
    protocol = row.asDict(recursive=True)
    if protocol.get("status") != frozen_status:
        raise ValueError(f"protocol status is {protocol.get('status')!r}, expected {frozen_status!r}")
    return protocol


def read_unit_tables(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | str, unit_pattern: str
) -> DataFrame:
    """Per-unit files, in folders of any depth, in one scan; ``file_unit`` is taken from the file path."""
    return read_csv(spark, paths, schema, unit_pattern=unit_pattern, nested=True)


def unit_table_violations(
    tables: DataFrame, unit: str, condition: str, conditions: list[str], expected: DataFrame
) -> DataFrame:
    """Files whose unit id or condition set is wrong, and expected units without a file.

    A null id is a wrong id, and so is a file without any; a null condition is
    none of the expected.
    """
    known = F.col(condition).isin(conditions)
    rows = tables.select(
        "file_unit", F.coalesce(F.col(unit).cast("string") == F.col("file_unit"), F.lit(False)).alias("own"),
        F.coalesce(known, F.lit(False)).alias("known"),
        *[F.coalesce(F.col(condition) == F.lit(c), F.lit(False)).alias(f"has{i}") for i, c in enumerate(conditions)],
    )
    wanted = expected.select(F.col(unit).cast("string").alias("file_unit"), F.lit(1).alias("expected"))
    # files and expected units meet in one aggregate, so the files are read once
    units = rows.unionByName(wanted, allowMissingColumns=True).groupBy("file_unit").agg(
        F.min("own").alias("own"), F.min("known").alias("known"),
        *[F.max(f"has{i}").alias(f"has{i}") for i in range(len(conditions))], F.sum("expected").cast("int").alias("expected"),
    )
    complete = F.col("known")
    for i in range(len(conditions)):
        complete = complete & F.col(f"has{i}")
    wrong = F.array_compact(F.array(F.when(~F.col("own"), F.lit("unit_mismatch")), F.when(~complete, F.lit("condition_mismatch"))))
    rules = F.when(F.col("own").isNull(), F.array_repeat(F.lit("missing"), F.col("expected"))).otherwise(wrong)
    return units.select("file_unit", F.explode(rules).alias("rule"))


def read_edges(spark: SparkSession, path: str, a: str = "channel_a", b: str = "channel_b") -> DataFrame:
    """Undirected edge list as both directions (a, b)."""
    from mensura.operators.graph import both_directions

    frame = read_csv(spark, path, f"{a} string, {b} string, distance double", optional=["distance"])
    return both_directions(frame, a, b)


def missing_inputs(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected table keys that are not present."""
    return expected.select(*keys).join(present.select(*keys), keys, "left_anti")


def even_windows(n_samples: str | Column, width: int, n_windows: int) -> Column:
    """Evenly spaced window starts from 0 to the last possible start, as an array."""
    total = F.col(n_samples) if isinstance(n_samples, str) else n_samples
    latest = F.greatest(F.lit(0), total - width)
    steps = F.sequence(F.lit(0), F.lit(n_windows - 1))
    starts = F.transform(steps, lambda i: F.floor(latest * i / F.lit(n_windows - 1)).cast("bigint"))
    return F.array_distinct(starts)


#: endings at which Spark's text scan gives the unpacked content
UNPACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw bytes of files between line feeds, in ranges as Spark splits files: ``path``, ``length``, ``start``, ``at``, ``piece``."""
    read = spark.read.option("lineSep", "\n").text(paths)
    packed = [f for f in read.inputFiles() if f.endswith(UNPACKED)]
    if packed:
        raise ValueError(f"Spark unpacks {packed[0]} while it reads; its own bytes cannot be fingerprinted")
    return read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("piece"),
    )


def _with_empty(spark: SparkSession, paths: str | list[str], digests: DataFrame, **empty: str) -> DataFrame:
    """All files below ``paths``, also those without a byte, which scans leave out."""
    files = spark.read.text(paths).inputFiles()
    listed = spark.createDataFrame([(f,) for f in files], "path string")
    name = lambda c: F.regexp_replace(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///")
    found = digests.withColumn("_path", name(F.col("path"))).drop("path")
    joined = listed.join(found, name(F.col("path")) == F.col("_path"), "left").drop("_path")
    return joined.select("path", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in empty.items()])


#: bytes of a file that one task hashes
STEP_BYTES = 256 << 20


class _Sha256:
    """SHA-256 whose state can be handed to another task, by the functions of OpenSSL's library."""

    def __init__(self, state: bytes | None = None):
        self.lib = ctypes.CDLL(ctypes.util.find_library("crypto"))
        self.held = ctypes.create_string_buffer(state or bytes(256), 256)  # its context has 112 bytes
        if state is None:
            self.lib.SHA256_Init(self.held)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.held, data, ctypes.c_size_t(len(data)))

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.held.raw, 256))
        return out.raw.hex()


def fingerprints(spark: SparkSession, paths: str | list[str], step_bytes: int = STEP_BYTES) -> DataFrame:
    """SHA-256 of each input file, streamed: ``path``, ``length``, ``sha256``.

    The pieces between line feeds are brought into file order by a sort that may
    spill, and a task feeds them to the hash, so no file is ever in memory.  The
    hash is sequential within a file.  Files of more than ``step_bytes`` are
    written out by steps, and the state of the hash goes from the task of one
    step to that of the next, so no task reads a large file whole, but the time
    still grows with the largest file; ``range_fingerprints`` works on all
    ranges at once.
    """
    kind = "path string, length bigint, state binary, fed bigint, sha256 string"

    def hashed(pieces: DataFrame, before: dict[str, tuple[bytes, int]]) -> DataFrame:
        """State and digest of each file after ``pieces``, from the states ``before``."""

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None  # path, length, hash, bytes so far

            def closed():
                path, length, digest, fed = now
                state = digest.held.raw
                if fed < length:  # a file that is at its end ends in a line feed
                    digest.update(b"\n")
                return pa.RecordBatch.from_pydict({"path": [path], "length": [length], "state": [state], "fed": [fed], "sha256": [digest.hexdigest()]})

            for batch in batches:
                names, lengths, parts = (batch.column(c).to_pylist() for c in ("path", "length", "piece"))
                low = 0
                while low < len(names):
                    high = low + 1
                    while high < len(names) and names[high] == names[low]:
                        high += 1
                    if now is None or now[0] != names[low]:
                        if now is not None:
                            yield closed()
                        known = before.get(names[low])
                        now = [names[low], lengths[low], _Sha256(known and known[0]), known[1] if known else -1]
                    data = b"\n".join(parts[low:high])
                    if now[3] >= 0:
                        data = b"\n" + data
                    now[2].update(data)
                    now[3] = max(0, now[3]) + len(data)
                    low = high
            if now is not None:
                yield closed()

        ordered = pieces.repartition("path").sortWithinPartitions("path", "start", "at").select("path", "length", "piece")
        return ordered.mapInArrow(stream, kind)

    pieces = _pieces(spark, paths)
    largest = listed(spark, paths).agg(F.max("length")).first()[0] or 0
    if largest <= step_bytes:
        found = hashed(pieces, {})
    else:
        folder = scratch(spark)
        pieces.withColumn("step", F.floor(F.col("start") / step_bytes).cast("int")).write.partitionBy("step").parquet(folder)
        written = spark.read.parquet(folder)
        states: dict[str, tuple] = {}  # a row per file
        for step in sorted(r[0] for r in written.select("step").distinct().collect()):
            known = {path: (bytes(r["state"]), r["fed"]) for path, r in states.items()}
            for r in hashed(written.filter(F.col("step") == step), known).collect():
                states[r["path"]] = r
        found = spark.createDataFrame([tuple(r) for r in states.values()], kind)
    return _with_empty(spark, paths, found.select("path", "length", "sha256"), sha256=hashlib.sha256(b"").hexdigest())


#: pieces under one leaf of a range fingerprint
LEAF_PIECES = 4096


def range_fingerprints(spark: SparkSession, paths: str | list[str], leaf_pieces: int = LEAF_PIECES) -> DataFrame:
    """Hash tree over the ranges of each file: ``path``, ``length``, ``tree_sha256``.

    Pieces are numbered through the file from the counts of the ranges before
    theirs; ``leaf_pieces`` of them form a leaf, whose SHA-256 covers them in
    order, and the leaves' digests are combined in the same way until one is
    left.  How Spark split the file leaves no trace in the result.
    """
    pieces = cut_lineage(_pieces(spark, paths).withColumn("d", F.unhex(F.sha2("piece", 256))).drop("piece"))
    ranges = pieces.groupBy("path", "start").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_first"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # a range lies in one task, where ``at`` is consecutive
    level = cut_lineage(pieces.join(ranges, ["path", "start"]).select(
        "path", "length", (F.col("_before") + F.col("at") - F.col("_first")).alias("i"), "d"
    ))
    roots = None
    while True:
        leaf = F.floor(F.col("i") / leaf_pieces).cast("bigint")
        joined = F.aggregate(F.sort_array(F.collect_list(F.struct("i", "d"))), F.lit(b""), lambda s, x: F.concat(s, x["d"]))
        level = cut_lineage(level.groupBy("path", "length", leaf.alias("i")).agg(F.unhex(F.sha2(joined, 256)).alias("d")))
        taller = level.filter("i > 0").select("path").distinct()
        done = level.join(taller, "path", "left_anti")
        roots = done if roots is None else roots.unionByName(done)
        if taller.isEmpty():
            break
        level = level.join(taller, "path", "left_semi")
    whole = F.sha2(F.concat(F.col("length").cast("string").cast("binary"), F.col("d")), 256)
    return _with_empty(spark, paths, roots.select("path", "length", whole.alias("tree_sha256")), tree_sha256=hashlib.sha256(b"0").hexdigest())


def fingerprint_mismatches(current: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files whose stored hash differs from the current one, or that are gone."""
    stored = manifest.select(key, F.col("sha256").alias("stored"))
    joined = stored.join(current.select(key, F.col("sha256").alias("current")), key, "left")
    return joined.filter(F.col("current").isNull() | (F.col("current") != F.col("stored")))
