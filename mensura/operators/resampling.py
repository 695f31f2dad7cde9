"""Tests and resampling: one job over all groups and replicates.

Random numbers are hashes of (seed, replicate, unit), so results do not depend
on partitioning and a retried task repeats them exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mensura.functions.scalar import spearman_brown
from mensura.functions.special import normal_two_sided_p, t_quantile, t_two_sided_p
from mensura.operators.aggregates import corrected_skewness, spearman
from mensura.operators.graph import connected_components
from mensura.operators.ordering import attach, join_null_safe, median_table, quantile_table, rank_table, row_index
from mensura.session import cut_lineage

SIGNS_PER_HASH = 32


# --- one-sample and paired tests -------------------------------------------------

def one_sample_t(df: DataFrame, keys: list[str], value: str, minimum: int = 3) -> DataFrame:
    """Mean, 95% interval, t, p, dz and direction fraction per group of differences."""
    v = F.col(value)
    stats = df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.avg((v > 0).cast("double")).alias("direction_fraction"),
    ).filter(F.col("n") >= minimum)
    joined = stats.withColumn("dof", F.col("n") - 1).withColumn("_t975", t_quantile(0.975, F.col("dof")))
    se = F.col("sd") / F.sqrt("n")
    t = F.when(F.col("sd") > 0, F.col("mean") / se)
    return joined.select(
        *keys, "n", "mean", "sd", se.alias("sem"),
        (F.col("mean") - F.col("_t975") * se).alias("ci95_low"),
        (F.col("mean") + F.col("_t975") * se).alias("ci95_high"),
        t.alias("t"), t_two_sided_p(t, F.col("dof")).alias("p_t"),
        F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).alias("dz"), "direction_fraction",
    )


def equivalence(tests: DataFrame, bound_dz: float = 0.3) -> DataFrame:
    """90% interval strictly inside +-bound, the bound being a share of the observed SD."""
    joined = tests.withColumn("_t95", t_quantile(0.95, F.col("n") - 1))
    low, high = F.col("mean") - F.col("_t95") * F.col("sem"), F.col("mean") + F.col("_t95") * F.col("sem")
    bound = bound_dz * F.col("sd")
    return joined.select(
        *tests.columns, low.alias("ci90_low"), high.alias("ci90_high"), bound.alias("equivalence_bound"),
        ((low > -bound) & (high < bound)).alias("equivalent"),
    )


def signed_rank(df: DataFrame, keys: list[str], value: str, exact_below: int = 51) -> DataFrame:
    """Wilcoxon signed-rank test with zeros dropped.

    Exact for at most fifty untied differences without zeros, otherwise the
    normal form with tie correction.  Differences are counted per distinct
    (|d|, sign) before ranking, so ties cost nothing.
    """
    v = F.col(value)
    base = df.filter(v.isNotNull()).withColumn("_a", F.abs(v))
    zeros = base.groupBy(*keys).agg(F.sum((v == 0).cast("bigint")).alias("_zeros"))
    nonzero = base.filter(v != 0)
    ranks = rank_table(nonzero, keys, "_a")
    above = nonzero.groupBy(*keys, "_a").agg(F.sum((v > 0).cast("bigint")).alias("_up"))
    ranked = ranks.join(above, [*keys, "_a"])
    ties = F.col("ties").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.max("total").alias("n_used"),
        F.sum(F.col("rank") * F.col("_up")).alias("w_plus"),
        F.sum(ties * ties * ties - ties).alias("_tie_term"),
    )
    sums = attach(sums, zeros, keys)
    n = F.col("n_used").cast("double")
    mean = n * (n + 1) / 4.0
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tie_term") / 48.0
    minus = n * (n + 1) / 2.0 - F.col("w_plus")
    exact_ok = (F.col("n_used") < exact_below) & (F.col("_tie_term") == 0) & (F.col("_zeros") == 0)
    sizes = sums.filter(exact_ok).select("n_used").distinct().withColumn("_counts", _signed_rank_counts(F.col("n_used")))
    out = sums.join(sizes, "n_used", "left").withColumn("statistic", F.least(F.col("w_plus"), minus))
    head = F.slice("_counts", F.lit(1), F.col("statistic").cast("int") + 1)
    exact = F.least(F.lit(1.0), 2.0 * F.aggregate(head, F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), n))
    normal = normal_two_sided_p((F.col("statistic") - mean) / F.sqrt(variance))
    return out.select(
        *keys, "n_used", "w_plus", "statistic",
        F.when(exact_ok, exact).otherwise(normal).alias("p_wilcoxon"), exact_ok.alias("is_exact"),
    )


def _signed_rank_counts(n: Column) -> Column:
    """Number of sign patterns giving each rank sum, by adding one rank at a time."""
    size = (n * (n + 1) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), size), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    return F.aggregate(
        F.sequence(F.lit(1), n.cast("int")), start,
        lambda acc, i: F.transform(acc, lambda x, k: x + F.when(k >= i, F.get(acc, k - i)).otherwise(0.0)),
    )


def paired_effects(
    differences: DataFrame, keys: list[str], value: str, unit: str, seed, replicates: int
) -> DataFrame:
    """The whole paired-effect record per metric."""
    tests = equivalence(one_sample_t(differences, keys, value))
    ranks = signed_rank(differences, keys, value).select(*keys, "p_wilcoxon")
    boot = bootstrap_mean(differences, keys, unit, value, seed, replicates)
    return tests.join(ranks, keys, "left").join(
        boot.select(*keys, F.col("ci_low").alias("bootstrap_ci95_low"), F.col("ci_high").alias("bootstrap_ci95_high")),
        keys, "left",
    )


# --- bootstraps ------------------------------------------------------------------

#: rows whose draws are counted together; a group of more rows is split by binomial draws
BLOCK_ROWS = 8192
#: counts held at once in a task: replicates x rows
COUNT_CELLS = 2 << 20
#: rows of a group whose replicates are ranked inside tasks, a share of the replicates in each
RANKED_ROWS = 1 << 20
#: counts of one turn of such a task, and of all its turns: at least and at most
RANK_CELLS, TASK_CELLS = 1 << 18, (1 << 24, 1 << 28)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _width(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit mixing of counters; the SQL twins repeat it."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x3F58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x14D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def block_draws(total: int, block: int, key: str, replicates: int, block_rows: int) -> np.ndarray:
    """Draws that fall into a block of a group of ``total`` rows, per replicate: multinomial by binary splitting.

    Each node of the splitting tree has a generator of its own, so every block
    finds its draws alone and the blocks of a replicate add up to ``total``.
    """
    draws, low, high = np.full(replicates, total, dtype=np.int64), 0, -(-total // block_rows)
    while high - low > 1:
        middle = (low + high) // 2
        drawn = _left_draws(draws, total, low, high, key, block_rows)
        draws, low, high = (drawn, low, middle) if block < middle else (draws - drawn, middle, high)
    return draws


def _left_draws(draws: np.ndarray, total: int, low: int, high: int, key: str, block_rows: int) -> np.ndarray:
    """Draws of the blocks ``low`` to ``high`` - 1 that fall into the first half of them."""
    rows = lambda a, b: min(total, b * block_rows) - a * block_rows
    share = rows(low, (low + high) // 2) / rows(low, high)
    return np.random.Generator(np.random.PCG64(_digest(f"{key}|{low}|{high}"))).binomial(draws, share)


def all_block_draws(total: int, key: str, replicates: int, block_rows: int, first: int, last: int) -> list[np.ndarray]:
    """``block_draws`` of every block, for the replicates ``first`` to ``last`` - 1; each node is split once."""

    def below(draws: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        if high - low == 1:
            return [draws[first:last].copy()]
        middle, drawn = (low + high) // 2, _left_draws(draws, total, low, high, key, block_rows)
        return below(drawn, low, middle) + below(draws - drawn, middle, high)

    return below(np.full(replicates, total, dtype=np.int64), 0, -(-total // block_rows))


def _counted(rows: int, own: np.ndarray, first: int, block: int, key: str) -> np.ndarray:
    """How often each of ``rows`` rows is drawn, for replicates from ``first`` on with ``own`` draws each."""
    base = np.array([_digest(f"{key}|{rep}|{block}") for rep in range(first, first + len(own))], dtype=np.uint64)
    rep = np.repeat(np.arange(len(own)), own)
    turn = np.arange(1, len(rep) + 1) - np.repeat(np.cumsum(own) - own, own)
    high = mixed(base[rep] + turn.astype(np.uint64) * _STEP) >> np.uint64(32)
    place = (high * np.uint64(rows) >> np.uint64(32)).astype(np.int64)
    return np.bincount(rep * rows + place, minlength=len(own) * rows).reshape(len(own), rows)


def draw_counts(rows: int, total: int, block: int, key: str, replicates: int, block_rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first replicate, counts of shape replicates x rows) of a block with ``rows`` rows; all replicates in turn."""
    draws = block_draws(total, block, key, replicates, block_rows)
    each = max(1, COUNT_CELLS // max(rows, int(draws.max(initial=1))))
    for first in range(0, replicates, each):
        yield first, _counted(rows, draws[first : first + each], first, block, key)


def group_counts(total: int, key: str, replicates: int, block_rows: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """``draw_counts`` of all blocks of a group side by side, for the replicates ``first`` to ``last`` - 1 in turn."""
    draws = all_block_draws(total, key, replicates, block_rows, first, last)
    each = max(1, RANK_CELLS // total)
    for low in range(first, last, each):
        high = min(last, low + each)
        counts = np.empty((high - low, total), dtype=np.int64)
        for block, own in enumerate(draws):
            begin, end = block * block_rows, min(total, (block + 1) * block_rows)
            counts[:, begin:end] = _counted(end - begin, own[low - first : high - first], low, block, key)
        yield low, counts


def _blocks(df: DataFrame, keys: list[str], unit: str, values: list[str], seed, block_rows: int) -> DataFrame:
    """Groups as blocks of at most ``block_rows`` rows: keys, ``_key``, ``_total``, ``_block``, ``_rows`` (structs in order)."""
    rows, order = df.select(*keys, unit, *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)]), [unit]
    if dict(df.dtypes)[unit] == "string":
        # text ids share prefixes: number them in hash order, which spreads evenly
        rows, order = rows.withColumn("_place", F.xxhash64(unit)), ["_place", unit]
    indexed = row_index(rows, keys, order, "idx", total="_total").withColumn("_block", F.floor((F.col("idx") - 1) / block_rows).cast("bigint"))
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return indexed.groupBy(*keys, "_block", "_total").agg(
        F.sort_array(F.collect_list(F.struct("idx", *[f"_v{i}" for i in range(len(values))]))).alias("_rows")
    ).withColumn("_key", key)


def _each_block(blocks: DataFrame, keys: list[str], width: int, fields: list[T.StructField], work) -> DataFrame:
    """``work(values, total, block, key)`` gives tuples of columns for every block inside tasks."""
    schema = T.StructType([f for f in blocks.schema.fields if f.name in keys] + fields)
    heads = [f.name for f in schema.fields if f.name in keys]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("_rows")[i].values
                values = np.column_stack([rows.field(f"_v{k}").to_numpy(zero_copy_only=False) for k in range(width)])
                one = lambda name: batch.column(name)[i].as_py()
                for columns in work(values, one("_total"), one("_block"), one("_key")):
                    place = pa.array(np.full(len(columns[0]), i))
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(place) for k in heads], *map(pa.array, columns)], names=[*heads, *names])

    return blocks.repartition(_width(blocks.sparkSession), *keys, "_block").mapInArrow(run, schema)


def bootstrap_sums(
    df: DataFrame, keys: list[str], unit: str, values: list[str], seed, replicates: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Sums of ``values`` over the rows drawn in each replicate: keys, ``rep``, ``n``, ``s0``, ``s1``, ...

    No drawn row exists anywhere: a task counts how often each row of its block
    is drawn and multiplies counts with values, and partial sums meet per replicate.
    """
    width = len(values)

    def work(rows, total, block, key):
        for first, counts in draw_counts(len(rows), total, block, key, replicates, block_rows):
            sums = counts.astype(np.float64) @ rows
            yield (np.arange(first, first + len(counts)), counts.sum(axis=1), *sums.T.copy())

    fields = [T.StructField("rep", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(f"s{k}", T.DoubleType()) for k in range(width)]]
    parts = _each_block(_blocks(df, keys, unit, values, seed, block_rows), keys, width, fields, work)
    return parts.groupBy(*keys, "rep").agg(*[F.sum(f.name).alias(f.name) for f in fields[1:]])


def _ties(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, first place of every distinct value in it, number of its value for each row."""
    order = np.argsort(values, kind="stable")
    change = np.concatenate([[True], values[order][1:] != values[order][:-1]])
    of_row = np.empty(len(values), dtype=np.int64)
    of_row[order] = np.cumsum(change) - 1
    return order, np.flatnonzero(change), of_row


def _counted_correlations(batches: Iterator[tuple[int, np.ndarray]], x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(replicates, their rank correlations) from how often each row is drawn; null where undefined.

    A replicate has as many draws as rows.  Ranks belong to distinct values, so
    sums of squares run over values and only the products run over rows.
    """
    total, middle = len(x), (len(x) + 1) / 2.0
    order, starts, _ = _ties(x)
    places, begins, value_of = _ties(y)
    value_of = value_of[order]
    for first, counts in batches:
        in_x = np.take(counts, order, axis=1)
        tx, ty = np.add.reduceat(in_x, starts, axis=1), np.add.reduceat(np.take(counts, places, axis=1), begins, axis=1)
        rx, ry = (np.cumsum(t, axis=1) - (t - 1) / 2.0 - middle for t in (tx, ty))
        xx, yy = (np.einsum("ij,ij,ij->i", t, r, r) for t, r in ((tx, rx), (ty, ry)))
        xy = np.einsum("ij,ij->i", rx, np.add.reduceat(in_x * np.take(ry, value_of, axis=1), starts, axis=1))
        defined = (xx > 0) & (yy > 0) & (total >= 3)
        rho = np.divide(xy, np.sqrt(xx * yy), out=np.zeros(len(xy)), where=defined)
        yield np.arange(first, first + len(counts)), pa.array(rho, mask=~defined)


def _ranked_in_tasks(blocks: DataFrame, keys: list[str], schema: T.StructType, replicates: int, block_rows: int) -> DataFrame:
    """Rank correlations of groups of several blocks: a task has a group's rows and a share of its replicates."""
    least, most = TASK_CELLS
    width = _width(blocks.sparkSession)
    cells = F.col("_total") * F.lit(replicates)
    shares = F.least(F.lit(replicates), F.greatest(F.ceil(cells / most), F.least(F.lit(width), F.ceil(cells / least)))).cast("int")
    dealt = blocks.withColumn("_shares", shares).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))

    def ranked(table: pa.Table) -> pa.Table:
        one = lambda name: table.column(name)[0].as_py()
        table = table.sort_by("_block")
        rows = [part.values for part in table.column("_rows").combine_chunks()]
        x, y = (np.concatenate([r.field(f"_v{k}").to_numpy(zero_copy_only=False) for r in rows]) for k in range(2))
        shares, share = one("_shares"), one("_share")
        counts = group_counts(len(x), one("_key"), replicates, block_rows, replicates * share // shares, replicates * (share + 1) // shares)
        reps, rhos = zip(*_counted_correlations(counts, x, y))
        reps = np.concatenate(reps)
        heads = [table.column(f.name).take(pa.array(np.zeros(len(reps), dtype=np.int64))) for f in schema.fields[:-2]]
        return pa.Table.from_arrays([*heads, pa.array(reps), pa.chunked_array(rhos)], names=schema.names)

    # more partitions than tasks at a time, since shares meet in them by hash
    return dealt.repartition(4 * width, *keys, "_share").groupBy(*keys, "_share").applyInArrow(ranked, schema)


def bootstrap_rank_correlation(
    df: DataFrame, keys: list[str], unit: str, x: str, y: str, seed, replicates: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rank correlation of the rows drawn in each replicate: keys, ``rep``, ``rho`` (null where undefined).

    Groups of one block rank their counts inside the task.  Groups up to
    ``RANKED_ROWS`` do so too, with their replicates dealt to tasks.  Larger
    groups keep counted rows, which are ranked by the ordering layer with the
    counts as weights.
    """
    blocks = cut_lineage(_blocks(df, keys, unit, [x, y], seed, block_rows))

    def whole(rows, total, block, key):
        return _counted_correlations(draw_counts(len(rows), total, block, key, replicates, block_rows), rows[:, 0], rows[:, 1])

    fields = [T.StructField("rep", T.LongType()), T.StructField("rho", T.DoubleType())]
    small = _each_block(blocks.filter(F.col("_total") <= block_rows), keys, 2, fields, whole)
    many = F.col("_total") > max(block_rows, RANKED_ROWS)
    inside = small.unionByName(_ranked_in_tasks(blocks.filter((F.col("_total") > block_rows) & ~many), keys, small.schema, replicates, block_rows))
    if blocks.filter(many).isEmpty():
        return inside

    def counted(rows, total, block, key):
        for first, counts in draw_counts(len(rows), total, block, key, replicates, block_rows):
            rep, row = np.nonzero(counts)
            yield rep + first, rows[row, 0], rows[row, 1], counts[rep, row]

    fields = [fields[0], T.StructField("_x", T.DoubleType()), T.StructField("_y", T.DoubleType()), T.StructField("_c", T.LongType())]
    drawn = _each_block(blocks.filter(many), keys, 2, fields, counted)
    by, ranked = [*keys, "rep"], drawn
    for column, name in (("_x", "_rx"), ("_y", "_ry")):
        ranks = rank_table(drawn, by, column, weight=F.col("_c")).select(*by, column, F.col("rank").alias(name))
        ranked = join_null_safe(ranked, ranks, [*by, column])
    c, rx, ry = F.col("_c"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*by).agg(
        F.sum(c).alias("n"), *[F.sum(c * e).alias(f"_{i}") for i, e in enumerate((rx, ry, rx * rx, ry * ry, rx * ry))]
    )
    xx, yy, xy = (F.expr(f"_{k} - _{i} * _{j} / n") for k, i, j in ((2, 0, 0), (3, 1, 1), (4, 0, 1)))
    large = sums.select(*by, F.when((xx > 0) & (yy > 0) & (F.col("n") >= 3), xy / F.sqrt(xx * yy)).alias("rho"))
    return inside.unionByName(large)


def bootstrap_mean(
    df: DataFrame, keys: list[str], unit: str, value: str, seed, replicates: int, level: float = 0.95
) -> DataFrame:
    """Percentile bootstrap of a mean.  Only ``replicates`` means per group reach the quantile step."""
    complete = df.filter(F.col(value).isNotNull())
    means = bootstrap_sums(complete, keys, unit, [value], seed, replicates).withColumn("_mean", F.col("s0") / F.col("n"))
    tail = (1 - level) / 2
    return means.groupBy(*keys).agg(
        F.percentile("_mean", F.lit(tail)).alias("ci_low"), F.percentile("_mean", F.lit(1 - tail)).alias("ci_high"),
        F.count(F.lit(1)).alias("n_replicates"),
    )


def mean_interval_report(df: DataFrame, keys: list[str], unit: str, value: str, seed, replicates: int) -> DataFrame:
    """Bootstrap interval with mean, median, skewness and share below zero."""
    boot = bootstrap_mean(df, keys, unit, value, seed, replicates)
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), corrected_skewness(value).alias("skewness"),
        F.avg((F.col(value) < 0).cast("double")).alias("fraction_below_zero"),
    )
    return attach(attach(base, median_table(df, keys, value, "median"), keys), boot, keys)


def bootstrap_spearman(
    df: DataFrame, keys: list[str], unit: str, x: str, y: str, seed, replicates: int, corrected: bool = False
) -> DataFrame:
    """Percentile bootstrap of a rank correlation, or of its full-length reliability.

    Undefined replicates are dropped and counted.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    point = spearman(pairs, keys, x, y)
    per_rep = bootstrap_rank_correlation(pairs, keys, unit, x, y, seed, replicates)
    statistic = spearman_brown("rho") if corrected else F.col("rho")
    finite = per_rep.withColumn("_s", statistic)
    interval = finite.groupBy(*keys).agg(
        F.count("_s").alias("n_finite"),
        F.percentile("_s", F.lit(0.025)).alias("ci_low"), F.percentile("_s", F.lit(0.975)).alias("ci_high"),
    )
    return attach(point, interval, keys)


def bootstrap_split_half(
    df: DataFrame, keys: list[str], unit: str, first: str, second: str, seed, replicates: int
) -> DataFrame:
    """Reliability bootstrap; needs five pairs and 99% defined replicates."""
    out = bootstrap_spearman(df, keys, unit, first, second, seed, replicates, corrected=True)
    enough = (F.col("n") >= 5) & (F.col("n_finite") >= 0.99 * replicates)
    checked = out.filter(F.assert_true(enough, "too few pairs or too many undefined replicates").isNull())
    return checked.withColumn("spearman_brown", spearman_brown("rho"))


# --- sign flips --------------------------------------------------------------------

#: signs of a turn, in hashes; sums that a task holds before it hands them on
FLIP_HASHES, FLIP_SUMS = 1 << 14, 1 << 23
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def _md5_words(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """First word of the MD5 of messages of one block, given as 16 words that spread to ``shape``."""
    a, b, c, d = (np.full(shape, v, dtype=np.uint32) for v in _MD5_START)
    f, spare = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    for i in range(61):  # the last three steps do not touch the first word
        if i < 16:
            place = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            place = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            place = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            place = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[place] + np.uint32(_MD5_SINES[i])
        turn = _MD5_TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=spare)
        f >>= np.uint32(32 - turn)
        f |= spare
        f += b
        a, b, c, d, f = d, f, b, c, a
    return b + np.uint32(_MD5_START[0])


def sign_words(seed: str, blocks: range, units: list[str | None]) -> np.ndarray:
    """First 32 bits of the MD5 of ``seed|block|unit``, blocks x units, as the digest's bytes lie in memory.

    Short ids are hashed side by side.  Long ones, and a missing id, which
    leaves its place out as in ``hash_bits``, go one by one.
    """
    out = np.empty((len(blocks), len(units)), dtype="<u4")
    texts = [None if u is None else u.encode() for u in units]
    low = blocks.start
    while low < blocks.stop:
        high = min(blocks.stop, 10 ** len(str(low)))  # numbers of one length
        heads = [f"{seed}|{b}|".encode() for b in range(low, high)]
        start = len(heads[0])
        short = [i for i, t in enumerate(texts) if t is not None and start + len(t) <= 55]
        for i in sorted(set(range(len(texts))) - set(short)):
            for j, head in enumerate(heads):
                digest = hashlib.md5(head[:-1] if texts[i] is None else head + texts[i]).digest()
                out[low - blocks.start + j, i] = int.from_bytes(digest[:4], "little")
        if short:
            sizes = np.array([len(texts[i]) for i in short])
            tail = np.zeros((len(short), 64), dtype=np.uint8)
            longest = max(1, int(sizes.max()))
            tail[:, start : start + longest] = np.array([texts[i] for i in short], dtype=f"S{longest}").view(np.uint8).reshape(len(short), longest)
            tail[np.arange(len(short)), start + sizes] = 0x80
            tail.view("<u4")[:, 14] = 8 * (start + sizes)
            front = np.zeros((len(heads), 64), dtype=np.uint8)
            front[:, :start] = np.frombuffer(b"".join(heads), dtype=np.uint8).reshape(len(heads), start)
            tails, fronts = (np.ascontiguousarray(m.view("<u4").T) for m in (tail, front))
            words = [t[None, :] if not f.any() else f[:, None] if not t.any() else f[:, None] | t[None, :] for t, f in zip(tails, fronts)]
            out[low - blocks.start : high - blocks.start, short] = _md5_words(words, (len(heads), len(short)))
        low = high
    return out


def sign_flip_sums(
    df: DataFrame, keys: list[str], unit: str, value: str, seed, replicates: int
) -> DataFrame:
    """Sum of randomly signed values per group and replicate.

    One hash of (seed, block of 32 replicates, unit) gives the signs of 32
    replicates.  Tasks hash their units side by side and multiply signs with
    values, so the shuffle carries replicates per task and not replicates per
    unit.  The same unit gets the same sign in every group.
    """
    n_blocks = math.ceil(replicates / SIGNS_PER_HASH)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(unit).cast("string").alias("_unit"), F.col(value).cast("double").alias("_value"))
    schema = T.StructType([f for f in rows.schema.fields if f.name in keys] + [
        T.StructField("_block", T.IntegerType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))])
    heads = [f.name for f in schema.fields[:-2]]
    most = max(1, FLIP_SUMS // (n_blocks * SIGNS_PER_HASH))  # groups

    def flip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[pa.RecordBatch, np.ndarray]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for head, sums in held.values():
                columns = [head.column(k).take(pa.array(np.zeros(n_blocks, dtype=np.int64))) for k in heads]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n_blocks + 1) * SIGNS_PER_HASH, pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n_blocks), pa.int32()), lists], names=schema.names)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            groups: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(*[batch.column(k).to_pylist() for k in heads]) if heads else [()] * batch.num_rows):
                groups.setdefault(group, []).append(i)
            ids = batch.column("_unit").dictionary_encode(null_encoding="encode")
            code_of, units = ids.indices.to_numpy(zero_copy_only=False), np.array(ids.dictionary.to_pylist(), dtype=object)
            values = batch.column("_value").to_numpy(zero_copy_only=False)
            named = list(groups.items())
            for start in range(0, len(named), most):
                some = named[start : start + most]
                order = np.concatenate([places for _, places in some])
                own, code = np.unique(code_of[order], return_inverse=True)
                bounds = np.concatenate([[0], np.cumsum([len(places) for _, places in some])])
                sums = np.empty((len(some), n_blocks, SIGNS_PER_HASH))
                ahead, each = max(1, 4 * FLIP_HASHES // len(own)), max(1, FLIP_HASHES // len(order))
                texts = list(units[own])
                for first in range(0, n_blocks, ahead):
                    hashed = sign_words(str(seed), range(first, min(n_blocks, first + ahead)), texts)
                    for low in range(0, len(hashed), each):
                        words = np.take(hashed[low : low + each], code, axis=1)
                        bits = np.unpackbits(words.view(np.uint8).reshape(*words.shape, 4), axis=-1)
                        signs = (bits.view(np.int8) * np.int8(2) - np.int8(1)).astype(np.float64)
                        for g in range(len(some)):
                            part = slice(bounds[g], bounds[g + 1])
                            signed = np.matmul(values[order[part]], signs[:, part])[:, ::-1]  # the lowest bit comes first
                            sums[g, first + low : first + low + len(words)] = signed
                for g, (group, places) in enumerate(some):
                    if group in held:
                        np.add(held[group][1], sums[g], out=held[group][1])
                    else:
                        held[group] = batch.slice(places[0], 1), sums[g].copy()
                if len(held) >= most:
                    yield from handed_on()
        yield from handed_on()

    # a unit's rows meet, so its hashes serve all its groups
    dealt = rows.repartition(_width(rows.sparkSession), "_unit").mapInArrow(flip, schema)
    sums = dealt.groupBy(*keys, "_block").agg(*[F.sum(F.col("_sums")[j]).alias(f"_s{j}") for j in range(SIGNS_PER_HASH)])
    return (
        sums.select(*keys, "_block", F.posexplode(F.array(*[f"_s{j}" for j in range(SIGNS_PER_HASH)])).alias("_j", "signed_sum"))
        .withColumn("rep", F.col("_block") * SIGNS_PER_HASH + F.col("_j"))
        .filter(F.col("rep") < replicates)
        .select(*keys, "rep", "signed_sum")
    )


def sign_flip_test(df: DataFrame, keys: list[str], unit: str, value: str, seed, replicates: int) -> DataFrame:
    """Null quantiles of the mean and p = (1 + exceedances) / (replicates + 1)."""
    complete = df.filter(F.col(value).isNotNull())
    observed = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("observed"))
    null = attach(sign_flip_sums(complete, keys, unit, value, seed, replicates), observed, keys)
    null = null.withColumn("_m", F.col("signed_sum") / F.col("n"))
    # the tolerance absorbs the summation order of equal sums
    beyond = F.abs(F.col("_m")) >= F.abs(F.col("observed")) - 1e-12 * F.abs(F.col("observed"))
    return null.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("observed").alias("observed"),
        F.percentile("_m", F.lit(0.025)).alias("null_q025"),
        F.percentile("_m", F.lit(0.5)).alias("null_q500"),
        F.percentile("_m", F.lit(0.975)).alias("null_q975"),
        ((1 + F.sum(beyond.cast("bigint"))) / F.lit(replicates + 1.0)).alias("p_value"),
    )


def sign_flip_t(
    df: DataFrame, keys: list[str], channel: str, unit: str, value: str, seed, replicates: int, minimum: int = 3
) -> DataFrame:
    """t per channel and replicate; replicate -1 is the observed data.

    Flipping signs leaves the sum of squares alone, so only signed sums are
    recomputed.
    """
    complete = df.filter(F.col(value).isNotNull())
    constants = complete.groupBy(*keys, channel).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("_sum"), F.sum(F.col(value) * F.col(value)).alias("_squares")
    ).filter(F.col("n") >= minimum)
    signed = constants.select(*keys, channel, F.lit(-1).alias("rep"), F.col("_sum").alias("signed_sum"))
    if replicates:
        signed = signed.unionByName(sign_flip_sums(complete, [*keys, channel], unit, value, seed, replicates))
    both = signed.join(constants.drop("_sum"), [*keys, channel])
    mean = F.col("signed_sum") / F.col("n")
    variance = (F.col("_squares") - F.col("signed_sum") * mean) / (F.col("n") - 1)
    return both.select(*keys, channel, "rep", "n", F.when(variance > 0, mean / F.sqrt(variance / F.col("n"))).alias("t"))


def suprathreshold(t_values: DataFrame, keys: list[str], channel: str, alpha: float = 0.05) -> DataFrame:
    """Channels at or beyond the two-sided threshold of their own degrees of freedom."""
    dof = t_values.select((F.col("n") - 1).alias("_dof")).distinct()
    limits = dof.select("_dof", t_quantile(1.0 - alpha / 2.0, F.col("_dof")).alias("_limit"))
    with_dof = t_values.withColumn("_dof", F.col("n") - 1)
    return with_dof.join(limits, "_dof").filter(F.abs("t") >= F.col("_limit")).select(
        *keys, F.when(F.col("t") > 0, 1).otherwise(-1).alias("sign"), F.col(channel).alias("node"), "t"
    )


def threshold_clusters(
    t_values: DataFrame, edges: DataFrame, keys: list[str], channel: str, alpha: float = 0.05
) -> DataFrame:
    """Signed suprathreshold components: keys, sign, channel, t, component.

    ``edges`` has both directions, columns ``a`` and ``b``.  The threshold is inclusive.
    """
    nodes = cut_lineage(suprathreshold(t_values, keys, channel, alpha))
    group = [*keys, "sign"]
    ends = nodes.select(*group, "node")
    links = (
        ends.withColumnRenamed("node", "a").join(edges.select("a", "b"), "a")
        .join(ends.withColumnRenamed("node", "b"), [*group, "b"])
    )
    parts = connected_components(ends, links, group, "node")
    return nodes.join(parts, [*group, "node"])


def cluster_permutation(
    differences: DataFrame, edges: DataFrame, keys: list[str], channel: str, unit: str, value: str,
    seed, replicates: int, alpha: float = 0.05,
) -> DataFrame:
    """Observed clusters with the share of replicates whose largest mass reaches theirs.

    Without an observed cluster the result is empty, with the same columns, and
    no replicate is computed.  ``keys`` names at least one column.
    """
    columns = [*keys, "cluster_id", "sign", "channels", "n_channels", "cluster_mass", "p_value"]
    quiet = suprathreshold(sign_flip_t(differences, keys, channel, unit, value, seed, 0), keys, channel, alpha).isEmpty()
    t_all = sign_flip_t(differences, keys, channel, unit, value, seed, 0 if quiet else replicates)
    members = threshold_clusters(t_all, edges, [*keys, "rep"], channel, alpha)
    masses = members.groupBy(*keys, "rep", "sign", "component").agg(F.sum(F.abs("t")).alias("cluster_mass"))
    observed = members.filter("rep = -1").groupBy(*keys, "sign", "component").agg(
        F.sum(F.abs("t")).alias("cluster_mass"), F.count(F.lit(1)).alias("n_channels"),
        F.array_join(F.array_sort(F.collect_set(F.col("node").cast("string"))), ";").alias("channels"),
    )
    largest = masses.filter("rep >= 0").groupBy(*keys, "rep").agg(F.max("cluster_mass").alias("null_max"))
    # replicates without any cluster have mass 0 and never reach an observed mass
    reached = observed.join(largest, keys, "left").groupBy(*keys, "sign", "component").agg(
        F.first("cluster_mass").alias("cluster_mass"), F.first("n_channels").alias("n_channels"),
        F.first("channels").alias("channels"),
        F.sum(F.coalesce(F.col("null_max") >= F.col("cluster_mass") * (1 - 1e-12), F.lit(False)).cast("bigint")).alias("_hits"),
    )
    numbered = row_index(
        reached.withColumn("_minus", -F.col("cluster_mass")), keys, ["_minus", "channels"], "cluster_id"
    )
    return numbered.withColumn("p_value", (1 + F.col("_hits")) / F.lit(replicates + 1.0)).select(*columns)


# --- reliability and audits -----------------------------------------------------------

def split_half_table(halves: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Rank correlation of two halves, its full-length form and p."""
    from mensura.operators.aggregates import correlation_p

    rho = spearman(halves, keys, first, second)
    return rho.withColumn("spearman_brown", spearman_brown("rho")).withColumn("p_value", correlation_p("rho"))


def loss_audit(
    losses: DataFrame, keys: list[str], unit: str, seed, replicates: int
) -> DataFrame:
    """Held-out loss increments: means, sign-flip test, distribution and leave-one-out range."""
    from mensura.operators.windows import leave_one_out_range

    wide = loss_increments(losses, keys, unit)
    means = wide.groupBy(*keys).agg(F.avg("base").alias("mean_base"), F.avg("extended").alias("mean_extended"))
    test = sign_flip_test(wide, keys, unit, "delta", seed, replicates)
    shape = quantile_table(wide, keys, "delta", {"median_delta": 0.5, "_q25": 0.25, "_q75": 0.75}).withColumn(
        "iqr_delta", F.col("_q75") - F.col("_q25")
    ).drop("_q25", "_q75")
    improved = wide.groupBy(*keys).agg(F.avg((F.col("delta") < 0).cast("double")).alias("fraction_improved"))
    out = means
    for part in (test, shape, improved, leave_one_out_range(wide, keys, "delta")):
        out = attach(out, part, keys)
    return out


def loss_increments(losses: DataFrame, keys: list[str], unit: str) -> DataFrame:
    side = lambda m: F.max(F.when(F.col("model") == m, F.col("loss")))
    return losses.groupBy(*keys, unit).agg(side("base").alias("base"), side("extended").alias("extended")).withColumn(
        "delta", F.col("extended") - F.col("base")
    )
