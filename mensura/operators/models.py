"""Regression models from additive sufficient statistics.

The pass over the rows is always a grouped sum of cross-products (or of Newton
terms).  Only p-by-p systems, one per model, fold or unit, are solved in NumPy
inside tasks.  Leaving out a fold subtracts its sums from the total, so no fold
reads the rows again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement, permutations
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mensura.functions.scalar import uniform
from mensura.functions.special import chi2_two_df_p, normal_two_sided_p
from mensura.operators.ordering import SENT_ROWS, attach, attach_few, join_null_safe, row_index
from mensura.session import cut_lineage


# --- design -----------------------------------------------------------------------

def category_levels(df: DataFrame, column: str) -> list:
    """Sorted distinct levels.  Each becomes a column of the design, so they fit on the driver whenever the design does."""
    return sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())


def treatment_columns(df: DataFrame, column: str, levels: list | None = None, keep_first: bool = False) -> tuple[DataFrame, list[str]]:
    """0/1 columns; the first sorted level is the base unless ``keep_first``.  Unknown levels are all zero."""
    levels = levels or category_levels(df, column)
    used = levels if keep_first else levels[1:]
    names = [f"{column}[{v}]" for v in used]
    flags = {n: F.coalesce((F.col(column) == F.lit(v)).cast("double"), F.lit(0.0)) for n, v in zip(names, used)}
    return df.withColumns(flags), names


def add_products(df: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    names = [f"{a}:{b}" for a, b in pairs]
    return df.withColumns({n: F.col(f"`{a}`") * F.col(f"`{b}`") for n, (a, b) in zip(names, pairs)}), names


# --- sums of cross-products ---------------------------------------------------------

def _packed(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _square(packed, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    rows, cols = zip(*_packed(p))
    out[rows, cols] = packed
    out[cols, rows] = packed
    return out


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def gram(df: DataFrame, keys: list[str], columns: list[str], weight: Column | None = None, name: str = "gram") -> DataFrame:
    """Packed upper triangle of the cross-products of ``[1, *columns]`` per group."""
    terms: list[Column] = [F.lit(1.0)] + [_q(c).cast("double") for c in columns]
    w = F.lit(1.0) if weight is None else weight
    pairs = _packed(len(terms))
    sums = df.groupBy(*keys).agg(*[F.sum(w * terms[i] * terms[j]).alias(f"_g{k}") for k, (i, j) in enumerate(pairs)])
    return sums.select(*keys, F.array(*[f"_g{k}" for k in range(len(pairs))]).alias(name))


def add_arrays(df: DataFrame, keys: list[str], array: str, size: int) -> DataFrame:
    """Element-wise sum of an array column."""
    sums = df.groupBy(*keys).agg(*[F.sum(F.col(array)[k]).alias(f"_g{k}") for k in range(size)])
    return sums.select(*keys, F.array(*[f"_g{k}" for k in range(size)]).alias(array))


def _solve_rows(df: DataFrame, keys: list[str], fields: list[T.StructField], solve) -> DataFrame:
    """Apply ``solve(row) -> list of tuples`` to every statistics row inside tasks."""
    schema = T.StructType([f for f in df.schema.fields if f.name in keys] + fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            heads = zip(*[pdf[k].tolist() for k in keys]) if keys else [()] * len(pdf)
            for head, row in zip(heads, pdf.itertuples(index=False)):
                rows += [tuple(head) + r for r in solve(row)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


_DOUBLES = T.ArrayType(T.DoubleType())


# --- least squares with robust covariance ---------------------------------------------

def standardised(df: DataFrame, keys: list[str], columns: list[str], kept: list[str] | None = None) -> DataFrame:
    """Columns as ``_z0``, ``_z1``, ... with mean 0 and deviation 1 per model, and arrays ``_mean``, ``_scale``.

    Cross-products of raw columns lose every digit when a column's mean is far
    from zero (years, timestamps, ids), so models are fitted on these columns
    and mapped back.  A column without spread keeps scale 1.
    """
    return _standardise(df, keys, columns, kept)[0]


def _standardise(df: DataFrame, keys: list[str], columns: list[str], kept: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``standardised`` rows and the table of means and scales, which is written out."""
    values = [_q(c).cast("double") for c in columns]
    spread = [F.coalesce(F.stddev_pop(v), F.lit(0.0)) for v in values]
    stats = cut_lineage(df.groupBy(*keys).agg(
        F.array(*[F.avg(v) for v in values]).alias("_mean"), F.array(*[F.when(s > 0, s).otherwise(1.0) for s in spread]).alias("_scale")
    ))
    rows = attach_few(df.select(*keys, *(kept or []), *[v.alias(f"_z{i}") for i, v in enumerate(values)]), stats, keys)
    return rows.withColumns({f"_z{i}": (F.col(f"_z{i}") - F.col("_mean")[i]) / F.col("_scale")[i] for i in range(len(columns))}), stats


def pseudo_inverse(a: np.ndarray) -> tuple[np.ndarray, int]:
    """Inverse of a symmetric matrix and its rank; directions without information get 0."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    kept = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    v = vectors[:, kept]
    return (v / values[kept]) @ v.T, int(kept.sum())


def _back(mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Map from coefficients of [1, standardised columns] to those of [1, columns]."""
    out = np.diag(np.concatenate([[1.0], 1.0 / scale]))
    out[0, 1:] = -mean / scale
    return out


def _sums_of_few(rows: DataFrame, keys: list[str], numbered: DataFrame, p: int, name: str, size: int, work) -> DataFrame:
    """``work(model, x, whole)`` added up per model, as array ``name``; ``x`` holds [1, ``_z0``, ...] of a batch's rows.

    For models that fit into every task: matrix products of the task's own
    rows, one partial result per task and model.  A null adds nothing to a
    product, as in SQL; ``whole`` marks the rows without one.
    """
    z = [f"_z{i}" for i in range(p)]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in z])
    flat = attach_few(rows.select(*keys, *z), numbered.select(*keys, "_m"), keys).select(
        "_m", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in z], whole.alias("_whole"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for data in batches:
            x, model = np.column_stack([np.ones(len(data)), data[z].to_numpy(float)]), data["_m"].to_numpy()
            for one in np.unique(model).tolist():
                mine = model == one
                part = work(one, x[mine], data["_whole"].to_numpy(bool)[mine])
                held[one] = held[one] + part if one in held else part
        if held:
            yield pd.DataFrame({"_m": list(held), name: [v.tolist() for v in held.values()]})

    sums = add_arrays(flat.mapInPandas(run, f"_m bigint, {name} array<double>"), ["_m"], name, size)
    return attach(numbered.select(*keys, "_m"), sums, ["_m"]).drop("_m")


def least_squares(rows: DataFrame, stats: DataFrame, keys: list[str], p: int, products: DataFrame | None = None) -> DataFrame:
    """Fit on standardised rows, whose last column is the outcome, and their ``stats``; written out.

    ``beta`` and ``inverse`` belong to the standardised columns, ``coefficients``
    to the given ones; residual and total sums of squares are in the outcome's
    unit.  With a singular design the fit is that of a pseudo-inverse and
    ``rank`` is below ``p``.
    """
    products = gram(rows, keys, [f"_z{i}" for i in range(p)]) if products is None else products
    scales = stats.select(*keys, F.col("_mean").alias("means"), F.col("_scale").alias("scales"))

    def solve(row):
        g = _square(row.gram, p + 1)
        inverse, rank = pseudo_inverse(g[:p, :p])
        beta = inverse @ g[:p, p]
        mean, scale = np.asarray(row.means, dtype=float), np.asarray(row.scales, dtype=float)
        unit = scale[-1] ** 2
        raw = scale[-1] * (_back(mean[:-1], scale[:-1]) @ beta)
        raw[0] += mean[-1]
        rss = max(0.0, float(g[p, p] - beta @ g[:p, p]))
        return [(
            beta.tolist(), inverse.ravel().tolist(), raw.tolist(), mean.tolist(), scale.tolist(), g[0, 0],
            rss * unit, float(g[p, p] - g[0, p] ** 2 / g[0, 0]) * unit, rank,
        )]

    fields = [T.StructField(c, _DOUBLES) for c in ("beta", "inverse", "coefficients", "mean", "scale")] + [
        T.StructField(c, T.DoubleType()) for c in ("n", "rss", "tss")
    ] + [T.StructField("rank", T.LongType())]
    return cut_lineage(_solve_rows(attach(products, scales, keys), keys, fields, solve))


def _leverage(terms: list[Column], inverse: str) -> Column:
    p = len(terms)
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            factor = 1.0 if i == j else 2.0
            total = total + factor * F.col(inverse)[i * p + j] * terms[i] * terms[j]
    return total


def _fitted(terms: list[Column], beta: str) -> Column:
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        total = total + F.col(beta)[i] * t
    return total


#: terms from which a few models take matrix products; fewer are quicker as sums in SQL
MATRIX_TERMS = 8


def ols_hc3(df: DataFrame, keys: list[str], predictors: list[str], outcome: str) -> DataFrame:
    """One row per model: ``terms``, ``beta``, ``cov`` (HC3, flattened), n, R2, adjusted R2, ``rank``.

    Three aggregates over the rows: moments, cross-products, then
    leverage-weighted scores.
    """
    names = ["Intercept", *predictors]
    p = len(names)
    rows, stats = _standardise(df, keys, [*predictors, outcome])
    terms = [F.lit(1.0)] + [F.col(f"_z{i}") for i in range(p - 1)]
    pairs = _packed(p)
    if keys and p >= MATRIX_TERMS and stats.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        numbered = cut_lineage(stats.withColumn("_m", F.monotonically_increasing_id()))
        upper, inner = np.triu_indices(p + 1), np.triu_indices(p)
        products = _sums_of_few(rows, keys, numbered, p, "gram", len(upper[0]), lambda model, x, whole: (x.T @ x)[upper])
        fit = least_squares(rows, stats, keys, p, products)
        sent = {r["_m"]: (np.asarray(r["beta"]), np.asarray(r["inverse"]).reshape(p, p)) for r in attach(fit, numbered.select(*keys, "_m"), keys).collect()}

        def scores(model, x, whole):
            beta, inverse = sent[model]
            y, x = x[whole, p], x[whole, :p]
            weight = ((y - x @ beta) / (1.0 - np.einsum("ij,ij->i", x @ inverse, x))) ** 2
            return ((x * weight[:, None]).T @ x)[inner]

        meat = _sums_of_few(rows, keys, numbered, p, "meat", len(pairs), scores)
    else:
        fit = least_squares(rows, stats, keys, p)
        residual = F.col(f"_z{p - 1}") - _fitted(terms, "beta")
        rows = attach_few(rows, fit, keys).withColumn("_w", F.pow(residual / (1.0 - _leverage(terms, "inverse")), F.lit(2.0)))
        meat = rows.groupBy(*keys).agg(*[F.sum(F.col("_w") * terms[i] * terms[j]).alias(f"_m{k}") for k, (i, j) in enumerate(pairs)])
        meat = meat.select(*keys, F.array(*[f"_m{k}" for k in range(len(pairs))]).alias("meat"))
    both = attach(fit, meat, keys)

    def solve(row):
        inverse = np.asarray(row.inverse).reshape(p, p)
        scale = np.asarray(row.scale)
        back = scale[-1] * _back(np.asarray(row.mean)[:-1], scale[:-1])
        cov = back @ inverse @ _square(row.meat, p) @ inverse @ back.T
        r2 = 1.0 - row.rss / row.tss if row.tss > 0 else math.nan
        left = row.n - row.rank
        adjusted = 1.0 - (1.0 - r2) * (row.n - 1) / left if left > 0 else math.nan
        return [(names, list(row.coefficients), cov.ravel().tolist(), int(row.n), r2, adjusted, int(row.rank))]

    return _solve_rows(both, keys, _MODEL_FIELDS + _R2_FIELDS, solve)


_MODEL_FIELDS = [
    T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("beta", _DOUBLES),
    T.StructField("cov", _DOUBLES), T.StructField("n", T.LongType()),
]
_R2_FIELDS = [T.StructField("r_squared", T.DoubleType()), T.StructField("adjusted_r_squared", T.DoubleType()), T.StructField("rank", T.LongType())]


def coefficient_rows(models: DataFrame, keys: list[str], extra: list[str] | None = None, z: float = 1.959963984540054) -> DataFrame:
    """Long table of a model's terms with standard errors, interval and normal p."""
    extra = extra or []
    exploded = models.select(*keys, *extra, "n", "cov", "beta", F.posexplode("terms").alias("_i", "term"))
    p = F.size("beta")
    out = exploded.withColumn("estimate", F.get("beta", F.col("_i"))).withColumn(
        "std_error", F.sqrt(F.get("cov", F.col("_i") * p + F.col("_i")))
    )
    return out.select(
        *keys, "term", "estimate", "std_error",
        (F.col("estimate") - z * F.col("std_error")).alias("ci_low"),
        (F.col("estimate") + z * F.col("std_error")).alias("ci_high"),
        normal_two_sided_p(F.col("estimate") / F.col("std_error")).alias("p_value"), "n", *extra,
    )


def linear_contrasts(models: DataFrame, keys: list[str], contrasts: dict[str, dict[str, float]]) -> DataFrame:
    """w'b with standard error sqrt(w'Vw), b +- 1.96 se and normal p, per contrast."""
    parts = []
    p = F.size("beta")
    for label, weights in contrasts.items():
        place = {t: F.array_position("terms", t).cast("int") - 1 for t in weights}
        estimate, variance = F.lit(0.0), F.lit(0.0)
        for t, w in weights.items():
            estimate = estimate + w * F.get("beta", place[t])
            for u, v in weights.items():
                variance = variance + w * v * F.get("cov", place[t] * p + place[u])
        parts.append(F.struct(F.lit(label).alias("contrast"), estimate.alias("estimate"), F.sqrt(variance).alias("std_error")))
    out = models.select(*keys, "n", F.explode(F.array(*parts)).alias("_c")).select(*keys, "n", "_c.*")
    return out.select(
        *keys, "contrast", "estimate", "std_error",
        (F.col("estimate") - 1.96 * F.col("std_error")).alias("ci_low"),
        (F.col("estimate") + 1.96 * F.col("std_error")).alias("ci_high"),
        normal_two_sided_p(F.col("estimate") / F.col("std_error")).alias("p_value"), "n",
    )


def joint_wald_two(models: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Wald test that two coefficients are both zero (chi-square, 2 degrees of freedom)."""
    p = F.size("beta")
    i, j = (F.array_position("terms", t).cast("int") - 1 for t in (first, second))
    b1, b2 = F.get("beta", i), F.get("beta", j)
    v11, v22, v12 = F.get("cov", i * p + i), F.get("cov", j * p + j), F.get("cov", i * p + j)
    wald = (b1 * b1 * v22 - 2.0 * b1 * b2 * v12 + b2 * b2 * v11) / (v11 * v22 - v12 * v12)
    return models.select(*keys, wald.alias("wald"), F.lit(2).cast("bigint").alias("dof"), chi2_two_df_p(wald).alias("p_value"), "n")


# --- clustered errors with unit fixed effects -------------------------------------------

def _outer_sum(df: DataFrame, keys: list[str], vector: str, p: int, name: str) -> DataFrame:
    pairs = _packed(p)
    sums = df.groupBy(*keys).agg(*[F.sum(F.col(vector)[i] * F.col(vector)[j]).alias(f"_m{k}") for k, (i, j) in enumerate(pairs)])
    return sums.select(*keys, F.array(*[f"_m{k}" for k in range(len(pairs))]).alias(name))


def _cluster_result(keys: list[str], names: list[str], df: DataFrame) -> DataFrame:
    """Map slopes and sandwich back from standardised columns; one cluster has no covariance."""
    p = len(names)

    def solve(row):
        inverse, _ = pseudo_inverse(_square(row.bread, p))
        g, n = row.n_clusters, row.n_rows
        k = p + g
        factor = g / (g - 1.0) * (n - 1.0) / (n - k) if g > 1 and n > k else math.nan
        back = np.asarray(row.factor, dtype=float)
        cov = factor * np.outer(back, back) * (inverse @ _square(row.meat, p) @ inverse)
        return [(names, (back * np.asarray(row.solution)).tolist(), cov.ravel().tolist(), int(n), int(g))]

    return _solve_rows(df, keys, _MODEL_FIELDS + [T.StructField("n_clusters", T.LongType())], solve)


def cluster_ols(df: DataFrame, keys: list[str], unit: str, predictors: list[str], outcome: str) -> DataFrame:
    """OLS with unit fixed effects and cluster-robust covariance, from moments and one pass.

    Per-unit cross-products give the within-unit Gram matrix, the slopes, and
    also each unit's score: s_u = c_u - W_u b.  The rows are not read again.
    """
    p = len(predictors)
    rows, stats = _standardise(df, keys, [*predictors, outcome], kept=[unit])
    per_unit = gram(rows, [*keys, unit], [f"_z{i}" for i in range(p + 1)])
    scale = F.col("_scale")
    factors = stats.select(*keys, F.array(*[scale[p] / scale[i] for i in range(p)]).alias("factor"))

    def within(row):
        g = _square(row.gram, p + 2)
        w = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0]
        return [([w[i, j] for i, j in _packed(p + 1)], float(g[0, 0]))]

    fields = [T.StructField("within", _DOUBLES), T.StructField("rows", T.DoubleType())]
    units = cut_lineage(_solve_rows(per_unit, [*keys, unit], fields, within))
    counts = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("rows").alias("n_rows"))
    total = add_arrays(units, keys, "within", (p + 1) * (p + 2) // 2)

    def slopes(row):
        w = _square(row.within, p + 1)
        return [((pseudo_inverse(w[:p, :p])[0] @ w[:p, p]).tolist(), [w[i, j] for i, j in _packed(p)])]

    fit = _solve_rows(total, keys, [T.StructField("solution", _DOUBLES), T.StructField("bread", _DOUBLES)], slopes)

    def score(row):
        w = _square(row.within, p + 1)
        return [((w[:p, p] - w[:p, :p] @ np.asarray(row.solution)).tolist(),)]

    scores = _solve_rows(attach_few(units, fit, keys), [*keys, unit], [T.StructField("score", _DOUBLES)], score)
    meat = _outer_sum(scores, keys, "score", p, "meat")
    return _cluster_result(keys, predictors, attach(attach(attach(fit, meat, keys), counts, keys), factors, keys))


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


#: rows of a unit that one task takes at once; larger units are cut into parts
UNIT_ROWS = 50_000
#: bytes of rows in a partition of blocks, about
BLOCK_BYTES = 64 << 20


def _unit_blocks(rows: DataFrame, p: int, n_rows: int) -> DataFrame:
    """Rows of ``_m``, ``_unit``, ``_u``, ``_part``, ``_y``, ``_z0``, ... as blocks of whole units or parts of one; written out.

    A block belongs to one model and holds ``x`` and ``y`` as bytes and the rows
    of each of its units.  Units whose outcome is constant are left out.
    """
    z = [f"_z{i}" for i in range(p)]
    at = ["_m", "_unit", "_part"]

    def cut(table: pa.Table, last: bool) -> tuple[list, pa.Table]:
        """Blocks of the complete runs of equal ``at``, and the rows after them."""
        codes = [table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in at]
        change = reduce(lambda a, b: a | b, [c[1:] != c[:-1] for c in codes])
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        end = table.num_rows if last else int(starts[-1])
        starts = starts[starts < end]
        if not len(starts):
            return [], table
        x = np.column_stack([table[c].to_numpy()[:end] for c in z])
        y = table["_y"].to_numpy()[:end]
        sizes, seen = np.diff(np.append(starts, end)), ~np.isnan(y)
        ones, n = np.add.reduceat(np.where(seen, y, 0.0), starts), np.add.reduceat(seen.astype(float), starts)
        parts = table["_u"].take(starts).to_pylist()
        model = table["_m"].to_numpy()[starts]
        whole = np.array([u is None for u in parts])
        out = [(int(model[i]), parts[i], slice(starts[i], starts[i] + sizes[i]), sizes[i:i + 1]) for i in np.flatnonzero(~whole)]
        free = whole & (ones > 0) & (ones < n)
        for one in np.unique(model[free]).tolist():
            mine = free & (model == one)
            out.append((one, None, np.repeat(mine, sizes), sizes[mine]))
        found = [(one, u, np.ascontiguousarray(x[rows]).tobytes(), np.ascontiguousarray(y[rows]).tobytes(), size.astype(np.int64).tobytes()) for one, u, rows, size in out]
        return found, table.slice(end)

    schema = pa.schema([("_m", pa.int64()), ("_u", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("sizes", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            blocks, held = cut(table if held is None else pa.concat_tables([held, table]), False)
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*blocks), schema)], schema=schema)
        if held is not None and held.num_rows:
            blocks, _ = cut(held, True)
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*blocks), schema)], schema=schema)

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows * (p + 1) * 8 // BLOCK_BYTES))
    together = rows.select(*at, "_u", "_y", *z).repartition(tasks, *at).sortWithinPartitions(*at)
    return cut_lineage(together.mapInArrow(pack, "_m bigint, _u bigint, x binary, y binary, sizes binary"))


def _unit_effects(e: np.ndarray, y: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each unit's effect at which its fitted outcomes add up to the observed ones; Newton steps within a bracket."""
    seen = ~np.isnan(y)
    ones, n = np.add.reduceat(np.where(seen, y, 0.0), starts), np.add.reduceat(seen.astype(float), starts)
    middle = np.log(ones / (n - ones))
    low, high = middle - np.maximum.reduceat(e, starts), middle - np.minimum.reduceat(e, starts)
    at = middle - np.add.reduceat(e, starts) / sizes
    for _ in range(200):
        prob = 1.0 / (1.0 + np.exp(-(np.repeat(at, sizes) + e)))
        miss = ones - np.add.reduceat(seen * prob, starts)
        slope = np.add.reduceat(seen * prob * (1.0 - prob), starts)
        low, high = np.where(miss > 0, at, low), np.where(miss < 0, at, high)
        moved = at + miss / slope
        moved = np.where((moved >= low) & (moved <= high), moved, (low + high) / 2)
        done = np.abs(moved - at) <= 1e-11 * (1.0 + np.abs(at))
        at = moved
        if done.all():
            break
    return at


def cluster_logit(
    df: DataFrame, unit: str, predictors: list[str], outcome: str, keys: list[str] | None = None,
    max_iterations: int = 30, tolerance: float = 1e-9,
) -> DataFrame:
    """Logit with unit fixed effects and cluster-robust covariance for any number of units and models.

    ``keys`` tell the models apart; all of them take their Newton steps in the
    same jobs, and models that have settled are left out of the later ones.  The
    rows of a unit are brought together once, as blocks.  The unit effects are
    eliminated: a task solves the effect of each of its units at the model's
    slopes, and what leaves it is one sum per model, of the p-by-p Schur
    complement and the gradient.  Units over ``UNIT_ROWS`` are cut into parts;
    the sums of their parts meet per unit and their effects are kept in a table,
    which takes its Newton steps along with the slopes.  Units with a constant
    outcome carry no information on the slopes.  A model without any other unit
    has no row.
    """
    keys, p = keys or [], len(predictors)
    z = [f"_z{i}" for i in range(p)]
    pairs = _packed(p)
    upper, size = tuple(zip(*pairs)), len(pairs)
    rows, stats = _standardise(df, keys, predictors, kept=[_q(unit).alias("_unit"), _q(outcome).cast("double").alias("_y")])
    scale = F.col("_scale")
    models = cut_lineage(stats.select(*keys, F.array(*[1.0 / scale[i] for i in range(p)]).alias("factor"), F.monotonically_increasing_id().alias("_m")))
    flat = attach_few(rows.select(*keys, "_unit", "_y", *z), models.select(*keys, "_m"), keys).select("_m", "_unit", "_y", *z)
    units = cut_lineage(flat.groupBy("_m", "_unit").agg(F.count(F.lit(1)).alias("_size"), F.sum("_y").alias("_ones")))
    counts = cut_lineage(units.groupBy("_m").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("_size").cast("double").alias("n_rows")))
    giants = cut_lineage(units.filter((F.col("_size") > UNIT_ROWS) & (F.col("_ones") > 0) & (F.col("_ones") < F.col("_size"))).select(
        "_m", "_unit", F.monotonically_increasing_id().alias("_u"), F.ceil(F.col("_size") / UNIT_ROWS).alias("_parts"),
        F.log((F.col("_ones") + 0.5) / (F.col("_size") - F.col("_ones") + 0.5)).alias("_alpha")))
    # a row with a null among its predictors adds nothing to the sums
    flat = flat.na.drop(subset=z)
    cut_up = not giants.isEmpty()
    if cut_up:
        flat = attach_few(cut_lineage(flat), giants.select("_m", "_unit", "_u", "_parts"), ["_m", "_unit"], "left")
        flat = flat.withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")), F.lit(0).cast("bigint")))
    else:
        flat = flat.withColumns({"_u": F.lit(None).cast("bigint"), "_part": F.lit(0).cast("bigint")})
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    blocks = _unit_blocks(flat, p, int(total))
    effects = giants.select("_u", "_alpha")
    state = cut_lineage(models.select("_m", F.array(*[F.lit(0.0)] * p).alias("_beta"), F.lit(True).alias("_open")))

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        parts = []
        for data in batches:
            for row in data.itertuples(index=False):
                one, u, x, y, sizes, beta, alpha = row
                x, y, sizes = np.frombuffer(x).reshape(-1, p), np.frombuffer(y), np.frombuffer(sizes, dtype=np.int64)
                starts = np.cumsum(sizes) - sizes
                whole = pd.isna(u)
                with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                    e = x @ np.asarray(beta, dtype=float)
                    effect = np.repeat(_unit_effects(e, y, starts, sizes), sizes) if whole else alpha
                    prob = 1.0 / (1.0 + np.exp(-(effect + e)))
                weight, error = prob * (1.0 - prob), np.where(np.isnan(y), 0.0, y - prob)
                wx = weight[:, None] * x
                d, ga = np.add.reduceat(weight, starts), np.add.reduceat(error, starts)
                b, gb = np.add.reduceat(wx, starts, axis=0), np.add.reduceat(error[:, None] * x, starts, axis=0)
                a = (x.T @ wx)[upper]
                if whole:
                    part = eliminated(d, ga, b, gb, a)
                    held[one] = held[one] + part if one in held else part
                else:
                    parts.append((one, int(u), np.concatenate([d, ga, b[0], gb[0], a]).tolist()))
            if parts:
                yield pd.DataFrame(parts, columns=["_m", "_u", "sums"]).astype({"_u": "Int64"})
                parts = []
        if held:
            yield pd.DataFrame({"_m": list(held), "_u": pd.array([None] * len(held), dtype="Int64"), "sums": [v.tolist() for v in held.values()]})

    def eliminated(d: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Number of units, Schur complement, gradient and outer products of the scores."""
        share = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)
        schur = a - (b.T @ (b * share[:, None]))[upper]
        return np.concatenate([[len(d)], schur, gb.sum(axis=0) - b.T @ (ga * share), (gb.T @ gb)[upper]])

    def giant(row):
        v = np.asarray(row.sums, dtype=float)
        d, ga, b, gb, a = v[:1], v[1:2], v[2:2 + p], v[2 + p:2 + 2 * p], v[2 + 2 * p:]
        return [(eliminated(d, ga, b[None], gb[None], a).tolist(),)]

    def model_sums(open_models: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Newton terms per model, and the sums of the units that are cut into parts."""
        met = attach_few(blocks, open_models.select("_m", "_beta"), ["_m"])
        met = attach_few(met, effects, ["_u"], "left") if cut_up else met.withColumn("_alpha", F.lit(None).cast("double"))
        found = cut_lineage(met.select("_m", "_u", "x", "y", "sizes", "_beta", "_alpha").mapInPandas(terms, "_m bigint, _u bigint, sums array<double>"))
        per_model, cut_units = found.filter("_u is null").select("_m", "sums"), None
        if cut_up:
            cut_units = cut_lineage(add_arrays(found.filter("_u is not null"), ["_m", "_u"], "sums", 2 + 2 * p + size))
            per_model = per_model.unionByName(_solve_rows(cut_units, ["_m"], [T.StructField("sums", _DOUBLES)], giant))
        return add_arrays(per_model, ["_m"], "sums", 1 + 2 * size + p), cut_units

    def newton(row):
        v = np.asarray(row.sums, dtype=float)
        step = pseudo_inverse(_square(v[1:1 + size], p))[0] @ v[1 + size:1 + size + p]
        return [(step.tolist(), float(np.max(np.abs(step))))]

    def follow(row):
        v, step = np.asarray(row.sums, dtype=float), np.asarray(row.step, dtype=float)
        return [(float(np.clip((v[1] - step @ v[2:2 + p]) / v[0], -3.0, 3.0)),)]

    fields = [T.StructField("_step", _DOUBLES), T.StructField("_size_of_step", T.DoubleType())]
    for _ in range(max_iterations):
        sums, cut_units = model_sums(state.filter("_open"))
        steps = cut_lineage(_solve_rows(sums, ["_m"], fields, newton))
        if cut_up:
            shifts = _solve_rows(attach_few(cut_units, steps.select("_m", F.col("_step").alias("step")), ["_m"]), ["_u"], [T.StructField("_shift", T.DoubleType())], follow)
            effects = cut_lineage(attach(effects, shifts, ["_u"], "left").select("_u", (F.col("_alpha") + F.coalesce("_shift", F.lit(0.0))).alias("_alpha")))
        state = cut_lineage(attach(state, steps, ["_m"], "left").select(
            "_m", F.when(F.col("_step").isNotNull(), F.zip_with("_beta", "_step", lambda b, s: b + s)).otherwise(F.col("_beta")).alias("_beta"),
            F.coalesce(F.col("_size_of_step") >= tolerance, F.lit(False)).alias("_open"),
        ))
        if state.filter("_open").isEmpty():
            break
    else:
        raise RuntimeError(f"a logit did not settle in {max_iterations} steps; its outcome may be separated")
    final = model_sums(state)[0].select("_m", F.slice("sums", 2, size).alias("bread"), F.slice("sums", 2 + size + p, size).alias("meat"))
    for table in (counts, state.select("_m", F.col("_beta").alias("solution")), models):
        final = attach(final, table, ["_m"])
    return _cluster_result(keys, predictors, final)


# --- one model per unit ------------------------------------------------------------------

def unit_slopes_ols(df: DataFrame, unit: str, predictors: list[str], outcome: str) -> DataFrame:
    """Least-squares coefficients per unit; singular units give null."""
    p = len(predictors) + 1
    stats = gram(df, [unit], [*predictors, outcome])

    def solve(row):
        g = _square(row.gram, p + 1)
        scale = np.sqrt(np.maximum(np.diag(g)[:p], 1e-300))
        a = g[:p, :p] / np.outer(scale, scale)
        if g[0, 0] < p or np.linalg.cond(a) > 1e12:
            return [(None,)]
        return [((np.linalg.solve(a, g[:p, p] / scale) / scale).tolist(),)]

    fits = _solve_rows(stats, [unit], [T.StructField("beta", _DOUBLES)], solve)
    return fits.select(unit, *[F.col("beta")[i + 1].alias(f"slope_{i}") for i in range(p - 1)])


def unit_slopes_logit(df: DataFrame, unit: str, predictors: list[str], outcome: str, iterations: int = 12) -> DataFrame:
    """Binomial fit per unit by Newton steps over the unit table of coefficients.

    ``largest_step`` is the size of the last step: separated units keep moving
    and are recognised by it, they are not dropped.
    """
    p = len(predictors) + 1
    rows = df.select(unit, *[_q(c) for c in predictors], _q(outcome).cast("double").alias("_y"))
    terms = [F.lit(1.0)] + [_q(c).cast("double") for c in predictors]
    pairs = _packed(p)
    state = cut_lineage(rows.groupBy(unit).agg(
        F.array(F.log((F.sum("_y") + 0.5) / (F.count(F.lit(1)) - F.sum("_y") + 0.5)), *[F.lit(0.0)] * (p - 1)).alias("beta")
    ))

    def solve(row):
        beta = np.asarray(row.beta, dtype=float)
        h = _square(row.hessian, p)
        scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
        a = h / np.outer(scale, scale) + 1e-12 * np.eye(p)
        step = np.linalg.solve(a, np.asarray(row.gradient) / scale) / scale
        size = float(np.max(np.abs(step * np.maximum(scale / np.sqrt(max(h[0, 0], 1e-300)), 1e-12))))
        if size > 5.0:
            step = step * (5.0 / size)
        return [((beta + step).tolist(), size)]

    fields = [T.StructField("beta", _DOUBLES), T.StructField("largest_step", T.DoubleType())]
    for _ in range(iterations):
        joined = rows.join(state.select(unit, "beta"), unit)
        prob = _sigmoid(_fitted(terms, "beta"))
        sums = joined.withColumn("_p", prob).groupBy(unit).agg(
            F.first("beta").alias("beta"),
            F.array(*[F.sum((F.col("_y") - F.col("_p")) * t) for t in terms]).alias("gradient"),
            F.array(*[F.sum(F.col("_p") * (1.0 - F.col("_p")) * terms[i] * terms[j]) for i, j in pairs]).alias("hessian"),
        )
        state = cut_lineage(_solve_rows(sums, [unit], fields, solve))
        if state.filter(F.col("largest_step") > 1e-8).isEmpty():
            break
    return state.select(unit, *[F.col("beta")[i + 1].alias(f"slope_{i}") for i in range(p - 1)], "largest_step")


# --- generalised estimating equations -----------------------------------------------------

def gee_exchangeable(
    df: DataFrame, unit: str, predictors: list[str], outcome: str, binomial: bool | Column, keys: list[str] | None = None,
    max_iterations: int = 60, tolerance: float = 1e-10,
) -> DataFrame:
    """GEE with exchangeable working correlation and sandwich covariance.

    ``keys`` tell the models apart, and ``binomial`` may be a column that is
    constant within a model.  Every model has its own correlation and leaves the
    iteration when it has settled.  The inverse of the exchangeable matrix is the
    identity minus a rank-one term, so each unit is described by a few weighted
    sums: one aggregate over the rows per iteration, then one over the units.
    """
    keys = keys or []
    names = ["Intercept", *predictors]
    p = len(names)
    pairs = _packed(p)
    terms = [F.lit(1.0)] + [_q(c).cast("double") for c in predictors]
    family = F.lit(binomial) if isinstance(binomial, bool) else binomial
    rows = df.select(*keys, unit, *[_q(c) for c in predictors], _q(outcome).cast("double").alias("_y"), family.alias("_binomial"))

    def unit_sums(models: DataFrame) -> DataFrame:
        eta = reduce(add, [F.col("_beta")[i] * terms[i] for i in range(p)])
        out = attach_few(rows, models.select(*keys, "_beta"), keys)
        out = out.withColumn("_mu", F.when(F.col("_binomial"), _sigmoid(eta)).otherwise(eta))
        out = out.withColumn("_v", F.when(F.col("_binomial"), F.col("_mu") * (1.0 - F.col("_mu"))).otherwise(1.0))
        root = F.sqrt("_v")
        r = (F.col("_y") - F.col("_mu")) / root
        return cut_lineage(out.groupBy(*keys, unit).agg(
            F.count(F.lit(1)).cast("double").alias("_m"), F.sum(r).alias("_r1"), F.sum(r * r).alias("_r2"),
            F.array(*[F.sum(root * t) for t in terms]).alias("_u"),
            F.array(*[F.sum((F.col("_y") - F.col("_mu")) * t) for t in terms]).alias("_g"),
            F.array(*[F.sum(F.col("_v") * terms[i] * terms[j]) for i, j in pairs]).alias("_h"),
        ))

    def correlations(sums: DataFrame) -> DataFrame:
        whole = sums.groupBy(*keys).agg(
            F.sum("_m").alias("n_"), F.sum("_r2").alias("_ss"), F.sum((F.col("_r1") ** 2 - F.col("_r2")) / 2.0).alias("_cross"),
            F.sum(F.col("_m") * (F.col("_m") - 1.0) / 2.0).alias("_pairs"), F.count(F.lit(1)).alias("units_"),
        )
        rho = F.col("_cross") / (F.col("_ss") / (F.col("n_") - p)) / (F.col("_pairs") - p)
        return whole.select(*keys, rho.alias("rho_"), "n_", "units_")

    c = F.col("rho_") / (1.0 + (F.col("_m") - 1.0) * F.col("rho_"))
    inv = 1.0 / (1.0 - F.col("rho_"))
    bread = [inv * (F.col("_h")[k] - c * F.col("_u")[i] * F.col("_u")[j]) for k, (i, j) in enumerate(pairs)]
    score = [inv * (F.col("_g")[i] - c * F.col("_u")[i] * F.col("_r1")) for i in range(p)]

    def step(row):
        inverse, _ = pseudo_inverse(_square(row.bread_, p))
        beta = np.asarray(row.start_, dtype=float)
        move = inverse @ np.asarray(row.score_, dtype=float)
        cov = inverse @ _square(row.meat_, p) @ inverse
        return [(names, (beta + move).tolist(), beta.tolist(), cov.ravel().tolist(), int(row.n_), int(row.units_), float(row.rho_), float(np.max(np.abs(move))))]

    fields = [_MODEL_FIELDS[0], T.StructField("_beta", _DOUBLES), *_MODEL_FIELDS[1:], T.StructField("n_units", T.LongType()),
              T.StructField("working_correlation", T.DoubleType()), T.StructField("_moved", T.DoubleType())]
    start = rows.groupBy(*keys).agg(F.avg("_y").alias("_s"), F.first("_binomial").alias("_b"))
    first = F.when(F.col("_b"), F.log(F.col("_s") / (1.0 - F.col("_s")))).otherwise(F.col("_s"))
    models = cut_lineage(start.select(*keys, F.array(first, *[F.lit(0.0)] * (p - 1)).alias("_beta")))
    settled = None
    for iteration in range(max_iterations):
        sums = unit_sums(models)
        rho = correlations(sums)
        rho = cut_lineage(rho if iteration else rho.withColumn("rho_", F.lit(0.0)))
        totals = attach_few(sums, rho, keys).groupBy(*keys).agg(
            F.array(*[F.sum(e) for e in bread]).alias("bread_"), F.array(*[F.sum(e) for e in score]).alias("score_"),
            F.array(*[F.sum(score[i] * score[j]) for i, j in pairs]).alias("meat_"),
        )
        both = attach(attach(totals, rho, keys), models.select(*keys, F.col("_beta").alias("start_")), keys)
        stepped = cut_lineage(_solve_rows(both, keys, fields, step))
        done = F.col("_moved") < tolerance if iteration else F.lit(False)
        ready = stepped.filter(done)
        settled = ready if settled is None else settled.unionByName(ready)
        models = stepped.filter(~done)
        if models.isEmpty():
            break
    else:
        raise RuntimeError(f"estimating equations did not settle in {max_iterations} steps")
    return settled.drop("_beta", "_moved")


# --- held-out prediction ------------------------------------------------------------------

def _ridge(g: np.ndarray, numeric: list[int], features: list[int], target: int, alphas) -> list[tuple[float, float, list[float]]]:
    """Ridge from a Gram matrix over [1, columns]: standardise numeric columns, free intercept.

    Returns (alpha, intercept, slopes on the original scale).
    """
    n = g[0, 0]
    means = g[0] / n
    centred = g - n * np.outer(means, means)
    scale = np.ones(len(g))
    for i in numeric:
        sd = math.sqrt(max(centred[i, i], 0.0) / n)
        scale[i] = sd if sd > 1e-12 * max(1.0, abs(means[i])) else 1.0
    f = np.asarray(features)
    x = centred[np.ix_(f, f)] / np.outer(scale[f], scale[f])
    y = centred[f, target] / scale[f]
    out = []
    for a in alphas:
        w = np.linalg.solve(x + a * np.eye(len(f)), y) / scale[f]
        out.append((float(a), float(means[target] - means[f] @ w), w.tolist()))
    return out


def _ridge_fields() -> list[T.StructField]:
    return [
        T.StructField("model", T.StringType()), T.StructField("alpha", T.DoubleType()),
        T.StructField("intercept", T.DoubleType()), T.StructField("weights", _DOUBLES), T.StructField("n_train", T.LongType()),
    ]


def _fold_ridges(
    folds: DataFrame, total: DataFrame, keys: list[str], fold_keys: list[str], columns: list[str],
    numeric: list[str], models: dict[str, list[str]], alpha: float,
) -> DataFrame:
    """Ridge per held-out fold: total minus fold cross-products.  Unused columns get weight 0."""
    size = len(columns) + 2
    place = {c: i + 1 for i, c in enumerate(columns)}
    joined = attach(folds, total.withColumnRenamed("gram", "total"), keys)

    def solve(row):
        g = _square(np.asarray(row.total) - np.asarray(row.gram), size)
        out = []
        for name, used in models.items():
            f = [place[c] for c in used]
            a, b0, w = _ridge(g, [place[c] for c in used if c in numeric], f, size - 1, [alpha])[0]
            full = np.zeros(len(columns))
            full[[i - 1 for i in f]] = w
            out.append((name, a, b0, full.tolist(), int(round(g[0, 0]))))
        return out

    return _solve_rows(joined, [*keys, *fold_keys], _ridge_fields(), solve)


def _stable(df: DataFrame, keys: list[str], kept: list[str], numeric: list[str], dummies: list[str], outcome: str) -> DataFrame:
    """Numeric columns and outcome (``_y``) standardised per key, dummies as given, plus ``observed``.

    Standardising on training rows afterwards undoes the shift and the scale, so
    the fits are those of the raw columns without their loss of digits.
    """
    plain = [*kept, *[_q(c).cast("double").alias(c) for c in dummies], _q(outcome).cast("double").alias("observed")]
    rows = standardised(df, keys, [*numeric, outcome], kept=plain)
    n = len(numeric)
    return rows.withColumns({**{c: F.col(f"_z{i}") for i, c in enumerate(numeric)}, "_y": F.col(f"_z{n}"), "_my": F.col("_mean")[n], "_sy": F.col("_scale")[n]}).drop(
        "_mean", "_scale", *[f"_z{i}" for i in range(n + 1)]
    )


def leave_unit_out_ridge(
    df: DataFrame, keys: list[str], unit: str, numeric: list[str], dummies: list[str],
    models: dict[str, list[str]], outcome: str, alpha: float = 1.0,
) -> DataFrame:
    """Held-out predictions, each unit predicted by a ridge fitted on all others.

    ``models`` maps a name to its columns, drawn from ``numeric`` (standardised
    on the training rows) and ``dummies``.
    """
    columns = [*numeric, *dummies]
    rows = _stable(df, keys, [unit], numeric, dummies, outcome)
    per_unit = gram(rows, [*keys, unit], [*columns, "_y"])
    size = len(columns) + 2
    total = add_arrays(per_unit, keys, "gram", size * (size + 1) // 2)
    fits = _fold_ridges(per_unit, total, keys, [unit], columns, numeric, models, alpha)
    scored = rows.join(fits, [*keys, unit])
    return scored.select(*keys, unit, "model", "observed", (F.col("_my") + F.col("_sy") * _predict(columns)).alias("predicted"))


def _predict(columns: list[str]) -> Column:
    out = F.col("intercept")
    for i, c in enumerate(columns):
        out = out + F.col("weights")[i] * _q(c)
    return out


def assign_folds(df: DataFrame, keys: list[str], unit: str, n_folds: int, repeats: int, seed) -> DataFrame:
    """Balanced folds per repeat: units in hash order, the first n mod k folds one larger."""
    spread = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    spread = spread.withColumn("_u", uniform(seed, "repeat", unit))
    placed = row_index(spread, [*keys, "repeat"], ["_u", unit], "_i", total="_t")
    i, t = F.col("_i") - 1, F.col("_t")
    small, rest = F.floor(t / n_folds), t % n_folds
    edge = rest * (small + 1)
    fold = F.when(i < edge, F.floor(i / (small + 1))).otherwise(rest + F.floor((i - edge) / F.greatest(small, F.lit(1))))
    return placed.withColumn("fold", fold.cast("int")).drop("_u", "_i", "_t")


def repeated_fold_ridge(
    df: DataFrame, keys: list[str], unit: str, numeric: list[str], dummies: list[str],
    models: dict[str, list[str]], outcome: str, n_folds: int = 10, repeats: int = 10, seed="folds", alpha: float = 1.0,
) -> DataFrame:
    """Held-out predictions of repeated k-fold ridge: one row per unit, repeat and model."""
    columns = [*numeric, *dummies]
    rows = _stable(df, keys, [unit], numeric, dummies, outcome)
    # folds are drawn on a narrow table and the rows copied per repeat on the way into the sums only
    folds = cut_lineage(assign_folds(rows.select(*keys, unit).distinct(), keys, unit, n_folds, repeats, seed))
    folded = rows.join(folds, [*keys, unit])
    per_fold = gram(folded, [*keys, "repeat", "fold"], [*columns, "_y"])
    total = gram(rows, keys, [*columns, "_y"])
    fits = _fold_ridges(per_fold, total, keys, ["repeat", "fold"], columns, numeric, models, alpha)
    scored = folded.join(fits, [*keys, "repeat", "fold"])
    return scored.select(
        *keys, "repeat", "fold", unit, "model", "n_train", "observed", (F.col("_my") + F.col("_sy") * _predict(columns)).alias("predicted"))


def _block_product(rows: DataFrame, fits: DataFrame, work, schema: str, rows_per_block: int, fits_per_block: int) -> DataFrame:
    """``work(rows, fits)`` for every block of rows with every block of fits, inside tasks.

    Both tables must be written out.  A hold-out over units needs every row
    against every fit; in blocks the work is matrix products, and what leaves a
    task is one partial result per fit.
    """
    n_rows, n_fits = rows.count(), fits.count()
    row_blocks, fit_blocks = max(1, -(-n_rows // rows_per_block)), max(1, -(-n_fits // fits_per_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = F.monotonically_increasing_id()
    left = rows.withColumn("_rb", F.pmod(place, F.lit(row_blocks)).cast("int")).withColumn("_fb", every(fit_blocks))
    right = fits.withColumn("_fb", F.pmod(place, F.lit(fit_blocks)).cast("int")).withColumn("_rb", every(row_blocks))

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return work(a, b)

    return left.groupBy("_rb", "_fb").cogroup(right.groupBy("_rb", "_fb")).applyInPandas(both, schema)


def _own(units: pd.Series, fitted: pd.Series) -> np.ndarray:
    """Place of each row's unit among the fitted units, -1 if it is not there; any type of id."""
    return pd.Index(fitted).get_indexer(units)


#: bound of the fourth derivative of the logistic function
_FOURTH = 0.14
#: products of four columns up to which held-out logits are expanded
EXPANSION_TERMS = 50_000


def _products_of(q: int, order: int) -> np.ndarray:
    """Places of all products of ``order`` out of ``q`` columns."""
    return np.array(list(combinations_with_replacement(range(q), order))).reshape(-1, order)


def _symmetric(packed: np.ndarray, q: int, order: int) -> np.ndarray:
    out, place = np.zeros((q,) * order), _products_of(q, order)
    for turn in permutations(range(order)):
        out[tuple(place[:, turn].T)] = packed
    return out


def logit_expansion(x: np.ndarray, y: np.ndarray, slope: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """Sums over the rows for the gradient of a logit around ``slope``: orders 1 to 4, packed one after the other."""
    q = x.shape[1]
    steps = []
    for order in range(2, 5):
        shorter = {tuple(v): i for i, v in enumerate(_products_of(q, order - 1).tolist())}
        place = _products_of(q, order)
        steps.append(([shorter[tuple(v)] for v in place[:, :-1].tolist()], place[:, -1]))
    out, rows = 0.0, max(1, cells // max(1, len(steps[-1][0])))
    for start in range(0, len(x), rows):
        z = x[start : start + rows]
        p = 1.0 / (1.0 + np.exp(-(z @ slope)))
        v = p * (1.0 - p)
        product, parts = z, [(y[start : start + rows] - p) @ z]
        for weight, (shorter, last) in zip((v, v * (1.0 - 2.0 * p), v * (1.0 - 6.0 * v)), steps):
            product = product[:, shorter] * z[:, last]
            parts.append(weight @ product)
        out = out + np.concatenate(parts)
    return out


def leave_unit_out_logistic(
    df: DataFrame, unit: str, numeric: list[str], dummies: list[str], models: dict[str, list[str]], outcome: str,
    c: float = 1.0, iterations: int = 25, tolerance: float = 1e-8, folds_per_block: int = 512, rows_per_block: int = 20_000,
    expand: bool = True,
) -> DataFrame:
    """Held-out probabilities, each unit predicted by an L2 logistic fit on all others.

    The fits are a table with one row per unit and model.  They begin at the fit
    on all rows.  Around it the gradient over all rows is a polynomial whose sums
    are taken once, so a Newton step of a fit needs the exact terms of its own
    unit's rows only and all steps read each row once.  What the polynomial
    leaves out is bounded for every fit.  Fits whose coefficients it could move
    by ``tolerance`` or more (units with a large share of the rows) go on with
    exact steps: those multiply blocks of rows with blocks of fits, leave out
    each fit's own unit, add the partial sums per fit and solve them in tasks;
    settled fits leave the table.  Training means and SDs come from sums.
    """
    columns = [*numeric, *dummies]
    p = len(columns) + 1
    rows = _stable(df, [], [_q(unit).alias("_unit")], numeric, dummies, outcome)
    rows = cut_lineage(rows.select("_unit", *[_q(x).alias(f"_x{i}") for i, x in enumerate(columns)], F.col("observed").alias("_y")))
    names = [f"_x{i}" for i in range(p - 1)]
    moments = cut_lineage(gram(rows, ["_unit"], names))
    total = np.asarray(add_arrays(moments, [], "gram", p * (p + 1) // 2).first()["gram"], dtype=float)
    total = np.zeros(p * (p + 1) // 2) if np.isnan(total).any() else total  # no rows
    kept = {name: np.asarray([0] + [columns.index(x) + 1 for x in used]) for name, used in models.items()}
    packed = {name: tuple(np.asarray(v) for v in zip(*_packed(len(q)))) for name, q in kept.items()}

    def scaling(packed: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Means and SDs of a model's columns, the constant first."""
        g, mean, scale = _square(packed, p), np.zeros(p), np.ones(p)
        for x in models[name]:
            if x in numeric and g[0, 0] > 0:
                i = columns.index(x) + 1
                mean[i] = g[0, i] / g[0, 0]
                sd = math.sqrt(max(g[i, i] / g[0, 0] - mean[i] ** 2, 0.0))
                scale[i] = sd if sd > 0 else 1.0
        return mean[kept[name]], scale[kept[name]]

    fields = [T.StructField("model", T.StringType())] + [T.StructField(f, _DOUBLES) for f in ("mean", "scale", "beta")] + [
        T.StructField("largest", T.DoubleType())]

    def to_raw(mean: np.ndarray, scale: np.ndarray, beta: np.ndarray) -> np.ndarray:
        return np.concatenate([[beta[0] - (beta[1:] * mean[1:] / scale[1:]).sum()], beta[1:] / scale[1:]])

    def to_scaled(mean: np.ndarray, scale: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.concatenate([[slope[0] + slope[1:] @ mean[1:]], slope[1:] * scale[1:]])

    def moved(g: np.ndarray, h: np.ndarray, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """A Newton step from raw sums: new coefficients, size of the step, and the map from a raw gradient to a step."""
        # raw sums to standardised ones: z = T x with T lower triangular in the constant
        t = np.diag(1.0 / scale)
        t[1:, 0] = -mean[1:] / scale[1:]
        penalty = np.full(len(beta), 1.0 / c)
        penalty[0] = 0.0
        inverse = pseudo_inverse(t @ h @ t.T + np.diag(penalty))[0]
        move = inverse @ (t @ g - penalty * beta)
        return beta + move, float(np.max(np.abs(move))), inverse @ t

    def over_rows(work, sizes: dict[str, int], together=np.add, across=F.sum) -> dict[str, np.ndarray]:
        """``work(model, x, y)`` added up over all rows for each model of ``sizes``; one partial result per task and model."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[str, np.ndarray] = {}
            for data in batches:
                x, y = np.column_stack([np.ones(len(data)), data[names].to_numpy(float)]), data["_y"].to_numpy(float)
                for name in sizes if len(data) else ():
                    part = work(name, x[:, kept[name]], y)
                    held[name] = together(held[name], part) if name in held else part
            if held:
                yield pd.DataFrame({"model": list(held), "v": [v.tolist() for v in held.values()]})

        parts = rows.mapInPandas(run, "model string, v array<double>")
        added = parts.select("model", F.posexplode("v").alias("i", "v")).groupBy("model", "i").agg(across("v").alias("v"))
        out = {name: np.zeros(size) for name, size in sizes.items()}
        for r in added.collect():
            out[r.model][r.i] = r.v
        return out

    # the fit on all rows, in raw coefficients
    whole: dict[str, np.ndarray] = {}
    state = {name: (*scaling(total, name), np.zeros(len(q))) for name, q in kept.items()}
    for _ in range(iterations):
        def first_two(name, x, y):
            first, second = packed[name]
            prob = 1.0 / (1.0 + np.exp(-(x @ to_raw(*state[name]))))
            return np.concatenate([(y - prob) @ x, (prob * (1.0 - prob)) @ (x[:, first] * x[:, second])])

        sums_of = over_rows(first_two, {name: len(kept[name]) + len(packed[name][0]) for name in state})
        for name, v in sums_of.items():
            mean, scale, beta = state.pop(name)
            q = len(beta)
            beta, size, _ = moved(v[:q], _square(v[q:], q), mean, scale, beta)
            if size < tolerance:
                whole[name] = to_raw(mean, scale, beta)
            else:
                state[name] = (mean, scale, beta)
        if not state:
            break
    else:
        raise RuntimeError(f"the logits on all rows did not settle in {iterations} steps")

    at = ["_unit", "model"]
    raw_fields = [T.StructField("model", T.StringType()), *[T.StructField(f, _DOUBLES) for f in ("mean", "scale", "slope")],
                  T.StructField("largest", T.DoubleType()), T.StructField("wrong", T.DoubleType())]

    def expanded(name_list: list[str]) -> DataFrame:
        """Fits whose polynomial is good to ``tolerance``: unit, model, ``slope`` (raw, all columns)."""
        sizes = {name: sum(math.comb(len(kept[name]) + k - 1, k) for k in range(1, 5)) for name in name_list}
        sums_of = over_rows(lambda name, x, y: logit_expansion(x, y, whole[name]), sizes)
        tensors, inverses, grams = {}, {}, {}
        for name, v in sums_of.items():
            q, tensors[name], start = len(kept[name]), [], 0
            for order in range(1, 5):
                end = start + math.comb(q + order - 1, order)
                tensors[name].append(_symmetric(v[start:end], q, order))
                start = end
            grams[name] = _square(total, p)[np.ix_(kept[name], kept[name])]
            inverses[name] = pseudo_inverse(grams[name])[0]
        widest_of = over_rows(
            lambda name, x, y: np.append(np.abs(x).max(axis=0), np.einsum("ij,jk,ik->i", x, inverses[name], x).max()),
            {name: len(kept[name]) + 1 for name in name_list}, np.maximum, F.max)

        def near(row):
            name = row.model
            q, (t1, t2, t3, t4), reach = kept[name], tensors[name], widest_of[name]
            mean, scale, slope = np.asarray(row.mean, dtype=float), np.asarray(row.scale, dtype=float), np.asarray(row.slope, dtype=float)[q]
            d = slope - whole[name]
            cubic = t4 @ d
            e, f = t3 @ d, cubic @ d
            own = _square(row.own_h, p)[np.ix_(q, q)]
            gradient = t1 - t2 @ d - e @ d / 2.0 - f @ d / 6.0 - np.asarray(row.own_g)[q]
            beta, size, back = moved(gradient, t2 + e + f / 2.0 - own, mean, scale, to_scaled(mean, scale, slope))
            slope = to_raw(mean, scale, beta)
            d = slope - whole[name]
            # |x d|^2 is at most s times the largest leverage, and s is the sum of its squares
            s = float(d @ grams[name] @ d)
            wrong = 2.0 * float(np.max(np.abs(back) @ (_FOURTH / 24.0 * s * s * reach[-1] * reach[:-1])))
            full = np.zeros(p)
            full[q] = slope
            return [(mean.tolist(), scale.tolist(), full.tolist(), size, wrong)]

        def begin(row):
            out = []
            for name in name_list:
                mean, scale = scaling(total - np.asarray(row.gram), name)
                full = np.zeros(p)
                full[kept[name]] = whole[name]
                out.append((name, mean.tolist(), scale.tolist(), full.tolist(), math.inf, 0.0))
            return out

        terms = [F.lit(1.0)] + [F.col(x) for x in names]
        fits, settled = cut_lineage(_solve_rows(moments, ["_unit"], raw_fields, begin)), None
        for _ in range(iterations):
            joined = join_null_safe(rows, fits.select(*at, "slope"), ["_unit"]).withColumn("_p", _sigmoid(_fitted(terms, "slope")))
            own = joined.groupBy(*at).agg(
                F.array(*[F.sum((F.col("_y") - F.col("_p")) * t) for t in terms]).alias("own_g"),
                F.array(*[F.sum(F.col("_p") * (1.0 - F.col("_p")) * terms[i] * terms[j]) for i, j in _packed(p)]).alias("own_h"))
            stepped = cut_lineage(_solve_rows(attach(fits, own, at), at, raw_fields[1:], near))
            good = stepped.filter(F.col("wrong") < tolerance)
            done = good.filter(F.col("largest") < tolerance)
            settled = done if settled is None else settled.unionByName(done)
            fits = good.filter(F.col("largest") >= tolerance)
            if fits.isEmpty():
                break
        return settled.select(*at, "slope")

    def sums(data: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, part in block.groupby("model", sort=False):
            q = kept[name]
            first, second = packed[name]
            beta, mean, scale = (np.stack(part[f].to_numpy()) for f in ("beta", "mean", "scale"))
            slope = beta / scale
            slope[:, 0] = beta[:, 0] - (slope[:, 1:] * mean[:, 1:]).sum(axis=1)
            if len(data):
                x = np.column_stack([np.ones(len(data)), data[names].to_numpy(float)])[:, q]
                own = _own(data["_unit"], part["_unit"])
                prob = 1.0 / (1.0 + np.exp(-(x @ slope.T)))
                error, weight = data["_y"].to_numpy(float)[:, None] - prob, prob * (1.0 - prob)
                mine = np.flatnonzero(own >= 0)
                error[mine, own[mine]] = 0.0
                weight[mine, own[mine]] = 0.0
                gradient, hessian = error.T @ x, weight.T @ (x[:, first] * x[:, second])
            else:
                gradient, hessian = np.zeros((len(part), len(q))), np.zeros((len(part), len(first)))
            out.append(pd.DataFrame({"_unit": part["_unit"].to_numpy(), "model": name, "g": list(gradient), "h": list(hessian)}))
        return pd.concat(out) if out else pd.DataFrame({"_unit": [], "model": [], "g": [], "h": []})

    kind = rows.schema["_unit"].dataType.simpleString()
    widest = max(len(q) for q in kept.values())
    add_up = lambda name, n: F.filter(F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(n)]), lambda v: v.isNotNull()).alias(name)

    def step(row):
        mean, scale, beta = (np.asarray(v, dtype=float) for v in (row.mean, row.scale, row.beta))
        beta, size, _ = moved(np.asarray(row.g), _square(row.h, len(beta)), mean, scale, beta)
        return [(mean.tolist(), scale.tolist(), beta.tolist(), size)]

    def newton(fits: DataFrame) -> DataFrame:
        settled = None
        for _ in range(iterations):
            partial = _block_product(rows, fits, sums, f"_unit {kind}, model string, g array<double>, h array<double>", rows_per_block, folds_per_block)
            added = partial.groupBy(*at).agg(add_up("g", widest), add_up("h", widest * (widest + 1) // 2))
            stepped = cut_lineage(_solve_rows(attach(fits, added, at), at, fields[1:], step))
            done = stepped.filter(F.col("largest") < tolerance)
            settled = done if settled is None else settled.unionByName(done)
            fits = stepped.filter(F.col("largest") >= tolerance)
            if fits.isEmpty():
                return settled
        raise RuntimeError(f"the held-out logits did not settle in {iterations} steps")

    def begin(row):
        out = []
        for name in kept:
            mean, scale = scaling(total - np.asarray(row.gram), name)
            out.append((name, mean.tolist(), scale.tolist(), to_scaled(mean, scale, whole[name]).tolist(), math.inf))
        return out

    def raw(row):
        full = np.zeros(p)
        full[kept[row.model]] = to_raw(*(np.asarray(v, dtype=float) for v in (row.mean, row.scale, row.beta)))
        return [(full.tolist(),)]

    exact = _solve_rows(moments, ["_unit"], fields, begin)
    narrow = [name for name, q in kept.items() if math.comb(len(q) + 3, 4) <= EXPANSION_TERMS]
    final = None
    if expand and narrow:
        final = cut_lineage(expanded(narrow))
        exact = join_null_safe(exact, final.select(*at), at, "left_anti")
    exact = cut_lineage(exact)
    if final is None or not exact.isEmpty():
        rest = _solve_rows(newton(exact), at, [T.StructField("slope", _DOUBLES)], raw)
        final = rest if final is None else final.unionByName(rest)
    final = final.select(*at, F.col("slope")[0].alias("intercept"), F.slice("slope", 2, p).alias("weights"))
    scored = join_null_safe(rows, final, ["_unit"])
    return scored.select(F.col("_unit").alias(unit), "model", F.col("_y").alias("observed"), _sigmoid(_predict(names)).alias("predicted"))


def _stacked_ridge(g: np.ndarray, numeric: list[int], features: list[int], target: int, alphas) -> np.ndarray:
    """``_ridge`` of a stack of Gram matrices: (matrix, alpha, [intercept, slopes]), unused columns 0."""
    n = g[:, 0, 0]
    means = g[:, 0] / n[:, None]
    centred = g - n[:, None, None] * means[:, :, None] * means[:, None, :]
    scale = np.ones(means.shape)
    for i in numeric:
        sd = np.sqrt(np.maximum(centred[:, i, i], 0.0) / n)
        scale[:, i] = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(means[:, i])), sd, 1.0)
    f = np.asarray(features)
    x = centred[:, f[:, None], f] / (scale[:, f, None] * scale[:, None, f])
    y = centred[:, f, target] / scale[:, f]
    out = np.zeros((len(g), len(alphas), target))
    for j, a in enumerate(alphas):
        w = np.linalg.solve(x + a * np.eye(len(f)), y[:, :, None])[:, :, 0] / scale[:, f]
        out[:, j, f] = w
        out[:, j, 0] = means[:, target] - _dot(means[:, f], w)
    return out


def _dot(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum over the last axis, column by column: equal inputs give equal results wherever they stand in a block."""
    return reduce(add, [x[..., c] * w[..., c] for c in range(x.shape[-1])])


def _arrays(values) -> pd.Series:
    """A column of arrays, also without rows."""
    return pd.Series(list(values), dtype=object)


def nested_ridge(
    df: DataFrame, unit: str, numeric: list[str], dummies: list[str], models: dict[str, list[str]], outcome: str,
    alphas=(0.1, 1.0, 10.0, 100.0), n_inner: int = 5, seed="inner", outers_per_block: int = 512, rows_per_block: int = 20_000,
) -> DataFrame:
    """Leave-one-unit-out ridge whose penalty is chosen by inner folds on mean absolute error.

    One row per unit.  Inner folds are fixed by hash, so the training sums of
    (outer unit, inner fold) are total - inner fold - outer unit and every
    system is solved in the task that holds the unit's sums.

    A unit moves the fit on all rows outside the inner fold, ``b``, by a small
    ``d``, or not at all if the fold holds it.  With s = sign(r) for a row's
    residual r at ``b``, |r - x'd| = |r| - s x'd but for rows with
    |r| <= |x'd|, whose residual may change its sign.  So the sums of |r| and
    s x are taken once per fold, and a fit meets only the rows with
    |r| / |x| <= |d|.  Rows and fits meet by powers of two of these sizes, in
    blocks inside tasks.  The errors are those of all rows; if most residuals
    are near zero, all rows meet all fits.  Errors are averaged within each
    inner fold and then over folds; ties keep the smaller penalty.
    """
    columns = [*numeric, *dummies]
    size, grid = len(columns) + 2, len(alphas)
    p = size - 1
    names = [f"_x{i}" for i in range(len(columns))]
    stable = _stable(df, [], [_q(unit).alias("_unit")], numeric, dummies, outcome)
    base = cut_lineage(assign_folds(
        stable.select("_unit", *[_q(x).alias(f"_x{i}") for i, x in enumerate(columns)], "_y", "observed", "_my", "_sy"), [], "_unit", n_inner, 1, seed,
    ).drop("repeat"))
    fold_sums = gram(base, ["fold"], [*names, "_y"])
    inner = {r["fold"]: np.asarray(r["gram"], dtype=float) for r in fold_sums.collect()}  # n_inner rows
    if not inner:
        inner = {0: np.zeros(size * (size + 1) // 2)}
    folds = sorted(inner)
    total = sum(inner.values())
    place = {x: i + 1 for i, x in enumerate(columns)}
    used = {name: ([place[x] for x in cols if x in numeric], [place[x] for x in cols]) for name, cols in models.items()}
    upper = _packed(size)
    kind = base.schema["_unit"].dataType.simpleString()

    def weights(grams: np.ndarray, name: str) -> np.ndarray:
        full = np.zeros((len(grams), size, size))
        for k, (i, j) in enumerate(upper):
            full[:, i, j] = full[:, j, i] = grams[:, k]
        return _stacked_ridge(full, *used[name], p, alphas)

    start = {name: {i: weights((total - inner[i])[None], name)[0] for i in folds} if len(folds) > 1 else {} for name in models}

    def design(data: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.column_stack([np.ones(len(data)), data[names].to_numpy(float)]), data["_y"].to_numpy(float)

    def residuals(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return y[:, None] - _dot(x[:, None, :], w[None])

    def level(sizes: np.ndarray) -> np.ndarray:
        """Least e with size < 2^e."""
        return np.where(sizes > 0, np.frexp(sizes)[1], -2000)

    def errors_at_start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for data in batches:
            x, y = design(data)
            fold = data["fold"].to_numpy()
            for name, fits in start.items():
                for i, w in fits.items():
                    mine = fold == i
                    r = residuals(x[mine], y[mine], w)
                    tilt = np.stack([(np.sign(r) * x[mine, c][:, None]).sum(axis=0) for c in range(p)], axis=1)
                    part = np.concatenate([[mine.sum()], np.abs(r).sum(axis=0), tilt.ravel()])
                    held[name, i] = held[name, i] + part if (name, i) in held else part
        if held:
            yield pd.DataFrame({"model": [k[0] for k in held], "fold": [k[1] for k in held], "sums": [v.tolist() for v in held.values()]})

    narrow = base.select("_unit", "fold", *names, "_y")
    at_start = add_arrays(narrow.mapInPandas(errors_at_start, "model string, fold int, sums array<double>"), ["model", "fold"], "sums", 1 + grid + grid * p)
    known = {(r["model"], r["fold"]): np.asarray(r["sums"]) for r in at_start.collect()}  # models by folds

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for data in batches:
            if not len(data):
                continue
            x, y = design(data)
            z = np.column_stack([x, y])
            own = np.stack([z[:, i] * z[:, j] for i, j in upper], axis=1)
            fold = data["fold"].to_numpy()
            for name in models:
                error = np.full((len(data), len(folds), grid), np.nan)
                moves = np.zeros((len(data), len(folds), grid, p))
                levels = np.full((len(data), len(folds)), -3000)
                for k, (i, w) in enumerate(start[name].items()):
                    sums = known[name, i]
                    whole, tilt = sums[1:1 + grid], sums[1 + grid:].reshape(grid, p)
                    inside, outside = fold == i, np.flatnonzero(fold != i)
                    if sums[0] > 1:
                        error[inside, k] = (whole - np.abs(residuals(x[inside], y[inside], w))) / (sums[0] - 1)
                    if len(outside):
                        d = weights(total - inner[i] - own[outside], name) - w
                        error[outside, k] = (whole - _dot(tilt[None], d)) / sums[0]
                        moves[outside, k] = d
                        # the margin covers the rounding of sizes and products
                        levels[outside, k] = level(np.sqrt(_dot(d, d)).max(axis=1) * (1 + 1e-6))
                yield pd.DataFrame({
                    "_unit": data["_unit"], "model": name, "error": list(error.reshape(len(data), -1)), "moves": list(moves.reshape(len(data), -1)),
                    "levels": list(levels.astype(np.int32)), "final": list(weights(total - own, name).reshape(len(data), -1)),
                })

    fits = cut_lineage(narrow.mapInPandas(
        solve, f"_unit {kind}, model string, error array<double>, moves array<double>, levels array<int>, final array<double>"))
    moved = fits.select("_unit", "model", "moves", F.posexplode("levels").alias("i", "level")).filter("level > -2000")
    moved = moved.select("_unit", "model", "i", "level", F.slice("moves", F.col("i") * (grid * p) + 1, F.lit(grid * p)).alias("move"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for data in batches:
            x, y = design(data)
            fold, length = data["fold"].to_numpy(), np.sqrt(_dot(x, x))
            for name, at in start.items():
                for k, (i, w) in enumerate(at.items()):
                    mine = fold == i
                    r = residuals(x[mine], y[mine], w)
                    yield pd.DataFrame({
                        "model": name, "i": np.int32(k), "level": level(np.abs(r).min(axis=1) / length[mine]).astype(np.int32), "x": _arrays(x[mine]), "r": _arrays(r),
                    })

    rows = cut_lineage(narrow.mapInPandas(near, "model string, i int, level int, x array<double>, r array<double>"))
    # a few rows per model, fold and power of two
    group = ["model", "i", "level"]
    asked = {tuple(r[c] for c in group): r["count"] for r in moved.groupBy(*group).count().collect()}
    there = {tuple(r[c] for c in group): r["count"] for r in rows.groupBy(*group).count().collect()}
    met = {g: sum(n for (name, i, e), n in there.items() if (name, i) == g[:2] and e <= g[2]) for g in asked}
    plan = [(*g, -(-met[g] // rows_per_block), -(-n // outers_per_block)) for g, n in asked.items() if met[g]]
    if plan:
        sent = F.broadcast(df.sparkSession.createDataFrame(plan, "model string, i int, at int, row_blocks bigint, fit_blocks bigint"))
        block = F.monotonically_increasing_id()
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        left = rows.withColumn("_place", block).join(sent, ["model", "i"]).filter("level <= at").select(
            "model", "i", "at", "x", "r", F.pmod("_place", "row_blocks").alias("_rb"), every("fit_blocks").alias("_fb"))
        right = moved.withColumnRenamed("level", "at").withColumn("_place", block).join(sent, ["model", "i", "at"]).select(
            "_unit", "model", "i", "at", "move", F.pmod("_place", "fit_blocks").alias("_fb"), every("row_blocks").alias("_rb"))

        def turned(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            """What |r - x'd| exceeds |r| - s x'd by, summed over the rows."""
            if not len(a) or not len(b):
                return pd.DataFrame({"_unit": b["_unit"][:0], "model": b["model"][:0], "i": b["i"][:0], "more": _arrays([])})
            x, r = np.stack(a["x"].to_numpy()), np.stack(a["r"].to_numpy())
            d = np.stack(b["move"].to_numpy()).reshape(len(b), grid, p)
            more, step = np.zeros((len(b), grid)), max(1, 500_000 // (len(b) * grid))
            for first in range(0, len(x), step):
                part = slice(first, first + step)
                shift = _dot(x[part, None, None, :], d[None])
                here = r[part, None, :]
                side = np.sign(here)
                more += np.where(side * shift > np.abs(here), 2.0 * (np.abs(shift) - np.abs(here)), np.where(side == 0, np.abs(shift), 0.0)).sum(axis=0)
            some = more.any(axis=1)
            return pd.DataFrame({c: b[c].to_numpy()[some] for c in ("_unit", "model", "i")} | {"more": _arrays(more[some])})

        keys = ["model", "i", "at", "_rb", "_fb"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(turned, f"_unit {kind}, model string, i int, more array<double>")
        more = found.groupBy("_unit", "model").agg(F.array(*[
            F.sum(F.when(F.col("i") == k, F.col("more")[j]).otherwise(0.0)) for k in range(len(folds)) for j in range(grid)]).alias("more"))
        fits = join_null_safe(fits, more, ["_unit", "model"], "left")
    else:
        fits = fits.withColumn("more", F.lit(None).cast("array<double>"))
    counts = np.array([[known[name, i][0] if (name, i) in known else np.nan for i in folds] for name in models])
    order = list(models)

    def choose(row):
        error = np.asarray(row.error, dtype=float).reshape(len(folds), grid)
        if row.more is not None:
            error = error + np.asarray(row.more, dtype=float).reshape(len(folds), grid) / counts[order.index(row.model)][:, None]
        best = int(np.nanargmin(np.nanmean(error, axis=0)))
        w = np.asarray(row.final).reshape(grid, p)[best]
        return [(float(alphas[best]), float(w[0]), w[1:].tolist())]

    chosen = _solve_rows(fits, ["_unit", "model"], [
        T.StructField("alpha", T.DoubleType()), T.StructField("intercept", T.DoubleType()), T.StructField("weights", _DOUBLES)], choose)
    return join_null_safe(base, chosen, ["_unit"]).select(
        F.col("_unit").alias(unit), "model", "alpha", "observed", (F.col("_my") + F.col("_sy") * _predict(names)).alias("predicted"))


def train_only_scaling(df: DataFrame, fold: str, column: str, folds: DataFrame) -> DataFrame:
    """Each fold's held-out rows, imputed and scaled with statistics of the other folds.

    Training sums are the total minus the fold; a missing value becomes the
    training mean and a zero spread divides by one.
    """
    x = F.col(column)
    sums = df.groupBy(fold).agg(F.count(x).alias("_c"), F.coalesce(F.sum(x), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("_q"))
    sums = folds.select(fold).join(sums, fold)
    total = sums.agg(F.sum("_c").alias("_tc"), F.sum("_s").alias("_ts"), F.sum("_q").alias("_tq"))
    stats = attach(sums, total, [])
    n = F.col("_tc") - F.col("_c")
    mean = (F.col("_ts") - F.col("_s")) / n
    # with mean imputation missing rows add to the count but not to the spread
    rows = df.groupBy(fold).agg(F.count(F.lit(1)).alias("_rows"))
    stats = stats.join(rows, fold)
    stats = attach(stats, stats.agg(F.sum("_rows").alias("_all")), [])
    spread = (F.col("_tq") - F.col("_q")) - n * mean * mean
    sd = F.sqrt(F.greatest(F.lit(0.0), spread) / (F.col("_all") - F.col("_rows")))
    stats = stats.select(fold, mean.alias("train_mean"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("train_sd"))
    return df.join(stats, fold).withColumn(
        "scaled", (F.coalesce(x, F.col("train_mean")) - F.col("train_mean")) / F.col("train_sd")
    )


# --- calibration, influence, partial association ------------------------------------------

def calibration_hc3(df: DataFrame, keys: list[str], observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Observed on predicted by least squares with HC3 errors, in closed form.

    Two aggregates: moments, then leverage-weighted residual sums.
    """
    x, y = F.col(predicted), F.col(observed)
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        (F.var_pop(x) * F.count(F.lit(1))).alias("_sxx"), (F.covar_pop(x, y) * F.count(F.lit(1))).alias("_sxy"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_syy"),
    ).withColumn("slope", F.col("_sxy") / F.col("_sxx")).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    rows = attach_few(df.select(*keys, predicted, observed), base, keys)
    d = x - F.col("_mx")
    leverage = 1.0 / F.col("n") + d * d / F.col("_sxx")
    e = (y - F.col("intercept") - F.col("slope") * x) / (1.0 - leverage)
    # influence of a row on slope and intercept
    on_slope = d / F.col("_sxx")
    on_intercept = 1.0 / F.col("n") - F.col("_mx") * on_slope
    errors = rows.groupBy(*keys).agg(
        F.sqrt(F.sum(e * e * on_slope * on_slope)).alias("slope_se"),
        F.sqrt(F.sum(e * e * on_intercept * on_intercept)).alias("intercept_se"),
    )
    z = 1.959963984540054
    out = attach(base, errors, keys)
    band = lambda c, s: (F.col(c) + s * z * F.col(f"{c}_se"))
    return out.select(
        *keys, "n", "intercept", "intercept_se", band("intercept", -1).alias("intercept_low"), band("intercept", 1).alias("intercept_high"),
        "slope", "slope_se", band("slope", -1).alias("slope_low"), band("slope", 1).alias("slope_high"),
        (F.col("_sxy") * F.col("_sxy") / (F.col("_sxx") * F.col("_syy"))).alias("r_squared"),
    )


def influence(df: DataFrame, ids: list[str], predictors: list[str], outcome: str, term: str) -> DataFrame:
    """Leave-one-out estimate of one coefficient and Cook's distance for every row.

    Removing a row is a rank-one change, so one fit serves all rows.
    """
    names = ["Intercept", *predictors]
    p, at = len(names), names.index(term)
    rows, stats = _standardise(df, [], [*predictors, outcome], kept=ids)
    rows = attach(rows, least_squares(rows, stats, [], p), [])
    terms = [F.lit(1.0)] + [F.col(f"_z{i}") for i in range(p - 1)]
    unit = F.col("scale")[p - 1]
    rows = rows.withColumn("_h", _leverage(terms, "inverse")).withColumn("_e", unit * (F.col(f"_z{p - 1}") - _fitted(terms, "beta")))
    own = lambda i: reduce(add, [F.col("inverse")[i * p + j] * t for j, t in enumerate(terms)])
    if at:
        direction = own(at) / F.col("scale")[at - 1]
    else:
        direction = own(0) - reduce(add, [F.col("mean")[i - 1] / F.col("scale")[i - 1] * own(i) for i in range(1, p)], F.lit(0.0))
    residual_variance = F.col("rss") / (F.col("n") - F.col("rank"))
    return rows.select(
        *ids, F.col("_h").alias("leverage"),
        (F.col("coefficients")[at] - direction * F.col("_e") / (1.0 - F.col("_h"))).alias("loo_estimate"),
        (F.col("_e") * F.col("_e") * F.col("_h") / (p * residual_variance * F.pow(1.0 - F.col("_h"), F.lit(2.0)))).alias("cooks_distance"),
    )


def variance_inflation(df: DataFrame, predictors: list[str]) -> DataFrame:
    """Diagonal of the inverse correlation matrix of the predictors."""
    p = len(predictors)
    stats = gram(standardised(df, [], predictors), [], [f"_z{i}" for i in range(p)])

    def solve(row):
        inverse, rank = pseudo_inverse(_square(row.gram, p + 1)[1:, 1:] / row.gram[0])
        # without full rank some predictor is a sum of others
        return [(t, float(v) if rank == p else math.inf) for t, v in zip(predictors, np.diag(inverse))]

    return _solve_rows(stats, [], [T.StructField("term", T.StringType()), T.StructField("vif", T.DoubleType())], solve)


def bootstrap_coefficients(
    df: DataFrame, unit: str, predictors: list[str], outcome: str, seed, replicates: int
) -> DataFrame:
    """Percentile intervals of coefficients, from the cross-products of the rows drawn in each replicate."""
    from mensura.operators.resampling import bootstrap_sums

    names = ["Intercept", *predictors]
    p = len(names)
    pairs = _packed(p + 1)
    terms = [F.lit(1.0)] + [_q(c).cast("double") for c in [*predictors, outcome]]
    products = df.select(unit, *[(terms[i] * terms[j]).alias(f"_p{k}") for k, (i, j) in enumerate(pairs)])
    sums = bootstrap_sums(products, [], unit, [f"_p{k}" for k in range(len(pairs))], seed, replicates)
    stats = sums.select("rep", F.array(*[f"s{k}" for k in range(len(pairs))]).alias("gram"))

    def solve(row):
        g = _square(row.gram, p + 1)
        beta = np.linalg.lstsq(g[:p, :p], g[:p, p], rcond=None)[0]
        return [(t, float(b)) for t, b in zip(names, beta)]

    fits = _solve_rows(stats, ["rep"], [T.StructField("term", T.StringType()), T.StructField("estimate", T.DoubleType())], solve)
    return fits.groupBy("term").agg(
        F.percentile("estimate", F.lit(0.025)).alias("ci_low"), F.percentile("estimate", F.lit(0.5)).alias("median"),
        F.percentile("estimate", F.lit(0.975)).alias("ci_high"), F.count(F.lit(1)).alias("n_replicates"),
    )


def partial_spearman(df: DataFrame, keys: list[str], x: str, y: str, covariates: list[str]) -> DataFrame:
    """Correlation of the ranks of x and y after removing the ranks of the covariates."""
    from mensura.operators.ordering import average_rank

    columns = [*covariates, x, y]
    ranked = df.na.drop(subset=columns).select(*keys, *columns)
    for i, c in enumerate(columns):
        ranked = average_rank(ranked, keys, c, f"_rank{i}")
    p = len(columns)
    stats = gram(standardised(ranked, keys, [f"_rank{i}" for i in range(p)]), keys, [f"_z{i}" for i in range(p)])

    def solve(row):
        n = row.gram[0]
        precision, rank = pseudo_inverse(_square(row.gram, p + 1)[1:, 1:] / n)
        rho = -precision[-2, -1] / math.sqrt(precision[-2, -2] * precision[-1, -1]) if rank == p else math.nan
        return [(int(n), float(rho))]

    return _solve_rows(stats, keys, [T.StructField("n", T.LongType()), T.StructField("partial_rho", T.DoubleType())], solve)
