"""Signal operators (G rows) on the hourly series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mensura.functions.scalar import reasons
from mensura.operators import graph
from mensura.operators import signal as g
from mensura.operators.aggregates import behaviour_summary, neighbour_profile, peak_to_peak, signal_summary
from mensura.operators.ordering import median_table, row_index
from mensura.plans.bindings import EV, FT, PSMP, SMP, event_types, features, pooled_samples, samples
from mensura.plans.q_aggregates import RING, nation_ring
from mensura.plans.q_functions import flag_channels
from mensura.plans.q_joins import ALLPAIRS, _NATION, nation_daily
from mensura.plans.registry import query, table
from mensura.plans.sqltext import ctes

N, FS = 24, 24.0
BINS = list(range(13))
FREQ = g.bin_frequencies(N, FS, BINS)
TARGET = 4.0


@query("g1_average_reference", "unit:i channel trial:i rms:6 peak:6",
       ctes(SMP) + """, r as (select unit, channel, trial, x - avg(x) over (partition by unit, trial, s) as x from smp)
       select unit, channel, trial, sqrt(avg(x * x)) as rms, max(abs(x)) as peak from r group by all""")
def _(spark, d):
    x = F.col("x")
    return g.average_reference(samples(spark, d), ["unit", "trial", "s"]).groupBy("unit", "channel", "trial").agg(
        F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"))


@query("g2_median_removed", "channel trial:i s:i x:6",
       ctes(PSMP) + "select channel, trial, s, x - m as x from psmp join (select channel, trial, quantile_cont(x, 0.5) as m from psmp group by all) using (channel, trial)")
def _(spark, d):
    return g.remove_median(pooled_samples(spark, d), ["channel", "trial"])


@query("g3_trimmed_slice", "unit:i channel n:i total:6",
       ctes(SMP) + "select unit, channel, count(*) as n, sum(x) as total from smp where s >= 6 and s < 18 group by all")
def _(spark, d):
    return g.trim(samples(spark, d), 6, 18).groupBy("unit", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query("g4_region_signal", "unit:i trial:i s:i x:6",
       ctes(SMP) + "select unit, trial, s, avg(x) as x from smp where channel in ('click', 'view') group by all")
def _(spark, d):
    return g.region_signal(samples(spark, d), ["click", "view"], ["unit", "trial", "s"])


@query("g5_detrended", "channel trial:i s:i x:6",
       ctes(PSMP) + """, f as (select channel, trial, regr_slope(x, s) as b, regr_intercept(x, s) as a from psmp group by all)
       select channel, trial, s, x - a - b * s as x from psmp join f using (channel, trial)""")
def _(spark, d):
    return g.detrend(pooled_samples(spark, d), ["channel", "trial"])


def _fourier(source: str, keys: str, name: str) -> str:
    """Detrended, Hann-tapered periodogram of ``source`` as rows (keys, k, re, im, p)."""
    scale = g.power_scale(N, FS, [1])[0]
    return f"""{name}_f as (select {keys}, regr_slope(x, s) as b, regr_intercept(x, s) as a from {source} group by all),
{name}_c as (select {keys}, k, sum((0.5 - 0.5 * cos(2 * pi() * s / {N})) * (x - a - b * s) * cos(2 * pi() * k * s / {N})) as re,
  -sum((0.5 - 0.5 * cos(2 * pi() * s / {N})) * (x - a - b * s) * sin(2 * pi() * k * s / {N})) as im
  from {source} join {name}_f using ({keys}), range(0, 13) t(k) group by all),
{name} as (select *, (re * re + im * im) * {scale!r} * (case when k in (0, 12) then 0.5 else 1.0 end) as p from {name}_c)"""


_SNR = f"""10 * log10((avg(case when k between {TARGET - 0.5} and {TARGET + 0.5} then p end) + 1e-30)
  / ((avg(case when k between {TARGET - 2} and {TARGET - 1} then p end) + avg(case when k between {TARGET + 1} and {TARGET + 2} then p end)) / 2 + 1e-30))"""


def _bins(df, array, keys, value="power"):
    return df.select(*keys, F.posexplode(array).alias("k", value))


@query("g6_periodogram", "channel trial:i k:i power:6", ctes(PSMP, _fourier("psmp", "channel, trial", "pg")) + "select channel, trial, k, p as power from pg")
def _(spark, d):
    return _bins(g.periodogram(pooled_samples(spark, d), ["channel", "trial"], N, FS, BINS), "power", ["channel", "trial"])


@query("g7_band_mean", "unit:i channel trial:i band:6",
       ctes(SMP, _fourier("smp", "unit, channel, trial", "pg")) + "select unit, channel, trial, avg(p) as band from pg where k between 2 and 5 group by all")
def _(spark, d):
    p = g.periodogram(samples(spark, d), ["unit", "channel", "trial"], N, FS, BINS)
    return p.withColumn("band", g.band_mean("power", FREQ, 2.0, 5.0))


@query("g8_local_log_snr", "channel trial:i snr_db:6",
       ctes(PSMP, _fourier("psmp", "channel, trial", "pg")) + f"select channel, trial, {_SNR} as snr_db from pg group by all")
def _(spark, d):
    p = g.periodogram(pooled_samples(spark, d), ["channel", "trial"], N, FS, BINS)
    return p.withColumn("snr_db", g.local_log_snr("power", FREQ, TARGET))


def spectra(spark, d, where=None):
    """Per unit and channel, from one scan of the samples."""
    coefficients = g.coefficients(samples(spark, d), ["unit", "channel", "trial"], N, BINS)
    return g.condition_spectra(coefficients, ["unit", "channel"], N, FS, BINS, where)


_EVOKED = "evk as (select unit, channel, s, avg(x) as x from smp group by all)"
_RESID = "res as (select unit, channel, trial, s, x - avg(x) over (partition by unit, channel, s) as x from smp)"


@query("g9_evoked_snr", "unit:i channel snr_db:5",
       ctes(SMP, _EVOKED, _fourier("evk", "unit, channel", "pg")) + f"select unit, channel, {_SNR} as snr_db from pg group by all")
def _(spark, d):
    return spectra(spark, d).withColumn("snr_db", g.local_log_snr("evoked", FREQ, TARGET))


@query("g10_total_power_snr", "unit:i channel snr_db:5",
       ctes(SMP, _fourier("smp", "unit, channel, trial", "pt"), "pg as (select unit, channel, k, avg(p) as p from pt group by all)") + f"select unit, channel, {_SNR} as snr_db from pg group by all")
def _(spark, d):
    return spectra(spark, d).withColumn("snr_db", g.local_log_snr("total", FREQ, TARGET))


@query("g11_induced_snr", "unit:i channel snr_db:5",
       ctes(SMP, _RESID, _fourier("res", "unit, channel, trial", "pt"), "pg as (select unit, channel, k, avg(p) as p from pt group by all)") + f"select unit, channel, {_SNR} as snr_db from pg group by all")
def _(spark, d):
    return spectra(spark, d).withColumn("snr_db", g.local_log_snr("induced", FREQ, TARGET))


HALF = 6


def unit_phases(spark, d, pooled=True):
    df = pooled_samples(spark, d) if pooled else samples(spark, d)
    keys = ["channel", "trial"] if pooled else ["unit", "channel", "trial"]
    return g.demodulate(df, keys, TARGET, FS, HALF)


def _demod(source: str, keys: str, name: str) -> str:
    w = f"over (partition by {keys} order by s rows between {HALF} preceding and {HALF} following)"
    angle = f"2 * pi() * {TARGET} * s / {FS}"
    return f"""{name}_d as (select *, sum(x * cos({angle})) {w} as re, -sum(x * sin({angle})) {w} as im from {source}),
{name} as (select *, re / greatest(sqrt(re * re + im * im), 1e-30) as ure, im / greatest(sqrt(re * re + im * im), 1e-30) as uim from {name}_d)"""


@query("g12_narrow_band_phase", "channel trial:i s:i ure:6 uim:6", ctes(PSMP, _demod("psmp", "channel, trial", "ph")) + "select channel, trial, s, ure, uim from ph")
def _(spark, d):
    return unit_phases(spark, d)


def filtered_phases(spark, d):
    return g.analytic_phase(pooled_samples(spark, d), ["channel", "trial"], TARGET, FS)


@query("g12_zero_phase", "channel trial:i s:i ure:6 uim:6")
def _(spark, d):
    return filtered_phases(spark, d)


@query("g13_mean_itpc", "channel itpc:6",
       ctes(PSMP, _demod("psmp", "channel, trial", "ph")) + """select channel, avg(r) as itpc from (select channel, s, sqrt(power(avg(ure), 2) + power(avg(uim), 2)) as r from ph where s >= 4 and s < 20 group by all) group by all""")
def _(spark, d):
    return g.mean_coherence(g.trim(unit_phases(spark, d), 4, 20), ["channel"])


@query("g13_zero_phase_itpc", "channel itpc:6")
def _(spark, d):
    return g.mean_coherence(g.trim(filtered_phases(spark, d), 4, 20), ["channel"])


_COEF = "co as (select unit, event_id, trial_type, m40 * cos(m36) as re, m40 * sin(m36) as im, event_id % 2 as half from ft)"


@query("g14_coefficient_itpc", "unit:i half:i itpc:6 n_trials:i",
       ctes(EV, FT, _COEF) + "select unit, half, sqrt(power(avg(re / sqrt(re * re + im * im)), 2) + power(avg(im / sqrt(re * re + im * im)), 2)) as itpc, count(*) as n_trials from co group by all")
def _(spark, d):
    f = features(spark, d).select("unit", F.pmod(F.col("event_id"), F.lit(2)).alias("half"),
                                  (F.col("m40") * F.cos("m36")).alias("re"), (F.col("m40") * F.sin("m36")).alias("im"))
    return g.coefficient_coherence(f, ["unit", "half"], "re", "im")


@query("g15_loo_phase_alignment", "channel trial:i phase_alignment_loo:6",
       ctes(PSMP, _demod("psmp", "channel, trial", "ph")) + """, t as (select *, sum(ure) over (partition by channel, s) - ure as rr, sum(uim) over (partition by channel, s) - uim as ri from ph)
       select channel, trial, avg((ure * rr + uim * ri) / greatest(sqrt(rr * rr + ri * ri), 1e-30)) as phase_alignment_loo from t where s >= 4 and s < 20 group by all""")
def _(spark, d):
    return g.phase_alignment_loo(g.trim(unit_phases(spark, d), 4, 20), ["channel"], "trial")


@query("g15_zero_phase_alignment", "channel trial:i phase_alignment_loo:6")
def _(spark, d):
    return g.phase_alignment_loo(g.trim(filtered_phases(spark, d), 4, 20), ["channel"], "trial")


@query("g16_channel_condition_metrics", "unit:i channel n_trials:i itpc:6 evoked_snr_db:5",
       ctes(SMP, _EVOKED, _fourier("evk", "unit, channel", "pg"), _demod("smp", "unit, channel, trial", "ph"),
            "coh as (select unit, channel, avg(r) as itpc from (select unit, channel, s, sqrt(power(avg(ure), 2) + power(avg(uim), 2)) as r from ph group by all) group by all)",
            f"snr as (select unit, channel, {_SNR} as evoked_snr_db from pg group by all)") + "select unit, channel, (select count(distinct trial) from smp) as n_trials, itpc, evoked_snr_db from coh join snr using (unit, channel)")
def _(spark, d):
    coherence = g.mean_coherence(unit_phases(spark, d, pooled=False), ["unit", "channel"])
    snr = spectra(spark, d).filter("n_trials >= 4").select("unit", "channel", "n_trials", g.local_log_snr("evoked", FREQ, TARGET).alias("evoked_snr_db"))
    return coherence.join(snr, ["unit", "channel"])


def condition_bundle(spark, d, phases=unit_phases):
    """Coherence and three ratios per channel with odd/even and half splits, two aggregates in all."""
    trial = F.col("trial")
    pooled = pooled_samples(spark, d)
    half = pooled.agg(F.floor((F.max("trial") + 1) / 2)).first()[0]
    splits = {"odd": trial % 2 == 0, "even": trial % 2 == 1, "first": trial < half, "second": trial >= half}
    coherence = g.mean_coherence(phases(spark, d), ["channel"], where={f"{k}_itpc": c for k, c in splits.items()})
    coefficients = g.coefficients(pooled, ["channel", "trial"], N, BINS)
    power = g.condition_spectra(coefficients, ["channel"], N, FS, BINS, splits).filter("n_trials >= 4")
    snr = lambda c: g.local_log_snr(c, FREQ, TARGET)
    return coherence.join(power.select(
        "channel", "n_trials", snr("evoked").alias("evoked_snr"), snr("total").alias("total_snr"), snr("induced").alias("induced_snr"),
        *[snr(k).alias(f"{k}_snr") for k in splits]), "channel")


def _half_snr(name: str, cond: str) -> str:
    return f"e_{name} as (select channel, s, avg(x) as x from psmp where {cond} group by all),\n" + _fourier(f"e_{name}", "channel", f"pg_{name}") + \
        f",\ns_{name} as (select channel, {_SNR} as {name}_snr from pg_{name} group by all)"


_SPLITS = {"odd": "trial % 2 = 0", "even": "trial % 2 = 1", "first": "trial < (select (max(trial) + 1) // 2 from psmp)", "second": "trial >= (select (max(trial) + 1) // 2 from psmp)"}
_ITPC_PARTS = ", ".join(f"sqrt(power(avg(case when {c} then ure end), 2) + power(avg(case when {c} then uim end), 2)) as {k}_itpc" for k, c in _SPLITS.items())


@query("g17_condition_bundle", "channel n_trials:i itpc:6 odd_itpc:6 even_itpc:6 first_itpc:6 second_itpc:6 evoked_snr:5 total_snr:5 induced_snr:5 odd_snr:5 even_snr:5 first_snr:5 second_snr:5",
       ctes(PSMP, _demod("psmp", "channel, trial", "ph"),
            f"co0 as (select channel, s, sqrt(power(avg(ure), 2) + power(avg(uim), 2)) as itpc, {_ITPC_PARTS} from ph group by all)",
            "co as (select channel, avg(itpc) as itpc, avg(odd_itpc) as odd_itpc, avg(even_itpc) as even_itpc, avg(first_itpc) as first_itpc, avg(second_itpc) as second_itpc from co0 group by all)",
            _half_snr("evoked", "true"), *[_half_snr(k, c) for k, c in _SPLITS.items()],
            _fourier("psmp", "channel, trial", "pt"), "ptm as (select channel, k, avg(p) as p from pt group by all)", f"s_total as (select channel, {_SNR} as total_snr from ptm group by all)",
            "resp as (select channel, trial, s, x - avg(x) over (partition by channel, s) as x from psmp)", _fourier("resp", "channel, trial", "pr_"),
            "prm as (select channel, k, avg(p) as p from pr_ group by all)", f"s_induced as (select channel, {_SNR} as induced_snr from prm group by all)")
       + "select *, (select count(distinct trial) from psmp) as n_trials from co join s_evoked using (channel) join s_total using (channel) join s_induced using (channel) join s_odd using (channel) join s_even using (channel) join s_first using (channel) join s_second using (channel)")
def _(spark, d):
    return condition_bundle(spark, d)


@query("g17_zero_phase_bundle", "channel n_trials:i itpc:6 odd_itpc:6 even_itpc:6 first_itpc:6 second_itpc:6 evoked_snr:5 total_snr:5 induced_snr:5 odd_snr:5 even_snr:5 first_snr:5 second_snr:5")
def _(spark, d):
    return condition_bundle(spark, d, filtered_phases)


def epoch_table(spark, d):
    """One epoch per user and day: median range of its channels, range of the region signal."""
    s = samples(spark, d)
    scalp = peak_to_peak(s, ["unit", "trial"], "channel", "x").select("unit", "trial", "median_ptp")
    region = g.region_signal(s, ["click", "view"], ["unit", "trial", "s"]).groupBy("unit", "trial").agg((F.max("x") - F.min("x")).alias("roi_ptp"))
    return scalp.join(region, ["unit", "trial"]).withColumn("within_bounds", F.col("trial") > 0)


ARTIFACT = """pp as (select unit, trial, quantile_cont(p, 0.5) as median_ptp from (select unit, trial, channel, max(x) - min(x) as p from smp group by all) group by all),
rp as (select unit, trial, max(x) - min(x) as roi_ptp from (select unit, trial, s, avg(x) as x from smp where channel in ('click', 'view') group by all) group by all),
ep as (select *, trial > 0 as within_bounds from pp join rp using (unit, trial)),
cen as (select unit, quantile_cont(median_ptp, 0.5) as c1, quantile_cont(roi_ptp, 0.5) as c2 from ep where within_bounds group by unit),
lim as (select unit, c1 + 6 * quantile_cont(abs(median_ptp - c1), 0.5) as l1, c2 + 6 * quantile_cont(abs(roi_ptp - c2), 0.5) as l2 from ep join cen using (unit) where within_bounds group by unit, c1, c2),
fl as (select ep.*, l1, l2, median_ptp > 250 or roi_ptp > 150 as fixed_bad, median_ptp > l1 or roi_ptp > l2 as robust_bad from ep join lim using (unit)),
art as (select unit, trial, within_bounds, median_ptp, roi_ptp, l1 as scalp_robust_limit, within_bounds and not (fixed_bad or robust_bad) as usable,
  case when not within_bounds then 'out_of_bounds' when fixed_bad and robust_bad then 'peak_to_peak_fixed_and_robust' when fixed_bad then 'peak_to_peak_fixed'
    when robust_bad then 'peak_to_peak_robust' else '' end as rejection_reason from fl)"""


@query("g18_epoch_artifacts", "unit:i trial:i median_ptp:4 roi_ptp:4 scalp_robust_limit:4 usable rejection_reason", ctes(SMP, ARTIFACT) + "select * from art")
def _(spark, d):
    return g.epoch_artifacts(epoch_table(spark, d), ["unit"])


@query("g19_condition_qc", "unit:i n_trials:i n_usable:i rejection_fraction:6 median_usable_ptp:4",
       ctes(SMP, ARTIFACT) + """select unit, count(*) as n_trials, sum(usable::int) as n_usable, 1 - avg(usable::int) as rejection_fraction,
       quantile_cont(case when usable then median_ptp end, 0.5) as median_usable_ptp from art group by unit""")
def _(spark, d):
    epochs = g.epoch_artifacts(epoch_table(spark, d), ["unit"])
    counts = epochs.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n_trials"), F.sum(F.col("usable").cast("bigint")).alias("n_usable"), (1 - F.avg(F.col("usable").cast("double"))).alias("rejection_fraction"))
    return counts.join(median_table(epochs.filter("usable"), ["unit"], "median_ptp", "median_usable_ptp"), "unit", "left")


# continuous series per channel: sample = hour since the start, segments of two days every day
SEG, STEP, SFS = 48, 24, 24.0
SBINS = list(range(25))
SFREQ = g.bin_frequencies(SEG, SFS, SBINS)


def noise_ratios(spark, d):
    long = pooled_samples(spark, d).select("channel", (F.col("trial") * 24 + F.col("s")).alias("s"), "x")
    cut = g.segments(long, ["channel"], SEG, STEP)  # incomplete segments have no coefficients
    power = g.periodogram(cut, ["channel", "segment"], SEG, SFS, SBINS)
    mean = power.groupBy("channel").agg(F.array(*[F.avg(F.col("power")[i]) for i in range(len(SBINS))]).alias("power"))
    return mean.select(
        "channel", g.band_ratio("power", SFREQ, (4.5, 5.5), [(2.5, 3.5), (6.5, 7.5)]).alias("line_db"),
        g.band_ratio("power", SFREQ, (8.0, 12.0), [(0.5, 4.0)]).alias("high_db"))


def _ratio(a: str, refs: list[str]) -> str:
    base = " + ".join(f"avg(case when f between {r} then p end)" for r in refs)
    return f"10 * log10((avg(case when f between {a} then p end) + 1e-30) / (({base}) / {len(refs)}.0 + 1e-30))"


_NOISE = PSMP + f""",
cont as (select channel, trial * 24 + s as t, x from psmp),
seg as (select channel, j as segment, t - j * {STEP} as s, x from cont, (select unnest(range(0, (select (max(t) + 1 - {SEG}) // {STEP} + 1 from cont))) as j) r where t >= j * {STEP} and t < j * {STEP} + {SEG}),
sf as (select channel, segment, regr_slope(x, s) as b, regr_intercept(x, s) as a from seg group by all),
sc as (select channel, segment, k, sum((0.5 - 0.5 * cos(2 * pi() * s / {SEG})) * (x - a - b * s) * cos(2 * pi() * k * s / {SEG})) as re,
  sum((0.5 - 0.5 * cos(2 * pi() * s / {SEG})) * (x - a - b * s) * sin(2 * pi() * k * s / {SEG})) as im from seg join sf using (channel, segment), range(0, 25) r(k) group by all),
sp as (select channel, k * {SFS} / {SEG} as f, avg((re * re + im * im) * {g.power_scale(SEG, SFS, [1])[0]!r} * (case when k in (0, 24) then 0.5 else 1.0 end)) as p from sc group by all),
noise as (select channel, {_ratio('4.5 and 5.5', ['2.5 and 3.5', '6.5 and 7.5'])} as line_db, {_ratio('8.0 and 12.0', ['0.5 and 4.0'])} as high_db from sp group by channel)"""


@query("g20_noise_ratios", "channel line_db:5 high_db:5", ctes(_NOISE) + "select * from noise")
def _(spark, d):
    return noise_ratios(spark, d)


def channel_qc(spark, d):
    """Signal summary, noise ratios, correlation profile and flags per channel."""
    types = event_types(spark, d)
    s = pooled_samples(spark, d).withColumn("t", F.col("trial") * 24 + F.col("s"))
    summary = s.groupBy("channel").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("finite_fraction"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    cc = graph.channel_correlations(s, [], "channel", types, "t", "x")
    n = len(types)
    ring = spark.createDataFrame([(types[i], types[(i + k) % n]) for i in range(n) for k in (1, n - 1)], "a string, b string")
    profile = neighbour_profile(cc, ring).withColumnRenamed("a", "channel")
    joined = summary.join(noise_ratios(spark, d), "channel").join(profile, "channel").withColumn("median_r", F.col("median_neighbour_r"))
    return flag_channels(joined, [])


@query("g21_channel_qc", "channel rms:4 line_db:5 high_db:5 n_neighbours:i median_neighbour_r:6 strongest_neighbour median_global_r:6 z_log_rms:4 z_line_db:4 reason bad",
       ctes(_NOISE) + """, sm as (select channel, sqrt(avg(x * x)) as rms from psmp group by all),
       cc as (select p.channel as a, q.channel as b, corr(p.x, q.x) as r from cont p join cont q on p.t = q.t and p.channel <> q.channel group by all),
       ty as (select channel as a, row_number() over (order by channel) - 1 as i from sm),
       ring as (select p.a, q.a as b from ty p join ty q on (p.i + 1) % (select count(*) from ty) = q.i or (q.i + 1) % (select count(*) from ty) = p.i),
       prof as (select a as channel, count(*) as n_neighbours, quantile_cont(r, 0.5) as median_neighbour_r, arg_max(b, r) as strongest_neighbour, any_value(m) as median_global_r
         from cc join ring using (a, b) join (select a, quantile_cont(r, 0.5) as m from cc group by a) gl using (a) group by a),
       m1 as (select *, ln(rms) as log_rms, -median_neighbour_r as low_r from sm join noise using (channel) join prof using (channel)),
       med as (select quantile_cont(log_rms, 0.5) as a, quantile_cont(line_db, 0.5) as b, quantile_cont(high_db, 0.5) as c, quantile_cont(low_r, 0.5) as e from m1),
       mad as (select quantile_cont(abs(log_rms - a), 0.5) as ma, quantile_cont(abs(line_db - b), 0.5) as mb, quantile_cont(abs(high_db - c), 0.5) as mc, quantile_cont(abs(low_r - e), 0.5) as me from m1, med),
       zz as (select m1.*, 0.67448975 * (log_rms - a) / ma as z_log_rms, 0.67448975 * (line_db - b) / mb as z_line_db, 0.67448975 * (high_db - c) / mc as z3, 0.67448975 * (low_r - e) / me as z4 from m1, med, mad),
       r as (select *, concat_ws(';', case when abs(z_log_rms) > 5 then 'rms_outlier' end, case when z_line_db > 5 and line_db > 3 then 'line_noise_outlier' end,
         case when z3 > 5 and high_db > -3 then 'high_frequency_outlier' end, case when z4 > 5 and median_neighbour_r < 0.2 then 'low_correlation_outlier' end) as reason from zz)
       select *, reason <> '' as bad from r""")
def _(spark, d):
    return channel_qc(spark, d)
