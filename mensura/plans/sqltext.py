"""SQL text of distribution functions for the DuckDB twins.

The twins integrate densities with Simpson's rule, a different route from the
series and continued fractions of the Spark side.
"""

from __future__ import annotations

from mensura.functions.special import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, ACKLAM_LOW


def ctes(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n"


def _simpson(integrand: str, upper: str, steps: int) -> str:
    weight = f"(case when i = 0 or i = {steps} then 1.0 when i % 2 = 1 then 4.0 else 2.0 end)"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * ({integrand}))) * ({upper}) / {3.0 * steps})"


def normal_p(z: str, steps: int = 1000) -> str:
    """Two-sided normal tail."""
    return (
        f"(case when ({z}) is null then null when abs({z}) > 9 then 0.0 else greatest(0.0, 1.0 - 2.0 * "
        + _simpson(f"exp(-power(abs({z}) * i / {steps}.0, 2) / 2.0)", f"abs({z})", steps)
        + " / sqrt(2.0 * pi())) end)"
    )


def t_p(t: str, nu: str, steps: int = 1000) -> str:
    """Two-sided Student-t tail."""
    theta = f"atan(abs({t}) / sqrt({nu}))"
    constant = f"exp(lgamma((({nu}) + 1.0) / 2.0) - lgamma(({nu}) / 2.0)) / sqrt(pi())"
    return (
        f"(case when ({t}) is null then null else greatest(0.0, 1.0 - 2.0 * {constant} * "
        + _simpson(f"power(cos({theta} * i / {steps}.0), ({nu}) - 1.0)", theta, steps)
        + ") end)"
    )


def t_critical(source: str, alphas: dict[str, float], name: str = "crit") -> str:
    """Recursive CTE ``name(nu, <columns>)``: bisection per distinct ``nu`` of ``source``.

    ``alphas`` maps a column to its two-sided tail probability.
    """
    lists = ", ".join(f"({a!r}, '{c}')" for c, a in alphas.items())
    picks = ", ".join(f"max(case when label = '{c}' then (lo + hi) / 2 end) as {c}" for c in alphas)
    tail = t_p("(lo + hi) / 2", "nu", 400)
    return f"""
{name}_steps as (
  select nu, label, alpha, 0.0::double as lo, 300.0::double as hi, 0 as it
  from (select distinct cast(nu as double) as nu from {source} where nu > 0) d, (values {lists}) v(alpha, label)
  union all
  select nu, label, alpha, case when tail > alpha then (lo + hi) / 2 else lo end,
         case when tail > alpha then hi else (lo + hi) / 2 end, it + 1
  from (select *, {tail} as tail from {name}_steps where it < 60) s
),
{name} as (select nu, {picks} from {name}_steps where it = 60 group by nu)"""


def _horner(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


def normal_quantile(p: str) -> str:
    """Rational form, then one Newton step on the integrated normal density."""
    low, high = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - ({p})))"
    q = f"(({p}) - 0.5)"
    r = f"({q} * {q})"
    start = (
        f"(case when ({p}) < {ACKLAM_LOW} then {_horner(ACKLAM_C, low)} / ({_horner(ACKLAM_D, low)} * {low} + 1.0) "
        f"when ({p}) > {1 - ACKLAM_LOW} then -{_horner(ACKLAM_C, high)} / ({_horner(ACKLAM_D, high)} * {high} + 1.0) "
        f"else {_horner(ACKLAM_A, r)} * {q} / ({_horner(ACKLAM_B, r)} * {r} + 1.0) end)"
    )
    area = _simpson("exp(-power(z0 * i / 400.0, 2) / 2.0)", "z0", 400)
    newton = f"z0 - (0.5 + {area} / sqrt(2.0 * pi()) - ({p})) * sqrt(2.0 * pi()) * exp(z0 * z0 / 2.0)"
    return f"list_transform([{start}], lambda z0: {newton})[1]"


def uniform(seed: str, *keys: str) -> str:
    return f"(cast('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13) as bigint) / 4503599627370496.0)"


def _wrapped(x: str) -> str:
    return f"cast(({x}) % 18446744073709551616::hugeint as ubigint)"


def position(base: str, turn: str, n: str) -> str:
    """1-based row of a draw: the high bits of the mixed counter, spread over ``n`` rows."""
    start = _wrapped(f"{base}::hugeint + {turn}::hugeint * {0x9E3779B97F4A7C15}::hugeint")
    one = _wrapped(f"xor(a, a >> 30)::hugeint * {0x3F58476D1CE4E5B9}::hugeint")
    two = _wrapped(f"xor(b, b >> 27)::hugeint * {0x14D049BB133111EB}::hugeint")
    mixed = f"list_transform(list_transform(list_transform([{start}], lambda a: {one}), lambda b: {two}), lambda c: xor(c, c >> 31))[1]"
    return f"cast(((({mixed}) >> 32) * {n}::ubigint) >> 32 as bigint) + 1"


def draw_base(seed: str, *keys: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 15) as bigint)"


def sign(seed: str, rep: str, unit: str) -> str:
    """+1/-1 for a replicate: bit (rep mod 32) of the hash of (rep div 32, unit)."""
    bits = f"cast('0x' || substr(md5(concat_ws('|', '{seed}', {rep} // 32, {unit})), 1, 8) as bigint)"
    return f"(case when (({bits} >> ({rep} % 32)) & 1) = 1 then 1.0 else -1.0 end)"


def sign_bits(seed: str, source: str, replicates: int) -> str:
    """CTE ``bits``: one hash for the signs of 32 replicates of a unit; ``signed`` reads them."""
    return f"""bits as (select unit, b, cast('0x' || substr(md5(concat_ws('|', '{seed}', b, unit)), 1, 8) as bigint) as h
  from (select distinct unit from {source}), range(0, {-(-replicates // 32)}) r(b))"""


def signed(value: str) -> str:
    return f"(case when (h >> j) & 1 = 1 then {value} else -{value} end)"


def average_rank(value: str, partition: str = "") -> str:
    by = f"partition by {partition} " if partition else ""
    same = f"partition by {partition + ', ' if partition else ''}{value}"
    return f"(rank() over ({by}order by {value}) + (count(*) over ({same}) - 1) / 2.0)"


def bh(p: str, family: str) -> str:
    """Column ``q`` needs two levels; returns the candidate expression."""
    return f"{p} * count(*) over (partition by {family}) / rank_number"
