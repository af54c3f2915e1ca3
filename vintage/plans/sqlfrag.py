"""SQL text fragments for the DuckDB oracle, one per Spark helper in
``vintage.functions``. They spell out the same arithmetic in the same
association so both engines produce the same doubles."""

from __future__ import annotations

from vintage.functions.numeric import LIMBS, LIMIT

INF = "CAST('infinity' AS DOUBLE)"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def rnd(x: str, places: int) -> str:
    s = dbl(float(10 ** places))
    return f"(round_even(({x}) * {s}, 0) / {s})"


def month_start(x: str) -> str:
    return f"CAST(date_trunc('month', {x}) AS DATE)"


def year_start(x: str) -> str:
    return f"CAST(date_trunc('year', {x}) AS DATE)"


def month_diff(later: str, earlier: str) -> str:
    return (f"CAST((year({later}) - year({earlier})) * 12 + (month({later}) - month({earlier}))"
            f" AS INTEGER)")


def nan_to_null(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


def ltv_quotient(r: str, d: float) -> str:
    num = f"(({r}) / {dbl(100.0)})"
    den = f"(({dbl(1.0)} + {dbl(d)}) - {num})"
    return (f"(CASE WHEN {den} = 0 THEN (CASE WHEN {num} > 0 THEN {INF} WHEN {num} < 0 THEN -{INF} END)"
            f" ELSE {num} / {den} END)")


def stable_avg(x: str, places: int, over: str | None = None) -> str:
    s = dbl(float(10 ** places))
    o = f" OVER ({over})" if over is not None else ""
    n_pos = f"sum(CASE WHEN {x} = {INF} THEN 1 ELSE 0 END){o}"
    n_neg = f"sum(CASE WHEN {x} = -{INF} THEN 1 ELSE 0 END){o}"
    fin = f"(CASE WHEN isfinite({x}) THEN {x} END)"
    cnt = f"count({x}){o}"
    exact = f"(CASE WHEN {cnt} > 0 THEN sum(CAST(round_even({fin} * {s}, 0) AS BIGINT)){o} / ({cnt} * {s}) END)"
    return (f"(CASE WHEN {n_pos} > 0 AND {n_neg} > 0 THEN CAST(NULL AS DOUBLE)"
            f" WHEN {n_pos} > 0 THEN {INF} WHEN {n_neg} > 0 THEN -{INF} ELSE {exact} END)")


def exact_sum(x: str) -> str:
    """Twin of ``functions.exact_sum``."""
    small, rest, parts = f"abs({x}) < {dbl(LIMIT)}", f"(CASE WHEN abs({x}) < {dbl(LIMIT)} THEN {x} END)", []
    for unit in LIMBS:
        n = f"trunc({rest} / {dbl(unit)})"
        parts.append(f"CAST(sum(CAST({n} AS BIGINT)) AS DOUBLE) * {dbl(unit)}")
        rest = f"(CASE WHEN {small} THEN sign({x}) * fmod(abs({x}), {dbl(unit)}) END)"
    return f"COALESCE(sum(CASE WHEN NOT ({small}) THEN {x} END), {' + '.join(parts)})"


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes)
    return f"WITH {body}\n{final}"


def cols(seg: tuple[str, ...], *rest: str) -> str:
    return ", ".join([*seg, *rest])


def part(seg: tuple[str, ...], *rest: str) -> str:
    return "PARTITION BY " + ", ".join([*seg, *rest])
