"""The derived run log as SQL text, for the queries' twins."""

from __future__ import annotations

from ..sources import run_log as L


def _cast(expr: str, name: str, kind: str) -> str:
    kind = {"string": "varchar", "timestamp_ntz": "timestamp"}.get(kind, kind)
    return f"cast({expr.format(text='varchar')} as {kind}) as {name}"


def _build() -> str:
    fill = {t: t for t in ("lineitem", "orders", "part", "steps", "outcomes", "kept")}
    step_rows = " union all ".join(f"select *, {p} as p, '{e}' as event_type from kept where {c}" for p, e, c in L.STEP_EVENTS)
    run_rows = " union all ".join(
        f"select *, {'last_k + 1' if k else '0'} as k, {p} as p, '{e}' as event_type from runs where {c}" for k, p, e, c in L.RUN_EVENTS
    )
    ours = ", ".join([*[_cast("null", n, t) for n, t, _ in L.HEADER_COLUMNS], *[_cast(x, n, t) for n, t, x in L.STEP_COLUMNS]])
    theirs = ", ".join([*[_cast(x, n, t) for n, t, x in L.HEADER_COLUMNS], *[_cast(L.RUN_COLUMNS.get(n, "null"), n, t) for n, t, _ in L.STEP_COLUMNS]])
    run_id, at = L.RUN_ID.format(text="varchar"), L.OCCURRED.format(k="k")
    return f"""
steps as materialized ({L.STEP_SQL.format(**fill)}), outcomes as materialized ({L.OUTCOME_SQL.format(**fill)}), kept as materialized ({L.KEPT_SQL.format(**fill)}),
runs as (select * exclude (k) from kept where k = last_k), step_rows as ({step_rows}), run_rows as ({run_rows}),
both_rows as (
  select {run_id} as run_id, k, p, event_type, {at} as occurred_at, {ours} from step_rows
  union all select {run_id} as run_id, k, p, event_type, {at} as occurred_at, {theirs} from run_rows
),
log as materialized (select run_id, cast(row_number() over (partition by run_id order by k, p) as bigint) as seq, {", ".join(L.COLUMNS[2:])} from both_rows)
"""


LOG_CTES = _build()


def over_log(body: str, ctes: str = "") -> str:
    """A statement over the log; further CTEs may stand before the body."""
    return f"with {LOG_CTES}{', ' + ctes if ctes else ''} {body}"
