"""Ordered cleaning plans.

`build_plan` turns findings into actions in a fixed order of stages. `apply_plan` folds the actions over a frame into
one lazy plan; a failing action is recorded and the rest go on; long plans are cut by a reliable checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation

from grainmill.operators import clean
from grainmill.session import cut_lineage


@dataclass(frozen=True)
class Action:
    kind: str
    params: dict = field(default_factory=dict)
    affected: int = 0


@dataclass
class Run:
    """Result of a plan: the cleaned frame, lazy metrics per step, recorded errors."""

    df: DataFrame
    metrics: list[tuple[str, DataFrame]]
    errors: list[tuple[str, str]]


OPERATIONS: dict[str, Callable[..., clean.Cleaned]] = {
    "drop_missing": clean.drop_missing,
    "fill_default": clean.fill_default,
    "fill_statistic": clean.fill_statistic,
    "fill_direction": clean.fill_direction,
    "drop_rows_missing": clean.drop_rows_missing,
    "drop_trailing_empty": clean.drop_trailing_empty,
    "drop_embedded_headers": clean.drop_embedded_headers,
    "remove_duplicates": clean.remove_duplicates,
    "trim_whitespace": clean.trim_whitespace,
    "trim_ends": clean.trim_ends,
    "blanks_to_null": clean.blanks_to_null,
    "normalize_case": clean.normalize_case,
    "standardize_casing": clean.standardize_casing,
    "remove_special": clean.remove_special,
    "find_replace": clean.find_replace,
    "split_column": clean.split_column,
    "merge_columns": clean.merge_columns,
    "standardize_dates": clean.standardize_dates,
    "convert_numeric": clean.convert_numeric,
    "convert_integer": clean.convert_integer,
    "convert_numeric_plain": clean.convert_numeric_plain,
    "normalize_booleans": clean.normalize_booleans,
    "validate_ranges": clean.validate_ranges,
    "apply_range_rules": clean.apply_range_rules,
    "filter_outliers": clean.filter_outliers,
    "replace_sigma_outliers": clean.replace_sigma_outliers,
    "replace_negatives": clean.replace_negatives,
    "rename_columns": clean.rename_columns,
    "apply_learned_rules": clean.apply_learned_rules,
    "drop_columns": lambda df, columns: clean.measured(df, clean.drop_columns(df, columns), {}, columns_dropped=len(columns)),
}


def build_plan(findings: DataFrame, order: str | None = None) -> list[Action]:
    """Actions for a findings frame, stage by stage. Collects the findings: a few rows per column."""
    rows = findings.collect()
    of = lambda *kinds: [r for kind in kinds for r in rows if r["issue"] == kind]
    plan: list[Action] = []

    def add(kind: str, affected, **params) -> None:
        plan.append(Action(kind, params, int(affected)))

    for r in of("duplicate_rows")[:1]:
        add("remove_duplicates", r["count"], **({"order": order} if order else {}))
    empty = [r["column"] for r in of("empty_column")]
    if empty:
        add("drop_columns", len(empty), columns=empty)
    if order:
        for r in of("trailing_empty_rows")[:1]:
            add("drop_trailing_empty", r["count"], order=order)
    for r in of("embedded_headers")[:1]:
        add("drop_embedded_headers", r["count"], **({"ignore": [order]} if order else {}))
    for r in of("unnamed_columns")[:1]:
        names = [c for c in r["details"].split(", ") if c not in empty]
        if names:
            add("rename_columns", len(names), rules={c: f"col_{i}" for i, c in enumerate(names)})
    for r in of("missing_values"):
        if r["severity"] == "critical" and r["percentage"] > 50:
            add("drop_columns", r["count"], columns=[r["column"]])
        elif r["severity"] == "critical":
            add("drop_rows_missing", r["count"], column=r["column"])
        else:
            add("fill_default", r["count"], columns=[r["column"]], placeholder="Unknown")
    spaced = of("whitespace")
    if spaced:
        add("trim_ends", sum(r["count"] for r in spaced), columns=[r["column"] for r in spaced])
    for r in of("inconsistent_casing"):
        add("standardize_casing", r["count"], columns=[r["column"]], case="title")
    for r in of("numeric_with_symbols", "numeric_with_commas", "numeric_with_percent"):
        add("convert_numeric_plain", r["count"], columns=[r["column"]])
    for r in of("inconsistent_dates"):
        add("standardize_dates", r["count"], columns=[r["column"]], target="iso")
    for r in of("boolean_inconsistency"):
        add("normalize_booleans", r["count"], columns=[r["column"]], keep_others=True)
    for r in of("statistical_outlier"):
        add("replace_sigma_outliers", r["count"], column=r["column"])
    for r in of("negative_in_positive"):
        add("replace_negatives", r["count"], column=r["column"])
    return plan


def apply_plan(df: DataFrame, plan: Sequence[Action], cut_every: int = 10) -> Run:
    """Fold the actions over the frame. Nothing runs, except a checkpoint after every `cut_every` actions."""
    run = Run(df, [], [])
    for i, action in enumerate(plan):
        try:
            result = OPERATIONS[action.kind](run.df, **action.params)
        except Exception as error:  # noqa: BLE001 - a failing action must not stop the others
            run.errors.append((action.kind, str(error)))
            continue
        run.df = result.df
        run.metrics.append((action.kind, result.metrics))
        if cut_every and (i + 1) % cut_every == 0 and i + 1 < len(plan):
            run.df = cut_lineage(run.df)
    return run


@dataclass
class Measured:
    """Result of a plan that has run: the cleaned frame, each step's counts, recorded errors."""

    df: DataFrame
    steps: list[tuple[str, dict]]
    errors: list[tuple[str, str]]

    def timeline(self) -> DataFrame:
        """Step, operation and its counts as text, as `changelog.timeline` of the lazy metrics."""
        rows = [(i + 1, name, json.dumps(counts, separators=(",", ":"))) for i, (name, counts) in enumerate(self.steps)]
        return self.df.sparkSession.createDataFrame(rows, "step int, operation string, detail string")


def run_plan(df: DataFrame, plan: Sequence[Action]) -> Measured:
    """Run the actions and count what they do in the same pass: the source is read once, whatever the number of steps.

    Counts are observed while the rows go by. They are exact only where every row goes by once, in the last stage of a
    job, so the frame is checkpointed before a step that shuffles or that counts what it has made; that step and the
    next ones read the checkpoint. An action that fails, when its plan is built or when it runs, is recorded and left
    out; the others go on.
    """
    done: list[tuple[Action, Observation | None, dict]] = []
    steps: list[tuple[str, dict]] = []
    errors: list[tuple[str, str]] = []
    base, frame = df, df

    def flush() -> None:
        """Materialise what is pending; on an error step by step, so that only the failing step is lost."""
        nonlocal base, frame, done
        if not done:
            return
        try:
            frame = cut_lineage(frame)
            steps.extend((a.kind, {**(o.get if o else {}), **constants}) for a, o, constants in done)
        except Exception as error:  # noqa: BLE001 - a failing action must not stop the others
            pending, frame = [a for a, _, _ in done], base
            done = []
            if len(pending) == 1:
                errors.append((pending[0].kind, str(error)))
                return
            for action in pending:
                add(action)
                flush()
        base, done = frame, []

    def add(action: Action) -> None:
        nonlocal base, frame
        try:
            result = OPERATIONS[action.kind](frame, **action.params)
        except Exception as error:  # noqa: BLE001
            errors.append((action.kind, str(error)))
            return
        if result.counters:
            seen = Observation()
            watched = frame.observe(seen, *[c.alias(name) for name, c in result.counters.items()])
            frame = OPERATIONS[action.kind](watched, **action.params).df
            done.append((action, seen, result.constants))
        elif result.counters is not None:
            frame = result.df
            done.append((action, None, result.constants))
        else:
            flush()
            try:
                result = OPERATIONS[action.kind](frame, **action.params)
                made = cut_lineage(result.df)
                steps.append((action.kind, result.metrics.first().asDict()))
                base = frame = made
            except Exception as error:  # noqa: BLE001
                errors.append((action.kind, str(error)))

    for action in plan:
        add(action)
    flush()
    return Measured(frame, steps, errors)
