"""Preparation plans: the default plan, and the check every plan goes through.

A plan is ``{"cleaning_steps": [...], "feature_steps": [...]}`` where a step is
``{"step": name, "columns": [...]}`` with an option for some steps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.profile import Profile


@dataclass(frozen=True)
class Kind:
    """What a step accepts: its option, the option's values and default, its column type."""

    option: str | None = None
    values: tuple = ()
    default: object = None
    columns: str = "any"  # any, numeric or text
    heavy: bool = False


# Fixed names and options of the plan format. handle_missing takes the outlier
# methods too; like any other unknown method they mean median.
CLEANING = {
    "handle_missing": Kind("method", ("median", "mean", "mode", "drop_rows", "drop_cols", "iqr", "zscore", "clip"),
                           "median"),
    "remove_outliers": Kind("method", ("iqr", "zscore", "clip"), "iqr"),
    "drop_constants": Kind(),
    "fix_dtypes": Kind("target_dtype", ("numeric", "datetime", "string"), "numeric"),
    "drop_duplicates": Kind(),
}
FEATURES = {
    "encode_categorical": Kind("method", ("label", "onehot", "ordinal"), "label", columns="text"),
    "polynomial_features": Kind("degree", (2,), 2, columns="numeric", heavy=True),
    "interaction_features": Kind(columns="numeric", heavy=True),
    "log_transform": Kind(columns="numeric"),
    "datetime_decompose": Kind(),
}


@dataclass(frozen=True)
class Limits:
    """Bounds that a plan may be held to; None, the default of all, is no bound.

    log_rows: log transforms only up to so many rows. heavy_rows: heavy steps only below so many rows. heavy_steps: so
    many heavy steps at most. heavy_columns: with more number columns, interactions replace powers. scoped_columns: a
    step without columns takes so many. imputed_columns: a forced fill takes so many.
    """

    log_rows: int | None = None
    heavy_rows: int | None = None
    heavy_steps: int | None = None
    heavy_columns: int | None = None
    scoped_columns: int | None = None
    imputed_columns: int | None = None


def default_plan(profile: Profile, target: str, limits: Limits = Limits()) -> dict:
    """The conservative plan taken from the profile alone; the target is never touched."""
    def but_target(columns: Sequence[str]) -> list[str]:
        return [c for c in columns if c != target]

    constants = but_target(profile.constants)
    gaps = but_target([c for c, n in profile.missing.items() if n])
    wide = but_target(profile.high_cardinality)
    skewed = but_target(profile.skewed) if limits.log_rows is None or profile.n_rows <= limits.log_rows else []
    cleaning = [
        ({"step": "drop_constants", "columns": constants}, constants),
        ({"step": "handle_missing", "columns": gaps, "method": "median"}, gaps),
        ({"step": "drop_duplicates", "columns": []}, profile.duplicates),
    ]
    features = [
        ({"step": "encode_categorical", "columns": wide, "method": "label"}, wide),
        ({"step": "log_transform", "columns": skewed}, skewed),
    ]
    return {
        "cleaning_steps": [step for step, wanted in cleaning if wanted],
        "feature_steps": [step for step, wanted in features if wanted],
    }


def _known(steps: object, kinds: dict[str, Kind]) -> list[dict]:
    if not isinstance(steps, (list, tuple)):
        return []
    return [s for s in steps if isinstance(s, dict) and s.get("step") in kinds]


def _columns(step: dict, profile: Profile, target: str, kind: Kind) -> list[str]:
    asked = step.get("columns")
    allowed = {"any": profile.dtypes, "numeric": profile.numeric, "text": profile.text}[kind.columns]
    if not isinstance(asked, (list, tuple)):
        return []
    return list(dict.fromkeys(c for c in asked if isinstance(c, str) and c in allowed and c != target))


def _checked(step: dict, columns: list[str], kind: Kind) -> dict:
    out = {"step": step["step"], "columns": columns}
    if kind.option:
        value = step.get(kind.option, kind.default)
        out[kind.option] = value if value in kind.values else kind.default
    return out


def check_cleaning(steps: object, profile: Profile, target: str, limits: Limits = Limits()) -> list[dict]:
    """Known steps on existing columns, without repeats, plus the steps the profile forces."""
    out: list[dict] = []
    for step in _known(steps, CLEANING):
        kind = CLEANING[step["step"]]
        made = _checked(step, _columns(step, profile, target, kind), kind)
        if made not in out and (made["columns"] or made["step"] == "drop_duplicates"):
            out.append(made)
    used = {s["step"] for s in out}
    if profile.duplicates and "drop_duplicates" not in used:
        out.insert(0, {"step": "drop_duplicates", "columns": []})
    gaps = [c for c, n in profile.missing.items() if n and c != target][:limits.imputed_columns]
    if gaps and "handle_missing" not in used:
        out.append({"step": "handle_missing", "columns": gaps, "method": "median"})
    return out


def check_features(steps: object, profile: Profile, target: str, limits: Limits = Limits()) -> list[dict]:
    """Known steps on columns of a fitting type, within the limits given."""
    scope = {
        "encode_categorical": [c for c in sorted(profile.text) if c != target],
        "log_transform": [c for c in sorted(profile.skewed) if c != target],
    }
    wide = set(profile.high_cardinality)
    out: list[dict] = []
    heavy_left = math.inf if limits.heavy_steps is None else limits.heavy_steps
    if limits.heavy_rows is not None and profile.n_rows >= limits.heavy_rows:
        heavy_left = 0
    for step in _known(steps, FEATURES):
        kind = FEATURES[step["step"]]
        if kind.heavy and not heavy_left:
            continue
        heavy_left -= kind.heavy
        columns = _columns(step, profile, target, kind) or scope.get(step["step"], [])[:limits.scoped_columns]
        made = _checked(step, columns, kind)
        if step["step"] == "encode_categorical" and wide.intersection(columns):
            made["method"] = "label"
        if columns and made not in out:
            out.append(made)
    if limits.heavy_columns is not None and len(profile.numeric) > limits.heavy_columns and any(s["step"] == "interaction_features" for s in out):
        out = [s for s in out if s["step"] != "polynomial_features"]
    return out


def check_plan(plan: object, profile: Profile, target: str, limits: Limits = Limits()) -> dict:
    plan = plan if isinstance(plan, dict) else {}
    return {
        "cleaning_steps": check_cleaning(plan.get("cleaning_steps"), profile, target, limits),
        "feature_steps": check_features(plan.get("feature_steps"), profile, target, limits),
    }


def steps_table(spark: SparkSession, plan: dict) -> DataFrame:
    """``stage, position, step, columns, option`` of a plan."""
    rows = []
    for stage, key, kinds in (("cleaning", "cleaning_steps", CLEANING), ("features", "feature_steps", FEATURES)):
        for i, step in enumerate(plan[key]):
            option = step.get(kinds[step["step"]].option or "")
            rows.append((stage, i, step["step"], step["columns"], None if option is None else str(option)))
    return spark.createDataFrame(
        rows, "stage string, position int, step string, columns array<string>, option string")
