"""Running a plan: every step is fitted on one table and can be applied to others."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.columns import null_nan, present, text_names
from ..functions.storage import stored
from ..operators import clean, features, validate
from ..operators.profile import Profile, profile
from .steps import Limits, check_plan, default_plan

Applier = Callable[[DataFrame], DataFrame]

FITS_PER_CUT = 10  # fitted steps between two stored tables


def _fit_missing(df: DataFrame, columns: list[str], step: dict) -> Applier:
    method = step.get("method", "median")
    if method in ("drop_rows", "drop_cols"):
        hit = clean.columns_with_nulls(df, columns)
        if method == "drop_cols":
            return lambda d: clean.drop_columns(d, hit)
        return lambda d: clean.drop_null_rows(d, hit)
    fills = clean.fit_fill(df, columns, method)
    return lambda d: clean.apply_fill(d, fills)


def _fit_outliers(df: DataFrame, columns: list[str], step: dict) -> Applier:
    method = step.get("method", "iqr")
    if method == "zscore":
        stats = clean.fit_zscore(df, columns)
        return lambda d: clean.keep_zscore(d, stats)
    fences = clean.fit_fences(df, columns)
    keep = clean.clip if method == "clip" else clean.keep_within
    return lambda d: keep(d, fences) if fences else d


def _fit_encoding(df: DataFrame, columns: list[str], step: dict) -> Applier:
    hot = [c for c in columns if step.get("method") == "onehot" and not features.is_sex_name(c)]
    codes = features.fit_codes(df, [c for c in columns if c not in hot])
    levels = features.fit_levels(df, hot)

    def run(d: DataFrame) -> DataFrame:
        d = features.apply_codes(d, codes)
        return features.one_hot(d, hot, levels) if hot else d
    return run


def _fit_log(df: DataFrame, columns: list[str], step: dict) -> Applier:
    fitting = features.fit_log(df, columns)
    return lambda d: features.log_transform(d, fitting)


def _fit_dates(df: DataFrame, columns: list[str], step: dict) -> Applier:
    parts = features.fit_dates(df, columns)
    return lambda d: features.apply_dates(d, parts)


FITTERS: dict[str, Callable[[DataFrame, list[str], dict], Applier]] = {
    "handle_missing": _fit_missing,
    "remove_outliers": _fit_outliers,
    "drop_constants": lambda df, cols, step: lambda d: clean.drop_columns(d, cols),
    "fix_dtypes": lambda df, cols, step: lambda d: clean.convert(d, cols, step.get("target_dtype", "numeric")),
    "drop_duplicates": lambda df, cols, step: lambda d: clean.drop_duplicates(d, step.get("few", False)),
    "encode_categorical": _fit_encoding,
    "log_transform": _fit_log,
    "polynomial_features": lambda df, cols, step: lambda d: features.powers(d, cols, step.get("degree", 2)),
    "interaction_features": lambda df, cols, step: lambda d: features.interactions(d, cols),
    "datetime_decompose": _fit_dates,
}
SHUFFLES = {"drop_duplicates"}
FEW_COPIES = 1_000_000


@dataclass
class Prepared:
    """The prepared table, the steps taken, and the fitted steps for new data."""

    df: DataFrame
    plan: dict = field(default_factory=dict)
    steps: list[tuple[str, list[str]]] = field(default_factory=list)
    appliers: list[Applier] = field(default_factory=list)

    def apply(self, new: DataFrame) -> DataFrame:
        for run in self.appliers:
            new = run(new)
        return new

    def _take(self, name: str, columns: Sequence[str], run: Applier) -> None:
        self.df = run(self.df)
        self.steps.append((name, list(columns)))
        self.appliers.append(run)


def _run(state: Prepared, steps: Sequence[dict], target: str) -> None:
    """Fit and take each step in order; unknown steps are passed over.

    A shuffling step is stored before the next fit reads it, so it runs once.
    """
    for i, step in enumerate(steps):
        name = step.get("step")
        if name not in FITTERS:
            continue
        columns = present(state.df, step.get("columns") or [], target)
        if not columns and name != "drop_duplicates":
            continue
        state._take(name, columns, FITTERS[name](state.df, columns, step))
        if name in SHUFFLES or (i + 1) % FITS_PER_CUT == 0:
            state.df = stored(state.df, "prepared")


def _clean(state: Prepared, steps: Sequence[dict], target: str) -> None:
    _run(state, steps, target)
    state._take("drop_null_target", [target], lambda d: clean.drop_null_target(d, target))
    fills = clean.fit_fill(state.df, [c for c in state.df.columns if c != target])
    state._take("fill_remaining", list(fills), lambda d: clean.apply_fill(d, fills))


def _engineer(state: Prepared, steps: Sequence[dict], target: str) -> None:
    _run(state, steps, target)
    titles = features.fit_titles(state.df, text_names(state.df), target)
    if titles:
        state._take("name_titles", list(titles), lambda d: features.apply_titles(d, titles))
    state._take("family_size", [], lambda d: features.family_size(d, target))
    left = [c for c in text_names(state.df) if c != target]
    if left:
        codes = features.fit_codes(state.df, left)
        state._take("encode_leftover", left, lambda d: features.apply_codes(d, codes))


def run_cleaning(df: DataFrame, steps: Sequence[dict], target: str) -> Prepared:
    """The cleaning steps, then rows without a target out, then the last fill."""
    state = Prepared(df)
    _clean(state, steps, target)
    return state


def run_features(df: DataFrame, steps: Sequence[dict], target: str) -> Prepared:
    """The feature steps, then name titles, family size and codes for leftover text."""
    state = Prepared(df)
    _engineer(state, steps, target)
    return state


def prepare(df: DataFrame, plan: dict, target: str, found: Profile | None = None,
            limits: Limits = Limits()) -> Prepared:
    """Check the plan against the table's profile and run it.

    To keep held-out rows out of the fit, pass the training rows and use
    ``Prepared.apply`` on the rest.
    """
    df = null_nan(df)
    found = found or profile(df)
    checked = check_plan(plan, found, target, limits)
    few = found.n_rows > FEW_COPIES and found.duplicates <= FEW_COPIES
    state = Prepared(df, plan=checked)
    _clean(state, [s | {"few": few} if s["step"] in SHUFFLES else s for s in checked["cleaning_steps"]], target)
    _engineer(state, checked["feature_steps"], target)
    return state


def auto_prepare(df: DataFrame, target: str, task: str = "regression", order_by: Sequence[str] = (),
                 exact: bool = True, limits: Limits = Limits()) -> Prepared:
    """Validate, fix, profile, and run the default plan; without ``exact``, distinct counts far from every limit are estimates."""
    df = null_nan(df)
    report = validate.validate(df, target, task, order_by, exact=exact)
    fixes = report.fixes
    fixed = validate.apply_fixes(df, fixes)
    found = profile(fixed, exact, known_unique={c: n for c, n in report.n_unique.items() if c not in fixes})
    state = prepare(fixed, default_plan(found, target, limits), target, found, limits)
    state.appliers.insert(0, lambda d: validate.apply_fixes(d, fixes))
    state.steps.insert(0, ("apply_fixes", list(fixes)))
    return state
