"""Writing result tables and fitted models."""

from __future__ import annotations

import logging
import re

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


def plain_name(name: str) -> str:
    """File-name form of a label: letters, digits, ``-`` and ``_`` stay."""
    return re.sub(r"[^\w-]", "_", name)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each named table under ``folder``; returns where."""
    paths = {name: f"{folder.rstrip('/')}/{plain_name(name)}" for name in tables}
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(paths[name])
    return paths


def save_best(model: PipelineModel, name: str, folder: str = "artifacts") -> str | None:
    """Save the winning pipeline; a failed write is logged and gives None."""
    path = f"{folder.rstrip('/')}/{name.replace(' ', '_')}_best"
    try:
        model.write().overwrite().save(path)
    except Exception as error:  # the leaderboard must outlive a full or read-only folder
        log.warning("could not save %s: %s", path, error)
        return None
    return path


def load_best(path: str) -> PipelineModel:
    return PipelineModel.load(path)
