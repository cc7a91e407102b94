"""Writing scores, tables and frames."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame


def _plain(value):
    """NaN and infinite as null, containers as they are."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(payload: dict, path: str | Path) -> Path:
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(_plain(payload), indent=2))
    return out


def write_tables(tables: dict[str, DataFrame], folder: str, metadata: dict | None = None, form: str = "csv") -> None:
    """One folder a table, written by the executors, and ``metadata.json``."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).format(form).save(f"{folder}/{name}")
    if metadata is not None:
        some = next(iter(tables.values())).sparkSession
        some.createDataFrame([(json.dumps(_plain(metadata)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata.json")


def write_scenarios(tables: dict[str, DataFrame], folder: str) -> Path:
    """Scenario tables as CSV folders, the results as JSON records too, and
    ``diagnostics.json`` with what the other tables say of each group and metric
    (a row each)."""
    write_tables(tables, folder)
    tables["results"].write.mode("overwrite").json(f"{folder}/results.json")
    found: dict = {}
    for name in ("monotonicity", "saturation", "summary"):
        for r in tables[name].collect():
            found.setdefault(str(r["scenario_group"]), {}).setdefault(r["metric"], {})[name] = {k: v for k, v in r.asDict().items() if k not in ("scenario_group", "metric")}
    return write_json(found, Path(folder) / "diagnostics.json")


def write_frame(df: DataFrame, path: str, form: str = "csv") -> None:
    """A sequence frame, as it can be loaded again."""
    df.write.mode("overwrite").option("header", True).format(form).save(path)


def bar(value: float | None, width: int = 16, colours: bool = True) -> str:
    """A score from 0 to 1 as a line; from .8 on it is good, from .4 on fair."""
    if value is None or not math.isfinite(value):
        return "-" * width
    held = max(0.0, min(1.0, value))
    at = round(held * (width - 1))
    line = f"{'=' * at}>{'-' * (width - 1 - at)}"
    colour = 32 if held >= 0.8 else 33 if held >= 0.4 else 31
    return f"\033[{colour}m{line}\033[0m" if colours else line


def shown(label: str, scores: dict[str, float | None], colours: bool = True) -> str:
    lines = [f"  {k:32s} {'null' if v is None else f'{v:.3f}'} {bar(v, colours=colours)}" for k, v in scores.items()]
    return "\n".join([f"{label}:", *lines])
