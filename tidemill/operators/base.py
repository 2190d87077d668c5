"""The registry of steps and how a chain of them is applied."""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemill.errors import ConfigurationError, TidemillError, TransformationError
from tidemill.registry import Registry

STEPS = Registry("step")


@dataclass
class StepContext:
    """What steps may know of the run they belong to."""

    execution_id: str = ""
    pipeline_id: str = ""
    task_id: str = ""
    correlation_id: str = ""
    source: str = ""
    batch_size: int = 10_000
    params: dict = field(default_factory=dict)
    state: dict = field(default_factory=dict)
    read: object = None  # (spec) -> DataFrame, for lookups

    @property
    def scope(self) -> dict:
        return {"params": self.params, "state": self.state}


def apply_step(df: DataFrame, spec: dict, context: StepContext | None = None) -> DataFrame:
    """Apply one step, given as its type and options."""
    options = {k: v for k, v in spec.items() if k not in ("type", "name")}
    build = STEPS.get(spec.get("type", ""))
    known = inspect.signature(build).parameters
    extra = [k for k in options if k not in known and k + "_" not in known]
    if extra:
        raise ConfigurationError(f"step {spec['type']!r} has no option {', '.join(map(repr, extra))}")
    options = {k if k in known else k + "_": v for k, v in options.items()}
    try:
        return build(df, context or StepContext(), **options)
    except TidemillError:
        raise
    except TypeError as e:
        raise ConfigurationError(f"step {spec['type']!r}: {e}") from e
    except Exception as e:
        raise TransformationError(f"step {spec['type']!r}: {e}") from e


def apply_steps(df: DataFrame, specs: list[dict], context: StepContext | None = None) -> DataFrame:
    """Apply a chain; nothing runs until the result is used."""
    for spec in specs:
        df = apply_step(df, spec, context)
    return df
