"""Steps of a transform chain: functions from a DataFrame and options to a DataFrame."""

from tidemill.operators import dates, privacy, relational, shape, values, whole  # noqa: F401  (they register themselves)
from tidemill.operators.base import STEPS, apply_step, apply_steps

__all__ = ["STEPS", "apply_step", "apply_steps"]
