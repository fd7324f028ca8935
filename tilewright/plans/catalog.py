"""All registered queries."""

from tilewright.plans import state, datasets, geometry, sequences, pixels, runs, streams, files  # noqa: F401
from tilewright.plans.registry import ORACLES, QUERIES  # noqa: F401
