"""Driver queries and their SQL oracles."""

from checks import captions, predictions, windows  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
