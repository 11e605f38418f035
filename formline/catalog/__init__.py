"""Named queries over the given tables."""

from formline.catalog import form, models, probability, profiling, text  # noqa: F401
from formline.catalog.registry import ORACLES, QUERIES  # noqa: F401
