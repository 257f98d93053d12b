"""Import every catalog module so the registry is complete."""

from aspectra.plans import (catalog, catalog_focal, catalog_io, catalog_metrics, catalog_models, catalog_more,  # noqa: F401
                            catalog_sampling, catalog_scoring)
from aspectra.plans.registry import ORACLES, QUERIES  # noqa: F401
