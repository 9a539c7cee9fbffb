"""Every registered query; importing the package registers them all."""

from vulnlake.catalog import analyses, candidates, linking, nested, stores, texts  # noqa: F401
from vulnlake.catalog.registry import ORACLES, QUERIES  # noqa: F401
