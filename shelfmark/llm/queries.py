"""All queries of this subpackage."""

from . import centroids, exact_dedup, fingerprints, mixing, near_dedup, packing, resampling, secret_scans, sharding, suffix_dedup, token_counts, token_files, toxicity  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
