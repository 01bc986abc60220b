"""The registered queries of this subpackage."""

from docquarry.llm import bpe_codec, class_lm, exact_dedup, filter_audit, language_id, mixing, pii, sharding, shingle_join, token_counts, toxicity, vector_dedup, whitening  # noqa: F401
from docquarry.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
