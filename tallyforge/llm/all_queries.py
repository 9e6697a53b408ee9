"""Importing this module registers every corpus query."""

from tallyforge.llm import (  # noqa: F401
    attribution, byte_bpe, decontamination, divergence, licenses, line_dedup, mixing, quality, resampling, simhash, toxicity, warc, wrappers,
)
from tallyforge.llm.common import ORACLES, QUERIES  # noqa: F401
