"""Queries of this subpackage for the driver, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op6_nearest
from .bytebpe import op3_byte_bpe
from .packing import op4_packing
from .passages import op5_passages
from .setjoin import op8_ngram_join
from .sharding import SQL as SHARDING_SQL
from .sharding import op9_sharding
from .tokenfile import op1_token_files
from .digest import op7_digest
from .langid import op2_language_id
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_passages": op5_passages,
    "op8_ngram_join": op8_ngram_join,
    "op6_nearest": op6_nearest,
    "op3_byte_bpe": op3_byte_bpe,
    "op10_toxicity": op10_toxicity,
    "op2_language_id": op2_language_id,
    "op7_digest": op7_digest,
    "op1_token_files": op1_token_files,
    "op9_sharding": op9_sharding,
    "op4_packing": op4_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op9_sharding": SHARDING_SQL,
}
