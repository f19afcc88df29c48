"""The ten operators over their whole tables, and the pipeline, under the names of the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op8_neighbours
from .mixing import op6_mixing
from .neardup import op2_near_duplicates
from .packing import op3_packing
from .pii import op5_pii
from .quality import op10_quality
from .secrets import op7_secrets
from .sharding import op9_shards
from .suffix import op4_repeats
from .tokens import op1_tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_tokens, op2_near_duplicates, op3_packing, op4_repeats, op5_pii, op6_mixing, op7_secrets, op8_neighbours, op9_shards, op10_quality)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {}
