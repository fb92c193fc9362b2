"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import op5_chat_format
from .decontamination import op1_decontamination
from .embedding_dedup import op7_embedding_dedup
from .license_scan import op2_license_scan
from .lattice_lm import op4_lattice_lm
from .minhash_dedup import op9_minhash_dedup
from .piece_codec import op6_sentencepiece
from .secret_scan import op8_secret_scan
from .secret_scan import oracle as op8_sql
from .suffix_dedup import op10_suffix_dedup
from .toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_decontamination, op2_license_scan, op3_toxicity, op4_lattice_lm, op5_chat_format, op6_sentencepiece, op7_embedding_dedup, op8_secret_scan, op9_minhash_dedup, op10_suffix_dedup]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"op8_secret_scan": op8_sql()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
