"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_bpe
from .decontaminate import op9_decontamination
from .jaccard import OP10_SQL, op10_jaccard_join
from .katz import op3_katz
from .language import op5_language
from .negatives import OP11_SQL, op11_hard_negatives
from .phrases import OP12_SQL, op12_collocations
from .quality import op8_quality_rules
from .repeats import op13_repeats
from .secrets import op7_secrets
from .shards import op4_training_order
from .toxicity import op6_toxicity
from .warc import OP2_SQL, op2_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_katz": op3_katz,
    "op4_training_order": op4_training_order,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_repeats": op13_repeats,
}
ORACLE_SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
