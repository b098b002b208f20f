"""The queries of the training-data operators, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP4_SQL, op4_decontamination
from .fingerprint import op5_fingerprint
from .html import op6_html_extraction
from .langid import op7_language_id
from .linededup import OP2_SQL, op2_line_dedup
from .mixing import op3_mixing
from .neardup import op10_near_duplicates
from .secrets import OP9_SQL, op9_secret_scan
from .suffixdedup import op8_suffix_dedup
from .toxicity import op1_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_fingerprint": op5_fingerprint,
    "op6_html_extraction": op6_html_extraction,
    "op7_language_id": op7_language_id,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_near_duplicates": op10_near_duplicates,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op9_secret_scan": OP9_SQL,
}
