"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import chat, decontam, exact, html, langid, lm, mixing, near, pii, quality
from lodestone.llm.common import table


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": html.op1_html_extract,
    "op2_quality": quality.op2_quality,
    "op3_pii_surrogates": pii.op3_pii_surrogates,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_chat_format": chat.op5_chat_format,
    "op6_mixing": mixing.op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_lm_score": lm.op8_lm_score,
    "op9_near_dedup": near.op9_near_dedup,
    "op10_language_id": langid.op10_language_id,
}
ORACLES: dict[str, str] = {"op5_chat_format": chat.OP5_SQL, "op7_exact_dedup": OP7_SQL, "op9_near_dedup": near.OP9_SQL}
