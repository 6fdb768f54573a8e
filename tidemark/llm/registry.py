"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, jaccard, licenses, lm, media, packing, pii, secrets, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_html": html.op2_html,
        "op3_pack": packing.op3_pack,
        "op4_pii": pii.op4_pii,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_licenses": licenses.op6_licenses,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_jaccard_join": jaccard.op8_jaccard_join,
        "op9_lm": lm.op9_lm,
        "op10_media": media.op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_decontaminate": decontaminate.OP5_SQL,
        "op6_licenses": licenses.OP6_SQL,
        "op8_jaccard_join": jaccard.OP8_SQL,
    }
