"""The queries of this subpackage, as the driver names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import byte_bpe, digests
from .common import table
from .cotrain import classify_quality
from .flac import media_blocks, media_digests
from .langid import identify_languages
from .neardup import near_duplicates
from .packing import best_fit_packing
from .perplexity import quality_rules
from .preference import PREFERENCE_SQL, format_preferences, pair_conversations, spans_as_text
from .transducer import token_counts
from .warc import REVISIT_SQL, deduplicate_archives


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_as_text(format_preferences(pair_conversations(table(spark, sf_dir, "conversations"))))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_archives(table(spark, sf_dir, "pages"))


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(media_blocks(table(spark, sf_dir, "documents")))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(byte_bpe(table(spark, sf_dir, "documents")))


QUERIES = (
    op1_minhash_near_dedup,
    op2_co_training_quality,
    op3_language_id,
    op4_quality_rules,
    op5_preference_formatting,
    op6_token_counts,
    op7_best_fit_packing,
    op8_warc_revisits,
    op9_flac_media,
    op10_byte_level_bpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; the others are tested against plain Python on small tables."""
    return {"op5_preference_formatting": PREFERENCE_SQL, "op8_warc_revisits": REVISIT_SQL}
