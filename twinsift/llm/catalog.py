"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinsift.llm import collocations, quality
from twinsift.llm.alignment import op11_alignment
from twinsift.llm.collocations import op13_collocations
from twinsift.llm.common import stored, table
from twinsift.llm.mixing import op8_source_mix
from twinsift.llm.neighbours import op1_nearest_neighbours
from twinsift.llm.packing import op6_packing
from twinsift.llm.sentencepieces import op12_sentencepiece
from twinsift.llm.shards import op10_hilbert_shards
from twinsift.llm.simhash import op3_simhash
from twinsift.llm.substrings import op5_substring_dedup
from twinsift.llm.tokenfile import op4_token_file
from twinsift.llm.toxicity import op2_toxicity
from twinsift.llm.urls import op7_url_filter


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = stored(quality.prepared(table(spark, sf_dir, "documents").select("doc_id", "text")), "grams")  # each text is cut into words once
    model = quality.fit_prepared(ready, table(spark, sf_dir, "labels"))
    return quality.judge_prepared(ready, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_token_file": op4_token_file,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_url_filter": op7_url_filter,
    "op8_source_mix": op8_source_mix,
    "op9_quality_rules": op9_quality_rules,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op11_alignment": op11_alignment,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {"op13_collocations": collocations.SQL}
