"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from talliver.llm import collocations, line_dedup, oracles, resampling, topk_search, url_filter
from talliver.llm.byte_bpe import op9_byte_bpe
from talliver.llm.chat_format import op10_preference_format
from talliver.llm.decontaminate import op6_benchmark_decontamination
from talliver.llm.language_id import op8_language_id
from talliver.llm.ngram_join import op1_ngram_jaccard_join
from talliver.llm.secret_scan import op2_secret_scan
from talliver.llm.sharding import op5_hypergeometric_sharding
from talliver.llm.substring_dedup import op3_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_secret_scan,
        op3_substring_dedup,
        topk_search.op4_exact_topk,
        op5_hypergeometric_sharding,
        op6_benchmark_decontamination,
        url_filter.op7_url_filter,
        op8_language_id,
        op9_byte_bpe,
        op10_preference_format,
        line_dedup.op11_line_dedup,
        collocations.op12_phrase_collocations,
        resampling.op13_importance_resampling,
    )
}
ORACLES = {
    "op1_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op2_secret_scan": oracles.SECRETS,
    "op3_substring_dedup": oracles.SUBSTRINGS,
    "op4_exact_topk": topk_search.ORACLE,
    "op6_benchmark_decontamination": oracles.DECONTAMINATION,
    "op7_url_filter": url_filter.ORACLE,
    "op10_preference_format": oracles.PREFERENCES,
    "op11_line_dedup": line_dedup.ORACLE,
    "op12_phrase_collocations": collocations.ORACLE,
    "op13_importance_resampling": resampling.ORACLE,
}
