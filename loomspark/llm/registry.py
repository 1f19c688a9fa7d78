"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from loomspark.llm.decontaminate import op9_decontaminate
from loomspark.llm.fill_middle import OP12_SQL, op12_fill_middle
from loomspark.llm.language import op5_language
from loomspark.llm.licenses import OP1_SQL, op1_license_scan
from loomspark.llm.mixing import op10_mix_sources
from loomspark.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from loomspark.llm.quality import op3_quality
from loomspark.llm.secrets import OP2_SQL, op2_secret_scan
from loomspark.llm.simhash import op8_simhash
from loomspark.llm.token_counts import op6_token_counts
from loomspark.llm.tokens import op4_token_files
from loomspark.llm.topk import OP7_SQL, op7_exact_topk
from loomspark.llm.warc import OP13_SQL, op13_warc


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_secret_scan": op2_secret_scan,
        "op3_quality": op3_quality,
        "op4_token_files": op4_token_files,
        "op5_language": op5_language,
        "op6_token_counts": op6_token_counts,
        "op7_exact_topk": op7_exact_topk,
        "op8_simhash": op8_simhash,
        "op9_decontaminate": op9_decontaminate,
        "op10_mix_sources": op10_mix_sources,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_fill_middle": op12_fill_middle,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict:
    return {
        "op1_license_scan": OP1_SQL,
        "op2_secret_scan": OP2_SQL,
        "op7_exact_topk": OP7_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op12_fill_middle": OP12_SQL,
        "op13_warc": OP13_SQL,
    }
