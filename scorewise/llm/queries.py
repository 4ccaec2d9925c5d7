"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorewise.llm.bpe import op2_byte_bpe
from scorewise.llm.chat import OP9_SQL, op9_chat_format
from scorewise.llm.decontam import op6_string_tiling
from scorewise.llm.embed_dups import op10_cross_polytope
from scorewise.llm.idcodec import op3_token_files
from scorewise.llm.licenses import OP11_SQL, op11_license_blocks
from scorewise.llm.minhash import op8_minhash_groups
from scorewise.llm.quality import op4_quality
from scorewise.llm.repair import OP12_SQL, op12_cyk_repair
from scorewise.llm.shards import op5_uniform_shards
from scorewise.llm.suffix_dups import op1_suffix_repeats
from scorewise.llm.trie import OP13_SQL, op13_centroid_trie
from scorewise.llm.warc import op7_warc_derivatives


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_repeats": op1_suffix_repeats,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_token_files": op3_token_files,
        "op4_quality": op4_quality,
        "op5_uniform_shards": op5_uniform_shards,
        "op6_string_tiling": op6_string_tiling,
        "op7_warc_derivatives": op7_warc_derivatives,
        "op8_minhash_groups": op8_minhash_groups,
        "op10_cross_polytope": op10_cross_polytope,
        "op9_chat_format": op9_chat_format,
        "op11_license_blocks": op11_license_blocks,
        "op12_cyk_repair": op12_cyk_repair,
        "op13_centroid_trie": op13_centroid_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_chat_format": OP9_SQL,
        "op11_license_blocks": OP11_SQL,
        "op12_cyk_repair": OP12_SQL,
        "op13_centroid_trie": OP13_SQL,
    }
