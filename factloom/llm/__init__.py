"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .bpe import op4_bpe_trie
    from .decontaminate import op6_decontaminate
    from .html_extract import op2_html_text
    from .interactions import op11_filter_audit
    from .jaccard import op9_jaccard_join
    from .linededup import line_chunks_any, op10_line_chunks
    from .novelty import op12_secret_novelty
    from .quality import op8_quality_llr
    from .sharding import op1_hilbert_shards
    from .substrings import op7_substring_fm
    from .toxicity import op5_toxicity_mil
    from .warc import op3_warc_zstd
    from .whitening import op13_whitening

    found = (op1_hilbert_shards, op2_html_text, op3_warc_zstd, op4_bpe_trie, op5_toxicity_mil, op6_decontaminate)
    found += (op7_substring_fm, op8_quality_llr, op9_jaccard_join, op10_line_chunks, line_chunks_any)
    found += (op11_filter_audit, op12_secret_novelty, op13_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .decontaminate import OP6_SQL
    from .interactions import OP11_SQL
    from .jaccard import OP9_SQL
    from .linededup import ANY_SQL, OP10_SQL
    from .substrings import OP7_SQL
    from .warc import OP3_SQL

    found = {"op3_warc_zstd": OP3_SQL, "op6_decontaminate": OP6_SQL, "op7_substring_fm": OP7_SQL, "op9_jaccard_join": OP9_SQL}
    return found | {"op10_line_chunks": OP10_SQL, "line_chunks_any": ANY_SQL, "op11_filter_audit": OP11_SQL}
