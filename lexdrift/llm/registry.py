"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
import importlib.util

#: query -> module with query(spark, sf_dir) and perhaps ORACLE_SQL.
MODULES = {
    "op1_centroid_language": "langid",
    "op2_lattice_lm": "lm",
    "op3_jpeg_media": "media",
    "op4_piece_round_trip": "pieces",
    "op5_chunk_fingerprints": "fingerprints",
    "op6_attention_quality": "quality",
    "op7_edit_token_counts": "counts",
    "op8_metric_jaccard": "jaccard",
    "op9_minhash_lines": "lines",
    "op10_pivotal_mixing": "mixing",
    "op11_tiled_simhash": "simhash",
    "op12_filter_lattice": "audit",
    "op13_elkan_clusters": "kmeans",
}


#: Libraries that the operators build on, besides numpy and pyarrow.
NEEDED = ["ahocorasick", "regex", "sentencepiece", "tiktoken", "xxhash"]


def missing() -> list[str]:
    """Those that aren't installed."""
    return [name for name in NEEDED if importlib.util.find_spec(name) is None]


def queries() -> dict:
    return {name: importlib.import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
