"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import common


def _query(module: str, name: str):
    def run(spark, sf_dir):
        import importlib

        common.put_on_path(spark)
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


NAMES = {
    "op1_audio_features": "media",
    "op2_simhash": "simhash",
    "op3_main_text": "html",
    "op4_best_fit": "packing",
    "op5_toxicity": "toxicity",
    "op6_top_k": "topk",
    "op7_suffix_dedup": "suffix",
    "op8_separator_scan": "tokencount",
    "op9_byte_bpe": "bpe",
    "op10_quality": "quality",
    "op11_prefix_trie": "trie",
    "op12_near_embeddings": "caps",
    "op13_repair": "repair",
}


def queries():
    return {name: _query(module, name) for name, module in NAMES.items()}


def oracle_sql():
    from .caps import OP12_SQL
    from .repair import OP13_SQL
    from .topk import OP6_SQL
    from .trie import OP11_SQL

    return {"op6_top_k": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_near_embeddings": OP12_SQL, "op13_repair": OP13_SQL}
