"""All queries of this subpackage; importing it fills the registry."""

from importlib import import_module

from larder.llm.registry import ORACLES, QUERIES

MODULES = ["query_search", "query_phrases", "query_alignment", "query_curves", "query_native", "query_tokens", "query_dedup", "query_models"]

for _name in MODULES:
    import_module(f"larder.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
