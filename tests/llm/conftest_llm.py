"""Rows that tests share with the fixtures."""

import importlib.util
from pathlib import Path

_spec = importlib.util.spec_from_file_location("llm_fixtures", Path(__file__).with_name("conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
odd_rows, EXTRA, words = _module.odd_rows, _module.EXTRA, _module.words
