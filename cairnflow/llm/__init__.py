"""Operators on text for training corpora; nothing outside this folder imports them."""

from __future__ import annotations

import importlib

MODULES = ("packing", "contamination", "mojibake")


def query_modules() -> list:
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]
