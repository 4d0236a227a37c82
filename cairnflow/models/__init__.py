"""Models by name, each fitted and scored over DataFrames."""

from __future__ import annotations

MODELS = {"gbt": "cairnflow.models.trees", "sage": "cairnflow.models.sage"}


def get_model(name: str):
    import importlib

    if name not in MODELS:
        raise ValueError(f"no model {name!r}; there are {sorted(MODELS)}")
    return importlib.import_module(MODELS[name])
