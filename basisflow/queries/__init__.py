"""Importing this package registers every query."""

import importlib

for _module in ("core", "cleaning", "risk", "trades", "reporting", "volatility", "episodes", "files", "scalars", "grains", "strategies"):
    importlib.import_module(f"basisflow.queries.{_module}")
