"""Queries over the driver tables, for the correctness gate and the bench."""

import importlib

MODULES = ["scalars", "places", "linking", "recommending", "payload_checks", "page_rows", "event_rules"]


def load_all():
    for module in MODULES:
        importlib.import_module(f"workloads.{module}")
