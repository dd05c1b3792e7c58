"""The query modules of this subpackage."""

from __future__ import annotations

import importlib

#: Modules with queries() and oracle_sql(), by problem.
NAMES = ["q_alignment", "q_canonical", "q_lookalike", "q_scans", "q_sentences", "q_near", "q_tokens", "q_mixing", "q_abuse"]


def modules() -> list:
    return [importlib.import_module(f"folioscope.llm.{n}") for n in NAMES]
