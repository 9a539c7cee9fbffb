"""The registered queries and what they may depend on."""

from __future__ import annotations

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def imported(path: Path) -> set[str]:
    names: set[str] = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            names |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            names |= {f"{node.module}.{a.name}" for a in node.names}
    return names


def test_nothing_else_needs_the_text_operators():
    for path in (ROOT / "vulnlake").rglob("*.py"):
        if "llm" not in path.parts:
            assert not any(n.startswith("vulnlake.llm") or n.startswith("corpus_pipeline") for n in imported(path)), path


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry
    from vulnlake.catalog import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) - len(ORACLES) <= 4  # queries that SQL cannot express
