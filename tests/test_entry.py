import os

import pytest


def test_names_agree_and_flagship_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert e.entry(spark).columns == ["venue_key_a", "venue_key_b"]


def test_core_does_not_need_the_llm_package():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "lokalis"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("lokalis.llm") for n in names), p
