"""Operators never read files or know about the test data."""

import ast
import pathlib

ROOT = pathlib.Path(__file__).parent.parent / "plotgap"


def imports(path):
    tree = ast.parse(path.read_text())
    return {n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)} | {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}


def test_operators_do_not_import_sources_or_fixtures():
    for folder in ("operators", "plans", "functions"):
        for path in (ROOT / folder).glob("*.py"):
            assert not any(m.startswith(("plotgap.sources", "plotgap.fixtures", "plotgap.catalog")) for m in imports(path)), path


def test_no_lineage_is_cut_on_one_machine():
    for path in ROOT.rglob("*.py"):
        assert "local" + "Checkpoint" not in path.read_text(), path
