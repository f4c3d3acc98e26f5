import sys
from pathlib import Path

import pytest


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_llm_folder(tmp_path):
    """A copy without the folder and its pipeline imports, and has the other queries; a broken import within isn't hidden."""
    import shutil
    import subprocess

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "veriframe", tmp_path / "veriframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'record_rollup' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "HOME": str(tmp_path)})
    (tmp_path / "veriframe" / "llm").mkdir()
    (tmp_path / "veriframe" / "llm" / "__init__.py").write_text("")
    (tmp_path / "veriframe" / "llm" / "queries.py").write_text("import no_such_module")
    broken = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, env={"PATH": "/usr/bin", "HOME": str(tmp_path)})
    assert b"no_such_module" in broken.stderr


def test_nothing_else_imports_the_llm_folder():
    root = Path(__file__).resolve().parents[1]
    for path in (root / "veriframe").rglob("*.py"):
        if "llm" not in path.parts:
            assert "veriframe.llm" not in path.read_text(), path


@pytest.mark.parametrize("name", ["README.md"])
def test_readme_names_the_queries(name):
    assert "queries()" in (Path(__file__).resolve().parents[1] / name).read_text()
