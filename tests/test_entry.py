import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_language_model_subpackage(tmp_path):
    shutil.copytree(ROOT / "tabdelta", tmp_path / "tabdelta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'q_cell_changes' in q and not any(n.startswith('op') for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 60, out.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tabdelta").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
