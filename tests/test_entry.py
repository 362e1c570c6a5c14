import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_parts(tmp_path):
    """The entry point imports where the corpus operators are not there, also where their folder was left empty."""
    for f in ("seamark", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / f).is_dir() else shutil.copy)(ROOT / f, tmp_path / f)
    shutil.rmtree(tmp_path / "seamark/llm", ignore_errors=True)
    say = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) > 70 and out[1:] == ["0", "True"]
        (tmp_path / "seamark/llm/__pycache__").mkdir(parents=True, exist_ok=True)
