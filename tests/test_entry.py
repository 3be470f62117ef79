"""The entry module with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') for k in e.queries()), 'pipeline' in e.queries())"


def counted(folder: str) -> list[str]:
    env = os.environ | {"PYTHONPATH": folder}
    return subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split()


def test_core_queries_stand_alone(tmp_path):
    """corpus_pipeline.py may stay behind without the folder it imports from, or go with it."""
    every, sql, _, _ = counted(ROOT)
    shutil.copytree(f"{ROOT}/pagemill", tmp_path / "pagemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    core = counted(str(tmp_path))
    assert core[2:] == ["0", "False"] and 250 < int(core[0]) <= int(every) and 200 < int(core[1]) <= int(sql)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert counted(str(tmp_path)) == core
