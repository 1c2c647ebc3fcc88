"""The entry point without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_llm_folders(tmp_path):
    for name in ("tidemark", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'c1_decision_grid' in q, sorted(q)[:20]; assert not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry_where_the_training_data_operators_cannot_be_imported(tmp_path):
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('no tokenizers here')\n")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {str(ROOT)!r}]; import __spark_entry__ as e; q = e.queries(); assert 'c1_decision_grid' in q; assert not any(k.startswith('op') for k in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
