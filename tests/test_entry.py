"""The driver contract with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def loaded(folder):
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), int(out[1]), out[2] == "True"


def copied(tmp_path, *left_out):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *(Path(x).name for x in left_out if x.endswith(".py")))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    for name in left_out:
        if (tmp_path / "copy" / name).is_dir():
            shutil.rmtree(tmp_path / "copy" / name)
    return tmp_path / "copy"


@pytest.mark.parametrize("left_out", [
    ("corpusloom/llm", "tests/llm"), ("corpusloom/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",),
])
def test_entry_loads_without_the_training_data_operators(tmp_path, left_out):
    queries, twins, pipeline = loaded(copied(tmp_path, *left_out))
    assert queries > 100 and twins > 100 and not pipeline
