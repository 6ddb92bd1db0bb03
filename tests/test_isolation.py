"""The library, its queries and the entry point work without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = set(e.queries())
assert names and names == set(e.oracle_sql()) and not [n for n in names if n.startswith("op") or n == "pipeline"], names
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.entry(spark).count())
"""


def test_without_the_training_data_operators(tmp_path, sf_dir):
    for left_out in (["corpus_pipeline.py"], []):
        copy = tmp_path / str(len(left_out))
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", *left_out))
        for folder in ("shelfspark/llm", "tests/llm"):
            shutil.rmtree(copy / folder, ignore_errors=True)
        assert (copy / "corpus_pipeline.py").exists() == (not left_out and (ROOT / "corpus_pipeline.py").exists())
        out = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=300)
        assert "rows 200" in out.stdout, out.stderr[-2000:]


BLOCKED = """
import sys
sys.modules[{!r}] = None
import __spark_entry__ as e
print("queries", len([n for n in e.queries() if not n.startswith("op") and n != "pipeline"]), len([n for n in e.queries() if n.startswith("op")]))
"""


def test_with_a_dependency_of_the_operators_blocked():
    """Whatever the operators lack, the library's own queries are there."""
    import __spark_entry__

    names = list(__spark_entry__.queries())
    own = len([n for n in names if not n.startswith("op") and n != "pipeline"])
    for module in ("zstandard", "ahocorasick", "tokenizers"):
        out = subprocess.run([sys.executable, "-c", BLOCKED.format(module)], cwd=ROOT, capture_output=True, text=True, timeout=120)
        assert f"queries {own} " in out.stdout, (module, out.stderr[-2000:])
        if module == "zstandard" and len(names) > own:
            assert f"queries {own} 0" in out.stdout and "shelfspark.llm.queries is left out" in out.stderr
