import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_entry_works_without_the_training_data_subpackage(tmp_path, left):
    shutil.copytree(ROOT / "factledger", tmp_path / "factledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for name in left:  # a stand-in that needs the subpackage, since the real one may be deleted with it
        (tmp_path / name).write_text("from factledger.llm import common\n")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and o.keys() <= q.keys(); assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_another_missing_module_is_an_error(tmp_path):
    """With a stand-in for the subpackage that needs something else, so the test holds where the subpackage is not."""
    shutil.copytree(ROOT / "factledger", tmp_path / "factledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("run, ORACLE_SQL = None, None\n")
    (tmp_path / "factledger/llm").mkdir()
    (tmp_path / "factledger/llm/__init__.py").touch()
    (tmp_path / "factledger/llm/queries.py").write_text("QUERIES, ORACLES = {}, {}\n")
    run = lambda: subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; assert 'pipeline' in e.queries() or not e.llm_queries.QUERIES"], cwd=tmp_path, capture_output=True, timeout=120).returncode
    assert run() == 0
    (tmp_path / "factledger/llm/queries.py").write_text("import no_such_module\n")
    assert run() == 1


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "factledger").rglob("*.py"):
        if "llm" not in path.parts:
            assert "factledger.llm" not in path.read_text(), path


def test_entry_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["row_id", "entity_id", "metric_name", "num_value", "period_end"]
