import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_subpackage(tmp_path):
    """The rest of the library stands by itself."""
    for p in ROOT.rglob("*.py"):
        at = p.relative_to(ROOT)
        if "llm" in at.parts or at.name == "corpus_pipeline.py" or at.parts[0] == "tests":
            continue
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q1_pricing_summary' in q and not [x for x in q if x.startswith('op') or x == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "quillon").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "quillon.llm" not in p.read_text(), p
