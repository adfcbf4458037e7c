"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10 and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_topk' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_a_mistake_in_the_subpackage_is_not_hidden(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tessera" / "llm").mkdir()
    (tmp_path / "tessera" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("STAGES, ORACLE_SQL, run = [], None, None")
    for text, wrong in (("import tessera.llm.typo", True), ("import no_such_module", True), ("QUERIES, ORACLES = {}, {}", False)):
        (tmp_path / "tessera" / "llm" / "queries.py").write_text(text)
        done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True)
        assert (done.returncode != 0) == wrong, text
