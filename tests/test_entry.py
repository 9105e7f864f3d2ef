import importlib.util
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and {"asset", "price_usd", "vwap_24h", "price_status"} <= set(rows[0].asDict())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_without_the_text_operators(tmp_path):
    """Nothing outside names them but the guarded import of the entry."""
    inside = [p for p in (ROOT / "marketlake").rglob("*.py") if "llm" not in p.parts]
    assert all(not re.search(r"marketlake\.llm|corpus_pipeline", p.read_text()) for p in inside)
    code = "import sys; sys.modules['marketlake.llm'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.split()[1] == "False", out.stderr


def test_copy_without_the_text_operators(tmp_path):
    """A copy without their folders and the pipeline imports, registers and runs a query and the other tests' modules."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache"))
    code = (
        "import importlib, pathlib, __spark_entry__ as e\n"
        "assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())\n"
        "[importlib.import_module(f'tests.{p.stem}') for p in pathlib.Path('tests').glob('test_*.py')]\n"
        "from marketlake.session import session\n"
        "print('rows', e.entry(session('copy', master='local[2]', shuffle_partitions=2)).count())"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "rows 5" in out.stdout, out.stderr[-2000:]
