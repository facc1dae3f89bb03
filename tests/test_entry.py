import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_oracles():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stands_without_the_training_data_part():
    block = "import sys; sys.modules['bidloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(n.startswith('op1') for n in e.queries())"
    subprocess.run([sys.executable, "-c", block], cwd=ROOT, check=True)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
