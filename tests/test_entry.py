import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_llm_folders(tmp_path):
    for name in ("sparkloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", REPO / name, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "sparkloom/llm"], check=True)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 50, done.stderr


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
