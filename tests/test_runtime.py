"""The shared folder and what is written to it."""

import os
import shutil
import subprocess
import sys

import pytest

from corpusloom import runtime

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_materialised_tables_go(spark):
    one = runtime.materialise(spark.range(5), "t")
    path = one.inputFiles()[0].removeprefix("file://")
    assert one.count() == 5 and os.path.exists(path)
    assert runtime.release_tables(spark) >= 1 and not os.path.exists(path) and runtime.release_tables(spark) == 0


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="share"):
        runtime.shared_dir(Session)


def test_optional_part_only(tmp_path):
    """Without the optional part the other queries are there; another missing module is an error."""
    for name in ("corpusloom", "__spark_entry__.py"):
        source = os.path.join(HERE, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "corpusloom" / "llm", ignore_errors=True)
    run = lambda folder, before="pass": subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(folder)!r}); {before}; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op1_') for q in e.queries()))"], capture_output=True, text=True, cwd=folder)
    without = run(tmp_path).stdout.split()
    assert int(without[0]) > 80 and without[1] == "False"
    if os.path.exists(os.path.join(HERE, "corpus_pipeline.py")):
        broken = run(HERE, "sys.modules['zstandard'] = None")
        assert broken.returncode and "zstandard" in broken.stderr
