"""The registered queries without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), len(o), any(k.startswith('op') or k == 'pipeline' for k in q), set(o) <= set(q))"


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_the_corpus_operators(tmp_path, with_pipeline):
    """With the subpackage deleted every panel query still lists, whether corpus_pipeline.py is there or not."""
    from loomframe.plans import registry

    shutil.copytree(f"{ROOT}/loomframe", tmp_path / "loomframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (with_pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"))]:
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    said = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES)), "False", "True"], said.stderr


def test_shared_folder_is_required_on_a_cluster():
    from loomframe.functions.shared import shared_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
