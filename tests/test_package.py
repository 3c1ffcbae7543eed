import os
import subprocess
import sys

from pyspark import cloudpickle

import respondex
from respondex.models import word_count_model
from respondex.operators.embed import _embed_array


def test_tasks_need_no_installed_package(tmp_path):
    model = word_count_model(8, normalize=True)

    def task():
        return _embed_array(["one two", None], model, model.load()).to_pylist()

    (tmp_path / "task.pickle").write_bytes(cloudpickle.dumps(task))
    code = (
        "import importlib.util, pickle; assert importlib.util.find_spec('respondex') is None; "
        "print(pickle.load(open('task.pickle', 'rb'))())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == str(task())


def test_public_names():
    for name in ("build", "search", "search_batch", "prepare_prompts", "read_survey", "Model"):
        assert name in respondex.__all__
