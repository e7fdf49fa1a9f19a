"""What ``__spark_entry__`` registers where parts of the subpackage cannot be imported."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent.parent
COUNT = "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), len(e.queries()) > 20)"
HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "xxhash":
            raise ModuleNotFoundError("hidden", name=name)
sys.meta_path.insert(0, Hide())
"""


def _run(folder, code):
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=60, check=False)
    return run.stdout.strip(), run.stderr


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(REPO / name, tmp_path)
    shutil.copytree(REPO / "linewright", tmp_path / "linewright", ignore=shutil.ignore_patterns("__pycache__"))
    return tmp_path


def test_whole(copy):
    assert _run(copy, COUNT)[0] == "13 True"


def test_without_the_subpackage(copy):
    shutil.rmtree(copy / "linewright" / "llm")
    (copy / "corpus_pipeline.py").unlink()
    assert _run(copy, COUNT)[0] == "0 True"


def test_without_a_library_of_its_own(copy):
    assert _run(copy, HIDE + COUNT)[0] == "0 True"


@pytest.mark.parametrize("fault", ["module", "name"])
def test_faults_of_ours_are_raised(copy, fault):
    if fault == "module":
        (copy / "linewright" / "llm" / "shards.py").unlink()
    else:
        common = copy / "linewright" / "llm" / "common.py"
        common.write_text(common.read_text().replace("def join_counted", "def joined"))
    out, err = _run(copy, COUNT)
    assert out == "" and "ImportError" in err and ("'shards'" in err or "join_counted" in err)
