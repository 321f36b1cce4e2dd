import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_without_llm():
    """The entry and all other modules work without the optional subpackage."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("quarry.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert q and not any(n.startswith("op") or n == "pipeline" for n in q) and set(o) <= set(q)
import quarry.api, quarry.index, quarry.search, quarry.streaming.watch, quarry.sources.manifests
assert not any(m.startswith("quarry.llm") for m in sys.modules)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
