"""The entry works without the training-text subpackage, and without a library that only it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["trenchline.llm", "corpus_pipeline", "xxhash", "tiktoken", "public_tokenizers"])
def test_entry_without(missing):
    code = f"""
import sys, warnings
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing + '.'!r}):
            raise ModuleNotFoundError("no " + name, name=name)
sys.meta_path.insert(0, Gone())
with warnings.catch_warnings(record=True) as seen:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
assert any("left out" in str(w.message) for w in seen)
assert not [q for q in entry.queries() if q.startswith("op") and q[2].isdigit() or q == "pipeline"]
assert len(entry.queries()) > 100 and set(entry.oracle_sql()) <= set(entry.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
