"""The driver's entry imports before there is a session, and without modules that only the llm subpackage needs."""

import subprocess
import sys
from pathlib import Path

import pytest

from plumbline.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["", "regex", "public_tokenizers", "plumbline.llm"])
def test_entry_imports(missing):
    code = f"import sys\nif {missing!r}: sys.modules[{missing!r}] = None\nimport __spark_entry__ as e\nprint('\\n'.join(e.queries()))\nassert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    found = set(done.stdout.split())
    assert set(catalog.QUERIES) <= found
    if missing:
        assert found == set(catalog.QUERIES) and "left out" in done.stderr
