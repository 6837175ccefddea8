"""The registry without the training-data part, or without a library that only that part needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.modules[{hidden!r}] = None
import __spark_entry__ as registry
names = set(registry.queries())
print(len(names), any(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names, set(registry.oracle_sql()) <= names)
"""


@pytest.mark.parametrize("hidden", ["ahocorasick", "tiktoken", "tokenizers", "sentencepiece", "public_tokenizers", "surveyloom.llm", "corpus_pipeline"])
def test_core_queries_stay(hidden):
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    count, numbered, pipeline, checked = run.stdout.split()
    assert int(count) >= 90 and pipeline == "False" and checked == "True"
    assert numbered == str(hidden == "corpus_pipeline" and os.path.isdir(f"{ROOT}/surveyloom/llm"))
