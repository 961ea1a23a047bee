"""The driver contract holds whatever the text operators need and don't find."""

import subprocess
import sys
from pathlib import Path

import pytest

PROGRAM = """
import sys
for name in sys.argv[1].split(","):
    sys.modules[name] = None
import __spark_entry__
found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
print(sum(not n.startswith("op") and n != "pipeline" for n in found), sum(n.startswith("op") and n[2].isdigit() for n in found), set(sql) <= set(found))
"""


@pytest.mark.parametrize("missing", ["ahocorasick", "tiktoken", "tokenizers", "xxhash", "public_tokenizers", "regex", "graphweft.llm", "graphweft.llm,corpus_pipeline"])
def test_graph_queries_need_no_text_operators(missing):
    out = subprocess.run([sys.executable, "-c", PROGRAM, missing], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
    graph, text, known = out.stdout.split()[-3:]
    assert int(graph) > 100 and known == "True", out.stderr
    assert missing == "tokenizers" or int(text) == 0
