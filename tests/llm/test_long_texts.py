"""One text of 64 MB must leave a worker under 3 GB: each case runs in a process of its own and reports its peak."""

import subprocess
import sys

import pytest

MAKE = """
import random, resource, sys
import pyarrow as pa
draw = random.Random(1)
words = [f"w{draw.randrange(10**6)}" for _ in range(200000)]
text, kind = [], sys.argv[1]
while sum(map(len, text)) < 64 << 20:
    text.append(" ".join(words if kind == "repeated" else draw.choices(words, k=200000)) + " ")
table = pa.table({"doc_id": pa.array([1]), "text": pa.array(["".join(text)])})
del text
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
"""
REPORT = "\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
CASES = {
    "quality": "from veristream.llm import quality\nassert quality.assess(table['text'].combine_chunks())['n_words'][0] > 8e6",
    "simhash": "from veristream.llm import similar, simhash\nassert simhash.simhashes(table['text'].combine_chunks(), similar.SPACE).any()",
    "substrings": """
from veristream.llm import substrings
steps = substrings.Steps(20, 12, True)
docs = pa.table({"doc": pa.array(table.to_pylist(), pa.struct([("doc_id", pa.int64()), ("text", pa.string())]))})
del table
assert steps.probe([pa.scalar(0)], docs).num_rows
none = pa.table({"keys": pa.array([], pa.binary())})
assert steps.cut([pa.scalar(0)], docs, none)["n_words"][0].as_py() > 8e6
""",
}


@pytest.mark.parametrize("kind", ["fresh", "repeated"])
@pytest.mark.parametrize("case", CASES)
def test_peak(case, kind):
    done = subprocess.run([sys.executable, "-c", MAKE + CASES[case] + REPORT, kind], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) < 3 << 20, f"{int(done.stdout) >> 10} MB"
