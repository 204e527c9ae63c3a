"""Small observations of every kind, made here: the test tables hold no code, errors or logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SOURCE = "import os\nfrom sys import path\n\n@cached\ndef load_config(name):\n    value = read(name)\n    return value\n\nclass Store:\n    def get(self, key):\n        return self.rows[key]\n\n    def put(self, key, value):\n        raise KeyError('no key')\n" + "".join(f"\ndef helper_{i}(x):\n    return x + {i}\n" for i in range(6))
_TRACE = 'starting\nTraceback (most recent call last):\n  File "app/main.py", line 10, in run\n    go()\n  File "app/core.py", line 22, in go\n    load_config(1)\nValueError: bad config\ndone\n'
_DIFF = "diff --git a/x.py b/x.py\nindex 12ab..34cd 100644\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n import os\n-old = 1\n+new = 2\n tail\n"
_TESTS = "collected 3 items\ntests/test_a.py ..F\n=== FAILURES ===\ntests/test_a.py:12: AssertionError\nplain line\n1 failed, 2 passed\n"
_GREP = "src/a.py:3:def load_config(name):\nsrc/b.py:9:    load_config('x')\nsrc/c.py:1:import os\n"
_TREE = "src/\n├── app/\n│   ├── main.py\n│   └── core.py\n└── tests/\n    └── test_a.py\n"
_PLAIN = "".join(f"step {i} finished in {i * 3} ms\n" for i in range(30)) + "warning: disk almost full\n" + "".join(f"row {i}\n" for i in range(30))

#: (obs_id, command, path, query, text)
OBSERVATIONS = [
    (1, "cat src/config.py", "src/config.py", "where is load_config defined", _SOURCE),
    (2, "python app/main.py", "", "why does load_config fail", _TRACE),
    (3, "git diff", "", "what changed in x.py", _DIFF),
    (4, "pytest -q tests", "", "which test fails", _TESTS),
    (5, "grep -rn load_config src", "", "load_config callers", _GREP),
    (6, "tree src", "", "where is core.py", _TREE),
    (7, "make all", "", "is the disk full", _PLAIN),
    (8, "echo", "", "nothing", ""),
]


def observations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OBSERVATIONS, "obs_id bigint, command string, path string, query string, text string")


def observations_sql() -> str:
    """The same rows as a SQL relation."""
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in OBSERVATIONS) + ") AS t(obs_id, command, path, query, text)"
