"""Single-process Python reference point for the raw cue pass: the plain
``re`` statement of the semantics (tests/brute.py) over the salted documents
of an sf folder, built with the same SQL the oracle uses.

    python tools/python_reference_pass.py [sf_dir]
"""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

import brute  # noqa: E402
import duckdb  # noqa: E402

from cuelake.plans import derived as D  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
con = duckdb.connect()
con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
texts = [r[0] for r in con.execute(f"WITH {D.SALTED_DOCUMENTS_SQL} SELECT text FROM salted").fetchall()]
print("docs", len(texts), "chars", sum(map(len, texts)))
t = time.perf_counter()
tot = {}
for x in texts:
    for k, v in brute.totals(x).items():
        tot[k] = tot.get(k, 0) + v
print("python_re_raw_pass_sec", round(time.perf_counter() - t, 2), tot)
