"""CLI: compare every registered query with its oracle (python tests/run_oracles.py [sf_dir] [keys...])."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_compare import compare, duck  # noqa: E402

from shopflow.plans.catalog import ORACLES, QUERIES  # noqa: E402
from shopflow.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
keys = sys.argv[2:] or list(QUERIES)
spark = build_session()
con = duck(sf)
bad = 0
for k in keys:
    t0 = time.time()
    if k not in ORACLES:
        n = QUERIES[k](spark, sf).count()
        print(json.dumps({"key": k, "rows_only": n, "sec": round(time.time() - t0, 2)}))
        continue
    try:
        r = compare(spark, k, QUERIES[k], ORACLES[k], sf, con)
    except Exception as e:  # report and go on
        r = {"key": k, "error": str(e)[:800]}
    r["sec"] = round(time.time() - t0, 2)
    ok = r.get("values_match")
    bad += not ok
    print(("OK  " if ok else "BAD ") + json.dumps(r, default=str))
print("bad:", bad)
