"""Run selected registered queries against their oracle SQL: python scripts/oracle_check.py [names...]"""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from oracle_compare import compare, duck  # noqa: E402

from pulseframe.plans import catalog  # noqa: E402
from pulseframe.session import build_session, ensure_checkpoint_dir  # noqa: E402

sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
spark = build_session("local[8]", 8, extra={"spark.driver.memory": "8g"})
ensure_checkpoint_dir(spark)
qs, oracle = catalog.queries(), catalog.oracle_sql()
names = sys.argv[1:] or sorted(qs)
con = duck(sf)
bad = 0
for n in names:
    t = time.time()
    try:
        if n in oracle:
            ok, msg = compare(qs[n](spark, sf), oracle[n], con)
        else:
            c = qs[n](spark, sf).count()
            ok, msg = True, f"no oracle, {c} rows"
    except Exception as e:  # noqa: BLE001
        ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
    bad += not ok
    print(f"{'OK  ' if ok else 'FAIL'} {n:32s} {time.time()-t:6.2f}s {msg}", flush=True)
print(f"{len(names)-bad}/{len(names)} ok")
