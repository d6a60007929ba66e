"""Run the comparison by hand: python tests/run_oracle.py SF_DIR [name ...]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as e  # noqa: E402
import oracle  # noqa: E402
from corpusloom.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf)
    q, s = e.queries(), e.oracle_sql()
    bad = 0
    for n in names or q:
        try:
            if n in s:
                r = oracle.compare(spark, sf, n, q[n], s[n], con)
            else:
                import time
                t0 = time.time()
                r = {"name": n, "ok": True, "rows": len(q[n](spark, sf).collect()), "no_sql": True, "spark_s": round(time.time() - t0, 2)}
        except Exception as x:
            r = {"name": n, "ok": False, "why": f"{type(x).__name__}: {str(x)[:900]}"}
        bad += not r["ok"]
        print(r, flush=True)
    print("bad", bad, "of", len(names or q))
