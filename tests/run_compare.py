"""Command line: python tests/run_compare.py [sf] [key prefix ...]"""

import os
import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")
import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

from pitspark.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
prefixes = tuple(sys.argv[2:]) or ("",)
sf_dir = f"/root/testdata/sf{sf}"
spark = local_session(os.environ.get("CORES", "8"))
spark.sparkContext.setLogLevel("ERROR")
con = compare.connect(sf_dir)
sqls = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if not name.startswith(prefixes):
        continue
    t0 = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in sqls:
            diff = compare.differences(df, con, sqls[name])
        else:
            diff = [] if len(df.collect()) >= 0 else []
        status = "ok" if not diff else "DIFF"
    except Exception as e:  # noqa: BLE001
        diff, status = [str(e)[:900]], "FAIL"
    n = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchone()[0] if name in sqls and status != "FAIL" else "-"
    bad += status != "ok"
    print(f"{status:5s} {name} rows={n} {time.time() - t0:.1f}s", flush=True)
    for d in diff:
        print("   ", d)
print("bad:", bad)
