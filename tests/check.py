"""Run the SQL comparison from the command line: python tests/check.py [sf] [name ..]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from corpusbank.session import build_session  # noqa: E402


def main(args):
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, sql = entry.queries(), entry.oracle_sql()
    names = args[1:] or list(queries)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, name, queries[name], sql[name], sf_dir)
            else:
                rows = queries[name](spark, sf_dir).count()
                problem = None if rows else "empty result"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s "
              f"{'' if name in sql else '(no sql) '}{problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
