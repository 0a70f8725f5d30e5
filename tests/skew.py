"""Tables in which one user, customer, order, part and type hold a third of the rows or more, each
written as a folder of files: ``python tests/skew.py target_dir [sf_dir] [hot_rows]`` writes them and
runs all queries on them."""

from __future__ import annotations

import glob
import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HOT = {
    "events": {"user_id": 7, "event_type": "click"},
    "orders": {"o_custkey": 7, "o_orderpriority": "2-HIGH"},
    "lineitem": {"l_orderkey": 11, "l_partkey": 5, "l_returnflag": "R"},
    "customer": {"c_nationkey": 3},
}


def write_skewed(spark, sf_dir, target):
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        df = spark.read.parquet(path)
        key = df.columns[0]
        for i, (column, value) in enumerate(HOT.get(name, {}).items()):
            pick = F.pmod(F.xxhash64(F.lit(i), *df.columns[:2]), F.lit(5)) < 2
            kind = df.schema[column].dataType
            df = df.withColumn(column, F.when(pick, F.lit(value).cast(kind)).otherwise(
                F.col(column)))
        df.repartition(5, key).write.parquet(f"{target}/{name}.parquet")
    return target


def main() -> int:
    import __spark_entry__ as contract
    from compare import check, connect
    from topicloom.operators import ordered
    from topicloom.session import build_session

    target = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    ordered.HOT_ROWS = int(sys.argv[3]) if len(sys.argv) > 3 else 1000
    spark = build_session()
    con = connect(write_skewed(spark, sf_dir, target))
    bad = 0
    oracles = contract.oracle_sql()
    for name, query in contract.queries().items():
        problem = check(spark, con, name, query, oracles.get(name), target)
        bad += problem is not None
        print("BAD" if problem else "ok", name, problem or "", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
