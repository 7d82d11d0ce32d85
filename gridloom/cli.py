"""python -m gridloom.cli QUERY... --data DIR --out DIR [--resume]: runs queries and writes each as Parquet; --list names them."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gridloom import registry


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("queries", nargs="*")
    parser.add_argument("--data")
    parser.add_argument("--out")
    parser.add_argument("--resume", action="store_true", help="leave out queries whose result is there")
    parser.add_argument("--list", action="store_true")
    args = parser.parse_args(argv)
    known = registry.queries()
    if args.list:
        print("\n".join(sorted(known)))
        return 0
    unknown = [q for q in args.queries if q not in known]
    if unknown or not args.queries or not args.data or not args.out:
        parser.error(f"unknown queries {unknown}" if unknown else "queries, --data and --out are needed")
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    for name in args.queries:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{args.out}/{name}/_SUCCESS")
        if args.resume and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            continue
        known[name](spark, args.data).write.mode("overwrite").parquet(f"{args.out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
