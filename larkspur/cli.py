"""Command line over the library: python -m larkspur.cli NAME --data FOLDER [--out FOLDER] runs a named query; `list` names them all."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    from larkspur.plans import catalogue

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("name", help="a query, or list")
    parser.add_argument("--data", help="folder of the tables")
    parser.add_argument("--out", help="new folder for the result; without it the first rows are shown")
    a = parser.parse_args(args)
    if a.name == "list":
        print(*sorted(catalogue.QUERIES), sep="\n")
        return 0
    if a.name not in catalogue.QUERIES or not a.data:
        parser.error("a known query and --data are needed")
    spark = SparkSession.builder.getOrCreate()
    result = catalogue.QUERIES[a.name](spark, a.data)
    if a.out:
        result.write.mode("errorifexists").parquet(a.out)
    else:
        result.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
