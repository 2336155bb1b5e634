"""python -m tavuflow: the study on labelled tokens (--mode test or full), or one registered query (--query NAME)."""

from __future__ import annotations

import argparse

from tavuflow.plans import catalog, experiment
from tavuflow.plans.labels import tagged
from tavuflow.session import build_session, release, table


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tavuflow", description=__doc__)
    parser.add_argument("--data", required=True, help="folder of the tables")
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--mode", choices=("test", "full"), default="full", help="test: the first strategies only")
    parser.add_argument("--run", type=int, default=1, help="number of the run")
    parser.add_argument("--strategies", nargs="*", help="only these")
    parser.add_argument("--query", choices=sorted(catalog.queries()), help="write the rows of a query instead")
    parser.add_argument("--master", help="a Spark master; by default the cluster's own")
    given = parser.parse_args(args)
    spark = build_session("tavuflow", given.master)
    if given.query:
        catalog.queries()[given.query](spark, given.data).write.mode("error").parquet(given.out)
    else:
        experiment.run(spark, tagged(spark, given.data), table(spark, given.data, "folds"), given.out, given.run, given.strategies, given.mode == "test")
    release(spark)  # what was written for the way is no longer needed


if __name__ == "__main__":
    main()
