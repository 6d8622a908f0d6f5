"""`python -m polyad.cli -n 4 -c 1:5:10 -t 30-20-10`: fits random models to a random tensor, fused and one by one."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from polyad.plans.als import Params, cp_als_many, cp_concurrent, model_list, models_of, ranks_and_copies
from polyad.sources.tensors import low_rank


def main(arguments: list[str] | None = None) -> dict[str, float]:
    parser = argparse.ArgumentParser(prog="polyad")
    parser.add_argument("-n", "--threads", type=int, default=4)
    parser.add_argument("-c", "--components", default="1:10:10", help="MIN:MAX:COPIES")
    parser.add_argument("-t", "--tensor", default="60-50-40", help="sizes of three or more modes")
    parser.add_argument("options", nargs="*", help="as Params.from_options takes them")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.master(f"local[{given.threads}]").config("spark.ui.enabled", "false").getOrCreate()
    x, meta = low_rank(spark, tuple(int(i) for i in given.tensor.split("-")), 5, 0)
    low, high, copies = (int(i) for i in given.components.split(":"))
    params = Params.from_options(*(given.options or ("tol", "1e-5", "maxiters", "1000")))
    models = model_list(spark, [(i, r, i) for i, r in enumerate(ranks_and_copies(low, high, copies))]).cache()
    models.count()
    seconds = {}
    for name, fit in (("fused", cp_concurrent), ("single", cp_als_many)):
        began = time.perf_counter()
        models_of(fit(x, meta, models, params)).collect()
        seconds[name] = time.perf_counter() - began
        print(f"{name}: {seconds[name]:.2f} s")
    print(f"speed-up: {seconds['single'] / seconds['fused']:.2f}")
    return seconds


if __name__ == "__main__":
    main()
