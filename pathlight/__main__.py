"""``python -m pathlight [options] epsilon delta graph``: centralities of a graph in a text file."""

from __future__ import annotations

import argparse
import sys
import time

#: The largest k that is accepted.
MOST_K = 2**32 - 1


def _between(text: str) -> float:
    value = float(text)
    if not 0 < value < 1:
        raise argparse.ArgumentTypeError("lies between 0 and 1, both excluded")
    return value


def _count(text: str) -> int:
    value = int(text)
    if not 0 <= value <= MOST_K:
        raise argparse.ArgumentTypeError(f"lies between 0 and {MOST_K}")
    return value


def _seconds(text: str) -> float:
    value = float(text)
    if value < 0:
        raise argparse.ArgumentTypeError("is not negative")
    return value


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="pathlight", description="Betweenness centrality of all nodes within an absolute error, or of the top k within a relative one.")
    p.add_argument("epsilon", type=_between, help="error")
    p.add_argument("delta", type=_between, help="probability that a bound fails")
    p.add_argument("graph", help="edge list, any path that Spark reads")
    p.add_argument("-d", "--directed", action="store_true", help="edges have a direction")
    p.add_argument("-k", type=_count, default=0, help="the k most central nodes, 0 for all nodes")
    p.add_argument("-o", "--output", help="folder of the result, lines of id and estimate")
    p.add_argument("-a", "--peel-base", type=float, default=2.0, help="base of the partitions of nodes; 1 or less has one partition")
    p.add_argument("-s", "--alpha", type=float, help="draw so many paths for each shortest path of a pair, instead of taking all")
    p.add_argument("-m", "--no-samples-bound", action="store_true", help="do not bound the samples by the first phase")
    p.add_argument("-v", "--verbosity", type=_seconds, default=0.0, help="seconds between lines about the run, 0 for none")
    p.add_argument("--seed", type=int, default=42)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)

    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    from pathlight.plans.progressive import approximate_betweenness
    from pathlight.sources.graphs import read_edge_list, write_scores

    spark = SparkSession.builder.appName("pathlight").getOrCreate()
    try:
        edges = read_edge_list(spark, args.graph)
    except AnalysisException as e:
        print(f"pathlight: cannot read {args.graph}: {e.getCondition()}", file=sys.stderr)
        return 1
    told = [time.monotonic()]

    def progress(state: dict) -> None:
        if args.verbosity and time.monotonic() - told[0] >= args.verbosity:
            told[0] = time.monotonic()
            print(" ".join(f"{k}={v:.1f}" if isinstance(v, float) else f"{k}={v}" for k, v in state.items()), file=sys.stderr, flush=True)

    result = approximate_betweenness(
        edges, args.epsilon, args.delta, args.directed, args.k, args.alpha or 2.3, args.peel_base, not args.no_samples_bound,
        args.seed, "multi" if args.alpha else "exact", progress=progress,
    )
    for name, value in result.metrics.items():
        print(f"{name}: {value}")
    if args.output:
        write_scores(result.scores, args.output)
    else:
        for row in result.scores.orderBy("node").toLocalIterator():
            print(f"{row['node']},{row['bc']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
