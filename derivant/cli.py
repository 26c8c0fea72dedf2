"""python -m derivant.cli [PROGRAM] [--semiring KIND] [--prob-semiring KIND] [-k N] [--data RELATION=PATH[:COLUMN,...][@PROB] ...]
[--show-ast] [--show-strata] [--show-demand] [--show-plan] [--output RELATION ...] [--out FOLDER]

Without a program, items are read one by one from standard input. A program with
uncertain facts or data takes the tag of --prob-semiring if none is named. --data binds
the columns of a Parquet table, by name or position, to a relation; @PROB names the
column of their probabilities. --out writes each relation as a Parquet table instead of
printing it.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .errors import DatalogError
from .plans.syntax import Disjunction, Fact, parse


def _show(name: str, df: DataFrame) -> None:
    """Prints all rows as one list; only one partition at a time is in memory."""
    print(f"{name}: [", end="")
    for i, r in enumerate(df.toLocalIterator()):
        print(", " * (i > 0) + repr(tuple(r)), end="")
    print("]")


def bind(engine: Engine, what: str) -> None:
    """Takes in a table named as RELATION=PATH[:COLUMN,...][@PROB]."""
    relation, _, rest = what.partition("=")
    rest, _, prob = rest.partition("@")
    cut = rest.rfind(":", rest.rfind("/") + 1)  # not the one of a scheme
    path, columns = (rest, "") if cut < 0 else (rest[:cut], rest[cut + 1 :])
    df, names = engine.spark.read.parquet(path), columns.split(",") if columns else None
    if prob:
        engine.insert_prob(relation, df, prob, names)
    else:
        engine.bind(relation, df, names)


def interactive(engine: Engine, lines: Iterable[str]) -> None:
    """Loads each item as its last line ends with a full stop; a query prints its answer, an error changes nothing."""
    text = ""
    for line in lines:
        text += line
        if not line.rstrip().endswith("."):
            continue
        try:
            before = len(engine.queries)
            engine.load(text)
            for q in engine.queries[before:]:
                _show(q.atom.codify(), engine.query(q, prob=engine.tag.keeps_proofs))
        except DatalogError as e:
            print(f"{type(e).__name__}: {e}")
        text = ""
    if text.strip():
        print(f"unfinished: {text.strip()}")


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="derivant")
    p.add_argument("program", nargs="?")
    kinds = ["unit", "empty", "boolean", "proofs", "top-k-proofs"]
    p.add_argument("--semiring", default=None, choices=kinds)
    p.add_argument("--prob-semiring", default="top-k-proofs", choices=kinds)
    p.add_argument("--data", nargs="*", default=[], metavar="RELATION=PATH[:COLUMN,...][@PROB]")
    p.add_argument("--out", default=None, help="a folder for the relations as Parquet tables")
    p.add_argument("-k", type=int, default=3)
    p.add_argument("--demand", action="store_true")
    for what in ("ast", "strata", "demand", "plan"):
        p.add_argument(f"--show-{what}", action="store_true")
    p.add_argument("--output", nargs="*", default=None, help="relations to print; all, if none is named")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("derivant").getOrCreate()
    text = None
    if a.program is not None:
        with open(a.program, encoding="utf-8") as f:
            text = f.read()
    uncertain = any("@" in d for d in a.data) or text is not None and any(isinstance(x, Disjunction) or isinstance(x, Fact) and x.prob is not None for x in parse(text).items)
    engine = Engine(spark, a.semiring or (a.prob_semiring if uncertain else "unit"), a.k, a.demand)
    if text is None:
        interactive(engine, sys.stdin)
        return
    engine.load(text)
    for d in a.data:
        bind(engine, d)
    for what in ("ast", "strata", "demand"):
        if getattr(a, f"show_{what}"):
            print(engine.explain(what))
    if a.show_plan:
        print(engine.explain("plan"))
    for q, df in engine.answers().items():
        _show(q, df)
    if a.output is not None or not engine.queries:
        for name in a.output or engine.schema.types:
            df = engine.with_prob(name) if engine.tag.keeps_proofs else engine.relation(name)
            if a.out:
                df.write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/{name}")
            else:
                _show(name, df)


if __name__ == "__main__":
    main()
