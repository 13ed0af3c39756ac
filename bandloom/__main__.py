"""Scores of voices over a panel of a folder of tables.

    python -m bandloom /data/sf1 --panel nation_sales --voices seasonal_naive,cal:walk:linear --burn 12 --out scores
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.operators import scores
from bandloom.plans import backtest
from bandloom.sources import panels


def scored(spark: SparkSession, tables: str, panel: str, names: list[str], last: int = 6, burn: int = 0, ahead: int = 0, origins: int = 2, sample: int = 0) -> DataFrame:
    """``voice, (h,) n, wql, coverage80, coverage90, width80, pit_ks, wql_vs_naive`` of a walk over the ``last`` periods or, with
    ``ahead``, of projections over as many periods from some origins; of all series, or of a seeded sample."""
    hist, season = panels.kept(spark, tables, panel)
    hist = panels.head(hist, sample) if sample else hist
    if ahead:
        points = backtest.project(hist, names, ahead, origins, season, burn)
        return scores.score(points.where(F.col("h").isin(backtest.scored_horizons(ahead))), ["voice", "h"], places=4, exact=True)
    return scores.score(backtest.walk(hist, names, last, burn, 1, season), places=4, exact=True)


def main(args: list[str] | None = None) -> None:
    asked = argparse.ArgumentParser(prog="bandloom", description="Scores of voices over a panel of a folder of tables.")
    asked.add_argument("tables", help="folder of the Parquet tables")
    asked.add_argument("--panel", default="supplier_qty", choices=sorted(panels.PANELS))
    asked.add_argument("--voices", default="seasonal_naive,walk:linear", help="names with commas between, such as cal:walk:linear or blend:seasonal_naive+pooled")
    asked.add_argument("--last", type=int, default=6, help="periods that the walk scores")
    asked.add_argument("--burn", type=int, default=0, help="periods before them that only feed the records of cal: voices")
    asked.add_argument("--ahead", type=int, default=0, help="score projections over so many periods instead")
    asked.add_argument("--origins", type=int, default=2, help="from so many origins")
    asked.add_argument("--sample", type=int, default=0, help="of a seeded sample of so many series; 0: of all")
    asked.add_argument("--out", help="folder for the scores as JSON lines; else they are printed")
    told = asked.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    names = [v.strip() for v in told.voices.split(",") if v.strip()]
    df = scored(spark, told.tables, told.panel, names, told.last, told.burn, told.ahead, told.origins, told.sample)
    if told.out:
        scores.sink(df, told.out)
    else:
        for line in scores.encoded(df).orderBy("value").collect():  # a row a voice and horizon
            print(line.value)


if __name__ == "__main__":
    main()
