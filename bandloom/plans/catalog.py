"""The registered queries over the driver's tables, and the same in DuckDB's SQL where SQL can say it.

Every query runs over its whole tables. Results are long rows of scalars; measures are rounded alike on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions import tabled
from bandloom.functions.quantiles import BANDS, GRID, literal, merged_counts, with_levels
from bandloom.functions.tables import shared_folder, written
from bandloom.operators import calibration, features, misfit, parity, queues, scores, voices, whatif
from bandloom.plans import backtest, requests
from bandloom.sources import panels
from bandloom.streaming import records, serving

PLACES = 6


def _r(name: str, places: int = PLACES):
    return F.round(F.col(name).cast("double"), places).alias(name)


def _rows(spark: SparkSession, sf_dir: str, name: str, trim: bool = True) -> DataFrame:
    hist, season = panels.load(spark, sf_dir, name)
    return panels.panel(panels.trimmed(hist) if trim else hist, season)


def _context(spark, sf_dir, name, horizons, last, burn=0, step=1, ahead=1) -> backtest.Context:
    hist, season = panels.kept(spark, sf_dir, name)
    return backtest.Context(hist, voices.origins(hist, last, burn, step, ahead), horizons, season, exact=False)


def _long(bands: DataFrame, levels: list[float]) -> DataFrame:
    """A row per level: its number from 1, and the quantile."""
    # q is never empty; the outer form keeps the optimizer from testing that by computing it twice.
    df = bands.select("series", "origin", "h", F.posexplode_outer("q").alias("k", "q"))
    return df.select("series", "origin", F.col("h").cast("int").alias("h"), (F.col("k") + 1).cast("int").alias("level"), _r("q"))


def arrays_query(s, d):
    """Months of suppliers written as one row a series, and read back onto the calendar."""
    arrays = written(panels.as_arrays(panels.supplier_qty(s, d)), "arrays")
    return panels.panel(panels.from_arrays(arrays)).select("series", "t", "moy", _r("y", 4))


def table_function_query(s, d):
    tabled.register(s)
    name = f"facts_{uuid.uuid4().hex}"
    _rows(s, d, "supplier_qty").select("series", "t", "y").createOrReplaceTempView(name)
    return _long(s.sql(f"SELECT * FROM walk(TABLE({name}) PARTITION BY series ORDER BY (t), 'seasonal_naive', 3, 1, 12)"), BANDS)


def stream_record_query(s, d):
    """The floor voice's record of hours ahead, as a stream of the events closes them."""
    c = _context(s, d, "event_hours", [1, 6], 48, ahead=6)
    calls = written(voices.seasonal_naive(c.hist, c.at, [1, 6], GRID, c.season).withColumn("voice", F.lit("seasonal_naive")), "calls")
    path = f"{d}/events.parquet"
    # A pattern, since a stream's path by itself has to be a folder.
    events = s.readStream.schema(s.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    hours = records.drained(records.hourly(events, "event_type", "ts"), "hours")
    landed = s.readStream.schema(s.read.parquet(hours).schema).parquet(hours)
    told = s.read.parquet(records.drained(records.levels_as_they_land(landed, calls, BANDS), "levels"))
    last = told.groupBy("voice", "h").agg(F.max_by(F.struct("n", "levels"), "n").alias("r")).select("h", "r.n", F.posexplode("r.levels").alias("k", "read_at"))
    return last.select("h", "n", (F.col("k") + 1).cast("int").alias("level"), _r("read_at"))


def stream_requests_query(s, d):
    """The requests as files of a stream, answered batch by batch; then the kept answers of the floor voice."""
    folder = f"{shared_folder(s)}/bandloom-requests-{uuid.uuid4().hex}"
    _requests(s, d).repartition(16).write.text(f"{folder}/asked")
    serving.serve(serving.lines(s, f"{folder}/asked", 8), folder).awaitTermination()
    call = "struct<read:int,row:int,voice:string,levels:array<struct<level:double,q:double,raw:double>>>"
    told = serving.replied(s, folder).select("request_id", F.explode(F.from_json("value", f"struct<answers:array<{call}>>")["answers"]).alias("a"))
    found = told.where("a.voice = 'seasonal_naive'").select("request_id", F.col("a.read").alias("read"), F.col("a.row").alias("row"), F.explode("a.levels").alias("l"))
    return found.select("request_id", "read", "row", "l.level", F.round("l.q", PLACES).alias("q"))


def panel_query(name: str):
    return lambda s, d: _rows(s, d, name, trim=False).select("series", "t", "moy", _r("y", 4))


def trim_query(name: str):
    return lambda s, d: _rows(s, d, name).select("series", "i", "t", _r("y", 4))


def recipe_query(h: int, seasonal: bool = False):
    made, columns = (features.seasonal_recipe, features.SEASONAL) if seasonal else (features.recipe, features.RECIPE)
    return lambda s, d: made(_rows(s, d, "supplier_qty"), h).select("series", "t", "idx", "moy", *[_r(c) for c in columns[2:]], _r("label"))


def trailing_query(s, d):
    return features.trailing_sum(_rows(s, d, "supplier_qty"), 12).select("series", "t", _r("y", 4))


def fill_query(s, d):
    rows = features.filled(features.recipe(_rows(s, d, "supplier_qty"), 3), ["lag1", "mean3", "lag12"], ["series"])
    return rows.select("series", "t", *[_r(c) for c in ("lag1", "mean3", "lag12")])


def scale_query(s, d):
    return features.scales(_rows(s, d, "supplier_qty")).select("series", _r("scale"))


def naive_query(name: str, h: int, last: int):
    def run(s, d):
        c = _context(s, d, name, [h], last, ahead=h)
        return _long(voices.seasonal_naive(c.hist, c.at, [h], BANDS, c.season), BANDS)

    return run


def regression_query(s, d):
    c = _context(s, d, "supplier_qty", [1], 3)
    return _long(voices.regression(c.rows, c.at, 1, BANDS), BANDS)


def blend_query(s, d):
    c = _context(s, d, "supplier_qty", [1], 3)
    return _long(voices.blend([voices.seasonal_naive(c.hist, c.at, [1], BANDS), voices.regression(c.rows, c.at, 1, BANDS)]), BANDS)


NUMBERS = ["wql", "coverage80", "coverage90", "width80", "pit_ks", "wql_vs_naive"]


def _scored(df: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    return scores.score(df, keys, exact=exact).select(*keys, "n", *[_r(c, 5) for c in NUMBERS])


def walk_query(name: str):
    def run(s, d):
        hist, season = panels.kept(s, d, name)
        return _scored(backtest.walk(hist, ["seasonal_naive", "regression"], 6, 0, 1, season), ["voice"])

    return run


def project_query(s, d):
    hist, season = panels.kept(s, d, "supplier_qty")
    return _scored(backtest.project(hist, ["seasonal_naive"], 12, 2, season), ["voice", "h"])


def totals_query(s, d):
    hist, season = panels.kept(s, d, "supplier_qty")
    df = scores.score(backtest.totals(hist, "seasonal_naive", 12, 2, season))
    return df.select("voice", "n", *[_r(c, 5) for c in NUMBERS[:4]])


def _past(s, d) -> tuple[DataFrame, backtest.Context]:
    c = _context(s, d, "supplier_qty", [1, 3], 12, ahead=3)
    return calibration.pits(voices.seasonal_naive(c.hist, c.at, [1, 3], GRID, c.season), c.rows, exact=False), c


def histogram_query(s, d):
    return calibration.histogram(_past(s, d)[0], ["h"])


def record_query(s, d):
    past, c = _past(s, d)
    return calibration.record_as_of(past, c.at).select("origin", F.col("h").cast("int").alias("h"), "bin", F.col("n").cast("long").alias("n"))


def levels_query(s, d):
    record = calibration.as_counts(calibration.record_as_of(*(lambda p: (p[0], p[1].at))(_past(s, d))), ["origin", "h"])
    read = with_levels(record, F.col("counts"), BANDS).select("origin", F.col("h").cast("int").alias("h"), F.posexplode("levels").alias("k", "read_at"))
    return read.select("origin", "h", (F.col("k") + 1).cast("int").alias("level"), _r("read_at"))


def voice_walk_query(names: list[str]):
    """Voices that SQL can't follow: Python fits, or draws among ties."""

    def run(s, d):
        hist, season = panels.kept(s, d, "supplier_qty")
        return _scored(backtest.walk(hist, names, 6, 6, 1, season), ["voice"], exact=True)

    return run


def series_walk_query(s, d):
    """A smoother of the last values held against the floor, hours ahead."""
    hist, season = panels.kept(s, d, "event_hours")
    return _scored(backtest.project(hist, ["seasonal_naive", "series:local_level"], 6, 4, season), ["voice", "h"])


def request_members_query(s, d):
    """The requests with eight members each."""
    lines = _requests(s, d).select(F.regexp_replace("value", r"\}$", ',"members":8}').alias("value"))
    return requests.answers(requests.checked(requests.parsed(lines))).select("request_id", "read", "row", "voice", "level", _r("q"))


def calibrated_walk_query(s, d):
    """As walk_calibrated, with ties below the quantiles, so that SQL can follow."""
    hist, season = panels.kept(s, d, "supplier_qty")
    return _scored(backtest.walk(hist, ["seasonal_naive", "cal:seasonal_naive"], 6, 6, 1, season, exact=False), ["voice"])


def calibrated_projection_query(s, d):
    """As cal_project, with ties below the quantiles."""
    hist, season = panels.kept(s, d, "supplier_qty")
    points = backtest.project(hist, ["seasonal_naive", "cal:seasonal_naive"], 12, 2, season, burn=6, exact=False)
    return _scored(points.where(F.col("h").isin(backtest.scored_horizons(12))), ["voice", "h"])


def tied_walk_query(s, d):
    """A panel of many zeros: values that tie with quantiles are placed among them by a draw."""
    hist, season = panels.kept(s, d, "sparse_user")
    return _scored(backtest.walk(hist, ["seasonal_naive", "cal:seasonal_naive"], 6, 6, 1, season), ["voice"], exact=True)


def cal_project_query(s, d):
    """Projections read through records that origins before the scored ones have fed."""
    hist, season = panels.kept(s, d, "supplier_qty")
    points = backtest.project(hist, ["seasonal_naive", "cal:seasonal_naive"], 12, 2, season, burn=6)
    return _scored(points.where(F.col("h").isin(backtest.scored_horizons(12))), ["voice", "h"], exact=True)


def default_levels_query(s, d):
    """Where the records of totals and of single periods read the levels."""
    hist, season = panels.kept(s, d, "supplier_qty")
    records = backtest.default_records(hist, ["seasonal_naive"], 18, season, exact=False)
    read = with_levels(records, merged_counts(F.lit(None).cast("array<double>"), F.col("counts")), BANDS)
    return read.select("voice", "window", F.posexplode("levels").alias("k", "read_at")).select("voice", "window", (F.col("k") + 1).cast("int").alias("level"), _r("read_at"))


def request_naive_query(s, d):
    """What the floor voice answers to the requests."""
    found = requests.answers(requests.checked(requests.parsed(_requests(s, d)))).where("voice = 'seasonal_naive'")
    return found.select("request_id", "read", "row", "level", _r("q"))


def _world(s, d) -> DataFrame:
    li = s.read.parquet(f"{d}/lineitem.parquet")
    sums = li.groupBy(F.col("l_suppkey").alias("member"), panels.month("l_shipdate").alias("t")).agg(F.sum("l_extendedprice").alias("revenue"), F.sum("l_quantity").alias("volume"))
    return sums.where("volume > 0").select("member", "t", (F.col("revenue") / F.col("volume")).alias("price"), "revenue")


CUT = 2000 * 12


def usual_query(s, d):
    return whatif.usual(_world(s, d), CUT).select("member", _r("size", 2), _r("usual", 4))


def replay_query(s, d):
    df = whatif.pulled(_world(s, d), CUT)
    return df.select("member", "t", "factor", _r("price", 9), _r("truth", 4), _r("replay", 4))


def support_query(s, d):
    world = _world(s, d)
    return whatif.support(world, CUT, whatif.pulled(world, CUT)).select("factor", _r("in_support"))


def grade_query(s, d):
    return whatif.grade(_world(s, d), CUT).select("factor", *[_r(c) for c in ("true_move", "replay_off", "median_off")])


def misfit_pair_query(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_cust"))
    return misfit.misfit(orders, "o_orderkey", ["o_totalprice", "o_cust"]).select("o_orderkey", _r("score"), _r("share_o_totalprice"), _r("share_o_cust"))


def misfit_folds_query(s, d):
    line = s.read.parquet(f"{d}/lineitem.parquet")
    keyed = line.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return misfit.misfit(keyed, "line", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], folds=5)


def misfit_pair_folds_query(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_cust"))
    return misfit.misfit(orders, "o_orderkey", ["o_totalprice", "o_cust"], folds=3).select("o_orderkey", _r("score"), _r("share_o_totalprice"), _r("share_o_cust"))


def misfit_backend_query(s, d):
    """Densities read off the percentiles of a backend, each row scored from the rows of the other fold."""
    line = s.read.parquet(f"{d}/lineitem.parquet")
    keyed = line.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return misfit.misfit_by(keyed, "line", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], misfit.by_percentiles(voices.linear), folds=2)


def pinned_query(s, d):
    c = _context(s, d, "supplier_qty", [1], 6)
    found = scores.pinned(scores.points({"seasonal_naive": voices.seasonal_naive(c.hist, c.at, [1], GRID, c.season)}, c.rows))
    return found.select("series", "origin", *[F.round(F.get("q", F.lit(k)), PLACES).alias(f"q{round(a * 100)}") for k, a in enumerate(BANDS)], _r("pit"))


def lowest_query(s, d):
    return misfit.lowest(misfit_pair_query(s, d), "o_orderkey", ["o_totalprice", "o_cust"], 50)


def _frames(s, d) -> DataFrame:
    """One misfit request per supplier: its order lines as rows."""
    line = s.read.parquet(f"{d}/lineitem.parquet")
    row = F.struct("l_orderkey", "l_linenumber", F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount")]).alias("x"))
    frames = line.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    body = F.struct(F.lit("driver").alias("caller"), F.col("l_suppkey").cast("string").alias("request_id"), F.col("rows.x").alias("x"), F.lit(True).alias("columns"), F.lit(2).alias("folds"))
    return frames.select(F.to_json(body).alias("value"))


def misfit_requests_query(s, d):
    found = requests.misfit_answers(requests.misfit_parsed(_frames(s, d)))
    return found.select("request_id", "row", _r("score"), *[F.round(F.get("shares", F.lit(i)), PLACES).alias(f"share_{i}") for i in range(3)])


def _worlds(s, d) -> DataFrame:
    """The world of each nation: its suppliers' prices and revenues by month."""
    nations = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("member"), F.col("s_nationkey").cast("long").alias("world"))
    return _world(s, d).join(nations, "member")


def simulated_query(s, d):
    return whatif.simulated(whatif.fitted(_worlds(s, d), CUT), lean=1.0).select("world", "member", "t", _r("price"), _r("revenue", 3))


def true_median_query(s, d):
    found = whatif.outcomes(whatif.simulated(whatif.fitted(_worlds(s, d), CUT)), CUT, draws=25)
    return found.select("world", "member", "t", "factor", _r("true_median", 3), _r("actual", 3), _r("replay", 3))


def worlds_query(s, d):
    """Two dials: what the grade says where a shock that no column holds moves prices, and where none does."""
    rows = written(whatif.fitted(written(_worlds(s, d), "panel"), CUT), "fitted")
    moved = written(whatif.drawn(rows, CUT), "drawn")
    runs = [whatif.grade_fitted(rows, voices.linear, CUT, lean, moved=moved).withColumn("lean", F.lit(lean)) for lean in (0.0, 1.0)]
    return runs[0].unionByName(runs[1])


def parity_query(s, d):
    """A regression on the last value held against the floor voice, as if that were pinned."""
    c = _context(s, d, "supplier_qty", [1], 3)
    found = parity.deviations(voices.regression(c.rows, c.at, 1, BANDS), voices.seasonal_naive(c.hist, c.at, [1], BANDS), c.rows)
    return parity.report(found).select("fits", *[_r(n) for n in ("max_rel_dev", "p99_rel_dev", "median_rel_dev")], "flips80", "flips90")


def head_query(s, d):
    hist, season = panels.load(s, d, "supplier_qty")
    return panels.panel(panels.head(hist, 10), season).select("series", "t", _r("y", 4))


def standardised_query(s, d):
    return features.standardised(_rows(s, d, "supplier_qty")).select("series", "t", _r("z"))


def turns_query(s, d):
    line = s.read.parquet(f"{d}/lineitem.parquet")
    jobs = line.groupBy(F.col("l_suppkey").alias("caller"), F.col("l_orderkey").alias("seq")).agg(F.sum("l_quantity").cast("long").alias("n_cells"))
    # One order may have jobs of several callers: the caller breaks the tie of arrival.
    jobs = jobs.withColumn("seq", F.col("seq") * 1_000_000 + F.col("caller"))
    return requests.turns(jobs, 131_072)


#: Cells that may wait in a queue, and that one cycle serves.
QUEUE_CELLS, CYCLE_CELLS = 200, 120


def _jobs(s, d) -> DataFrame:
    """A job per order and supplier: it waits in the queue of the supplier's nation and the order's priority until it ships."""
    line = s.read.parquet(f"{d}/lineitem.parquet")
    sums = line.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_shipdate").cast("date").alias("till"), F.sum("l_quantity").cast("long").alias("cells"), F.max("l_discount").alias("discount"))
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("since"), "o_orderpriority")
    nations = s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey")
    told = sums.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    queue = F.concat_ws("|", F.col("s_nationkey").cast("string"), "o_orderpriority")
    return told.select(queue.alias("queue"), (F.col("l_orderkey") * 1_000_000 + F.col("l_suppkey")).alias("job"), F.col("l_suppkey").alias("caller"), "since", "till", "cells", "discount")


def admission_query(s, d):
    jobs = _jobs(s, d)
    # What comes and goes on one day, or goes before it comes, leaves at the end of the day on which it comes.
    comes = jobs.select("queue", F.struct(F.col("since").alias("day"), F.lit(0).alias("late")).alias("at"), F.lit(queues.ARRIVE).alias("step"), "job", "caller", "cells")
    at = F.struct(F.greatest("since", "till").alias("day"), F.when(F.col("till") > F.col("since"), 0).otherwise(1).alias("late"))
    goes = jobs.select("queue", at.alias("at"), F.lit(queues.LEAVE).alias("step"), "job", "caller", "cells")
    return queues.admitted(comes.unionByName(goes), QUEUE_CELLS)


def _served(s, d) -> DataFrame:
    """A cycle a month; jobs at the highest discount are served alone, the others by the supplier's ensemble size."""
    jobs = _jobs(s, d)
    month = F.trunc("since", "month")
    comes = jobs.select("queue", month.alias("at"), F.lit(queues.ARRIVE).alias("step"), "job", "caller", "cells", F.when(F.col("discount") >= 0.1, "misfit").otherwise(queues.BAND).alias("kind"), F.when(F.col("discount") >= 0.05, 8).otherwise(1).alias("members"))
    takes = jobs.select("queue", F.add_months(month, 1).alias("at")).distinct().select("queue", "at", F.lit(queues.TAKE).alias("step"), F.lit(0).cast("long").alias("job"), F.lit(0).cast("long").alias("caller"), F.lit(0).cast("long").alias("cells"), F.lit("").alias("kind"), F.lit(0).alias("members"))
    return comes.unionByName(takes)


def cycles_query(s, d):
    return queues.served(_served(s, d), QUEUE_CELLS, CYCLE_CELLS)


#: A change to a sound request, what it is refused for, and the cases that the request itself decides.
REFUSALS = [
    ("none", "", "", None, None),
    ("level", r'"alphas":\[[^\]]*\]', '"alphas":[0.5,1.0]', 400, "alphas must be numbers strictly between 0 and 1"),
    ("no_levels", r'"alphas":\[[^\]]*\]', '"alphas":[]', 400, "alphas must be numbers strictly between 0 and 1"),
    ("text", r'"alphas":\[[^\]]*\]', '"alphas":"half"', 400, "not a JSON object of the expected fields"),
    ("cut", r"\}$", "", 400, "not a JSON object of the expected fields"),
    ("members", r"\}$", ',"members":33}', 400, "members must be 1 to 32"),
    ("season", r"\}$", ',"season":0}', 400, "season must be 1 to 366"),
    ("window", r"\}$", ',"window":367}', 400, "window must be 1 to 366"),
    ("longest_window", r"\}$", ',"window":366}', None, None),
    ("voice", r'"voices":\[[^\]]*\]', '"voices":["linear","someone"]', 400, "voices must be known, each once, with linear among them"),
    ("voice_twice", r'"voices":\[[^\]]*\]', '"voices":["linear","linear"]', 400, "voices must be known, each once, with linear among them"),
    ("no_linear", r'"voices":\[[^\]]*\]', '"voices":["seasonal_naive"]', 400, "voices must be known, each once, with linear among them"),
    ("bare_history", r"\}$", ',"pit_history":[1,2]}', 400, "pit_history must be a list of counts, with several voices an object of lists by voice"),
    ("unknown_history", r"\}$", ',"pit_history":{"someone":[1]}}', 400, "pit_history must be a list of counts, with several voices an object of lists by voice"),
    ("short_history", r"\}$", ',"pit_history":{"linear":[1,2]}}', 400, "pit_history must be 100 counts that are not negative"),
    ("no_reads", r'"reads":\[.*\]', '"reads":[]', 400, "reads are missing"),
    ("both", r'"train_y":', '"context":"c","train_y":', 400, "a context stands in place of train_x and train_y"),
    ("unknown_context", r'"train_x":.*"test_x":', '"context":"c","test_x":', 404, "context_unknown: it is not kept here for this caller; send the rows again"),
    ("no_test", r'"test_x":\[\[[^\]]*\]\]', '"test_x":[]', 400, "a read needs train_x, train_y and test_x"),
    ("width", r'"test_x":\[\[[^\]]*\]\]', '"test_x":[[1.0]]', 400, "rows differ in length"),
    ("labels", r'"train_y":\[', '"train_y":[7.0,', 422, "a read needs two training rows and one train_y each"),
    ("actual", r'"actual":\[', '"actual":[7.0,', 400, "actual needs one value per test row"),
    ("salt", r'"actual":', '"salt":[1,2],"actual":', 400, "salt needs one value per test row"),
    ("horizon", r'"actual":', '"horizon":[121],"actual":', 400, "horizon needs one whole number of 1 to 120 per test row"),
    ("no_history", r'"history":\[[^\]]*\]', '"history":null', 400, "several voices need a history"),
]


def refusals_query(s, d):
    """Every rule broken by every supplier's request."""
    # Each request is made once and dealt anew: its cases are far more than it is.
    made = _requests(s, d).withColumn("number", F.get_json_object("value", "$.request_id")).repartition("number")
    cases = [F.struct(F.lit(name).alias("name"), (F.regexp_replace("value", F.lit(pattern), F.lit(told)) if pattern else F.col("value")).alias("value")) for name, pattern, told, *_ in REFUSALS]
    broken = made.select("number", F.explode(F.array(*cases)).alias("c")).select(F.concat_ws("-", "number", "c.name").alias("id"), "c.name", "c.value")
    lines = broken.select("id", F.regexp_replace("value", F.lit(r'"request_id":"([^"]*)"'), F.concat(F.lit('"request_id":"$1-'), "name", F.lit('"'))).alias("value"))
    checked = requests.checked(requests.rows_of(lines, ["id"]))
    return checked.select("id", F.col("refusal.status").alias("status"), F.col("refusal.reason").alias("reason"))


#: Levels between and beyond the percentiles.
OFF_GRID = [0.001, 0.005, 0.015, 0.5, 0.995, 0.999]


def request_levels_query(s, d):
    """Answers at levels that no percentile is."""
    found = requests.answers(requests.checked(requests.parsed(_requests(s, d, OFF_GRID)))).where("voice = 'seasonal_naive'")
    return found.select("request_id", "level", _r("q"), "raw")


def _requests(s, d, alphas: list[float] = BANDS) -> DataFrame:
    """One JSON request per supplier, about its own history."""
    hist = panels.trimmed(panels.load(s, d, "supplier_qty")[0])
    # A column of its own, so that the steps don't look for what is known again and again.
    hist, known = hist.withColumn("known", F.filter("ys", lambda y: y.isNotNull())), F.col("known")
    row = lambda i: F.array(i.cast("double"), F.get(known, i - 1))
    steps = F.sequence(F.lit(1), F.size(known) - 1)
    read = F.struct(F.transform(steps, row).alias("train_x"), F.transform(steps, lambda i: F.get(known, i)).alias("train_y"), F.array(row(F.size(known))).alias("test_x"), F.array(F.get(known, F.lit(0))).alias("actual"), F.col("ys").alias("history"))
    body = F.struct(F.lit("driver").alias("caller"), F.col("series").cast("string").alias("request_id"), literal(alphas).alias("alphas"), F.array(F.lit("linear"), F.lit("seasonal_naive")).alias("voices"), F.array(read).alias("reads"))
    return hist.where(F.size(known) > 1).select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def validation_query(s, d):
    checked = requests.checked(requests.parsed(_requests(s, d)))
    cost = F.aggregate(F.transform("reads", lambda r: requests.cells(r, F.col("members"))), F.lit(0), lambda a, x: a + x)
    return checked.select("request_id", F.col("refusal.status").alias("status"), F.col("refusal.reason").alias("reason"), cost.cast("long").alias("n_cells"))


def answers_query(s, d):
    return requests.answers(requests.checked(requests.parsed(_requests(s, d))))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a walk over the last half year on the panel of return flags."""
    return walk_query("flag_qty")(spark, sf_dir)


QUERIES = {
    "panel_supplier_qty": panel_query("supplier_qty"),
    "panel_nation_sales": panel_query("nation_sales"),
    "panel_flag_qty": panel_query("flag_qty"),
    "panel_event_hours": panel_query("event_hours"),
    "trim_nation_sales": trim_query("nation_sales"),
    **{f"recipe_h{h}": recipe_query(h) for h in (1, 3, 6, 12, 13)},
    **{f"seasonal_recipe_h{h}": recipe_query(h, True) for h in (6, 13)},
    "trailing_sum_12": trailing_query,
    "fill_median": fill_query,
    "scale_last12": scale_query,
    "naive_h1": naive_query("supplier_qty", 1, 3),
    "naive_h12": naive_query("supplier_qty", 12, 2),
    "naive_h18": naive_query("nation_sales", 18, 2),
    "naive_hourly": naive_query("event_hours", 6, 3),
    "regression_voice": regression_query,
    "blend_mean": blend_query,
    "walk_scores": walk_query("supplier_qty"),
    "walk_scores_flags": walk_query("flag_qty"),
    "project_scores": project_query,
    "total_scores": totals_query,
    "pit_histogram": histogram_query,
    "record_as_of_origin": record_query,
    "calibrated_levels": levels_query,
    "walk_linear_blend": voice_walk_query(["seasonal_naive", "walk:linear", "blend:seasonal_naive+walk:linear"]),
    "walk_pooled": voice_walk_query(["seasonal_naive", "pooled", "seasonal:linear"]),
    "walk_calibrated": voice_walk_query(["seasonal_naive", "cal:seasonal_naive"]),
    "walk_pooled_backend": voice_walk_query(["seasonal_naive", "pooled:linear"]),
    "walk_tied": tied_walk_query,
    "cal_project": cal_project_query,
    "default_record_levels": default_levels_query,
    "panel_sparse_user": panel_query("sparse_user"),
    "whatif_size_usual": usual_query,
    "whatif_replay": replay_query,
    "whatif_support": support_query,
    "whatif_grade": grade_query,
    "misfit_pair": misfit_pair_query,
    "misfit_folds": misfit_folds_query,
    "misfit_lowest": lowest_query,
    "misfit_requests": misfit_requests_query,
    "whatif_simulated": simulated_query,
    "whatif_true_median": true_median_query,
    "whatif_worlds": worlds_query,
    "parity_report": parity_query,
    "panel_head": head_query,
    "panel_synthetic": panel_query("synthetic"),
    "standardised": standardised_query,
    "request_validation": validation_query,
    "request_answers": answers_query,
    "request_naive": request_naive_query,
    "queue_round_robin": turns_query,
    "queue_admission": admission_query,
    "queue_cycles": cycles_query,
    "request_refusals": refusals_query,
    "request_levels": request_levels_query,
    "misfit_pair_folds": misfit_pair_folds_query,
    "misfit_backend": misfit_backend_query,
    "pinned_points": pinned_query,
    "panel_arrays": arrays_query,
    "walk_table_function": table_function_query,
    "stream_record": stream_record_query,
    "stream_requests": stream_requests_query,
    "walk_series": series_walk_query,
    "walk_calibrated_untied": calibrated_walk_query,
    "cal_project_untied": calibrated_projection_query,
    "request_members": request_members_query,
}

# ---- DuckDB ----

_MONTH = "(year({0}) * 12 + month({0}) - 1)::BIGINT"
_FACTS = {
    "supplier_qty": ("l_suppkey", _MONTH.format("l_shipdate"), "sum(l_quantity)", "lineitem", True, 12),
    "flag_qty": ("l_returnflag || l_linestatus", _MONTH.format("l_shipdate"), "sum(l_quantity)", "lineitem", True, 12),
    "nation_sales": ("c_nationkey::BIGINT", _MONTH.format("o_orderdate"), "sum(o_totalprice)", "orders JOIN customer ON o_custkey = c_custkey", True, 12),
    "event_hours": ("event_type", "floor(epoch(ts) / 3600)::BIGINT", "count(*)::DOUBLE", "events", False, 24),
}


def _panel(name: str) -> str:
    """CTEs p (series, t, moy, y) and tr (trimmed: also i) of a panel."""
    series, t, y, table, drop, season = _FACTS[name]
    cut = "WHERE t < (SELECT max(t) FROM f0)" if drop else ""
    return f"""f0 AS (SELECT {series} AS series, {t} AS t, {y} AS y FROM {table} GROUP BY 1, 2), f AS (SELECT * FROM f0 {cut}),
e AS (SELECT series, min(t) AS first, max(t) AS last FROM f GROUP BY series),
m AS (SELECT last, min(first) AS start FROM e GROUP BY last ORDER BY count(*) DESC, last LIMIT 1),
p AS (SELECT e.series, g.t, (g.t % {season} + 1)::INT AS moy, f.y FROM e JOIN m USING (last) CROSS JOIN (SELECT unnest(generate_series(m.start, m.last)) AS t FROM m) g LEFT JOIN f ON f.series = e.series AND f.t = g.t),
st AS (SELECT series, min(t) AS start FROM p WHERE y IS NOT NULL GROUP BY series),
tr AS (SELECT p.*, (t - start)::INT AS i FROM p JOIN st USING (series) WHERE t >= start)"""


def _ahead(h: int, season: int = 12) -> str:
    """CTE x: tr and h periods more."""
    return f"""x AS (SELECT series, i, t, moy, y FROM tr UNION ALL
SELECT series, (n + k)::INT, start + n + k, ((start + n + k) % {season} + 1)::INT, NULL FROM (SELECT series, count(*) AS n, min(t) AS start FROM tr GROUP BY series) CROSS JOIN (SELECT unnest(range({h})) AS k))"""


def _recipe(h: int, seasonal: bool = False) -> str:
    at = lambda k: f"(SELECT b.y FROM x b WHERE b.series = a.series AND b.i = a.i - {k})"
    mean = lambda k, n: f"(SELECT avg(b.y) FROM x b WHERE b.series = a.series AND b.i BETWEEN a.i - {k + n - 1} AND a.i - {k})"
    if seasonal:
        back = -(-h // 12) * 12
        cols = {"same_month": at(back), "same_month_prev": at(back + 12), "level12": mean(h, 12), "level12_prev": mean(h + 12, 12), "last": at(h)}
    else:
        cols = {"lag1": at(h), "mean3": mean(h, 3), "lag12": at(12) if h <= 12 else "NULL::DOUBLE"}
    told = ", ".join(f"round({v}, {PLACES}) AS {k}" for k, v in cols.items())
    return f"WITH {_panel('supplier_qty')}, {_ahead(h)} SELECT series, t, i AS idx, moy, {told}, round(y, {PLACES}) AS label FROM x a WHERE i >= {h}"


def _origins(last: int, step: int = 1, ahead: int = 1) -> str:
    return f"o AS (SELECT (SELECT max(t) + 1 FROM p) - {ahead} - {step} * k AS origin FROM (SELECT unnest(range({last})) AS k))"


def _naive(horizons: str, levels: list[float], season: int = 12, rows: str = "tr") -> str:
    """CTE nq (series, origin, h, level, q); needs o and the rows (series, i, t, y)."""
    return f"""hh AS (SELECT unnest({horizons}) AS h),
s0 AS (SELECT series, min(t) AS start FROM {rows} GROUP BY series),
a0 AS (SELECT series, origin, h, origin - start AS n, CASE WHEN origin - start > {season + 5} AND h <= {season} THEN {season} ELSE h END AS lag FROM s0, o, hh WHERE origin > start),
a1 AS (SELECT a0.*, r.y AS anchor FROM a0 JOIN {rows} r ON r.series = a0.series AND r.i = n + h - 1 - lag WHERE n > lag + 5 AND r.y IS NOT NULL),
mv AS (SELECT a1.series, a1.origin, a1.h, any_value(anchor) AS anchor, quantile_cont(v.y - w.y, {levels}) AS qs FROM a1 JOIN {rows} v ON v.series = a1.series AND v.i < n JOIN {rows} w ON w.series = v.series AND w.i = v.i - lag WHERE v.y - w.y IS NOT NULL GROUP BY 1, 2, 3),
nq AS (SELECT series, origin, h::INT AS h, unnest(range(1, {len(levels) + 1}))::INT AS level, anchor + unnest(qs) AS q FROM mv)"""


def _regression(levels: list[float]) -> str:
    """CTE rq like nq: a regression on the value one period before."""
    return f"""rx AS (SELECT a.series, a.t, b.y AS lag1, a.y AS label FROM (SELECT * FROM tr UNION ALL SELECT series, max(t) + 1, NULL, NULL, (max(i) + 1)::INT FROM tr GROUP BY series) a JOIN tr b ON b.series = a.series AND b.i = a.i - 1),
rt AS (SELECT rx.*, origin FROM rx JOIN o ON rx.t < origin WHERE lag1 IS NOT NULL AND label IS NOT NULL),
rf AS (SELECT series, origin, regr_slope(label, lag1) AS b, regr_intercept(label, lag1) AS a FROM rt GROUP BY 1, 2 HAVING count(*) >= {voices.MIN_TRAIN} AND var_pop(lag1) > 0),
rr AS (SELECT series, origin, any_value(a) AS a, any_value(b) AS b, quantile_cont(label - a - b * lag1, {levels}) AS rest FROM rt JOIN rf USING (series, origin) GROUP BY 1, 2),
rq AS (SELECT series, origin, 1::INT AS h, unnest(range(1, {len(levels) + 1}))::INT AS level, a + b * lag1 + unnest(rest) AS q FROM rr JOIN rx USING (series) WHERE rx.t = origin AND lag1 IS NOT NULL)"""


_LONG = f"series, origin, h, level, round(q, {PLACES}) AS q"


def _graded(points: str, voices_n: int, keys: str = "voice", floor: bool = True, ks: bool = True) -> str:
    """CTEs to scores from ``pts`` rows (voice, series, origin, h, level, q, y)."""
    lv = lambda a: f"max(CASE WHEN level = {round(a * 100)} THEN q END)"
    pin = " + ".join(f"greatest({a} * (y - q{round(a * 100)}), {a - 1} * (y - q{round(a * 100)}))" for a in BANDS)
    other = keys.replace("voice, ", "").replace("voice", "")
    return f"""{points}, w0 AS (SELECT voice, series, origin, h, y, {", ".join(f"{lv(a)} AS q{round(a * 100)}" for a in BANDS)}, sum((q < y)::INT) / 100.0::DOUBLE AS pit FROM pts GROUP BY voice, series, origin, h, y),
w1 AS (SELECT * FROM w0 QUALIFY count(*) OVER (PARTITION BY series, origin, h) = {voices_n}),
kr AS (SELECT {keys}, pit, row_number() OVER (PARTITION BY {keys} ORDER BY pit) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM w1),
ks AS (SELECT {keys}, max(greatest(k::DOUBLE / n - pit, pit - (k - 1)::DOUBLE / n)) AS pit_ks FROM kr GROUP BY {keys}),
g AS (SELECT {keys}, count(*) AS n, 2 * sum({pin}) / (greatest(sum(abs(y)), 1e-12) * 5) AS wql, avg((y BETWEEN q10 AND q90)::INT) AS coverage80, avg((y BETWEEN q5 AND q95)::INT) AS coverage90, sum(q90 - q10) / nullif(sum(abs(y)), 0) AS width80 FROM w1 GROUP BY {keys})
SELECT {keys}, n, round(wql, 5) AS wql, round(coverage80, 5) AS coverage80, round(coverage90, 5) AS coverage90, round(width80, 5) AS width80{", round(pit_ks, 5) AS pit_ks" if ks else ""}{f", round(wql / max(CASE WHEN voice = 'seasonal_naive' THEN wql END) OVER ({'PARTITION BY ' + other if other else ''}), 5) AS wql_vs_naive" if floor else ""}
FROM g JOIN ks USING ({keys})"""


def _walk(name: str) -> str:
    pts = "pts AS (SELECT v.*, tr.y FROM (SELECT 'seasonal_naive' AS voice, * FROM nq UNION ALL SELECT 'regression', * FROM rq) v JOIN tr ON tr.series = v.series AND tr.t = v.origin + v.h - 1 WHERE tr.y IS NOT NULL)"
    return f"WITH {_panel(name)}, {_origins(6)}, {_naive('[1]', GRID)}, {_regression(GRID)}, {_graded(pts, 2)}"


_H12 = "range(1, 13)"
_PTS = "pts AS (SELECT 'seasonal_naive' AS voice, v.*, tr.y FROM nq v JOIN tr ON tr.series = v.series AND tr.t = v.origin + v.h - 1 WHERE tr.y IS NOT NULL)"
_PROJECT = f"WITH {_panel('supplier_qty')}, {_origins(2, 12, 12)}, {_naive(_H12, GRID)}, {_graded(_PTS, 1, 'voice, h')}"
_TOTALS = f"""WITH {_panel('supplier_qty')}, {_origins(2, 12, 12)}, {_naive(_H12, GRID)},
su AS (SELECT 'total_summed' AS voice, v.series, v.origin, 12 AS h, level, sum(q) AS q, sum(tr.y) AS y FROM nq v JOIN tr ON tr.series = v.series AND tr.t = v.origin + v.h - 1 WHERE tr.y IS NOT NULL GROUP BY ALL HAVING count(*) = 12),
ys AS (SELECT series, i, t, CASE WHEN count(y) OVER b = 12 THEN sum(y) OVER b END AS y FROM tr WINDOW b AS (PARTITION BY series ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
y0 AS (SELECT series, min(t) AS from_t FROM ys WHERE y IS NOT NULL GROUP BY series), yt AS (SELECT series, (t - from_t)::INT AS i, t, y FROM ys JOIN y0 USING (series) WHERE t >= from_t),
d AS (SELECT * FROM (WITH {_naive("[12]", GRID, 12, "yt")} SELECT nq.*, yt.y FROM nq JOIN yt ON yt.series = nq.series AND yt.t = nq.origin + 11 WHERE yt.y IS NOT NULL)),
{_graded("pts AS (SELECT voice, series, origin, h, level, q, y FROM su UNION ALL SELECT 'total_direct', series, origin, h, level, q, y FROM d)", 2, floor=False, ks=False)}"""
_PAST = f"""WITH {_panel('supplier_qty')}, {_origins(12, 1, 3)}, {_naive('[1, 3]', GRID)},
pit AS (SELECT v.series, v.origin, v.h, sum((q < y)::INT) / 100.0::DOUBLE AS p FROM nq v JOIN tr ON tr.series = v.series AND tr.t = v.origin + v.h - 1 WHERE y IS NOT NULL GROUP BY 1, 2, 3),
b0 AS (SELECT *, least(floor(p * 100)::INT, 99) AS b FROM pit),
bins AS (SELECT series, origin, h, (b - (p < b * 0.01::DOUBLE)::INT + (b <> 99 AND p >= (b + 1) * 0.01::DOUBLE)::INT)::INT AS bin FROM b0)"""
_RECORD = "rec AS (SELECT o.origin, h, bin, count(*) AS n FROM bins JOIN o ON bins.origin + h <= o.origin GROUP BY 1, 2, 3)"
_LEVELS = f"""{_PAST}, {_RECORD}, keys AS (SELECT DISTINCT origin, h FROM rec),
c AS (SELECT origin, h, b.bin, coalesce(n, 0) + 1e-9::DOUBLE AS n FROM keys CROSS JOIN (SELECT unnest(range(100)) AS bin) b LEFT JOIN rec USING (origin, h, bin)),
s AS (SELECT origin, h, bin, n / sum(n) OVER k AS w, sum(n) OVER (PARTITION BY origin, h ORDER BY bin) / sum(n) OVER k AS hi FROM c WINDOW k AS (PARTITION BY origin, h)),
t AS (SELECT origin, h, sum(n) AS total FROM rec GROUP BY 1, 2), a AS (SELECT unnest({BANDS}) AS alpha, unnest(range(1, 6))::INT AS level)
SELECT origin, h, level, round(CASE WHEN any_value(total) < 100 THEN any_value(alpha) ELSE arg_min((bin + (alpha - (hi - w)) / w) / 100.0::DOUBLE, bin) END, {PLACES}) AS read_at FROM t JOIN s USING (origin, h) CROSS JOIN a WHERE hi >= alpha GROUP BY 1, 2, 3"""
_BINS = """pit AS (SELECT v.series, v.origin, v.h, sum((q < y)::INT) / 100.0::DOUBLE AS p FROM nq v JOIN tr ON tr.series = v.series AND tr.t = v.origin + v.h - 1 WHERE y IS NOT NULL GROUP BY 1, 2, 3),
b0 AS (SELECT *, least(floor(p * 100)::INT, 99) AS b FROM pit),
bins AS (SELECT series, origin, h, (b - (p < b * 0.01::DOUBLE)::INT + (b <> 99 AND p >= (b + 1) * 0.01::DOUBLE)::INT)::INT AS bin FROM b0)"""
#: CTEs from nq, bins and o: pts, with the calls as they are and as their records of the origin read them.
_CALIBRATED = f"""{_RECORD}, keys AS (SELECT DISTINCT origin, h FROM nq), t AS (SELECT origin, h, sum(n) AS total FROM rec GROUP BY 1, 2),
c AS (SELECT origin, h, b.bin, coalesce(n, 0) + 1e-9::DOUBLE AS n FROM keys CROSS JOIN (SELECT unnest(range(100)) AS bin) b LEFT JOIN rec USING (origin, h, bin)),
s AS (SELECT origin, h, bin, n / sum(n) OVER k AS w, sum(n) OVER (PARTITION BY origin, h ORDER BY bin) / sum(n) OVER k AS hi FROM c WINDOW k AS (PARTITION BY origin, h)),
a AS (SELECT unnest({GRID}) AS alpha, unnest(range(1, 100))::INT AS level),
lv AS (SELECT origin, h, level, CASE WHEN coalesce(any_value(total), 0) < 100 THEN any_value(alpha) ELSE arg_min((bin + (alpha - (hi - w)) / w) / 100.0::DOUBLE, bin) END AS read_at FROM s CROSS JOIN a LEFT JOIN t USING (origin, h) WHERE hi >= alpha GROUP BY 1, 2, 3),
qa AS (SELECT series, origin, h, list(q ORDER BY level) AS qs FROM nq GROUP BY 1, 2, 3),
pl AS (SELECT series, origin, h, level, qs, 98 * least(greatest((read_at - 0.01::DOUBLE) / (0.99::DOUBLE - 0.01::DOUBLE), 0), 1) AS p FROM qa JOIN lv USING (origin, h)),
cal AS (SELECT series, origin, h, level, qs[floor(p)::INT + 1] + (qs[least(floor(p)::INT + 1, 98) + 1] - qs[floor(p)::INT + 1]) * (p - floor(p)) AS q FROM pl),
pts AS (SELECT v.*, tr.y FROM (SELECT 'seasonal_naive' AS voice, series, origin, h, level, q FROM nq UNION ALL SELECT 'cal:seasonal_naive', * FROM cal) v JOIN tr ON tr.series = v.series AND tr.t = v.origin + v.h - 1 WHERE tr.y IS NOT NULL AND v.origin IN (SELECT origin FROM sc))"""
_WALK_CALIBRATED = f"WITH {_panel('supplier_qty')}, {_origins(12)}, sc AS (SELECT origin FROM o ORDER BY origin DESC LIMIT 6), {_naive('[1]', GRID)}, {_BINS}, {_graded(_CALIBRATED, 2)}"
_CAL_PROJECT = f"""WITH {_panel('supplier_qty')}, e0 AS (SELECT max(t) + 1 AS stop FROM p), sc AS (SELECT stop - 12 - 12 * k AS origin FROM e0, (SELECT unnest(range(2)) AS k)),
o AS (SELECT origin FROM sc UNION ALL SELECT stop - 36 - k FROM e0, (SELECT unnest(range(6)) AS k)), {_naive('[1, 3, 6, 12]', GRID)}, {_BINS}, {_graded(_CALIBRATED, 2, 'voice, h')}"""
_DEFAULTS = f"""WITH {_panel('supplier_qty')},
ys AS (SELECT series, i, t, CASE WHEN count(y) OVER b = 12 THEN sum(y) OVER b END AS y FROM tr WINDOW b AS (PARTITION BY series ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
y0 AS (SELECT series, min(t) AS from_t FROM ys WHERE y IS NOT NULL GROUP BY series), yt AS (SELECT series, (t - from_t)::INT AS i, t, y FROM ys JOIN y0 USING (series) WHERE t >= from_t),
both_ AS (SELECT 1 AS "window", bin FROM (WITH {_origins(18)}, {_naive('[1]', GRID)}, {_BINS} SELECT bin FROM bins)
 UNION ALL SELECT 12, bin FROM (WITH {_origins(18, 1, 12)}, {_naive('[12]', GRID, 12, 'yt')}, {_BINS.replace("JOIN tr ON tr.series = v.series AND tr.t", "JOIN yt ON yt.series = v.series AND yt.t")} SELECT bin FROM bins)),
rec AS (SELECT "window", bin, count(*) AS n FROM both_ GROUP BY 1, 2), z AS (SELECT "window", sum(n) AS total FROM rec GROUP BY 1),
c AS (SELECT z."window", b.bin, coalesce(n, 0) * {float(200)}::DOUBLE / total + 1e-9::DOUBLE AS n FROM z CROSS JOIN (SELECT unnest(range(100)) AS bin) b LEFT JOIN rec ON rec."window" = z."window" AND rec.bin = b.bin),
s AS (SELECT "window", bin, n / sum(n) OVER k AS w, sum(n) OVER (PARTITION BY "window" ORDER BY bin) / sum(n) OVER k AS hi FROM c WINDOW k AS (PARTITION BY "window")),
a AS (SELECT unnest({BANDS}) AS alpha, unnest(range(1, 6))::INT AS level)
SELECT 'seasonal_naive' AS voice, "window"::INT AS "window", level, round(arg_min((bin + (alpha - (hi - w)) / w) / 100.0::DOUBLE, bin), {PLACES}) AS read_at FROM s CROSS JOIN a WHERE hi >= alpha GROUP BY "window", level"""
_WORLD = f"wd AS (SELECT l_suppkey AS member, {_MONTH.format('l_shipdate')} AS t, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) > 0)"
_USUAL = f"us AS (SELECT member, avg(revenue) AS size, exp(avg(ln(price))) AS usual FROM wd WHERE t < {CUT} GROUP BY 1)"
_PULLED = f"pu AS (SELECT member, t, factor, price * factor AS price, revenue * pow(factor, {1 - whatif.ELASTICITY}) AS truth, revenue * factor AS replay FROM wd, (SELECT unnest({whatif.FACTORS}::DOUBLE[]) AS factor) WHERE t >= {CUT})"
_PAIR = f"""WITH d AS (SELECT o_orderkey, o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders),
s AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM d),
l AS (SELECT o_orderkey, x - mx AS dx, y - my AS dy, vx, vy, c, vy - c * c / vx AS vyx, vx - c * c / vy AS vxy FROM d, s),
n AS (SELECT o_orderkey, -0.5 * ln(2 * pi() * vx) - dx * dx / (2 * vx) AS fx, -0.5 * ln(2 * pi() * vy) - dy * dy / (2 * vy) AS fy,
 -0.5 * ln(2 * pi() * vyx) - pow(dy - c / vx * dx, 2) / (2 * vyx) AS fyx, -0.5 * ln(2 * pi() * vxy) - pow(dx - c / vy * dy, 2) / (2 * vxy) AS fxy FROM l)
SELECT o_orderkey, round((fx + fyx + fy + fxy) / 2, {PLACES}) AS score, round((fx + fxy) / 2, {PLACES}) AS share_o_totalprice, round((fy + fyx) / 2, {PLACES}) AS share_o_cust FROM n"""


_PAIR_FOLDS = f"""WITH d AS (SELECT o_orderkey, o_totalprice AS x, o_custkey::DOUBLE AS y, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 15))::BIGINT % 3 AS fold FROM orders),
s AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM d, (SELECT unnest(range(3)) AS fold) f WHERE d.fold <> f.fold GROUP BY f.fold),
l AS (SELECT o_orderkey, x - mx AS dx, y - my AS dy, vx, vy, c, vy - c * c / vx AS vyx, vx - c * c / vy AS vxy FROM d JOIN s USING (fold)),
n AS (SELECT o_orderkey, -0.5 * ln(2 * pi() * vx) - dx * dx / (2 * vx) AS fx, -0.5 * ln(2 * pi() * vy) - dy * dy / (2 * vy) AS fy,
 -0.5 * ln(2 * pi() * vyx) - pow(dy - c / vx * dx, 2) / (2 * vyx) AS fyx, -0.5 * ln(2 * pi() * vxy) - pow(dx - c / vy * dy, 2) / (2 * vxy) AS fxy FROM l)
SELECT o_orderkey, round((fx + fyx + fy + fxy) / 2, {PLACES}) AS score, round((fx + fxy) / 2, {PLACES}) AS share_o_totalprice, round((fy + fyx) / 2, {PLACES}) AS share_o_cust FROM n"""
_JOBS = "jobs AS (SELECT s_nationkey::VARCHAR || '|' || o_orderpriority AS queue, l_orderkey * 1000000 + l_suppkey AS job, l_suppkey AS caller, any_value(o_orderdate)::DATE AS since, max(l_shipdate)::DATE AS till, sum(l_quantity)::BIGINT AS cells, max(l_discount) AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, o_orderpriority, l_orderkey, l_suppkey)"
_WAITS = "list_sum([0] || list_transform({}, lambda x: x.cells))"
#: A step of all queues a round; what waits in each is a list.
_ADMISSION = f"""WITH RECURSIVE {_JOBS},
log AS (SELECT queue, since AS day, 0 AS late, 2 AS step, job, caller, cells FROM jobs UNION ALL SELECT queue, greatest(since, till), (till <= since)::INT, 0, job, caller, cells FROM jobs),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY day, late, step, job) AS k FROM log),
st(queue, k, held, job, status) AS (SELECT DISTINCT queue, 0::BIGINT, []::STRUCT(job BIGINT, caller BIGINT, cells BIGINT)[], NULL::BIGINT, NULL::VARCHAR FROM jobs
 UNION ALL SELECT queue, k, CASE WHEN step = 0 THEN list_filter(held, lambda x: x.job <> job) WHEN status = 'admitted' THEN list_append(held, {{'job': job, 'caller': caller, 'cells': cells}}) ELSE held END, CASE WHEN step = 2 THEN job END, status
 FROM (SELECT e.queue, e.k, e.step, e.job, e.caller, e.cells, st.held, CASE WHEN e.step = 0 THEN NULL WHEN e.cells > {QUEUE_CELLS * 0.5} THEN 'too_large'
  WHEN {_WAITS.format("list_filter(st.held, lambda x: x.caller = e.caller)")} + e.cells > {QUEUE_CELLS * 0.5} OR {_WAITS.format("st.held")} + e.cells > {QUEUE_CELLS} THEN 'busy' ELSE 'admitted' END AS status
  FROM st JOIN e ON e.queue = st.queue AND e.k = st.k + 1))
SELECT queue, job, caller, cells, status, ({_WAITS.format("held")})::BIGINT AS waiting FROM st JOIN jobs USING (queue, job)"""
_HALF = QUEUE_CELLS * 0.5
#: A step is a row of the log or, inside a cycle, the look at one caller's first job.
_CYCLES = f"""WITH RECURSIVE {_JOBS}, m AS (SELECT *, date_trunc('month', since)::DATE AS month FROM jobs),
log AS (SELECT queue, month AS day, 2 AS step, job, caller, cells, CASE WHEN discount >= 0.1 THEN 'misfit' ELSE 'bands' END AS kind, CASE WHEN discount >= 0.05 THEN 8 ELSE 1 END AS members FROM m
 UNION ALL SELECT DISTINCT queue, (month + INTERVAL 1 MONTH)::DATE, 1, 0, 0, 0, '', 0 FROM m),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY day, step, job) AS k FROM log), z AS MATERIALIZED (SELECT queue, max(k) AS stop FROM e GROUP BY 1),
st(queue, k, waits, due, scan, serving, taken, members, budget, again, cycles, job, status, cycle, place) AS (
 SELECT queue, 0::BIGINT, []::STRUCT(job BIGINT, caller BIGINT, cells BIGINT, kind VARCHAR, members INT)[], []::BIGINT[], []::BIGINT[], false, 0, 0, 0::BIGINT, false, 0, NULL::BIGINT, NULL::VARCHAR, NULL::INT, NULL::INT FROM z
 UNION ALL SELECT queue, CASE WHEN reads THEN k + 1 ELSE k END,
  CASE WHEN let = 'admitted' THEN list_append(waits, own) WHEN fits THEN rest ELSE waits END,
  CASE WHEN let = 'admitted' AND NOT list_contains(due, own.caller) THEN list_append(due, own.caller) WHEN fits THEN list_filter(due, lambda x: x <> first.caller) || CASE WHEN len(list_filter(rest, lambda x: x.caller = first.caller)) > 0 THEN [first.caller] ELSE [] END ELSE due END,
  CASE WHEN opens OR (serving AND len(scan) = 0) THEN due ELSE scan[2:] END, opens OR (serving AND NOT ends),
  CASE WHEN opens THEN 0 WHEN fits THEN taken + 1 ELSE taken END, CASE WHEN fits AND taken = 0 THEN first.members ELSE members END, CASE WHEN opens THEN {CYCLE_CELLS} WHEN fits THEN budget - first.cells ELSE budget END,
  CASE WHEN opens OR (serving AND len(scan) = 0) THEN false ELSE again OR fits END, CASE WHEN ends AND (fits OR taken > 0) THEN cycles + 1 ELSE cycles END,
  CASE WHEN let <> 'admitted' THEN own.job WHEN fits THEN first.job END, CASE WHEN let <> 'admitted' THEN let WHEN fits THEN 'admitted' END, CASE WHEN fits THEN cycles + 1 END, CASE WHEN fits THEN taken + 1 END
 FROM (SELECT *, fits AND first.kind <> 'bands' OR serving AND len(scan) = 0 AND NOT (again_round AND len(due) > 0) AS ends, list_filter(waits, lambda x: x.job <> first.job) AS rest
  FROM (SELECT *, coalesce(serving AND len(scan) > 0 AND (taken = 0 OR first.kind = 'bands' AND first.members = members AND first.cells <= budget), false) AS fits
   FROM (SELECT st.*, e.k IS NOT NULL AS reads, NOT serving AND (e.k IS NULL OR e.step = 1) AS opens, list_filter(waits, lambda x: x.caller = st.scan[1])[1] AS first, st.again AS again_round,
     struct_pack(job := e.job, caller := e.caller, cells := e.cells, kind := e.kind, members := e.members) AS own,
     CASE WHEN e.step = 2 THEN CASE WHEN e.cells > {_HALF} THEN 'too_large' WHEN {_WAITS.format("list_filter(waits, lambda x: x.caller = e.caller)")} + e.cells > {_HALF} OR {_WAITS.format("waits")} + e.cells > {QUEUE_CELLS} THEN 'busy' ELSE 'admitted' END END AS let
    FROM st JOIN z ON z.queue = st.queue LEFT JOIN e ON e.queue = st.queue AND e.k = st.k + 1 AND NOT serving WHERE serving OR st.k < stop OR len(waits) > 0))))
SELECT queue, job, caller, cells, status, cycle, place FROM st JOIN jobs USING (queue, job)"""
_LATE = ["none", "longest_window", "actual", "salt", "horizon", "no_history"]
_SHORT = "a read needs two training rows and one train_y each"
_CASES = ", ".join("('{}', {}, {}, {})".format(n, status or "NULL", f"'{reason}'" if reason else "NULL", n in _LATE) for n, _, _, status, reason in REFUSALS)
_REFUSED = f"""WITH {_panel('supplier_qty')}, n AS (SELECT series, count(y) AS known FROM tr GROUP BY series HAVING count(y) > 1), c(name, status, reason, late) AS (VALUES {_CASES})
SELECT series::VARCHAR || '-' || name AS id, (CASE WHEN late AND known < 3 THEN 422 ELSE status END)::INT AS status, CASE WHEN late AND known < 3 THEN '{_SHORT}' ELSE reason END AS reason FROM n, c"""
_OFF_GRID = f"""WITH {_panel('supplier_qty')}, o AS (SELECT max(t) + 1 AS origin FROM p), {_naive('[1]', OFF_GRID)}, al AS (SELECT unnest({OFF_GRID}) AS alpha, unnest(range(1, {len(OFF_GRID) + 1}))::INT AS level)
SELECT series::VARCHAR AS request_id, alpha::DOUBLE AS level, round(q, {PLACES}) AS q, NULL::DOUBLE AS raw FROM nq JOIN al USING (level) JOIN (SELECT series FROM tr WHERE y IS NOT NULL GROUP BY 1 HAVING count(*) > 2) USING (series)"""
_PINNED = f"""WITH {_panel('supplier_qty')}, {_origins(6)}, {_naive('[1]', GRID)}
SELECT v.series, v.origin, {", ".join(f"round(max(CASE WHEN level = {round(a * 100)} THEN q END), {PLACES}) AS q{round(a * 100)}" for a in BANDS)}, round(sum((q <= y)::INT) / 100.0::DOUBLE, {PLACES}) AS pit
FROM nq v JOIN tr ON tr.series = v.series AND tr.t = v.origin + v.h - 1 WHERE y IS NOT NULL GROUP BY v.series, v.origin"""


_STREAMED = f"""WITH {_panel('event_hours')}, {_origins(48, 1, 6)}, {_naive('[1, 6]', GRID, 24)}, z AS (SELECT floor((epoch(max(ts)) - 3600) / 3600)::BIGINT AS closed FROM events),
pit AS (SELECT v.series, v.origin, v.h, sum((q < y)::INT) / 100.0::DOUBLE AS p FROM nq v JOIN tr ON tr.series = v.series AND tr.t = v.origin + v.h - 1 WHERE y IS NOT NULL AND tr.t < (SELECT closed FROM z) GROUP BY 1, 2, 3),
b0 AS (SELECT *, least(floor(p * 100)::INT, 99) AS b FROM pit),
bins AS (SELECT h, (b - (p < b * 0.01::DOUBLE)::INT + (b <> 99 AND p >= (b + 1) * 0.01::DOUBLE)::INT)::INT AS bin FROM b0),
rec AS (SELECT h, bin, count(*) AS n FROM bins GROUP BY 1, 2), keys AS (SELECT DISTINCT h FROM rec),
c AS (SELECT h, b.bin, coalesce(n, 0) + 1e-9::DOUBLE AS n FROM keys CROSS JOIN (SELECT unnest(range(100)) AS bin) b LEFT JOIN rec USING (h, bin)),
s AS (SELECT h, bin, n / sum(n) OVER k AS w, sum(n) OVER (PARTITION BY h ORDER BY bin) / sum(n) OVER k AS hi FROM c WINDOW k AS (PARTITION BY h)),
t AS (SELECT h, sum(n) AS total FROM rec GROUP BY 1), a AS (SELECT unnest({BANDS}) AS alpha, unnest(range(1, 6))::INT AS level)
SELECT h, any_value(total)::BIGINT AS n, level, round(CASE WHEN any_value(total) < 100 THEN any_value(alpha) ELSE arg_min((bin + (alpha - (hi - w)) / w) / 100.0::DOUBLE, bin) END, {PLACES}) AS read_at FROM t JOIN s USING (h) CROSS JOIN a WHERE hi >= alpha GROUP BY h, level"""


_DAYS = "floor(epoch(ts) / 86400)::BIGINT"
_SPARSE = f"""WITH c AS (SELECT user_id AS series, {_DAYS} AS t, count(*)::DOUBLE AS y FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
g AS (SELECT series, unnest(generate_series((SELECT min(t) FROM c), (SELECT max(t) FROM c))) AS t FROM (SELECT DISTINCT series FROM c))
SELECT series, t, (t % 7 + 1)::INT AS moy, round(coalesce(y, 0), 4) AS y FROM g LEFT JOIN c USING (series, t)"""
_REQUESTED = f"""WITH {_panel('supplier_qty')}, o AS (SELECT max(t) + 1 AS origin FROM p), {_naive('[1]', BANDS)}, al AS (SELECT unnest({BANDS}) AS alpha, unnest(range(1, 6))::INT AS level)
SELECT series::VARCHAR AS request_id, 0::INT AS read, 0::INT AS row, alpha AS level, round(q, {PLACES}) AS q FROM nq JOIN al USING (level) JOIN (SELECT series FROM tr WHERE y IS NOT NULL GROUP BY 1 HAVING count(*) > 2) USING (series)"""


def _uniform(*names: str) -> str:
    told = " || '|' || ".join(f"({n})::VARCHAR" for n in names)
    return f"((('0x' || substr(md5({told}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"


def _normal(*names: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(*names, _T('r'))})) * cos(2 * pi() * {_uniform(*names, _T('a'))}))"


def _T(text: str) -> str:
    return f"'{text}'"


def _simulated(lean: float) -> str:
    """CTE sim like whatif.simulated of whatif.fitted."""
    e, drawn = whatif.ELASTICITY, "exp(base + season + shock - {e} * (ln({p}) - usual) + 0.05 * {z})"
    return f"""{_WORLD}, w0 AS (SELECT s_nationkey::BIGINT AS world, wd.*, t % 12 AS moy, ln(price) AS p, ln(revenue) - ln(price) AS v FROM wd JOIN supplier ON member = s_suppkey WHERE price > 0 AND revenue > 0),
w1 AS (SELECT w0.*, usual, base, v - base + {e} * (p - usual) AS rest FROM w0 JOIN (SELECT world, member, avg(p) AS usual, avg(v) AS base FROM w0 WHERE t < {CUT} GROUP BY 1, 2) USING (world, member)),
w2 AS (SELECT w1.*, coalesce(season, 0) AS season FROM w1 LEFT JOIN (SELECT world, moy, avg(rest) AS season FROM w1 WHERE t < {CUT} GROUP BY 1, 2) USING (world, moy)),
w3 AS (SELECT w2.* EXCLUDE (price), price * exp({lean}::DOUBLE * shock) AS price, shock FROM w2 JOIN (SELECT world, t, avg(rest - season) AS shock FROM w2 GROUP BY 1, 2) USING (world, t)),
sim AS (SELECT * EXCLUDE (revenue), price * {drawn.format(e=e, p="price", z=_normal(_T('landed'), 'world', 'member', 't'))} AS revenue FROM w3)"""


_OUTCOMES = f"""WITH {_simulated(0.0)}, pu AS (SELECT *, price * factor AS pulled FROM sim, (SELECT unnest({whatif.FACTORS}::DOUBLE[]) AS factor) WHERE t >= {CUT}),
dr AS (SELECT world, member, t, factor, k, revenue * factor AS replay, pulled * exp(base + season + shock - {whatif.ELASTICITY} * (ln(pulled) - usual) + 0.05 * {_normal(_T('pulled'), 'world', 'member', 't', 'factor', 'k')}) AS run FROM pu, range(25) d(k))
SELECT world, member, t, factor, round(median(run), 3) AS true_median, round(max(CASE WHEN k = 0 THEN run END), 3) AS actual, round(any_value(replay), 3) AS replay FROM dr GROUP BY ALL"""
_SYNTHETIC = f"""WITH f0 AS (SELECT l_suppkey AS series, {_MONTH.format('l_shipdate')} AS t, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2), f AS (SELECT * FROM f0 WHERE t < (SELECT max(t) FROM f0)),
g AS (SELECT f.*, level + coalesce(slope, 0) * (t - middle) AS line FROM f JOIN (SELECT series, avg(y) AS level, avg(t) AS middle, regr_slope(y, t) AS slope FROM f GROUP BY 1) USING (series)),
fs AS (SELECT series, t, line * season * (1 + 0.05 * {_normal(_T('noise'), 'series', 't')}) AS y FROM g JOIN (SELECT t % 12 AS moy, sum(y) / sum(line) AS season FROM g GROUP BY 1) ON moy = t % 12),
e AS (SELECT series, min(t) AS first, max(t) AS last FROM fs GROUP BY series), m AS (SELECT last, min(first) AS start FROM e GROUP BY last ORDER BY count(*) DESC, last LIMIT 1)
SELECT e.series, g.t, (g.t % 12 + 1)::INT AS moy, round(fs.y, 4) AS y FROM e JOIN m USING (last) CROSS JOIN (SELECT unnest(generate_series(m.start, m.last)) AS t FROM m) g LEFT JOIN fs ON fs.series = e.series AND fs.t = g.t"""
_PARITY = f"""WITH {_panel('supplier_qty')}, {_origins(3)}, {_naive('[1]', BANDS)}, {_regression(BANDS)},
b AS (SELECT series, origin, max(abs(rq.q - nq.q) / greatest(1, abs(nq.q))) AS dev, any_value(tr.y) AS y, {", ".join(f"max(CASE WHEN level = {k + 1} THEN {v}q.q END) AS {v}{k}" for v in "rn" for k in range(5))}
 FROM rq JOIN nq USING (series, origin, h, level) LEFT JOIN tr ON tr.series = nq.series AND tr.t = origin + h - 1 GROUP BY 1, 2)
SELECT count(*) AS fits, round(max(dev), {PLACES}) AS max_rel_dev, round(quantile_cont(dev, 0.99), {PLACES}) AS p99_rel_dev, round(quantile_cont(dev, 0.5), {PLACES}) AS median_rel_dev,
 count(*) FILTER ((y BETWEEN least(r1, r3) AND greatest(r1, r3)) <> (y BETWEEN least(n1, n3) AND greatest(n1, n3))) AS flips80,
 count(*) FILTER ((y BETWEEN least(r0, r4) AND greatest(r0, r4)) <> (y BETWEEN least(n0, n4) AND greatest(n0, n4))) AS flips90 FROM b"""


def _panel_oracle(name: str) -> str:
    return f"WITH {_panel(name)} SELECT series, t, moy, round(y, 4) AS y FROM p"


ORACLES = {
    **{f"panel_{n}": _panel_oracle(n) for n in _FACTS},
    "panel_sparse_user": _SPARSE,
    "request_naive": _REQUESTED,
    "request_validation": f"""WITH {_panel('supplier_qty')}, n AS (SELECT series, count(y) AS known, count(*) AS n FROM tr GROUP BY series)
SELECT series::VARCHAR AS request_id, CASE WHEN known < 3 THEN 422 END::INT AS status,
  CASE WHEN known < 3 THEN 'a read needs two training rows and one train_y each' END AS reason, (2 * known + n)::BIGINT AS n_cells FROM n WHERE known > 1""",
    "trim_nation_sales": f"WITH {_panel('nation_sales')} SELECT series, i, t, round(y, 4) AS y FROM tr",
    **{f"recipe_h{h}": _recipe(h) for h in (1, 3, 6, 12, 13)},
    **{f"seasonal_recipe_h{h}": _recipe(h, True) for h in (6, 13)},
    "trailing_sum_12": f"WITH {_panel('supplier_qty')} SELECT series, t, round(CASE WHEN count(y) OVER b = 12 THEN sum(y) OVER b END, 4) AS y FROM tr WINDOW b AS (PARTITION BY series ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)",
    "fill_median": f"WITH r AS ({_recipe(3)}), m AS (SELECT series, coalesce(quantile_cont(lag1, 0.5), 0) AS l1, coalesce(quantile_cont(mean3, 0.5), 0) AS m3, coalesce(quantile_cont(lag12, 0.5), 0) AS l12 FROM r GROUP BY 1) SELECT series, t, round(coalesce(lag1, l1), {PLACES}) AS lag1, round(coalesce(mean3, m3), {PLACES}) AS mean3, round(coalesce(lag12, l12), {PLACES}) AS lag12 FROM r JOIN m USING (series)",
    "scale_last12": f"WITH {_panel('supplier_qty')} SELECT series, round(coalesce(nullif(avg(abs(y)) FILTER (WHERE i > z - 12), 0), 1), {PLACES}) AS scale FROM (SELECT *, max(i) OVER (PARTITION BY series) AS z FROM tr) GROUP BY series",
    "naive_h1": f"WITH {_panel('supplier_qty')}, {_origins(3)}, {_naive('[1]', BANDS)} SELECT {_LONG} FROM nq",
    "naive_h12": f"WITH {_panel('supplier_qty')}, {_origins(2, 1, 12)}, {_naive('[12]', BANDS)} SELECT {_LONG} FROM nq",
    "naive_h18": f"WITH {_panel('nation_sales')}, {_origins(2, 1, 18)}, {_naive('[18]', BANDS)} SELECT {_LONG} FROM nq",
    "naive_hourly": f"WITH {_panel('event_hours')}, {_origins(3, 1, 6)}, {_naive('[6]', BANDS, 24)} SELECT {_LONG} FROM nq",
    "regression_voice": f"WITH {_panel('supplier_qty')}, {_origins(3)}, {_regression(BANDS)} SELECT {_LONG} FROM rq",
    "blend_mean": f"WITH {_panel('supplier_qty')}, {_origins(3)}, {_naive('[1]', BANDS)}, {_regression(BANDS)} SELECT series, origin, h, level, round((nq.q + rq.q) / 2, {PLACES}) AS q FROM nq JOIN rq USING (series, origin, h, level)",
    "walk_scores": _walk("supplier_qty"),
    "walk_scores_flags": _walk("flag_qty"),
    "project_scores": _PROJECT,
    "total_scores": _TOTALS,
    "pit_histogram": f"{_PAST} SELECT h, bin, count(*) AS n FROM bins GROUP BY 1, 2",
    "record_as_of_origin": f"{_PAST}, {_RECORD} SELECT origin, h, bin, n FROM rec",
    "calibrated_levels": _LEVELS,
    "whatif_size_usual": f"WITH {_WORLD}, {_USUAL} SELECT member, round(size, 2) AS size, round(usual, 4) AS usual FROM us",
    "whatif_replay": f"WITH {_WORLD}, {_PULLED} SELECT member, t, factor, round(price, 9) AS price, round(truth, 4) AS truth, round(replay, 4) AS replay FROM pu",
    "whatif_support": f"WITH {_WORLD}, {_PULLED}, z AS (SELECT min(price) AS lo, max(price) AS hi FROM wd WHERE t < {CUT}) SELECT factor, round(avg((price BETWEEN lo AND hi)::INT), {PLACES}) AS in_support FROM pu, z GROUP BY 1",
    "whatif_grade": f"WITH {_WORLD}, {_USUAL}, {_PULLED}, fit AS (SELECT regr_slope(ln(revenue / size), ln(price / usual)) AS b, regr_intercept(ln(revenue / size), ln(price / usual)) AS a FROM wd JOIN us USING (member) WHERE t < {CUT}) SELECT factor, round(pow(factor, {1 - whatif.ELASTICITY}), {PLACES}) AS true_move, round(avg(abs(replay - truth) / truth), {PLACES}) AS replay_off, round(avg(abs(size * exp(a + b * ln(price / usual)) - truth) / truth), {PLACES}) AS median_off FROM pu JOIN us USING (member), fit GROUP BY 1",
    "misfit_pair": _PAIR,
    "misfit_pair_folds": _PAIR_FOLDS,
    "queue_admission": _ADMISSION,
    "queue_cycles": _CYCLES,
    "request_refusals": _REFUSED,
    "request_levels": _OFF_GRID,
    "pinned_points": _PINNED,
    "walk_calibrated_untied": _WALK_CALIBRATED,
    "cal_project_untied": _CAL_PROJECT,
    "default_record_levels": _DEFAULTS,
    "panel_arrays": _panel_oracle("supplier_qty"),
    "walk_table_function": f"WITH {_panel('supplier_qty')}, {_origins(3)}, {_naive('[1]', BANDS)} SELECT {_LONG} FROM nq",
    "stream_record": _STREAMED,
    "stream_requests": _REQUESTED,
    "misfit_lowest": f"SELECT o_orderkey, score, CASE WHEN share_o_cust <= share_o_totalprice THEN 'o_cust' ELSE 'o_totalprice' END AS cell FROM ({_PAIR}) ORDER BY score, o_orderkey LIMIT 50",
    "whatif_simulated": f"WITH {_simulated(1.0)} SELECT world, member, t, round(price, {PLACES}) AS price, round(revenue, 3) AS revenue FROM sim",
    "whatif_true_median": _OUTCOMES,
    "parity_report": _PARITY,
    "panel_synthetic": _SYNTHETIC,
    "panel_head": f"WITH {_panel('supplier_qty')} SELECT series, t, round(y, 4) AS y FROM p WHERE series IN (SELECT series FROM e JOIN m USING (last) ORDER BY md5('0|' || series::VARCHAR), series LIMIT 10)",
    "standardised": f"WITH {_panel('supplier_qty')} SELECT series, t, round((y - avg(y) OVER w) / coalesce(nullif(stddev_pop(y) OVER w, 0), 1), {PLACES}) AS z FROM tr WINDOW w AS (PARTITION BY series)",
    "queue_round_robin": "WITH j AS (SELECT l_suppkey AS caller, l_orderkey * 1000000 + l_suppkey AS seq, sum(l_quantity)::BIGINT AS n_cells FROM lineitem GROUP BY 1, l_orderkey), r AS (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY seq)::INT AS round FROM j) SELECT caller, seq, n_cells, round, ((sum(n_cells) OVER (ORDER BY round, seq) - 1) // 131072)::BIGINT AS cycle FROM r",
}
