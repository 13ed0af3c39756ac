"""A batch of requests as JSON lines: checked rows, refusals with their reasons, and answers.

Nothing raises for a bad request: it becomes a row with a status and a reason, and the others are answered.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.functions.quantiles import BINS, GRID, literal, merged_counts, pit, place, quantile, with_levels
from bandloom.functions.tables import checkpointed, running, written
from bandloom.operators.calibration import TOTAL_WINDOW
from bandloom.operators.ensembles import views
from bandloom.operators.misfit import frame_shares
from bandloom.operators.voices import linear_reads, naive_calls

READ = "struct<train_x:array<array<double>>,train_y:array<double>,test_x:array<array<double>>,actual:array<double>,salt:array<bigint>,history:array<double>,horizon:array<int>,context:string,cache:boolean>"
SCHEMA = f"caller string, request_id string, alphas array<double>, members int, voices array<string>, season int, window int, pit_history string, reads array<{READ}>"
VOICES = ["linear", "seasonal_naive"]
MOST_BYTES = 32_000_000
#: A voice alone is asked within these levels where its record says others.
OUTER = (0.001, 0.999)


def rows_of(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows of the schema from a column ``value``, with its size and whether it was JSON at all.

    ``keep`` names columns of ``lines`` that stay.

    A line that is too large is not parsed.
    """
    size = F.octet_length("value")
    doc = F.from_json(F.when(size <= MOST_BYTES, F.col("value")), f"{SCHEMA}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(*(keep or []), size.alias("n_bytes"), doc.alias("r")).select(*(keep or []), "n_bytes", "r.*")


def parsed(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """As ``rows_of``, for what is used more than once: parsed once, and kept in its order."""
    return checkpointed(rows_of(lines, keep))


def context_id(train_x: Column, train_y: Column, members: Column) -> Column:
    """What a context is: its rows and how they are read."""
    return F.substring(F.sha2(F.to_json(F.struct(train_x.alias("x"), train_y.alias("y"), F.coalesce(members, F.lit(1)).alias("members")), {"ignoreNullFields": "false"}), 256), 1, 32)


def kept(checked: DataFrame) -> DataFrame:
    """``caller, context, train_x, train_y``: what the sound requests ask to be kept (``cache``), each once.

    Written to a table by the caller of this, it is the store that later requests name their contexts from.
    """
    reads = checked.where("refusal is null").select("caller", "members", F.explode("reads").alias("r")).where("r.cache and r.context is null")
    named = reads.select("caller", context_id(F.col("r.train_x"), F.col("r.train_y"), F.col("members")).alias("context"), "r.train_x", "r.train_y")
    return named.groupBy("caller", "context").agg(F.first("train_x").alias("train_x"), F.first("train_y").alias("train_y"))


def with_contexts(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests whose reads have the rows of the contexts that they name, as far as their caller keeps them in ``store``.

    What is not found, or comes with rows of its own, stays as it is: ``checked`` refuses it. Requests without such
    reads are not shuffled.
    """
    names = F.exists("reads", lambda r: r["context"].isNotNull())
    df = requests.withColumn("_at", F.monotonically_increasing_id())  # of rows that parsed() has checkpointed
    reads = df.where(names).select("_at", "caller", F.posexplode("reads").alias("pos", "r"))
    held = store.select(F.col("caller").alias("of"), F.col("context").alias("named"), F.col("train_x").alias("x"), F.col("train_y").alias("y"))
    reads = reads.join(held, (F.col("caller") == F.col("of")) & (F.col("r.context") == F.col("named")), "left")
    bare = F.col("named").isNotNull() & F.col("r.train_x").isNull() & F.col("r.train_y").isNull()
    filled = F.when(bare, F.col("r").withField("train_x", F.col("x")).withField("train_y", F.col("y")).withField("context", F.lit(None).cast("string")).withField("cache", F.lit(False))).otherwise(F.col("r"))
    found = reads.groupBy("_at").agg(F.array_sort(F.collect_list(F.struct("pos", filled.alias("r")))).alias("filled"))
    df = df.join(found, "_at", "left").drop("_at")
    return df.withColumn("reads", F.coalesce(F.col("filled.r"), F.col("reads"))).drop("filled")


def histories(df: DataFrame) -> DataFrame:
    """Adds ``counts``, histories of PITs by voice; null where ``pit_history`` is absent or not as it has to be.

    A bare list is the history of the one voice that is asked; several voices have an object of lists by voice.
    """
    raw, several = F.col("pit_history"), F.size("voices") > 1
    by_voice = F.from_json(raw, "map<string,array<double>>", {"mode": "PERMISSIVE"})
    alone = F.create_map(F.lit("linear"), F.from_json(raw, "array<double>", {"mode": "PERMISSIVE"}))
    return df.withColumn("counts", F.when(several & raw.rlike(r"^\s*\{"), by_voice).when(~several & raw.rlike(r"^\s*\["), alone))


def _refused(cases: list[tuple[Column, int, str]]) -> Column:
    out = F.lit(None).cast("struct<status:int,reason:string>")
    for bad, status, reason in reversed(cases):
        out = F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def checked(requests: DataFrame) -> DataFrame:
    """Adds ``refusal``: null, or the first rule that the request breaks."""
    df = requests.withColumns({"members": F.coalesce("members", F.lit(1)), "season": F.coalesce("season", F.lit(12)), "window": F.coalesce("window", F.lit(1)), "voices": F.coalesce("voices", F.array(F.lit("linear")))})
    df = histories(df)
    is_history = lambda x: x.isNotNull() & (F.size(x) == BINS) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (c < 0))
    ragged = lambda x: F.exists(x, lambda r: F.size(r) != F.size(F.get(x, F.lit(0))))
    any_read = lambda bad: F.exists("reads", bad)
    rows = lambda r: F.size(r["test_x"])
    # Absent cells stand at the mean, so a column is constant if its known values are.
    column = lambda x, j: F.filter(F.transform(x, lambda row: F.get(row, j)), lambda v: v.isNotNull())
    varies = lambda x: F.exists(F.sequence(F.lit(0), F.size(F.get(x, F.lit(0))) - 1), lambda j: F.size(F.array_distinct(column(x, j))) > 1)
    cases = [
        (F.col("n_bytes") > MOST_BYTES, 413, "the request is too large"),
        (F.col("_bad").isNotNull(), 400, "not a JSON object of the expected fields"),
        (F.col("alphas").isNull() | (F.size("alphas") == 0) | F.exists("alphas", lambda a: a.isNull() | (a <= 0) | (a >= 1)), 400, "alphas must be numbers strictly between 0 and 1"),
        ((F.col("members") < 1) | (F.col("members") > 32), 400, "members must be 1 to 32"),
        ((F.col("season") < 1) | (F.col("season") > 366), 400, "season must be 1 to 366"),
        ((F.size(F.array_distinct("voices")) != F.size("voices")) | (F.size(F.array_except("voices", F.array(*[F.lit(v) for v in VOICES]))) > 0) | ~F.array_contains("voices", "linear"), 400, "voices must be known, each once, with linear among them"),
        ((F.col("window") < 1) | (F.col("window") > 366), 400, "window must be 1 to 366"),
        (F.col("pit_history").isNotNull() & (F.col("counts").isNull() | (F.size(F.array_except(F.map_keys("counts"), F.concat("voices", F.array(F.lit("blend"))))) > 0)), 400, "pit_history must be a list of counts, with several voices an object of lists by voice"),
        (F.col("counts").isNotNull() & ~F.forall(F.map_values("counts"), is_history), 400, f"pit_history must be {BINS} counts that are not negative"),
        (F.col("reads").isNull() | (F.size("reads") == 0), 400, "reads are missing"),
        (any_read(lambda r: r["context"].isNotNull() & (r["train_x"].isNotNull() | r["train_y"].isNotNull())), 400, "a context stands in place of train_x and train_y"),
        (any_read(lambda r: r["context"].isNotNull()), 404, "context_unknown: it is not kept here for this caller; send the rows again"),
        (any_read(lambda r: r["train_x"].isNull() | r["train_y"].isNull() | r["test_x"].isNull() | (rows(r) < 1)), 400, "a read needs train_x, train_y and test_x"),
        (any_read(lambda r: ragged(r["train_x"]) | ragged(r["test_x"]) | (F.size(F.get(r["train_x"], F.lit(0))) != F.size(F.get(r["test_x"], F.lit(0))))), 400, "rows differ in length"),
        (any_read(lambda r: (F.size(r["train_x"]) < 2) | (F.size(r["train_x"]) != F.size(r["train_y"]))), 422, "a read needs two training rows and one train_y each"),
        ((F.col("members") > 1) & any_read(lambda r: ~varies(r["train_x"])), 422, "every feature is constant over the training rows"),
        (any_read(lambda r: r["actual"].isNotNull() & (F.size(r["actual"]) != rows(r))), 400, "actual needs one value per test row"),
        (any_read(lambda r: r["salt"].isNotNull() & (F.size(r["salt"]) != rows(r))), 400, "salt needs one value per test row"),
        (any_read(lambda r: r["horizon"].isNotNull() & ((F.size(r["horizon"]) != rows(r)) | F.exists(r["horizon"], lambda h: h.isNull() | (h < 1) | (h > 120)))), 400, "horizon needs one whole number of 1 to 120 per test row"),
        ((F.size("voices") > 1) & any_read(lambda r: r["history"].isNull()), 400, "several voices need a history"),
    ]
    return df.withColumn("refusal", _refused(cases))


def cells(r: Column, members: Column) -> Column:
    """What a read costs: cells of its tables times members, and its history."""
    width = F.coalesce(F.size(F.get(r["test_x"], F.lit(0))), F.lit(0))
    return members * width * (F.size(r["test_x"]) + F.size(r["train_x"])) + F.coalesce(F.when(r["history"].isNotNull(), F.size(r["history"])), F.lit(0))


def turns(jobs: DataFrame, budget: int) -> DataFrame:
    """``caller, seq, n_cells`` -> also ``round, cycle``: one job per caller and round, in the order of arrival, cut by cells.

    Both are running sums over ranges of the jobs in order, so neither a caller of many jobs nor the first round, which has a
    job of every caller, is the work of one task.
    """
    placed = running(jobs.select("caller", "seq", "n_cells"), ["caller", "seq"], F.lit(1).cast("long"), "place")
    first = placed.groupBy("caller").agg(F.min("place").alias("first"))
    rounds = placed.join(first, "caller").select("caller", "seq", "n_cells", (F.col("place") - F.col("first") + 1).cast("int").alias("round"))
    till = running(rounds, ["round", "seq"], F.col("n_cells"), "till")
    return till.select("caller", "seq", "n_cells", "round", F.floor((F.col("till") - 1) / F.lit(budget)).cast("long").alias("cycle"))


def _matrix(rows: pa.ListScalar) -> np.ndarray:
    """Rows of one length as a matrix, NaN for null, without a Python object a cell."""
    return rows.values.flatten().to_numpy(zero_copy_only=False).reshape(len(rows.values), -1)


#: Training cells that are fitted together.
CELLS = 2_000_000


def _told(train_x: np.ndarray, train_y: np.ndarray, test_x: np.ndarray, levels: list[float], members: int) -> np.ndarray:
    """The mean over the members of what each says, scaled back: (reads, test rows, levels); not finite where one's answer is not."""
    if members == 1:
        return linear_reads(train_x, train_y, test_x, levels)
    mean, std = train_y.mean(1, keepdims=True), train_y.std(1, keepdims=True)
    std[std == 0] = 1.0
    total = 0.0
    for train, test in views(train_x, test_x, members):
        total = total + (linear_reads(train, (train_y - mean) / std, test, levels) * std[..., None] + mean[..., None])
    return total / members


def _linear_answers(batches):
    """``row, both``: what the voice says at the levels of the read and at the percentiles, of several members their mean.

    Tables of equal shape and levels are fitted together, as one stacked solve.
    """
    for b in batches:
        alike = defaultdict(list)
        for i in range(len(b)):
            members, train_x, train_y, test_x, ask = (b.column(c)[i] for c in ("members", "train_x", "train_y", "test_x", "ask"))
            x, test = _matrix(train_x), _matrix(test_x)
            y = train_y.values.to_numpy(zero_copy_only=False)
            x, y = x[~np.isnan(y)], y[~np.isnan(y)]
            if len(y) >= 2:
                if np.isnan(x).any() or np.isnan(test).any():
                    fill = np.array([np.median(c) if len(c := col[~np.isnan(col)]) else 0.0 for col in x.T])
                    x, test = np.where(np.isnan(x), fill, x), np.where(np.isnan(test), fill, test)
                alike[x.shape, len(test), tuple(ask.as_py()), members.as_py()].append((i, x, y, test))
        for (shape, _, ask, members), reads in alike.items():
            step = max(1, CELLS // max(1, shape[0] * shape[1]))
            for some in (reads[k : k + step] for k in range(0, len(reads), step)):
                at, *tables = zip(*some, strict=True)
                found = _told(*map(np.stack, tables), [*ask, *GRID], members)
                read, row = np.nonzero(np.isfinite(found).all(2))
                keys = [b.column(c).take(pa.array(np.array(at)[read])) for c in ("caller", "request_id", "read")]
                ends = np.arange(len(read) + 1, dtype=np.int32) * found.shape[2]
                both = pa.ListArray.from_arrays(ends, found[read, row].ravel())
                yield pa.RecordBatch.from_arrays([*keys, pa.array(row.astype(np.int32)), both], ["caller", "request_id", "read", "row", "both"])


def _through_records(df: DataFrame, defaults: DataFrame | None) -> DataFrame:
    """Adds ``own``, the voice's history, and where it says that the percentiles (``read_at``) and the request's levels
    (``alphas_at``) have to be read; the levels themselves without a history."""
    df = df.withColumn("own", F.try_element_at("counts", F.col("voice")))
    if defaults is not None:
        window = F.when(F.col("window") <= 1, 1).otherwise(TOTAL_WINDOW)
        told = defaults.select(F.col("voice").alias("of"), F.col("window").alias("over"), F.col("counts").alias("default"))  # a row per voice and window
        df = df.join(F.broadcast(told), (F.col("voice") == F.col("of")) & (window == F.col("over")), "left").drop("of", "over")
    else:
        df = df.withColumn("default", F.lit(None).cast("array<double>"))
    df = with_levels(df, merged_counts(F.col("own"), F.col("default")), GRID, "read_at")
    df = with_levels(df, merged_counts(F.col("own"), F.col("default")), None, "alphas_at", F.col("alphas"))
    return df.withColumn("read_at", F.when(F.col("own").isNotNull(), F.col("read_at")).otherwise(literal(GRID))).drop("default")


def _as_read(df: DataFrame) -> DataFrame:
    """Adds ``q`` and ``raw``, at the request's levels: as the voice was asked or, with a history, as its record reads it.

    A voice alone was asked at the levels that its record says; of several the percentiles are read there.
    """
    n = F.size("alphas")
    raw = F.slice("asked", 1, n)
    told = F.when(F.col("several"), F.transform("alphas_at", lambda a: quantile(F.col("grid"), place(a)))).otherwise(F.sort_array(F.slice("asked", n + 1, n)))
    return df.withColumn("q", F.when(F.col("own").isNull(), raw).otherwise(told)).withColumn("raw", F.when(F.col("own").isNotNull(), raw))


def answers(requests: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """``caller, request_id, read, row, voice, level, q, raw, pit``: a row a level of ``calls``."""
    df = calls(requests, defaults).select("caller", "request_id", "read", "row", "voice", "pit", F.explode("levels").alias("l"))
    return df.select("caller", "request_id", "read", "row", "voice", "l.level", "l.q", "l.raw", "pit")


def calls(requests: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """``caller, request_id, read, row, voice, pit, levels (level, q, raw)`` of the requests without refusal; ``blend`` where several call.

    Every voice is asked at the request's own levels, so none is cut off at the first or last percentile. A voice with a
    history in ``pit_history`` is read through it, and through the record of ``defaults (voice, window, counts)`` for the
    request's window: alone it is asked once more, at the levels that the record says (within OUTER); of several the
    percentiles are read there. ``raw`` is then its answer as it was, else null. The blend is the mean of the voices as read,
    and may have a history of its own. The PIT is against the raw percentiles, ties by salt (else the row). With ``members``
    a read is fitted once for each of them, on a view of its own (``ensembles.views``), and the answer is their mean.
    """
    read, key = ["caller", "request_id", "read"], ["caller", "request_id", "read", "row"]
    reads = requests.where("refusal is null").select("caller", "request_id", "alphas", "members", "voices", "season", "window", "counts", F.posexplode("reads").alias("read", "r"))
    reads = reads.withColumn("several", F.size("voices") > 1)
    reads = reads.withColumn("voice", F.explode(F.when(F.col("several"), F.concat("voices", F.array(F.lit("blend")))).otherwise(F.col("voices"))))
    reads = _through_records(reads.select(*read, "voice", "several", "alphas", "members", "voices", "season", "window", "counts", "r.*"), defaults)
    once_more = F.transform("alphas_at", lambda a: F.least(F.greatest(a, F.lit(OUTER[0])), F.lit(OUTER[1])))
    reads = written(reads.withColumn("ask", F.when(F.col("several") | F.col("own").isNull(), F.col("alphas")).otherwise(F.concat("alphas", once_more))), "reads")

    # Reads are dealt anew: files of few bytes would be the work of few tasks.
    asked = reads.where("voice = 'linear'").select(*read, "members", "train_x", "train_y", "test_x", "ask").repartition(*read)
    fitted = asked.mapInArrow(_linear_answers, "caller string, request_id string, read int, row int, both array<double>")
    n = F.size("both") - len(GRID)
    fitted = fitted.select(*key, F.slice("both", F.lit(1), n).alias("asked"), F.sort_array(F.slice("both", n + 1, F.lit(len(GRID)))).alias("grid"), F.lit("linear").alias("voice"))
    asked = reads.where("voice = 'seasonal_naive'").select(*read, "season", "history", "ask", F.posexplode(F.coalesce("horizon", F.array_repeat(F.lit(1), F.size("test_x")))).alias("row", "h"))
    series = asked.withColumn("from", F.expr("array_position(transform(history, y -> y is not null), true)")).where(F.col("from") > 0)
    series = series.select(F.struct(*key, "ask").alias("series"), "season", "h", F.expr("slice(history, `from`, size(history))").alias("ys"))
    # Each history is asked at its own end.
    naive = naive_calls(series.withColumn("n", F.size("ys")).withColumn("origin", F.col("n").cast("long")), F.concat("series.ask", literal(GRID)))
    n = F.size("series.ask")
    naive = naive.select(*[f"series.{c}" for c in key], F.slice("q", 1, n).alias("asked"), F.sort_array(F.slice("q", n + 1, len(GRID))).alias("grid"), F.lit("seasonal_naive").alias("voice"))

    told = reads.select(*read, "voice", "several", "voices", "alphas", "own", "read_at", "alphas_at", F.posexplode("test_x").alias("row", "_x"), "actual", "salt")
    told = told.withColumn("y", F.get("actual", "row")).withColumn("salt", F.coalesce(F.get("salt", "row"), F.col("row").cast("long"))).drop("_x", "actual")
    spoke = _as_read(fitted.unionByName(naive).join(told, [*key, "voice"]))
    spoke = written(spoke.withColumn("as_read", F.when(F.col("own").isNull(), F.col("grid")).otherwise(F.transform("read_at", lambda a: quantile(F.col("grid"), place(a))))), "spoke")
    # The answers and the percentiles are two sets of levels, and are blended apart; all voices must have called.
    # Those of a row meet as whole arrays: a row a level and voice would be a hundred times as many.
    each = spoke.where("several").select(*key, F.size("voices").alias("n_voices"), F.concat(F.sort_array("q"), "as_read").alias("v"))
    met = each.groupBy(*key).agg(F.first("n_voices").alias("n_voices"), F.collect_list("v").alias("vs")).where("size(vs) = n_voices")
    total = F.aggregate("vs", F.array_repeat(F.lit(0.0), F.size(F.get("vs", F.lit(0)))), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    means = met.select(*key, F.transform(total, lambda v: v / F.col("n_voices")).alias("both")).join(told.where("voice = 'blend'"), key)
    blend = means.withColumn("asked", F.slice("both", F.lit(1), F.size("alphas"))).withColumn("grid", F.slice("both", F.size("alphas") + 1, F.lit(len(GRID))))
    columns = [*key, "voice", "alphas", "y", "salt", "grid", "q", "raw"]
    df = spoke.select(*columns).unionByName(_as_read(blend).select(*columns)).withColumn("pit", pit(F.col("grid"), F.col("y"), F.col("salt")))
    # Without a history raw is null, and so is each of its levels.
    df = df.withColumn("raw", F.coalesce("raw", F.array_repeat(F.lit(None).cast("double"), F.size("alphas"))))
    return df.select(*key, "voice", "pit", F.arrays_zip(F.col("alphas").alias("level"), "q", "raw").alias("levels"))


def encoded(answered: DataFrame) -> DataFrame:
    """``caller, request_id, value``: the answers of a request as one JSON text, by read, row and voice; no number but finite ones."""
    return encoded_calls(answered.select("caller", "request_id", "read", "row", "voice", "pit", F.array(F.struct("level", "q", "raw")).alias("levels")))


def encoded_calls(called: DataFrame) -> DataFrame:
    """As ``encoded``, from rows of ``calls``."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    levels = F.transform("levels", lambda c: F.struct(c["level"].alias("level"), finite(c["q"]).alias("q"), finite(c["raw"]).alias("raw")))
    # Dealt by request once, for both steps.
    whole = called.select("caller", "request_id", "read", "row", "voice", finite(F.col("pit")).alias("pit"), levels.alias("levels")).repartition("caller", "request_id")
    each = whole.groupBy("caller", "request_id", "read", "row", "voice").agg(F.first("pit").alias("pit"), F.array_sort(F.flatten(F.collect_list("levels"))).alias("levels"))
    lines = each.groupBy("caller", "request_id").agg(F.array_sort(F.collect_list(F.struct("read", "row", "voice", "levels", "pit"))).alias("answers"))
    return lines.select("caller", "request_id", F.to_json(F.struct("answers"), {"ignoreNullFields": "false"}).alias("value"))


def sink(answered: DataFrame, path: str) -> None:
    """Writes the answers as JSON lines."""
    encoded(answered).select("value").write.text(path)


FRAME = "caller string, request_id string, x array<array<double>>, columns boolean, folds int"


def misfit_parsed(lines: DataFrame) -> DataFrame:
    """Requests ``{x, columns, folds}`` from JSON lines, with ``refusal``: null, or the first rule broken."""
    size = F.octet_length("value")
    doc = F.from_json(F.when(size <= MOST_BYTES, F.col("value")), f"{FRAME}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = checkpointed(lines.select(size.alias("n_bytes"), doc.alias("r")).select("n_bytes", "r.*"))
    df = df.withColumns({"columns": F.coalesce("columns", F.lit(False)), "folds": F.coalesce("folds", F.lit(1))})
    width = F.size(F.get("x", F.lit(0)))
    cases = [
        (F.col("n_bytes") > MOST_BYTES, 413, "the request is too large"),
        (F.col("_bad").isNotNull(), 400, "not a JSON object of the expected fields: columns is true or false"),
        ((F.col("folds") < 1) | (F.col("folds") > 10), 400, "folds is a whole number from 1 to 10"),
        (F.col("x").isNull() | (F.size("x") == 0) | F.exists("x", lambda r: r.isNull() | (F.size(r) != width)), 400, "x must be rows of one length"),
        ((F.size("x") < 2) | (width < 2), 422, "misfit needs two rows and two columns"),
        ((F.col("folds") > 1) & (F.size("x") < 2 * F.col("folds")), 422, "folds need two rows each"),
    ]
    return df.withColumn("refusal", _refused(cases))


def misfit_cost(x: Column, folds: Column) -> Column:
    """What a frame costs: its cells, once for each column, order and fold."""
    width = F.size(F.get(x, F.lit(0))).cast("long")
    return 2 * width * width * F.size(x) * folds


#: Rows of answers that a task makes at a time.
TOGETHER = 10_000


def _frames(batches):
    kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64())]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        """The answers of some frames ``(caller, request_id, shares, columns)``."""
        n = [len(shares) for _, _, shares, _ in rows]
        scores = np.concatenate([np.nansum(shares, 1) for _, _, shares, _ in rows])
        told = [shares if columns else shares[:, :0] for _, _, shares, columns in rows]
        flat = np.concatenate([t.ravel() for t in told])
        ends = np.concatenate([[0], np.cumsum(np.repeat([t.shape[1] for t in told], n))])
        absent = np.repeat([not columns for *_, columns in rows], n)
        shares = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, mask=np.isnan(flat)), mask=pa.array(absent))
        names = [pa.array([r[c] for r in rows], kinds[c]).take(pa.array(np.repeat(np.arange(len(rows)), n))) for c in (0, 1)]
        place = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
        return pa.RecordBatch.from_arrays([*names, pa.array(place), pa.array(scores), shares], ["caller", "request_id", "row", "score", "shares"])

    for b in batches:
        held, n = [], 0
        for i in range(len(b)):
            caller, name, x, columns, folds = (c[i] for c in b.columns)
            shares = frame_shares(_matrix(x), folds.as_py())
            held.append((caller.as_py(), name.as_py(), shares, columns.as_py()))
            n += len(shares)
            if n >= TOGETHER:
                yield made(held)
                held, n = [], 0
        if held:
            yield made(held)


def misfit_answers(requests: DataFrame) -> DataFrame:
    """``caller, request_id, row, score, shares`` of the frames without refusal; ``shares`` by column where asked, else null."""
    good = requests.where("refusal is null").select("caller", "request_id", "x", "columns", "folds")
    return good.mapInArrow(_frames, "caller string, request_id string, row int, score double, shares array<double>")
