"""Line deduplication by a log-template tree.

A line's tokens are what white space separates; a token with a digit is a variable field, ``<*>``. The tree
has a fixed depth: the number of tokens, then the first ``LEAD`` tokens; the path of a line of fewer than ``SHORT``
tokens is the whole masked line, which must recur as it is. In a leaf, a later token is kept in
the template if lines of ``MIN_DOCS`` documents have it at that place, and generalised to ``<*>`` otherwise.
A template counts if at least half of its tokens are fixed, and with evidence beyond the path: half of
the tokens after the lead are fixed, or ``MIN_DOCS`` documents have the line itself. Lines of templates that recur in
``MIN_DOCS`` documents are dropped. All of it is counting: leaves, tokens and templates are aggregated
before each shuffle, equal lines are counted once, and no leaf's lines ever meet in one task.

Documents that have a token, or a template, are counted once each, however many lines they have of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, materialize

LEAD, SHORT, MIN_DOCS, FIXED = 3, 5, 5, 0.5
#: Leaves, or dropped lines, that may be broadcast; more are joined by a shuffle.
HELD = 500_000
VARIABLE = "<*>"


def masked(line: Column) -> Column:
    """The line's tokens joined by one blank, tokens with a digit as <*>."""
    flat = F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " "))
    return F.regexp_replace(flat, "[^\\x20]*[0-9][^\\x20]*", VARIABLE)


def path(line: Column) -> Column:
    """Where a masked line goes in the tree; null for empty lines only."""
    n = F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1
    return F.when(line != "", F.concat_ws(" ", n, F.when(n >= SHORT, F.substring_index(line, " ", LEAD)).otherwise(line)))


def _in_documents(keys: DataFrame, own: DataFrame) -> DataFrame:
    """The keys of ``keys`` (key, hash of a line, its documents n) whose lines stand in MIN_DOCS distinct documents.

    One line in that many decides at once; only keys whose lines reach it together are counted by rows of ``own``.
    """
    sums = keys.groupBy("key").agg(F.max("n").alias("most"), F.sum("n").alias("m")).where(F.col("m") >= MIN_DOCS)
    sums = materialize(sums, "sums")
    unsure = keys.join(sums.where(F.col("most") < MIN_DOCS).select("key"), "key", "left_semi").groupBy("hash").agg(F.collect_set("key").alias("keys"))
    unsure = materialize(unsure, "unsure")
    at = own.select("row", F.explode(F.array_distinct("hashes")).alias("hash")).join(bounded(unsure, HELD), "hash")
    counted = at.select("row", F.explode("keys").alias("key")).distinct().groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") >= MIN_DOCS)
    return sums.where(F.col("most") >= MIN_DOCS).select("key").unionByName(counted.select("key"))


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, dropped`` (ascending numbers, from 0, of dropped lines).

    Lines end at ``\\n``. A null text has no lines; an empty one has an empty line, and empty lines are kept. Rows that repeat a
    doc_id, and rows without one, are documents like any other. Very long texts and lines are taken whole.
    """
    lines = F.coalesce(F.transform(F.split(F.col(text_col).cast("string"), "\n", -1), masked), F.array().cast("array<string>"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), lines.alias("lines"))
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.array_distinct(F.filter(F.transform("lines", path), lambda p: p.isNotNull())).alias("paths"))
    own = materialize(own, "lines")
    leaves = own.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS).select("path")
    leaves = materialize(leaves, "leaves")
    seen = own.select(F.explode(F.array_distinct("lines")).alias("line")).withColumn("path", path(F.col("line"))).where("path is not null")
    kinds = seen.join(bounded(leaves, HELD), "path", "left_semi").groupBy("path", "line").agg(F.count("*").alias("n"))
    kinds = materialize(kinds, "kinds")
    tokens = kinds.select(F.xxhash64("line").alias("hash"), F.xxhash64("path").alias("leaf"), "n", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    tokens = tokens.withColumn("key", F.xxhash64("leaf", "pos", "token"))
    common = materialize(_in_documents(tokens.where(F.col("pos") >= LEAD), own).withColumn("common", F.lit(True)), "common")
    # Leading tokens are the path itself; they stay whatever their frequency.
    fixed = F.when((F.col("pos") < LEAD) | F.coalesce("common", F.lit(False)), F.col("token")).otherwise(VARIABLE)
    built = tokens.join(common, "key", "left").groupBy("hash", "leaf", "n").agg(F.array_sort(F.collect_list(F.struct("pos", fixed.alias("token")))).alias("t"))
    built = built.select("hash", "leaf", "n", F.col("t.token").alias("t"))
    is_fixed = lambda x: x != VARIABLE
    enough = F.size(F.filter("t", is_fixed)) >= F.size("t") * F.lit(FIXED)
    after = F.slice("t", LEAD + 1, F.size("t"))
    enough &= (F.size(F.filter(after, is_fixed)) >= F.size(after) * F.lit(FIXED)) | (F.col("n") >= MIN_DOCS)
    built = built.where(enough).select("hash", "leaf", "n", F.array_join("t", " ").alias("template"))
    built = materialize(built, "templates")
    keys = built.select("hash", "n", F.xxhash64("leaf", "template").alias("key"))
    gone = keys.join(_in_documents(keys, own), "key", "left_semi")
    gone = materialize(gone.select("hash").distinct(), "gone")
    hits = own.select("row", F.posexplode("hashes").alias("line", "hash")).join(bounded(gone, HELD), "hash", "left_semi")
    hits = hits.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("dropped"))
    out = own.select("row", "doc_id", F.size("hashes").cast("long").alias("n_lines")).join(hits, "row", "left")
    return out.select("doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = drop_templates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
raw AS (SELECT rid, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
m AS (SELECT rid, i, regexp_replace(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g')), '[^\x20]*[0-9][^\x20]*', '{VARIABLE}', 'g') AS line FROM raw),
k AS (SELECT rid, i, line, string_split(line, ' ') AS t FROM m WHERE line <> ''),
p AS (SELECT *, len(t) || ' ' || array_to_string(CASE WHEN len(t) >= {SHORT} THEN t[1:{LEAD}] ELSE t END, ' ') AS path FROM k),
leaves AS (SELECT path FROM p GROUP BY path HAVING count(DISTINCT rid) >= {MIN_DOCS}),
kinds AS (SELECT path, line, any_value(t) AS t, count(DISTINCT rid) AS n FROM p WHERE path IN (SELECT path FROM leaves) GROUP BY path, line),
tok AS (SELECT path, line, n, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM kinds),
occ AS (SELECT DISTINCT rid, path, line FROM p WHERE path IN (SELECT path FROM leaves)),
com AS (SELECT path, pos, token FROM tok JOIN occ USING (path, line) GROUP BY path, pos, token HAVING count(DISTINCT rid) >= {MIN_DOCS}),
fix AS (SELECT tok.path, line, n, tok.pos, CASE WHEN tok.pos <= {LEAD} OR com.token IS NOT NULL THEN tok.token ELSE '{VARIABLE}' END AS f FROM tok LEFT JOIN com USING (path, pos, token)),
built AS (SELECT path, line, n, string_agg(f, ' ' ORDER BY pos) AS template FROM fix GROUP BY path, line, n HAVING sum((f <> '{VARIABLE}')::INT) >= count(*) * {FIXED}
  AND (sum((f <> '{VARIABLE}' AND pos > {LEAD})::INT) >= sum((pos > {LEAD})::INT) * {FIXED} OR n >= {MIN_DOCS})),
rec AS (SELECT path, template FROM built JOIN occ USING (path, line) GROUP BY path, template HAVING count(DISTINCT rid) >= {MIN_DOCS}),
gone AS (SELECT DISTINCT line FROM built JOIN rec USING (path, template)),
hit AS (SELECT rid, count(*) AS n_dropped, string_agg(i::VARCHAR, ',' ORDER BY i) AS dropped FROM m WHERE line IN (SELECT line FROM gone) GROUP BY rid)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(dropped, '') AS dropped
FROM d LEFT JOIN hit USING (rid)
"""
