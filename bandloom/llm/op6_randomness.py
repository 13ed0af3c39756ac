"""Secrets by strict patterns and a randomness test battery, in DataFrame functions only.

Base spans come from the patterns and always stay. Further candidates are long tokens outside of them whose characters
fit an encoding (hex, base32, base64, its URL form, or lower-case letters and digits). What base spans hold is tested, too. Under the hypothesis that a token is random in its
encoding, three tests are made: chi-squared of uniform use of the alphabet (Wilson-Hilferty), runs above and
below the middle of the alphabet, and serial correlation of neighbours. The least of the three p-values, times
three, is the token's p-value: random tokens spread evenly over (0, 1], structured ones crowd near 0.
Per length band, the number of random tokens is taken from the upper half of the p-values of all
documents, each distinct token once however often it is copied; a band of fewer than ``FEW`` distinct tokens takes
the estimate, and so the threshold, of all bands together. The threshold is the least at which the estimated share of structured tokens among those
accepted stays within ``FALSE_SHARE``. Short bands, whose tests see less, so get stricter thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{16,}+"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"
#: Alphabets by name, the narrowest first in either case; a token takes the first that has all its characters.
ALPHABETS = (("hex", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
             ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
             ("hex_lower", "0123456789abcdef"), ("base32_lower", "abcdefghijklmnopqrstuvwxyz234567"), ("base36_lower", "abcdefghijklmnopqrstuvwxyz0123456789"))
FALSE_SHARE, BANDS, BINS = 0.05, (20, 28, 40, 64, 128), 50
#: Tokens whose p-value is less are structured, whatever their band accepts.
LEAST = 0.001
#: Bands of fewer distinct tokens take the threshold of ALL bands together.
FEW, ALL = 20, -1


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches in order: ``(kind, at, gap, found)``, gap the characters since the last one."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda f, g: F.struct(F.length(g).alias("gap"), f.alias("found")))
    placed = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["found"].alias("found")))
    return F.when(F.regexp_like(text, F.lit(pattern)), placed).otherwise(F.array().cast("array<struct<kind:int,at:int,gap:int,found:string>>"))


def placed(marks: DataFrame) -> DataFrame:
    """``(row, kind, start, stop, token)`` of the spans among ``marks (row, kind, at, gap, found)``.

    A span ends after all gaps and matches of its pattern so far. Tokens (kind 3) that overlap base spans are left out:
    the furthest end of the base spans that start before one, and the next start of those behind, tell that.
    """
    till = W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    df = marks.withColumn("stop", F.sum(F.col("gap") + F.length("found")).over(till).cast("int")).withColumn("start", F.col("stop") - F.length("found"))
    token = F.when(F.col("kind") == 0, F.regexp_extract("found", ASSIGN, 2)).otherwise(F.col("found"))
    df = df.select("row", "kind", "start", "stop", token.alias("token"))
    df = df.where((F.col("kind") == 2) | (F.col("kind") == 0) & (F.length("token") >= 12) | (F.col("kind") == 1) & (F.length("token") >= 18) | (F.col("kind") == 3) & F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]"))
    is_base = F.col("kind") < 3
    ahead = W.partitionBy("row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, 0)
    behind = W.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("passed", F.max(F.when(is_base, F.col("stop"))).over(ahead)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(behind))
    free = F.coalesce(F.col("passed") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("stop"), F.lit(True))
    return df.where(is_base | free).select("row", "kind", "start", "stop", "token")


def _upper_tail(z: Column) -> Column:
    """P(normal > z), by the logistic form with cubic term (absolute error below 2e-4)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), z * 1.5976 + F.pow(z, 3) * 0.070566)))


def battery(df: DataFrame, token: str = "token") -> DataFrame:
    """Adds ``encoding, n, p_uniform, p_runs, p_serial, p`` to rows with a token; p is null without encoding.

    base64 tokens must hold both cases and a digit, the others a letter of their case and a digit: words are no encoding.
    """
    raw = F.regexp_replace(token, "=+$", "")
    lower, upper = raw.rlike("[a-z]"), raw.rlike("[A-Z]")
    cases = lambda name: lower & upper if name.startswith("base64") else lower if name.endswith("lower") else upper
    names = F.coalesce(*[F.when(raw.rlike(f"^[{letters.replace('-', '')}{'-' if '-' in letters else ''}]+$") & raw.rlike("[0-9]") & cases(name), F.lit(name)) for name, letters in ALPHABETS])
    letters = F.coalesce(*[F.when(F.col("encoding") == name, F.lit(a)) for name, a in ALPHABETS])
    df = df.withColumn("encoding", names).withColumn("letters", letters).withColumn("raw", raw)
    df = df.withColumn("at", F.when(F.col("encoding").isNotNull(), F.transform(F.split("raw", "(?!^)"), lambda c: F.instr(F.col("letters"), c).cast("double"))))
    k, n = F.length("letters").cast("double"), F.size("at").cast("double")
    squares = F.aggregate(F.array_distinct("at"), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter("at", lambda y: y == x)), F.lit(2)))
    chi = squares * k / n - n
    z_uniform = (F.pow(F.greatest(chi, F.lit(1e-9)) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    high = F.size(F.filter("at", lambda x: x > k / 2)).cast("double")
    low = n - high
    pairs = F.zip_with(F.slice("at", F.lit(2), F.size("at")), F.slice("at", F.lit(1), F.size("at") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = F.size(F.filter(pairs, lambda p: (p["a"] > k / 2) != (p["b"] > k / 2))) + 1.0
    expect = 2 * high * low / n + 1
    spread = F.sqrt(F.greatest((expect - 1) * (expect - 2) / (n - 1), F.lit(1e-9)))
    mean = F.aggregate("at", F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate("at", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    serial = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean)) / F.greatest(var, F.lit(1e-9))
    two = lambda z: 2 * _upper_tail(F.abs(z))
    df = df.withColumn("n", F.length("raw")).withColumn("p_uniform", _upper_tail(z_uniform)).withColumn("p_runs", two((runs - expect) / spread)).withColumn("p_serial", two((serial * n + 1) / F.sqrt(n)))
    return df.withColumn("p", F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial"))).drop("letters", "raw", "at")


def thresholds(tokens: DataFrame) -> DataFrame:
    """``(band, floor)`` from rows ``(token, n, p)`` of all tokens: tokens of the band with p above floor are accepted.

    Equal tokens are one test. Every band with a p-value has a floor; it is 1 (none accepted) if no bin is good enough.
    """
    tests = tokens.where("p is not null").select("token", "n", "p").distinct()
    tests = tests.select(F.explode(F.array(_band(), F.lit(ALL))).alias("band"), F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).cast("int").alias("bin"))
    bins = tests.groupBy("band", "bin").agg(F.count("*").alias("m"))
    bins = bins.withColumn("half", F.sum(F.when(F.col("bin") >= BINS // 2, F.col("m")).otherwise(0)).over(W.partitionBy("band")))
    bins = bins.withColumn("accepted", F.sum("m").over(W.partitionBy("band").orderBy(F.desc("bin"))))
    wrong = 1 - 2 * F.col("half") * (1 - F.col("bin") / F.lit(float(BINS))) / F.col("accepted")
    good = (wrong <= FALSE_SHARE) & (F.col("half") > 0)
    floors = bins.groupBy("band").agg((F.coalesce(F.min(F.when(good, F.col("bin"))), F.lit(BINS)) / F.lit(float(BINS))).alias("floor"), F.sum("m").alias("total"))
    floors = floors.withColumn("of_all", F.max(F.when(F.col("band") == ALL, F.col("floor"))).over(W.partitionBy()))  # a row per band
    return floors.where(F.col("band") != ALL).select("band", F.when(F.col("total") < FEW, F.col("of_all")).otherwise(F.col("floor")).alias("floor"))


def _band() -> Column:
    return F.coalesce(*[F.when(F.col("n") >= b, F.lit(b)) for b in reversed(BANDS)], F.lit(0))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``found``, all spans ``(start, kind, stop)`` by start, then kind, and
    ``n_confirmed``, the base spans whose token passes the battery.

    Places are code points, stop exclusive; a null text is empty. Tokens that overlap base spans are no candidates.
    Rows that repeat a doc_id or a text each have their own spans; equal tokens are one test.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marks = F.concat(matches(text, ASSIGN, 0), matches(text, ACCESS, 1), matches(text, HEX, 2), matches(text, TOKEN, 3))
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), marks.alias("marks"))
    df = materialize(df, "marks")
    spans = materialize(placed(df.select("row", F.explode("marks").alias("m")).select("row", "m.*")), "spans")
    tokens = battery(spans).withColumn("band", _band()).where(F.col("p").isNotNull() & (F.col("n") >= BANDS[0]))
    tokens = materialize(tokens.select("row", "kind", "start", "stop", "token", "n", "band", "p"), "battery")
    passed = tokens.join(F.broadcast(thresholds(tokens)), "band").where((F.col("p") > F.col("floor")) & (F.col("p") >= LEAST)).select("row", "kind", "start", "stop")  # a row a band
    told = spans.where("kind < 3").select("row", "kind", "start", "stop", F.lit(0).alias("confirmed")).unionByName(passed.select("*", (F.col("kind") < 3).cast("int").alias("confirmed")))
    told = told.groupBy("row").agg(F.array_sort(F.collect_list(F.when((F.col("kind") == 3) | (F.col("confirmed") == 0), F.struct("start", "kind", "stop")))).alias("found"), F.sum("confirmed").alias("n_confirmed"))
    out = df.select("row", "doc_id").join(told, "row", "left")
    return out.select("doc_id", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,stop:int>>")).alias("found"), F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*[F.lit(k) for k in KINDS])
    is_kind = lambda k: lambda s: s["kind"] == k
    told = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    base = F.filter("found", lambda s: s["kind"] < 3)
    number = [F.size(F.filter(base, is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return df.select("doc_id", *number, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"), "n_confirmed")


def _oracle() -> str:
    """The whole query, battery and thresholds included, from rows of characters instead of arrays."""
    fold = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    assign = "((?:" + "|".join(map(fold, ("password", "passwd", "secret", "token", "api_?key"))) + "))" + r"""[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = (assign, ACCESS, "[0-9a-f]{16,}", "[A-Za-z0-9+/_=-]{20,}")
    found = " UNION ALL ".join(f"SELECT row, {k} AS kind, regexp_extract_all(text, '{p}') AS f, string_split_regex(text, '{p}') AS g FROM d" for k, p in enumerate(patterns))
    cases = lambda n: "lower AND upper" if n.startswith("base64") else "lower" if n.endswith("lower") else "upper"
    letters = " ".join(f"WHEN {cases(n)} AND digit AND translate(raw, '{a}', '') = '' THEN '{a}'" for n, a in ALPHABETS)
    band = " ".join(f"WHEN n >= {b} THEN {b}" for b in reversed(BANDS))
    tail = lambda z: f"1 / (1 + exp(least(700.0, ({z}) * 1.5976 + pow({z}, 3) * 0.070566)))"
    told = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    number = ", ".join(f"coalesce(n_{name}, 0)::BIGINT AS n_{name}" for name in KINDS[:3])
    count = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(KINDS[:3]))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({found}),
u AS (SELECT row, kind, unnest(f) AS found, unnest(g[1:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM m),
s AS (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY row, kind ORDER BY i) AS stop FROM u),
t AS (SELECT row, kind, stop - length(found) AS start, stop, CASE WHEN kind = 0 THEN regexp_extract(found, '{assign}', 2) ELSE found END AS token FROM s),
base AS MATERIALIZED (SELECT * FROM t WHERE kind = 2 OR kind = 0 AND length(token) >= 12 OR kind = 1 AND length(token) >= 18),
free AS (SELECT * FROM t WHERE kind = 3 AND regexp_matches(token, '[0-9]') AND regexp_matches(token, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = t.row AND b.start < t.stop AND b.stop > t.start)),
spans AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM free),
raws AS (SELECT DISTINCT token, regexp_replace(token, '=+$', '') AS raw FROM spans),
marks AS (SELECT *, regexp_matches(raw, '[a-z]') AS lower, regexp_matches(raw, '[A-Z]') AS upper, regexp_matches(raw, '[0-9]') AS digit FROM raws),
known AS MATERIALIZED (SELECT * FROM (SELECT token, raw, length(raw)::DOUBLE AS n, CASE {letters} END AS letters FROM marks) WHERE letters IS NOT NULL AND n >= {BANDS[0]}),
chars AS (SELECT token, n, length(letters)::DOUBLE AS k, letters, unnest(string_split(raw, '')) AS c, unnest(range(1, n::BIGINT + 1)) AS i FROM known),
x AS (SELECT token, n, k, i, instr(letters, c)::DOUBLE AS x FROM chars),
v AS MATERIALIZED (SELECT *, lag(x) OVER (PARTITION BY token ORDER BY i) AS y, avg(x) OVER (PARTITION BY token) AS mean FROM x),
uses AS (SELECT token, sum(m * m)::DOUBLE AS squares FROM (SELECT token, x, count(*) AS m FROM v GROUP BY ALL) GROUP BY token),
sums AS (SELECT token, any_value(n) AS n, any_value(k) AS k, sum((x > k / 2)::INT)::DOUBLE AS high, count(*) FILTER (y IS NOT NULL AND (x > k / 2) <> (y > k / 2)) + 1.0 AS runs,
  sum((x - mean) * (x - mean)) AS var, coalesce(sum((x - mean) * (y - mean)), 0) AS cov FROM v GROUP BY token),
z AS (SELECT token, n, runs, high, 2 * high * (n - high) / n + 1 AS expect, cov / greatest(var, 1e-9) AS serial,
  (pow(greatest(squares * k / n - n, 1e-9) / (k - 1), 1 / 3.0::DOUBLE) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS zu FROM sums JOIN uses USING (token)),
zz AS (SELECT token, n, zu, abs((runs - expect) / sqrt(greatest((expect - 1) * (expect - 2) / (n - 1), 1e-9))) AS zr, abs((serial * n + 1) / sqrt(n)) AS zs FROM z),
tests AS MATERIALIZED (SELECT token, CASE {band} END AS band, least(1.0, 3 * least({tail("zu")}, 2 * {tail("zr")}, 2 * {tail("zs")})) AS p FROM zz),
binned AS (SELECT unnest([band, {ALL}]) AS band, least({BINS - 1}, floor(p * {BINS}))::INT AS bin FROM tests),
bins AS (SELECT band, bin, count(*) AS m FROM binned GROUP BY ALL),
halves AS (SELECT band, sum(m) AS total, coalesce(sum(m) FILTER (bin >= {BINS // 2}), 0) AS half FROM bins GROUP BY band),
shares AS (SELECT band, bin, total, half, 1 - 2 * half * (1 - bin / {float(BINS)}::DOUBLE) / sum(m) OVER (PARTITION BY band ORDER BY bin DESC) AS wrong FROM bins JOIN halves USING (band)),
floors AS (SELECT band, any_value(total) AS total, coalesce(min(bin) FILTER (wrong <= {FALSE_SHARE} AND half > 0), {BINS}) / {float(BINS)}::DOUBLE AS floor FROM shares GROUP BY band),
level AS (SELECT band, CASE WHEN total < {FEW} THEN (SELECT floor FROM floors WHERE band = {ALL}) ELSE floor END AS floor FROM floors WHERE band <> {ALL}),
passed AS (SELECT token FROM tests JOIN level USING (band) WHERE p > floor AND p >= {LEAST}),
kept AS (SELECT *, {list(KINDS)}[kind + 1] AS name, token IN (SELECT token FROM passed) AS ok FROM spans),
told AS (SELECT row, {count}, {told} FILTER (kind < 3) AS base, {told} FILTER (kind < 3 OR ok) AS spans, count(*) FILTER (kind < 3 AND ok) AS confirmed FROM kept GROUP BY row)
SELECT doc_id, {number}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(confirmed, 0)::BIGINT AS n_confirmed
FROM d LEFT JOIN told USING (row)
"""


ORACLE = _oracle()
