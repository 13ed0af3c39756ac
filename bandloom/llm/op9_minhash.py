"""Near-duplicate documents: bottom-k sketches from one hash function.

Inverted lists of retained values generate overlaps, the sketch of the union filters them, and exact
Jaccard similarity of the full shingle sets confirms them.

* Texts with equal word sequences form one class, so copies are never paired with each other.
* A class's sketch is the ``k`` least hashes of its shingles. Classes that are ``similarity`` alike share at
  least half of a sketch, but for a chance below 1e-5 at k = 64. So a class needs only its rarest
  ``k/2 + 1`` retained values as list entries (the prefix filter); values that only one class retains
  count as entries but need no list. What many texts share is frequent and seldom enters a prefix.
  What this and the sketches of unions miss costs no link: the last step is exact.
* Each list has a hub, its member whose retained values are the most frequent ones: the most central of the
  copies. All members are tested against their hubs, as a star. So a group of n near copies costs about n tests.
* A longer sketch, in proportion to the set, finds every class that may still have a link to another component
  (``_open``). With s values, of which alike sets of at least that size miss m at most, the l-th least value in common
  is among the m + l least of both sets. So of the m + s/12 + 1 least values of a class about a fifth must occur
  in such sketches of other components, or it has no link there. A shared line or passage is no such fifth of a long text.
* These classes are searched again, by their full sets and for links
  between components only (``_between``). The values are ordered by how many of these texts hold them, those
  of a single component first; alike texts then share one of the first quarter of their values, and the smaller of two
  one of its first seventh. A passage that many otherwise different texts share comes last in that order, so
  that such a group yields lists without pairs, whatever its size. Lists are dealt in chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import HOT_KEYS, WordHashes, ascii_words, bounded, counted_join, materialize, pieces, scratch, shingle_set

#: A class shows one value in EXTRA more than the least common one needs: see _open.
EXTRA = 12
#: Members that are verified against one hub in one group.
CHUNK = 64
#: Members of a list that meet in one key of a join.
DEALT = 1024
#: Keys of lists or hubs that may be broadcast; of more only the hot ones are.
HELD = 100_000
#: Ids that may be broadcast to pick texts for the exact check; more are joined by a shuffle.
PICKED = 1_000_000


def _shown(size: int, percent: int) -> int:
    """How many of its least values a set of ``size`` shows in the search for links that sketches missed."""
    return size * (100 - percent) // 100 + size // EXTRA + 1


def _sketches(k: int, n: int, percent: int):
    def run(batches):
        table = WordHashes()
        for b in pieces(batches):
            nodes, sizes, least = [], [], []
            for text in b.column(1).to_pylist():
                words = ascii_words(text)
                full = shingle_set(table.array(words), n)
                nodes.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sizes.append(len(full))
                least.append(full[: max(k, _shown(len(full), percent))].copy())  # a view would keep the whole set
            ends = np.cumsum([0, *map(len, least)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *least])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                ["doc_id", "node", "size", "least"],
            )

    return run


def _sets(n: int):
    """The shingle set of each text by its node."""

    def run(batches):
        table = WordHashes()
        for b in pieces(batches):
            for text in b.column(0).to_pylist():
                if words := ascii_words(text):
                    full = pa.array([shingle_set(table.array(words), n)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(b" ".join(words))], pa.binary()), full], ["node", "full"])

    return run


def _confirm(percent: int):
    def run(group: pa.Table) -> pa.Table:
        hub = group.column("hub_full").combine_chunks().drop_null()[0].values.to_numpy()
        keep = []
        for i, one in enumerate(group.column("full").combine_chunks()):
            if one.is_valid:
                other = one.values.to_numpy()
                both = len(np.intersect1d(hub, other, assume_unique=True))
                if 100 * both >= percent * (len(hub) + len(other) - both):
                    keep.append(i)
        return group.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


def _full_sets(wanted: DataFrame, docs: DataFrame, cands: DataFrame, n: int) -> DataFrame:
    """``(rid, full)`` of the classes ``wanted(rid)``, from one text of each."""
    wanted = materialize(wanted.join(cands, "rid").select("rid", "doc_id", "node"), "wanted")
    texts = docs.join(bounded(wanted.select("doc_id").distinct(), PICKED), "doc_id", "left_semi").select("text")
    made = texts.mapInArrow(_sets(n), "node binary, full array<long>")
    return materialize(made.join(bounded(wanted, PICKED), "node").groupBy("rid").agg(F.first("full").alias("full")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose full sets are alike; the set of u is sent once per CHUNK pairs."""
    chunks = pairs.groupBy("u").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    dealt = pairs.join(bounded(chunks, PICKED), "u", "left").withColumn("chunk", F.pmod(F.xxhash64("v"), F.coalesce("chunks", F.lit(1))).cast("int"))
    none = F.lit(None).cast("array<long>")
    members = dealt.join(sets, F.col("v") == F.col("rid")).select("u", "chunk", "v", "full", none.alias("hub_full"))
    hubs = (
        dealt.select("u", "chunk").distinct().join(sets, F.col("u") == F.col("rid"))
        .select("u", "chunk", F.col("u").alias("v"), none.alias("full"), F.col("full").alias("hub_full"))
    )
    return members.unionByName(hubs).groupBy("u", "chunk").applyInArrow(_confirm(percent), "u long, v long")


def _open(placed: DataFrame, percent: int) -> DataFrame:
    """``(rid, root)`` of the classes ``placed(rid, root, size, least)`` that may be alike to one of another root.

    Sets of a >= b values that are alike share at least b' = ceil(percent * a / 100) of them, and b >= b'. Each misses a share of
    (100 - percent) / 100 of its own values at most, so the first b' / EXTRA + 1 values in common are among those shown by both.
    """
    shown = F.expr(f"cast(size * {100 - percent} div 100 + size div {EXTRA} + 1 as int)")
    values = placed.select("rid", "root", F.explode(F.slice("least", F.lit(1), shown)).alias("value"))
    mixed = values.groupBy("value").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    mixed = materialize(mixed.select("value", "n"), "met")
    met = counted_join(values.select("rid", "value"), mixed, "value", "n", "left_semi", HELD).groupBy("rid").agg(F.count("*").alias("met"))
    need = f"met > (size * {percent} + 99) div 100 div {EXTRA}"
    return met.join(placed.select("rid", "root", "size"), "rid").where(need).select("rid", "root")


def _between(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of ``apart(rid, root)`` of different roots that may be alike, by prefixes of ``sets(rid, full)``.

    Two sets are alike if they share ceil(percent * (a + b) / (100 + percent)) values. So the first value they share, in
    one order of all values, has at least that many values from it on in both; the smaller set is ``early`` there.
    """
    known = sets.join(apart, "rid").withColumn("size", F.size("full"))
    values = known.select("rid", "root", F.explode("full").alias("value"))
    # Values of one root come first and need no list; then the rarest.
    mixed = values.groupBy("value").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    mixed = materialize(mixed.select("value", "n"), "mixed")
    many = counted_join(values.select("rid", "value"), mixed, "value", "n", held=HELD).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("many"))
    rows = many.join(known.drop("full"), "rid").withColumn("own", F.col("size") - F.size("many"))
    need = F.expr(f"size - cast(ceil(size * {percent} / 100.0D) as int) + 1 - own")
    rows = rows.withColumn("need", need).where("need > 0").select("rid", "root", "size", "own", F.posexplode(F.slice("many.value", F.lit(1), F.col("need"))).alias("at", "value"))
    early = F.expr(f"(size - own - at) * {100 + percent} >= size * {2 * percent}")
    lists = materialize(rows.select("rid", "root", "size", (F.col("own") + F.col("at")).alias("pos"), "value", early.alias("early")), "lists")
    # In a list whose most frequent root is ``most``, all pairs of two roots have a member of another one.
    roots = lists.groupBy("value", "root").agg(F.count("*").alias("n"), F.max("early").alias("early"))
    kinds = roots.groupBy("value").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.max("n").alias("n_most"), F.sum("n").alias("n"), F.count("*").alias("roots"), F.max("early").alias("early"))
    kinds = materialize(kinds.where("roots > 1 and early").select("value", "most", "n_most", "n"), "kinds")
    lists = counted_join(lists, kinds.withColumn("members", F.col("n")), "value", "members", held=HELD)
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / DEALT)).cast("int")
    all_, most, others = F.col("n"), F.col("n_most"), F.col("n") - F.col("n_most")
    other = F.col("root") != F.col("most")

    def side(name: str, rows: DataFrame, kind: int, own: Column, facing: Column, first: bool) -> DataFrame:
        mine, theirs = F.pmod(F.xxhash64("rid"), chunks(own)).cast("int"), F.explode(F.sequence(F.lit(0), chunks(facing) - 1))
        i, j = (mine.alias("i"), theirs.alias("j")) if first else (theirs.alias("i"), mine.alias("j"))
        return rows.select("value", F.lit(kind).alias("kind"), i, j, F.struct("rid", "root", "size", "pos").alias(name))

    larger = side("a", lists.where(other), 0, others, all_, True).unionByName(side("a", lists.where(~other), 1, most, others, True))
    smaller = lists.where("early")
    smaller = side("b", smaller, 0, all_, others, False).unionByName(side("b", smaller.where(other), 1, others, most, False))
    pairs = larger.join(smaller, ["value", "kind", "i", "j"]).where(
        f"""a.root <> b.root and (a.size > b.size or a.size = b.size and a.rid < b.rid) and 100L * b.size >= {percent} * a.size
        and {100 + percent} * least(a.size - a.pos, b.size - b.pos) >= {percent} * (a.size + b.size)"""
    )
    return pairs.select(F.least("a.rid", "b.rid").alias("u"), F.greatest("a.rid", "b.rid").alias("v")).distinct()


def _alike(k: int, similarity: float) -> str:
    """Whether sketches of a and b may belong to alike sets: by size, and by what tells the union's sketch.

    Up to the least end of a cut sketch both sketches are whole, so there their union is a random sample of the
    sets' union. It is given 4.5 standard deviations, and none if both sets are whole.
    """
    end = lambda x: f"if({x}.size > {k}, element_at({x}.sketch, -1), 9223372036854775807)"
    till = lambda v: f"size(filter({v}, x -> x <= least({end('a')}, {end('b')})))"
    both = till(f"array_intersect(a.sketch, b.sketch)")
    least = f"if(greatest(a.size, b.size) <= {k}, {similarity}D, {similarity - 4.5 * (similarity * (1 - similarity) / k) ** 0.5}D)"
    return (
        f"least(a.size, b.size) >= {similarity}D * greatest(a.size, b.size) AND "
        f"{both} * (1 + {least}) >= {least} * ({till(f'a.sketch')} + {till(f'b.sketch')}) - 1e-9D"
    )


def _told_alike(pairs: DataFrame, cands: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (u, v) that the sketches of their union do not rule out."""
    side = lambda name: cands.select(F.col("rid").alias(f"{name}_rid"), F.struct("size", "sketch").alias(name))
    hubs = materialize(pairs.groupBy("u").agg(F.count("*").alias("n")).join(side("a"), F.col("u") == F.col("a_rid")).select("u", "a", "n"), "told")
    both = counted_join(pairs, hubs, "u", "n", held=HOT_KEYS).join(side("b"), F.col("v") == F.col("b_rid"))
    return both.where(_alike(k, similarity)).select("u", "v")


def _sketch_links(docs: DataFrame, sketched: DataFrame, k: int, n: int, similarity: float) -> DataFrame:
    """The links (u, v) between classes ``sketched(rid, node, doc_id, size, sketch)`` that sketches find, verified."""
    entries = sketched.select("rid", F.explode("sketch").alias("value"))
    shared = materialize(entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    many = counted_join(entries, shared, "value", "df", held=HELD).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("many"), F.sum(F.log2("df")).alias("central"))
    # The rarest values come first: those of one class, then by (df, value); half the sketch and one are needed.
    held = sketched.select("rid", F.least(F.col("size"), F.lit(k)).cast("int").alias("held"))
    need = F.col("held") - F.ceil(F.col("held") / 2).cast("int") + 1 - (F.col("held") - F.size("many"))
    first = materialize(many.join(held, "rid").withColumn("need", need).where("need > 0").select("rid", "central", F.slice("many.value", F.lit(1), F.col("need")).alias("values")), "prefixes")
    lists = first.select("rid", "central", F.explode("values").alias("value"))
    hubs = lists.groupBy("value").agg(F.max_by("rid", F.struct("central", "rid")).alias("u"), F.count("*").alias("n")).where("n > 1")
    hubs = materialize(hubs, "hubs")
    stars = materialize(counted_join(lists, hubs, "value", "n", held=HELD).where("rid <> u").select("u", F.col("rid").alias("v")).distinct(), "stars")
    cands = materialize(sketched.join(bounded(first.select("rid"), PICKED), "rid"), "candidates")
    near = materialize(_told_alike(stars, cands, k, similarity), "near")
    sets = _full_sets(near.select(F.explode(F.array("u", "v")).alias("rid")).distinct(), docs, sketched, n)
    return _verified(near, sets, round(similarity * 100))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 64, shingle: int = 5, similarity: float = 0.75) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    component_id is the least doc_id that confirmed links reach. A null or wordless text has no shingles
    and is a component of its own. A row without doc_id takes no part: its component_id is null and it is
    kept. Rows that repeat a doc_id each get the component of their text. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    percent = round(similarity * 100)
    base = materialize(docs.mapInArrow(_sketches(k, shingle, percent), "doc_id long, node binary, size long, least array<long>"), "sketches")
    reps = base.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("least").alias("least"))
    # The number of a class is fixed once the table is written.
    reps = materialize(reps.withColumn("rid", F.monotonically_increasing_id()), "classes")
    sketched = reps.withColumn("sketch", F.slice("least", 1, k)).drop("least")
    with scratch(docs.sparkSession):
        links = materialize(_sketch_links(docs, sketched, k, shingle, similarity), "links", keep=True)
    with scratch(docs.sparkSession):
        roots = materialize(components(links).withColumnRenamed("node", "rid"), "roots")
        placed = reps.select("rid", "size", "least").join(bounded(roots, PICKED), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        with scratch(docs.sparkSession):
            apart = materialize(_open(placed, percent), "apart", keep=True)
        sets = _full_sets(apart.select("rid"), docs, sketched, shingle)
        with scratch(docs.sparkSession):
            rest = materialize(_between(apart, sets, percent), "rest", keep=True)
        roots = materialize(components(links.unionByName(_verified(rest, sets, percent))).withColumnRenamed("node", "rid"), "components", keep=True)
    named = reps.select("rid", "node", "doc_id").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id")
    out = base.select("doc_id", "size", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    out = out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but for those of which another document of their group stays.

    Rows that repeat the doc_id that stays stay with it.
    """
    with scratch(docs.sparkSession):
        gone = materialize(near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct(), "dropped", keep=True)
    return docs.join(bounded(gone, PICKED), id_col, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: All pairs that share a shingle are counted, so this is for small tables.
ORACLE = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
starts AS (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS x FROM starts),
sizes AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
both_have AS (SELECT a.rid AS u, b.rid AS v, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.rid <> b.rid GROUP BY ALL),
linked AS MATERIALIZED (SELECT u, v FROM both_have JOIN sizes a ON a.rid = u JOIN sizes b ON b.rid = v WHERE 100 * m >= 75 * (a.n + b.n - m)),
reached(rid, node) AS (SELECT rid, rid FROM d UNION SELECT reached.rid, v FROM reached JOIN linked ON u = node),
least AS (SELECT reached.rid, min(doc_id) AS component_id FROM reached JOIN d ON d.rid = node GROUP BY reached.rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least USING (rid) LEFT JOIN sizes USING (rid)
"""
