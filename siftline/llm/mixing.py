"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled queue. A document's virtual finish time is its source's cumulative
tokens up to its end, divided by the source's target; a second copy follows when the whole queue has passed once.
All turns are range-sorted by finish time and cut where their running total reaches the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.staging import fresh, shuffle_width, staged

#: A word, and how often the sources' weights repeat.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Documents of one bucket of the shuffle order, about; sums run over buckets first, then inside them.
BUCKET_DOCS = 1 << 11


def _big(c) -> F.Column:
    return c.cast("decimal(38,0)")


def source_targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(key, nth, source_size, target, whole): each source's words and target, ``sizes`` having (key, size).

    Sources sorted by code point, null last, weigh ``weights`` in turn and share 150 % of all words by weight; a
    target stops at twice its source's words, what is over being shared anew. One row per source is sorted in one
    task: a few hundred bytes for each of what may be millions of sources.
    """
    total = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    each = total.withColumns({"nth": number.cast("long"), "weight": weight})
    # sources in the order in which a rising share per weight reaches their limits
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    each = each.withColumns(
        {
            "left": 3 * _big(F.sum("source_size").over(Window.partitionBy())) - 4 * F.coalesce(_big(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1))), _big(F.lit(0))),
            "heavy": _big(F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))),
        }
    )
    each = each.withColumn("open", 4 * _big(F.col("source_size")) * F.col("heavy") >= F.col("weight") * F.col("left"))
    # the first source that isn't at its limit sets the share of all others that are not
    first = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "key", "left", "heavy"))).over(Window.partitionBy())
    each = each.withColumn("first", first)
    share = F.col("weight") * F.col("first.left")
    limit = F.struct(F.col("source_size") / F.col("weight"), F.col("key")) < F.struct(F.col("first.col1"), F.col("first.key"))
    capped = F.col("first").isNull() | limit
    return each.select(
        "key",
        "nth",
        "source_size",
        F.when(capped, (2 * F.col("source_size")).cast("double")).otherwise(share.cast("double") / (2 * F.col("first.heavy")).cast("double")).alias("target"),
        F.when(capped, 2 * F.col("source_size")).otherwise(F.floor(share / (2 * F.col("first.heavy"))).cast("long")).alias("whole"),
    )


def _place(docs: DataFrame) -> F.Column:
    """Where a document stands in the shuffle: the MD5 of its doc_id, source and text."""
    part = lambda c: F.coalesce(docs[c].cast("string"), F.lit("null"))
    return F.md5(F.concat(part("doc_id"), F.lit(":"), part("source"), F.lit(":"), F.coalesce(docs["text"].cast("string"), F.lit(""))).cast("binary"))


def queued(docs: DataFrame) -> DataFrame:
    """(doc_id, size, nth, source_size, target, whole, before) for each row of ``docs(doc_id, text, source)``.

    nth is the source's number; ``before`` is what the source's queue holds before the document. The queue's
    order is that of ``_place``. Running sums go over buckets of that order, then inside each bucket, so
    no task sees a whole source.
    """
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digits = 1
    many = docs.count()
    while 16**digits * BUCKET_DOCS < many:
        digits += 1
    sized = staged(docs.select("doc_id", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _place(docs).alias("place")))
    sized = sized.withColumn("bucket", F.substring("place", 1, digits))
    inside = Window.partitionBy("key", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = sized.groupBy("key", "bucket").agg(F.sum("size").alias("held"))
    running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = buckets.select("key", "bucket", (F.sum("held").over(running) - F.col("held")).alias("ahead"))
    targets = source_targets(buckets.select("key", F.col("held").alias("size")))
    ranked = sized.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    return ranked.join(ahead.join(targets, "key"), ["key", "bucket"]).select("doc_id", "place", "size", "nth", "source_size", "target", "whole", (F.col("ahead") + F.col("inside")).alias("before"))


def served(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, entries): the mix as entries in the order of virtual finish time, cut at the total budget.

    An entry is a document's turn: (doc_id, place, nth, before, copy, words, finish, taken). Its finish time is
    its source's cumulative words, up to its end, divided by the source's target; a second copy's turn comes when
    the queue has passed once. The turn under way at time 1, when each source has had its target, is two
    entries: what is served by then, finishing at 1, and the rest. Entries are range-sorted by finish time; sums
    are taken for each range, then inside it, and the running total of words is cut at the budget, 150 % of all
    words: what lies before the cut is taken.
    """
    queue = staged(queued(docs))
    budget = queue.agg(F.coalesce(F.floor(3 * _big(F.sum("size")) / 2), F.lit(0)).cast("long")).first()[0]
    size, target = F.col("size"), F.col("target")
    turn = lambda start, copy: F.struct(start.alias("start"), F.lit(copy).alias("copy"))
    turns = queue.where("size > 0").withColumn("turn", F.explode(F.array(turn(F.col("before"), 1), turn(F.col("before") + F.col("source_size"), 2))))
    start = F.col("turn.start")
    by_time = F.greatest(F.lit(0).cast("long"), F.least(size, F.col("whole") - start))
    end = (start + size) / target
    part = lambda words, finish: F.struct(words.alias("words"), finish.alias("finish"))
    parts = turns.withColumn("part", F.explode(F.array(part(by_time, F.least(end, F.lit(1.0))), part(size - by_time, end)))).where("part.words > 0")
    columns = ("doc_id", "place", "nth", "before", "size", "source_size", "target", F.col("turn.copy").alias("copy"), "part.words", "part.finish")
    order = ("finish", "nth", "before", "copy")
    ranged = parts.select(*columns).repartitionByRange(shuffle_width(docs.sparkSession), *order).withColumn("range", F.spark_partition_id())
    entries = staged(ranged.sortWithinPartitions(*order))
    # one row per range
    held = entries.groupBy("range").agg(F.sum("words").alias("held"))
    running = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = held.select("range", (F.sum("held").over(running) - F.col("held")).alias("ahead"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = entries.withColumn("inside", F.sum("words").over(inside) - F.col("words")).join(F.broadcast(ahead), "range")
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), budget - F.col("ahead") - F.col("inside")))
    return queue, placed.withColumn("taken", taken).where("taken > 0").drop("range", "inside", "ahead")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs(doc_id, text, source)``, other columns being ignored.

    size counts the whole text's words (null and empty: 0); taken, the words that the mix holds of the document,
    both copies together, at most twice its size. A source's taken words are its target but for less than one word
    for each source. A null source is a source of its own, the last one. Repeated rows each take their turn; rows
    that agree in doc_id and text may change places. An empty table gives an empty table.
    """
    queue, entries = served(docs)
    sums = entries.groupBy("doc_id", "size", "source_size", "target", "nth", "before").agg(F.sum("taken").alias("taken"))
    # a row that gets nothing has no entry before the cut: it comes back with 0
    nothing = queue.select("doc_id", "size", "source_size", "target", "nth", "before", F.lit(0).cast("long").alias("taken"))
    idle = nothing.where("size = 0").select("doc_id", "size", "source_size", "target", "taken")
    both = sums.union(nothing.where("size > 0").select(*sums.columns)).groupBy("doc_id", "size", "source_size", "target", "nth", "before").agg(F.sum("taken").alias("taken"))
    return both.select("doc_id", "size", "source_size", "target", "taken").union(idle)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: ``docs``' rows, each as often as it is served, in the order of virtual finish time.

    The turns are those of ``served``, cut at the same budget. Documents are served whole here: a turn is in if half
    of its words or more lie before the cut, and stands where its last taken word does. Null and empty texts, and
    documents of white space only, are left out; repeated rows and rows with a null doc_id take their turns like
    others. Columns of any name are carried. An empty table gives an empty table.
    """
    place, rank, turns, finish = (fresh(n, docs) for n in ("place", "rank", "turns", "finish"))
    _, entries = served(docs)
    each = entries.groupBy("place", "before", "copy", "size").agg(F.sum("taken").alias("taken"), F.max("finish").alias("finish")).where("2 * taken >= size")
    # rows alike in doc_id, source and text have one place: each of them takes the turns of one position in the queue
    position = each.groupBy("place", "before").agg(F.collect_list("finish").alias("finish"))
    listed = position.groupBy(F.col("place").alias(place)).agg(F.sort_array(F.collect_list(F.struct("before", "finish"))).alias(turns))
    joined = docs.withColumn(place, _place(docs)).join(listed, place)
    ranked = joined.withColumn(rank, F.row_number().over(Window.partitionBy(place).orderBy(F.lit(1))))
    timed = ranked.withColumn(finish, F.explode(F.get(F.col(turns), F.col(rank) - 1)["finish"]))
    order = [F.col(finish), F.col(place)]
    return timed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


#: The same in DuckDB's SQL.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(source, 'null') || ':' || coalesce(text, '')) AS place
  FROM documents
), totals AS (
  SELECT source, sum(size)::HUGEINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM sized GROUP BY source
), weighed AS (
  SELECT source, s, number, CASE number % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM totals
), filled AS (
  SELECT *, row_number() OVER (ORDER BY s / w, number) AS nth,
         3 * sum(s) OVER () - 4 * coalesce(sum(s) OVER (ORDER BY s / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
         sum(w) OVER (ORDER BY s / w, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM weighed
), opened AS (
  SELECT min(nth) AS nth FROM filled WHERE 4 * s * heavy >= w * remain
), targets AS (
  SELECT f.source, f.number, f.s::BIGINT AS source_size,
         CASE WHEN o.nth IS NULL OR f.nth < o.nth THEN (2 * f.s)::DOUBLE ELSE (f.w * g.remain)::DOUBLE / (2 * g.heavy)::DOUBLE END AS target,
         CASE WHEN o.nth IS NULL OR f.nth < o.nth THEN 2 * f.s ELSE (f.w * g.remain)::HUGEINT // (2 * g.heavy)::HUGEINT END::BIGINT AS whole
  FROM filled f CROSS JOIN opened o LEFT JOIN filled g ON g.nth = o.nth
), queued AS (
  SELECT z.*, t.number, t.source_size, t.target, t.whole, row_number() OVER () AS id,
         (sum(size) OVER (PARTITION BY z.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source
), turns AS (
  SELECT *, 1 AS copy, before AS start FROM queued WHERE size > 0 UNION ALL SELECT *, 2, before + source_size FROM queued WHERE size > 0
), timed AS (
  SELECT *, greatest(0, least(size, whole - start)) AS by_time, (start + size)::DOUBLE / target AS finish_all FROM turns
), parts AS (
  SELECT *, by_time AS words, least(finish_all, 1.0::DOUBLE) AS finish FROM timed WHERE by_time > 0
  UNION ALL SELECT *, size - by_time, finish_all FROM timed WHERE size > by_time
), summed AS (
  SELECT *, sum(words) OVER (ORDER BY finish, number, before, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS ahead FROM parts
), cut AS (
  SELECT id, sum(greatest(0, least(words, (SELECT sum(size) * 3 // 2 FROM sized) - ahead)))::BIGINT AS taken FROM summed GROUP BY id
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(c.taken, 0) AS taken FROM queued q LEFT JOIN cut c USING (id)
"""
