"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words are hashed, every GRAM consecutive ones to a rolling hash (a polynomial of the words' hashes modulo
a prime, worked out for all positions by doubling); of each WINDOW consecutive hashes the least is kept, the rightmost of equal ones, with its position. So two texts that share GRAM + WINDOW - 1 words in
a row share a fingerprint. A word longer than PIECE characters counts as all pieces of PIECE characters in it, one
from each position, so unspaced texts that share PIECE + GRAM + WINDOW - 2 characters in a row share one too.

Hash and position are one number: hash in the upper bits, the position counted down in the lower ones. The least
number is then the least hash with the rightmost position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.staging import shuffle_width

#: Words of a gram (a power of two) and hashes of a window (a power of two); characters of a long word's pieces.
GRAM, WINDOW, PIECE = 4, 8, 16
#: Bits of the position, which starts anew after 2**28 words; the hash has the 35 others below the sign.
PLACE_BITS = 28
#: The rolling hash's modulus, the greatest prime below 2**35, and its base: base**2 times a hash stays below 2**63.
PRIME, BASE = 2**35 - 31, 8191
#: Groups of neighbouring doc_ids for each shuffle partition.
GROUPS = 8


def _shifted(values: F.Column, by: int) -> F.Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _folded(values: F.Column, by: int, f) -> F.Column:
    """f of each element and the one ``by`` places on, as many as there are."""
    n = F.greatest(F.size(values) - by, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), _shifted(values, by), f)


def _rolled(step: int):
    """The hash of two runs of words one after the other, the second ``step`` words long."""
    return lambda a, b: (a * F.lit(BASE**step) + b) % F.lit(PRIME)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` and an array column ``name``: the kept numbers of column ``text``, by position; a null text counts as empty.

    Each step has a column of its own, so that none is computed twice.
    """
    c = F.col
    words = F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    pieces = lambda w: F.regexp_extract_all(w, F.lit(rf"(?s)(?=(.{{{PIECE}}}))."), F.lit(1))
    each = F.flatten(F.transform("_h", lambda w: F.when(F.length(w) > PIECE, pieces(w)).otherwise(F.array(w))))
    out = df.withColumn("_h", words).withColumn("_h", F.when(F.exists("_h", lambda w: F.length(w) > PIECE), each).otherwise(c("_h")))
    out = out.withColumn("_h", F.transform("_h", lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))
    step = 1
    while step < GRAM:
        folded = _folded(c("_h"), step, _rolled(step))
        # fewer words than a gram has: all of them are one gram
        out = out.withColumn("_h", F.when(F.size("_h") > step, folded).when(F.size("_h") > 1, F.array(F.pmod(F.xxhash64(c("_h")), F.lit(PRIME)))).otherwise(c("_h")))
        step *= 2
    last = (1 << PLACE_BITS) - 1
    number = F.transform(c("_h"), lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR((F.lit(last) - i).cast("long").bitwiseAND(F.lit(last).cast("long"))))
    out = out.withColumn("_h", number)
    step = 1
    while step < WINDOW:
        folded = _folded(c("_h"), step, lambda a, b: F.least(a, b))
        out = out.withColumn("_h", F.when(F.size("_h") > step, folded).when(F.size("_h") > 1, F.array(F.array_min("_h"))).otherwise(c("_h")))
        step *= 2
    return out.withColumn(name, F.array_distinct("_h")).drop("_h")


def hashes(kept: F.Column) -> F.Column:
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, PLACE_BITS)))


def likeness(a: F.Column, b: F.Column) -> F.Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def as_string(kept: F.Column) -> F.Column:
    """Kept numbers as text: equal texts have equal strings, and hash and position can be told from each."""
    return F.array_join(kept.cast("array<string>"), " ")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, hashes): each row's kept numbers and their distinct hashes."""
    out = with_fingerprint(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", "fingerprint")
    return out.select("doc_id", "fingerprint", hashes(F.col("fingerprint")).alias("hashes"))


def _group(cuts: list[int], parts: int) -> F.Column:
    """The number of the group that a row belongs to, ``cuts`` falling: group 0 has the greatest ids.

    A binary search in the cuts, one literal. Null ids come last, in ``parts`` groups by hash of the text.
    """
    found = F.lit(0)
    if cuts:
        listed, n, steps = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>"), len(cuts), []
        while (1 << len(steps)) <= n:
            steps.append(1 << len(steps))
        doc = F.col("doc_id")
        ahead = lambda at, step: F.coalesce(F.get(listed, at + step - 1) >= doc, F.lit(False))
        found = F.aggregate(F.array(*map(F.lit, reversed(steps))), F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))
    # the hash's upper bits in its order
    place = F.shiftright(F.xxhash64("text"), 40) + (1 << 23)
    return F.when(F.col("doc_id").isNull(), len(cuts) + F.shiftright(place * parts, 24).cast("int")).otherwise(found).cast("int")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` fingerprinted beside its edited text and the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The edited text
    has its last floor(n_chars / 2) characters replaced by the first as many of the next document by descending
    doc_id; the first follows the last. Null doc_ids come last, rows with one doc_id follow each other by hash of
    the text. A null text is empty; an only row is its own next; texts of any length are read whole. Other columns
    are ignored. An empty table gives an empty table.

    The documents are dealt to groups of neighbouring ids, each group having the next group's first row too, so
    one shuffle brings every text to the one before it, and no task sees more than its groups.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    key = F.struct(F.coalesce((-F.col("doc_id").cast("decimal(20,0)")), F.lit(str(10**19)).cast("decimal(20,0)")).alias("down"), F.xxhash64("text").alias("tie"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / (GROUPS * width) for i in range(1, GROUPS * width)], 20 * GROUPS * width).alias("c")).first()["c"] or []
    group = _group(sorted(set(cuts), reverse=True), GROUPS * width)
    rows = rows.withColumns({"group": group, "key": key})
    first = rows.groupBy("group").agg(F.min("key").alias("first"))
    before = F.lag("group").over(Window.orderBy("group"))
    ends = first.select("group", "first", F.coalesce(before, F.max("group").over(Window.partitionBy())).alias("before"))
    # one row per group, as many as there are cuts: a bounded table
    begun = rows.join(F.broadcast(ends), "group")
    leads = begun.withColumn("lead", F.col("key") == F.col("first"))
    dealt = leads.select(
        "doc_id",
        "text",
        "key",
        F.explode(
            F.when(F.col("lead"), F.array(F.struct(F.col("group").alias("to"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("to"), F.lit(True).alias("guest")))).otherwise(
                F.array(F.struct(F.col("group").alias("to"), F.lit(False).alias("guest")))
            )
        ).alias("deal"),
    ).select("doc_id", "text", "key", "deal.to", "deal.guest")
    marked = with_fingerprint(dealt.repartition(width, "to"), "text", "fingerprint")
    order = Window.partitionBy("to").orderBy("guest", "key")
    pairs = marked.select("doc_id", "text", "guest", "fingerprint", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint")).where("not guest")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = with_fingerprint(edited.drop("text", "next_text"), "edited", "edited_fingerprint")
    out = both.withColumns({"a": hashes(F.col("fingerprint")), "b": hashes(F.col("edited_fingerprint")), "c": hashes(F.col("next_fingerprint"))})
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("fingerprint")).alias("fingerprint"),
        as_string(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
