"""N-gram Jaccard join by vertical partitioning.

The global order of word n-grams is cut into fragments. First every fragment counts, for each document, how many
of its n-grams another document has too: the partial counts' sum bounds any overlap, and most documents can't
link with any other by it. The others' sets are ordered from rare to frequent; documents that share none of
their first n-grams can't link either. Pairs that remain are counted fragment by fragment, and the partial
overlaps are summed per pair.

Exact copies are one class from the beginning. Links are looked for in two rounds: each rare n-gram's documents
against its fullest one, then what these links have left unconnected. A frequent n-gram's documents are dealt in
blocks of bounded size, and pairs that are connected already are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.components import components
from siftline.llm.sharedkeys import shared_counts
from siftline.llm.staging import fresh, shuffle_width, staged
from siftline.llm.wordkeys import Words, mix, shingles, slices

#: Members of an n-gram's list that are compared inside one row; buckets of the overlap bound; fragments of a pair's sets.
BLOCK, BUCKETS, SEGMENTS = 256, 32, 4
#: Ids up to this number (16 MB) go to every executor; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    text = batch.column(batch.schema.get_field_index("text"))
    for a, b in slices(text):
        words = Words(text.slice(a, b - a))
        yield batch.slice(a, b - a), shingles(words, words.hashes(), k)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one = np.array([int(mix(s).sum()) & (2**64 - 1) if len(s) else 0 for s in sets], np.uint64)
    two = np.array([int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()) & (2**64 - 1) if len(s) else 0 for s in sets], np.uint64)
    return one.view(np.int64), two.view(np.int64)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, a, b): the size and a 128-bit digest of each document's set of k-word shingles."""

    def run(batches):
        for batch in batches:
            for part, sets in _sets(batch, k):
                one, two = _digests(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two)], names=["doc_id", "n", "a", "b"])

    return docs.mapInArrow(run, "doc_id long, n long, a long, b long")


def _near(table: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """An inner join that sends ``ids`` to every executor only where they are few."""
    return table.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on)


def _candidates(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, doc, n, a, b) of the classes (with copies, their number of rows) so much of whose set occurs elsewhere that a link is possible.

    node is a number of the class's own: one doc_id may have several classes.
    """

    def keys_of(batch):
        for _, sets in _sets(batch, k):
            one, _ = _digests(sets)
            size = [len(s) for s in sets]
            yield np.repeat(one, size), np.concatenate(sets)

    found = shared_counts(docs.where("doc_id is not null").select("text"), keys_of)
    total = found.select(F.col("owner").alias("a"), F.col("n").alias("shared"))
    # each copy has counted its shingles
    enough = 100 * F.col("shared") >= percent * F.col("n") * F.col("copies")
    able = classes.join(total, "a").where(enough)
    return staged(able.select(F.monotonically_increasing_id().alias("node"), "doc", "n", "a", "b"))


def _ordered_sets(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, n, shared, firsts, bound, segments) of each candidate: its shared shingles only, rare ones first.

    firsts: as many as two linked documents must have one of in common. bound: counts by hash range.
    """

    def keys(batches):
        for batch in batches:
            for part, sets in _sets(batch, k):
                one, two = _digests(sets)
                own = (one == part.column("a").to_numpy()) & (two == part.column("b").to_numpy())
                part = part.filter(pa.array(own))
                sets = [s for s, x in zip(sets, own, strict=True) if x]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("n"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "n", "keys"]
                )

    def order(batches):
        for batch in batches:
            out = []
            for node, n, key, df in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "key", "df")), strict=True):
                key, df = np.array(key, np.int64), np.array(df, np.int64)
                key = key[np.lexsort((key, df))]
                first = max(0, len(key) - -(-percent * n // 100) + 1)
                hashed = key.view(np.uint64)
                bound = np.bincount((hashed >> np.uint64(59)).astype(np.int64), minlength=BUCKETS)
                where = (hashed >> np.uint64(62)).astype(np.int64)
                out.append((node, n, len(key), key[:first], bound.astype(np.int32), [key[where == s] for s in range(SEGMENTS)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64()))), strict=True)] if out else [[]] * 6,
                names=["node", "n", "shared", "firsts", "bound", "segments"],
            )

    text = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("doc"), "text")
    # rows that repeat a doc_id with other texts fall to the digests; those with the same text are one
    sets = staged(_near(text, nodes, ["doc"]).select("node", "n", "a", "b", "text").mapInArrow(keys, "node long, n long, keys array<long>").dropDuplicates(["node"]))
    each = sets.select("node", "n", F.explode("keys").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    mine = each.join(often, "key").groupBy("node", "n").agg(F.collect_list("key").alias("key"), F.collect_list("df").alias("df"))
    mine = mine.where(100 * F.size("key") >= percent * F.col("n"))
    return staged(mine.mapInArrow(order, "node long, n long, shared long, firsts array<long>, bound array<int>, segments array<array<long>>"))


def _possible(percent: int, n1, s1, n2, s2):
    """Whether sizes and shared counts leave room for a link: intersection / union >= percent / 100."""
    most = np.minimum(s1, s2) if isinstance(s1, np.ndarray) else F.least(s1, s2)
    return (100 + percent) * most >= percent * (n1 + n2)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (x, y) whose overlaps, counted in each fragment and summed, make a link."""
    segment = sets.select("node", "n", F.posexplode("segments").alias("part", "keys")).where(F.size("keys") > 0)
    left = segment.select(F.col("node").alias("x"), F.col("n").alias("nx"), "part", F.col("keys").alias("kx"))
    right = segment.select(F.col("node").alias("y"), F.col("n").alias("ny"), "part", F.col("keys").alias("ky"))
    partial = pairs.join(left, "x").join(right, ["y", "part"]).select("x", "y", "nx", "ny", F.size(F.array_intersect("kx", "ky")).alias("both"))
    total = partial.groupBy("x", "y", "nx", "ny").agg(F.sum("both").alias("both"))
    return staged(total.where((100 + percent) * F.col("both") >= percent * (F.col("nx") + F.col("ny"))).select(F.col("x").alias("a"), F.col("y").alias("b")))


def _first_round(lists: DataFrame, percent: int) -> DataFrame:
    """Each n-gram's documents paired with the one of which most is shared."""
    best = F.struct((F.col("shared") / F.col("n")).alias("r"), F.col("shared").alias("s"), (-F.col("node")).alias("o"), F.col("n").alias("m"))
    hub = lists.groupBy("key").agg(F.max(best).alias("hub"), F.count("*").alias("members")).where("members > 1")
    with_hub = lists.join(hub.select("key", (-F.col("hub.o")).alias("h"), F.col("hub.m").alias("hn"), F.col("hub.s").alias("hs")), "key")
    fits = _possible(percent, F.col("n"), F.col("shared"), F.col("hn"), F.col("hs"))
    return with_hub.where((F.col("node") != F.col("h")) & fits).select(F.least("node", "h").alias("x"), F.greatest("node", "h").alias("y")).distinct()


def _second_round(lists: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs within an n-gram's list that aren't connected yet and whose counts by hash range allow a link."""

    fields = ("node", "n", "shared", "comp")

    def run(batches):
        for batch in batches:
            xs, ys = [], []
            for row in batch.to_pylist():
                left, right = row["left"], row["right"] or row["left"]
                node, n, shared, comp = (np.array([x[c] for x in left], np.int64) for c in fields)
                node_, n_, shared_, comp_ = (np.array([x[c] for x in right], np.int64) for c in fields)
                fit = (comp[:, None] != comp_[None]) & _possible(percent, n[:, None], shared[:, None], n_[None], shared_[None])
                i, j = np.nonzero(np.triu(fit, 1) if row["right"] is None else fit)
                if len(i):
                    bound, bound_ = np.array([x["bound"] for x in left], np.int32), np.array([x["bound"] for x in right], np.int32)
                    most = np.concatenate([np.minimum(bound[i[s : s + 4096]], bound_[j[s : s + 4096]]).sum(1) for s in range(0, len(i), 4096)])
                    fit = _possible(percent, n[i], most, n_[j], most)
                    i, j = i[fit], j[fit]
                    xs.append(np.minimum(node[i], node_[j]))
                    ys.append(np.maximum(node[i], node_[j]))
            if xs:
                x, y = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

    comp = sets.select("node", "bound").join(known, "node", "left").select("node", "bound", F.coalesce("component", "node").alias("comp"))
    member = lists.join(comp, "node")
    open_lists = member.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key")
    place = F.row_number().over(Window.partitionBy("key").orderBy("comp", "node")) - 1
    dealt = member.join(open_lists, "key").withColumn("block", F.floor(place / BLOCK))
    packed = F.collect_list(F.struct("node", "n", "shared", "comp", "bound")).alias("members")
    blocks = staged(dealt.groupBy("key", "block").agg(packed, F.min("comp").alias("least"), F.max("comp").alias("most")))
    alone = blocks.where("least < most").select("key", F.col("block").alias("i"), F.col("block").alias("j"), F.col("members").alias("left"), F.lit(None).cast(blocks.schema["members"].dataType).alias("right"))
    # members stand by component in their blocks: two blocks of one and the same component have nothing to compare
    one, two = blocks.alias("one"), blocks.alias("two")
    open_ = (F.col("one.key") == F.col("two.key")) & (F.col("one.block") < F.col("two.block")) & ~((F.col("one.least") == F.col("one.most")) & (F.col("two.least") == F.col("two.most")) & (F.col("one.least") == F.col("two.least")))
    across = one.join(two, open_).select("one.key", F.col("one.block").alias("i"), F.col("two.block").alias("j"), F.col("one.members").alias("left"), F.col("two.members").alias("right"))
    pairs = alone.union(across.repartition(shuffle_width(sets.sparkSession), "key", "i", "j"))
    return pairs.select("left", "right").mapInArrow(run, "x long, y long").distinct()


def _same_document(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): each doc_id that several classes have, and these classes' least doc_ids; all of them are linked."""
    held = sets.where("n > 0 and doc_id is not null")
    repeated = held.groupBy("doc_id").agg(F.min(F.struct("n", "a", "b")).alias("one"), F.max(F.struct("n", "a", "b")).alias("two")).where("one < two").select("doc_id")
    return held.join(repeated, "doc_id").join(classes, ["n", "a", "b"]).select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))


def ngram_links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, members) of a similarity self-join of ``docs(doc_id, text)``.

    sets: (doc_id, n, a, b) for every row, a and b being the set's digest. classes: (doc, n, a, b, copies), doc the
    least doc_id of those with that set. members: (node, component) for the docs with links to other classes.
    Two documents link when 100 * |intersection| >= percent * |union| of their k-word shingle sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = staged(shingle_sets(docs, k))
    classes = sets.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"))
    nodes = _candidates(docs, classes, k, percent)
    ordered = _ordered_sets(docs, nodes, k, percent)
    lists = staged(ordered.select("node", "n", "shared", F.explode("firsts").alias("key")))
    first = _links(_first_round(lists, percent), ordered, percent)
    rest = _links(_second_round(lists, ordered, components(first), percent), ordered, percent)
    named = nodes.select("node", "doc")
    one, two = named.select(F.col("node").alias("a"), F.col("doc").alias("x")), named.select(F.col("node").alias("b"), F.col("doc").alias("y"))
    links = first.union(rest).join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return sets, classes, components(links.union(_same_document(sets, classes)))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``, other columns being ignored.

    component_id is the least doc_id that links reach. A null or empty text has no shingles and links with
    nothing; a text of fewer than k words has its whole sequence as one shingle; texts of any length count whole.
    Rows with a null doc_id come back with a null component and link with nothing. Rows that repeat a doc_id each
    come back and are one document: it links where the text of any of them does, so all that have shingles get one
    component. An empty table gives an empty table.
    """
    sets, classes, members = ngram_links(docs, k, percent)
    found = classes.join(members.withColumnRenamed("node", "doc"), "doc", "left").select("n", "a", "b", F.coalesce("component", "doc").alias("component"))
    joined = sets.where("n > 0 and doc_id is not null").join(found, ["n", "a", "b"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return joined.union(sets.where("n = 0 or doc_id is null").select("doc_id", "n", "doc_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``' rows without those that links connect with a document of smaller doc_id.

    Documents without shingles (null, empty and blank texts) and rows with a null doc_id stay; rows that repeat a
    doc_id stay or go together. Columns of any name are carried. An empty table gives an empty table.
    """
    name = fresh("gone", docs)
    found = jaccard_components(docs.select("doc_id", "text"), k, percent).where("component_id <> doc_id")
    gone = staged(found.select(F.col("doc_id").alias(name)).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, docs.doc_id == F.col(name), "left_anti")
