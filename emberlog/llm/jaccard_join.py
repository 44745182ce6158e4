"""N-gram Jaccard join: a grouped prefix join of the sets of word shingles of documents.

A document's set holds the distinct runs of ``size`` words of its whole text; with fewer words the
whole sequence is its one member; without words the set is empty and links with nothing. Two
documents link when den * |A and B| >= num * |A or B|.

1. Members are ordered from rare to frequent, by counts of all shingles of the corpus in a bounded
   array of counters. If two sets link, they share a member of their prefixes, the first
   n - ceil(num * n / den) + 1 members in that order. The order decides costs only, never links.
2. Documents with the same set become one node, nodes with the same prefix and size one group.
   Groups that share a prefix member are a list. Lists with the same groups are kept once, lists
   of one group of one node go.
3. Lists are expanded to nodes. Each node carries a parity sketch of its set: the popcount of the
   difference of two sketches never exceeds the size of the sets' difference, so pairs that
   cannot link are dropped without a look at their sets. Within chunks of a list only a spanning
   tree of the closest remaining pairs is emitted and verified with the whole sets, which joins
   large groups of near copies with few pairs. Whole sets are made for nodes of such pairs only.
4. What may still link but lies in different components is emitted from all chunks of a list and
   verified likewise, so that no link between components is lost.

Sets travel once per verified pair, texts not at all. Large lists are cut into chunks of about
``CHUNK`` nodes. The answer is one row per document with the component of its links, so pairs
between copies are never spelled out.

NULL texts are empty. Rows without an id cannot link documents with each other; they take the
component of an equal set, else NULL. Repeated rows agree in all columns. An empty table gives
an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.components import components
from emberlog.llm.registry import query
from emberlog.llm.support import bit_words, fresh, small_batches, table, with_bit, written
from emberlog.llm.words import mix, shingles, word_hashes

COUNTERS = 1 << 22  # counters of shingles; the table broadcast for the order has as many bytes
CHUNK = 512  # nodes of a list that are compared within one task at a time
SKETCH_BITS = 4096
FILTER_BITS = 1 << 27  # of filters of ids and members: 2 million words at most
_PART = 1 << 16


# ---- counting shingles -------------------------------------------------------------------------

def _count_cells(size: int):
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        waiting, n = [], 0

        def add():
            cells, counts = np.unique(np.concatenate(waiting), return_counts=True)
            total[cells] += counts.astype(np.uint32)

        for batch in batches:
            for words in word_hashes(batch.column(0)):
                cells = (shingles(words, size)[0] >> shift).astype(np.int64)
                waiting.append(cells)
                n += len(cells)
                if n > _PART * 4:
                    add()
                    waiting, n = [], 0
        if waiting:
            add()
        for part in range(COUNTERS // _PART):
            piece = total[part * _PART : (part + 1) * _PART]
            if piece.any():
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()),
                    "counts": [zlib.compress(piece.tobytes(), 1)],
                })

    return run


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each part, rows sorted by part."""
    at, total = None, None

    def done():
        return pa.RecordBatch.from_pydict({
            "part": pa.array([at], pa.int32()), "counts": [zlib.compress(total.tobytes(), 1)]
        })

    for batch in batches:
        for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if part != at:
                if at is not None:
                    yield done()
                at, total = part, np.zeros(_PART, np.uint64)
            got = zlib.decompress(counts)
            total += np.frombuffer(got, np.uint32 if len(got) == 4 * _PART else np.uint64)
    if at is not None:
        yield done()


def shingle_ranks(docs: DataFrame, size: int, text_col: str = "text") -> np.ndarray:
    """One byte per counter: 0 for none or one occurrence in the corpus, else grows with the
    logarithm of the count. ``COUNTERS`` bytes reach the driver, whatever the corpus."""
    schema = "part int, counts binary"
    parts = (
        docs.select(text_col).mapInArrow(_count_cells(size), schema)
        # Summed in two steps, so that no task reads the counts of very many others.
        .withColumn("salt", F.spark_partition_id() % 16)
        .repartition("part", "salt").sortWithinPartitions("part", "salt").select("part", "counts")
        .mapInArrow(_add_parts, schema)
        .repartition("part").sortWithinPartitions("part").mapInArrow(_add_parts, schema)
        .collect()
    )
    counts = np.zeros(COUNTERS, np.uint64)
    for r in parts:
        counts[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(
            zlib.decompress(r["counts"]), np.uint64
        )
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


# ---- sets, prefixes, sketches ------------------------------------------------------------------

def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _digest(size: int, num: int, den: int, ranks):
    """(id, text) to the size of the set, a 128-bit key of the set and of its prefix, and the
    members of the prefix that occur elsewhere, too."""
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = ranks.value
        for batch in batches:
            ids = batch.column(0)
            sizes, keys, firsts, members, lengths = [], [], [], [], []
            for words in word_hashes(batch.column(1)):
                hashes, starts = shingles(words, size)
                for a, b in zip(starts, starts[1:]):
                    if a == b:
                        sizes.append(0)
                        keys.append((0, 0))
                        firsts.append((0, 0))
                        lengths.append(0)
                        continue
                    own = np.unique(hashes[a:b])
                    rank = table_[(own >> shift).astype(np.int64)]
                    p = prefix_length(len(own), num, den)
                    first = np.argsort(rank, kind="stable")[:p]
                    head = own[first]
                    sizes.append(len(own))
                    keys.append(_key(own))
                    firsts.append(_key(head))
                    shared = head[rank[first] > 0]
                    members.append(shared)
                    lengths.append(len(shared))
            flat = np.concatenate(members).view(np.int64) if members else np.empty(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            key = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
            head = np.array(firsts, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int32()), pa.array(key[:, 0]), pa.array(key[:, 1]),
                 pa.array(head[:, 0]), pa.array(head[:, 1]), pa.ListArray.from_arrays(offsets, flat)],
                ["id", "n", "k1", "k2", "p1", "p2", "prefix"],
            )

    return run


def _key(members: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set, the same in any order."""
    return int(np.bitwise_xor.reduce(mix(members))), int(mix(members ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum())


def _sets(size: int, sketched: bool):
    """(id, text) to (id, n, sketch) or to (id, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for words in word_hashes(batch.column(1)):
                hashes, starts = shingles(words, size)
                own = [np.unique(hashes[a:b]) for a, b in zip(starts, starts[1:])]
                id_ = pa.array(ids[words.first : words.first + words.rows], pa.int64())
                if sketched:
                    sizes = pa.array([len(x) for x in own], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [id_, sizes, pa.array([_sketch(x) for x in own], pa.binary())], ["id", "n", "sketch"]
                    )
                else:
                    members = pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([id_, members], ["id", "members"])

    return run


def _sketch(members: np.ndarray) -> bytes:
    at = (members % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(at, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


# ---- comparing sketches within chunks ----------------------------------------------------------

def _chunks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first ``keys`` columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _columns(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, sizes and sketches of a chunk, each node once, by size."""
    node = chunk.column("node").to_numpy()
    n = chunk.column("n").to_numpy().astype(np.int64)
    words = np.frombuffer(b"".join(chunk.column("sketch").to_pylist()), np.uint64)
    order = np.lexsort((node, n))
    keep = order[np.concatenate(([True], np.diff(node[order]) != 0))] if len(order) else order
    return node[keep], n[keep], words.reshape(len(node), -1)[keep], keep


def _reach(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each size, in ascending order, how far the sizes go that can link with it."""
    return np.searchsorted(n * num, n * den, "right")


def _distances(sketch: np.ndarray, n: np.ndarray, i: int, others: slice, num: int, den: int) -> np.ndarray:
    """Lower bounds of the set differences between row i and others; -1 where no link is possible."""
    differ = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1, dtype=np.int64)
    possible = differ * (num + den) <= (n[others] + n[i]) * (den - num)
    return np.where(possible, differ, -1)


def _tree_pairs(num: int, den: int):
    """Per chunk, a spanning forest of the pairs that may link, the closest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for chunk in _chunks(batches, 3):
            node, n, sketch, _ = _columns(chunk)
            size = len(node)
            if size < 2:
                continue
            reach = _reach(n, num, den)
            far = np.iinfo(np.int64).max
            best = np.full(size, far)
            parent = np.full(size, -1)
            open_ = np.ones(size, bool)
            low = np.searchsorted(n * den, n * num, "left")  # the smallest size that can link
            at = 0
            for _ in range(size):
                open_[at] = False
                span = slice(int(low[at]), int(reach[at]))
                d = _distances(sketch, n, at, span, num, den)
                better = open_[span] & (d >= 0) & (d < best[span])
                best[span] = np.where(better, d, best[span])
                parent[span] = np.where(better, at, parent[span])
                rest = np.where(open_, best, far)
                at = int(rest.argmin())
                if not open_[at]:
                    at = int(open_.argmax())
                if open_[at] and parent[at] >= 0:
                    out_a.append(min(node[at], node[parent[at]]))
                    out_b.append(max(node[at], node[parent[at]]))
            if len(out_a) >= 10_000:
                yield _pairs(out_a, out_b)
                out_a, out_b = [], []
        if out_a:
            yield _pairs(out_a, out_b)

    return run


def _cross_pairs(num: int, den: int):
    """Per pair of chunks, all pairs of different components that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 3):
            node, n, sketch, keep = _columns(chunk)
            label = chunk.column("label").to_numpy()[keep]
            side = chunk.column("side").to_numpy()[keep]
            apart = chunk.column("i")[0].as_py() != chunk.column("j")[0].as_py()
            reach = _reach(n, num, den)
            for i in range(len(node)):
                span = slice(i + 1, int(reach[i]))
                open_ = label[span] != label[i]
                if apart:
                    open_ &= side[span] != side[i]
                if not open_.any():
                    continue
                at = np.flatnonzero(open_) + i + 1
                differ = np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                at = at[differ * (num + den) <= (n[at] + n[i]) * (den - num)]
                if len(at):
                    yield _pairs(np.minimum(node[at], node[i]), np.maximum(node[at], node[i]))

    return run


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], ["a", "b"]
    )


def _of_nodes(texts: DataFrame, nodes: DataFrame, size: int, sketched: bool) -> DataFrame:
    """Sketches or whole sets of the documents ``nodes`` (id). A bit filter of bounded size keeps
    nearly all other documents out; texts are not shuffled."""
    nodes = written(nodes.distinct(), "needed")
    cell = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = bit_words(nodes.select(cell.alias("cell")))
    schema = "id long, n int, sketch binary" if sketched else "id long, members array<bigint>"
    near = with_bit(texts, cell, words, "near").filter("near").select("id", "text").mapInArrow(_sets(size, sketched), schema)
    return near.join(nodes, "id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs that link, decided on the whole sets."""
    pairs = written(pairs.distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    sets = written(_of_nodes(texts, nodes, size, sketched=False), "sets")

    def side(x: str) -> DataFrame:
        return sets.select(F.col("id").alias(x), F.col("members").alias(f"{x}_set"))

    both = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - both
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .filter(both * den >= union * num).select("a", "b").distinct()
    )


# ---- the join ----------------------------------------------------------------------------------

def jaccard_components(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row, linking at a similarity of num / den."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranks = spark.sparkContext.broadcast(shingle_ranks(texts, size))
    digests = written(
        texts.mapInArrow(
            _digest(size, num, den, ranks),
            "id long, n int, k1 long, k2 long, p1 long, p2 long, prefix array<bigint>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )

    # Nodes: one document of each set. Groups: nodes with the same prefix and size.
    classes = written(
        digests.filter("n > 0").groupBy("n", "k1", "k2", "p1", "p2")
        .agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"))
        .select("n", "k1", "k2", "p1", "p2", F.col("best.id").alias("node"), F.col("best.row").alias("row")),
        "classes",
    )
    nodes = classes.filter("node is not null")
    groups = nodes.groupBy("n", "p1", "p2").agg(
        F.min(F.struct("node", "row")).alias("first"), F.count("*").alias("members")
    )
    in_groups = written(
        nodes.join(groups, ["n", "p1", "p2"]).select(
            "node", "n", "p1", "members", F.col("first.node").alias("group"),
            (F.col("first.row") == F.col("row")).alias("leads"), "row",
        ),
        "nodes",
    )
    heads = digests.select("row", "prefix").join(in_groups.filter("leads").select("row", "n", "group", "members"), "row")
    lists = _lists(heads.withColumn("band", _band(num, den)), in_groups)
    placed = written(
        lists.join(in_groups.select("group", "node", "n"), "group").select("token", "node", "n", "length"),
        "lists",
    )
    found = written(_of_nodes(texts, placed.select(F.col("node").alias("id")), size, sketched=True), "sketches")
    found = found.select(F.col("id").alias("node"), "sketch")
    sketches = placed.join(found, "node")

    def in_chunks(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys)

    salted = sketches.select(
        "token", _band(num, den).alias("band"),
        F.pmod(F.xxhash64("token", "node"), F.ceil(F.col("length") / CHUNK)).alias("salt"),
        "node", "n", "sketch",
    )
    trees = in_chunks(salted, "token", "band", "salt").mapInArrow(_tree_pairs(num, den), "a long, b long")
    links = written(_verified(trees, texts, size, num, den), "links")
    labels = components(links)

    # Lists that still hold more than one component.
    labelled = placed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = (
        labelled.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"),
                                      F.count("*").alias("rows"))
        .filter("least <> most").select("token", F.ceil(F.col("rows") / CHUNK).cast("int").alias("parts"))
    )
    rest = labelled.select("token", "node", "n", "label").join(mixed, "token")
    side = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    spread = rest.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    chunked = spread.select(
        "token", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
        "side", "node", "n", "label",
    ).join(found, "node")
    cross = in_chunks(
        chunked.select("token", "i", "j", "side", "node", "n", "label", "sketch"), "token", "i", "j"
    ).mapInArrow(_cross_pairs(num, den), "a long, b long")
    more = written(_verified(cross, texts, size, num, den), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    settled = written(
        classes.join(labels, "node", "left")
        .select("n", "k1", "k2", F.coalesce("label", "node").alias("component")),
        "components",
    )
    return digests.join(settled, ["n", "k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )


def _band(num: int, den: int) -> Column:
    """Bands of sizes: those that can link are in the same or in neighbouring bands."""
    step = float(np.log(den / num)) if num < den else 1.0
    # A little wider than the reach, so that rounding cannot put two of them further apart.
    return F.floor(F.log(F.col("n").cast("double")) / (step * 1.001)).cast("int")


def _lists(heads: DataFrame, in_groups: DataFrame) -> DataFrame:
    """(token, group, length): groups that share a prefix member, lists with the same groups once,
    and groups of several nodes; ``length`` counts nodes.

    Most members are in the prefix of one group only. Their counts alone are shuffled; a bit filter
    of the others picks the rows that go on. Of these, groups go whose size is in no reach of
    another's in the list: sizes that can link lie in the same band or in neighbouring ones.
    """
    postings = heads.select("group", "members", "band", F.explode("prefix").alias("token"))
    common = written(
        postings.groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1").select("token"), "tokens"
    )
    cell = F.pmod(F.xxhash64("token"), F.lit(FILTER_BITS))
    near = with_bit(postings, cell, bit_words(common.select(cell.alias("cell"))), "near").filter("near")
    near = written(near.drop("near"), "postings")
    lower, upper = near.select("token", "band"), near.select("token", (F.col("band") + 1).alias("band"))
    met = written(
        lower.union(upper).groupBy("token", "band").agg(F.count("*").alias("rows")).filter("rows > 1").select("token", "band"),
        "bands",
    )
    # A group is in two bands of a list: its own, and the next one for larger partners.
    partners = met.union(met.select("token", F.col("band") - 1)).distinct()
    shared = written(near.join(partners, ["token", "band"], "left_semi"), "postings")
    tokens = (
        shared.groupBy("token").agg(
            F.count("*").alias("groups"), F.sum("members").alias("length"),
            F.bit_xor(F.xxhash64("group")).alias("x1"), F.bit_xor(F.xxhash64("group", F.lit(1))).alias("x2"),
        )
        .filter("groups > 1").groupBy("groups", "length", "x1", "x2").agg(F.min("token").alias("token"))
    )
    alike = in_groups.filter("leads and members > 1").select(
        F.col("p1").alias("token"), "group", F.col("members").alias("length")
    )
    return (
        shared.select("token", "group").join(tokens.select("token", "length"), "token")
        .select("token", "group", "length").union(alike)
    )


def one_of_each(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that remain when of each component only the document with the smallest id stays;
    rows without an id and with an empty text stay."""
    found = jaccard_components(docs, size, num, den, id_col, text_col)
    flag, key = fresh(docs, "maybe", "dropped_id")
    gone = written(
        found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(key)).distinct(), "dropped"
    )
    # Rows outside a filter of the dropped ids pass straight through; the others are shuffled.
    def cell(c: str):
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FILTER_BITS))

    marked = with_bit(docs, cell(id_col), bit_words(gone.select(cell(key).alias("cell"))), flag)
    maybe = marked.filter(flag).join(gone, F.col(id_col) == F.col(key), "left_anti")
    return marked.filter(~F.col(flag)).select(*docs.columns).unionByName(maybe.select(*docs.columns))


@query("op1_jaccard_join")
def _op1(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, num=9, den=10)
