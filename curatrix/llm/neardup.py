"""A similarity join of texts on the Jaccard index of their word n-grams, by a MinHash LSH forest.

Each distinct text has a signature of LEVELS MinHash values in each of TREES trees. A tree is the prefix
trie of its signatures, kept as a table sorted by signature: texts that share a prefix stand in a row, a
subtree. Two texts are candidates if they share a subtree of their tree's depth in any tree. Depths
begin at whole signatures and are shortened tree by tree, as what was found demands: all neighbours in
the sorted table that share two values or more are compared exactly, and as long as the links among them,
band by band of similarity, are found by a forest of the depths with less than the target recall, the
longest prefix is shortened by one value. A band counts one link at its lower edge more than were seen,
so that the target also holds where none was seen. Tasks add up counts for each depth the prefixes can
get to, so the driver sees no pairs. Every candidate pair is then verified on the n-grams of both whole
texts.

Equal texts are one class and enter once, with their number. A subtree is cut into tiles of about TILE
texts and TILE_BYTES of text, and each pair of tiles is one task's piece of work, however large the
subtree; a subtree with the same texts as that of another tree is left out; and a pair that shares
subtrees of several trees counts in the first. Pieces return a count of links and a root for each text,
never pairs. Classes are the connected components of the links, found by alternating stars on tables.

Defined cases: words are runs between white space, lower-cased in ASCII. A text of fewer words than n
is one n-gram; one without words, null ones among them, links with nothing but is in a class with its
equals. Rows with a null id have no class and no links. Rows with equal ids are one document. Only the
two columns named are read, so other columns may have any name; rows that ``keep_one`` keeps have all.
N-grams are compared by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from curatrix.llm.common import kth_largest, materialize, spare
from curatrix.llm.words import Words, blocks

WORDS, THRESHOLD = 5, 0.8
TREES, LEVELS, RECALL = 16, 8, 0.9995
BANDS = 4
TILE, TILE_BYTES = 256, 4 << 20
#: Probabilities are added up as whole numbers of this unit, so that sums do not depend on their order.
UNIT = 2.0**-30
#: Ids are broadcast up to this number, 16 bytes each or so; beyond it texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def signatures_of(words: Words, n: int, trees: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each text and tree, and which texts have n-grams at all.

    A signature is LEVELS values of 16 bits, the first one on top, so that the order of the numbers is
    that of the prefix trie. Each pass over the n-grams gives the two MinHash values of both halves of
    a hash.
    """
    grams, _, ptr = words.ngrams(n)
    full = np.flatnonzero(np.diff(ptr))
    factors = np.random.default_rng(seed).integers(1, 1 << 63, trees * LEVELS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(full), trees, 2), np.uint64)
    first = ptr[:-1][full]
    for k, f in enumerate(factors if len(full) else []):
        tree, level = divmod(2 * k, LEVELS)
        h = grams * f
        h ^= h >> np.uint64(29)
        for half in ((h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32)):
            least = np.minimum.reduceat(half, first) * np.uint32(0x9E3779B1)  # a minimum is small: spread it
            out[:, tree, level // 4] |= (least >> np.uint32(16)).astype(np.uint64) << np.uint64(48 - 16 * (level % 4))
            level += 1
    return out.reshape(len(full), 2 * trees), full


def signatures(df: DataFrame, id_column: str, text: str, n: int, trees: int) -> DataFrame:
    """``id``, ``text_key``, ``size`` (bytes), ``sig``: the last is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "body"):
            sig, full = signatures_of(Words(block.column(3)), n, trees)
            there = np.zeros(block.num_rows, bool)
            there[full] = True
            at = np.concatenate([[0], np.cumsum(there * 2 * trees)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(sig.reshape(-1).view(np.int64)), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([*block.columns[:3], lists], names=["id", "text_key", "size", "sig"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.unhex(F.md5(body.cast("binary"))).alias("text_key"), F.octet_length(body).cast("long").alias("size"), body.alias("body"))
    return rows.mapInArrow(run, "id long, text_key binary, size long, sig array<long>")


def plant(classes: DataFrame, trees: int) -> DataFrame:
    """The forest: ``tree, hi, lo, rep, size``, sorted by signature within ranges of it.

    Ranges end with the ids, so that a subtree of any size spreads over as many as it takes.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    rows = classes.where("sig IS NOT NULL").select("rep", "size", "sig", tree).select("tree", F.expr("sig[2 * tree]").alias("hi"), F.expr("sig[2 * tree + 1]").alias("lo"), "rep", "size")
    order = ["tree", "hi", "lo", "rep"]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def shared_levels(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """How many values each signature shares, from the first on, with the one before; 0 for the first."""
    out = np.zeros(len(hi), np.int64)
    if len(hi) > 1:
        up, down = hi[1:] ^ hi[:-1], lo[1:] ^ lo[:-1]
        for level in range(4):
            shift = np.uint64(48 - 16 * level)
            out[1:] += up >> shift == 0
            out[1:] += (up == 0) & (down >> shift == 0)
    return out


def between_files(forest: DataFrame) -> list[tuple[int, int, int]]:
    """``level, a, b`` of the neighbours that stand in different files or partitions of a sorted forest.

    The driver gets the first and the last row of each.
    """
    row = F.struct("tree", "hi", "lo", "rep")
    part = [F.spark_partition_id().alias("p"), F.input_file_name().alias("f"), F.input_file_block_start().alias("s")]
    ends = sorted((tuple(r["first"]), tuple(r["last"])) for r in forest.select(*part, row.alias("row")).groupBy("p", "f", "s").agg(F.min("row").alias("first"), F.max("row").alias("last")).collect())
    out = []
    for (_, x), (y, _) in zip(ends[:-1], ends[1:], strict=True):
        level = int(shared_levels(*(np.array([x[k], y[k]]).view(np.uint64) for k in (1, 2)))[1])
        if x[0] == y[0] and level > 1:
            out.append((level, min(x[3], y[3]), max(x[3], y[3])))
    return out


def neighbours(forest: DataFrame) -> DataFrame:
    """``level, a, b``: texts next to each other in a tree that share two values or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(4)]
            tree, hi, lo, rep = columns if last is None else (np.concatenate(both) for both in zip(last, columns, strict=True))
            last = [c[-1:].copy() for c in columns]
            level = shared_levels(hi.view(np.uint64), lo.view(np.uint64))
            level[1:][tree[1:] != tree[:-1]] = 0
            at = np.flatnonzero(level > 1)
            yield pa.RecordBatch.from_arrays([pa.array(level[at].astype(np.int32)), pa.array(np.minimum(rep[at - 1], rep[at])), pa.array(np.maximum(rep[at - 1], rep[at]))], names=["level", "a", "b"])

    schema = "level int, a long, b long"
    within = forest.select("tree", "hi", "lo", "rep").mapInArrow(run, schema)
    across = between_files(forest)
    return within.unionAll(forest.sparkSession.createDataFrame([Row(level=k, a=a, b=b) for k, a, b in across], schema)) if across else within


def bodies_of(source: DataFrame, ids: DataFrame) -> DataFrame:
    """``rep, text_key, body``: the distinct texts of these ids."""
    texts = source.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "rep", "left_semi")
    return texts.select("rep", F.unhex(F.md5(F.col("body").cast("binary"))).alias("text_key"), "body").dropDuplicates(["rep", "text_key"])


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))).distinct()


def both_bodies(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a_body, b_body`` of each pair; an id is in no more pairs than it has neighbours, two a tree."""
    left, right = (texts.select(F.col("rep").alias(c), F.col("body").alias(f"{c}_body")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a_body", "b_body")


def jaccard(block: pa.RecordBatch, n: int) -> np.ndarray:
    """The Jaccard index of the n-grams of the texts in the first two columns of each row."""
    both = [Words(block.column(k)).ngrams(n) for k in (0, 1)]
    out = np.zeros(block.num_rows)
    for i in range(block.num_rows):
        x, y = (np.unique(g[ptr[i] : ptr[i + 1]]) for g, _, ptr in both)
        same = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = same / max(1, len(x) + len(y) - same)
    return out


def sampled_similarities(forest: DataFrame, bodies: DataFrame, n: int, most: int = 500) -> np.ndarray:
    """Jaccard indices of some neighbours, for a look at a forest: ``most`` for each number of shared values.

    ``join_similar`` takes nothing from it; see ``neighbour_links``.
    """
    pairs = materialize(neighbours(forest).groupBy("a", "b").agg(F.max("level").alias("level")).select("level", "a", "b", F.shiftright(F.xxhash64("a", "b"), 2).alias("key")), "neighbours")
    chosen = pairs.limit(0)
    for r in pairs.groupBy("level").count().collect():
        some = pairs.where(F.col("level") == r["level"])
        at = kth_largest(some.select("key"), most) if r["count"] > most else None
        chosen = chosen.unionAll(some if at is None else some.where(F.col("key") >= at))
    chosen = materialize(chosen.select("a", "b"), "some")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "a_body"):
            yield pa.RecordBatch.from_arrays([pa.array(jaccard(block, n))], names=["similarity"])

    met = both_bodies(chosen, bodies_of(bodies, ends_of(chosen)))
    return np.array([r[0] for r in met.mapInArrow(run, "similarity double").collect()])


def found_with(depths: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """With which probability trees cut at these depths bring together pairs of these similarities."""
    return 1 - np.prod(1 - similarity[:, None] ** depths[None, :], axis=1)


def lower_edges(threshold: float, bands: int = BANDS) -> np.ndarray:
    return threshold + (1 - threshold) * np.arange(bands) / bands


def schedule(trees: int) -> np.ndarray:
    """The depths of all trees at each step of shortening: the longest prefix loses one value."""
    depths = np.full(trees, LEVELS)
    steps = [depths.copy()]
    while depths.max() > 1:
        depths[int(depths.argmax())] -= 1
        steps.append(depths.copy())
    return np.array(steps)


def tally(steps: np.ndarray, similarity: np.ndarray, threshold: float, bands: int = BANDS) -> np.ndarray:
    """For each band its number of links, then for each step how many of them are found, in UNITs.

    Tallies of parts of the links add up to that of all, exactly.
    """
    of = np.searchsorted(lower_edges(threshold, bands), similarity + 1e-12, "right") - 1
    out = np.zeros((bands, 1 + len(steps)), np.int64)
    for k in range(bands):
        links = similarity[of == k]
        out[k, 0] = len(links)
        out[k, 1:] = [np.rint(found_with(depths, links) / UNIT).astype(np.int64).sum() for depths in steps]
    return out


def recalls(steps: np.ndarray, tallied: np.ndarray, threshold: float) -> np.ndarray:
    """For each step the least recall of any band of links, each with one link more at its lower edge."""
    edge = np.array([found_with(depths, lower_edges(threshold, len(tallied))) for depths in steps]).T
    return ((tallied[:, 1:] * UNIT + edge) / (tallied[:, :1] + 1)).min(0)


def recall_of(depths: np.ndarray, similarity: np.ndarray, threshold: float, bands: int = BANDS) -> float:
    return float(recalls(depths[None], tally(depths[None], similarity, threshold, bands), threshold)[0])


def first_step(tallied: np.ndarray, threshold: float, trees: int = TREES, recall: float = RECALL) -> np.ndarray:
    """Each tree's depth: prefixes are shortened, the longest first, until the recall is reached."""
    steps = schedule(trees)
    enough = recalls(steps, tallied, threshold) >= recall
    return steps[int(enough.argmax()) if enough.any() else -1]


def shorten(similarity: np.ndarray, threshold: float, trees: int = TREES, recall: float = RECALL) -> np.ndarray:
    return first_step(tally(schedule(trees), similarity, threshold), threshold, trees, recall)


def neighbour_links(forest: DataFrame, classes: DataFrame, source: DataFrame, n: int, threshold: float, trees: int) -> np.ndarray:
    """The tally, for all steps of shortening, of all links between neighbours.

    Each pair is compared once, however many trees it is in; a task adds up its pairs.
    """
    pairs = materialize(neighbours(forest).where("a <> b").select("a", "b").distinct(), "neighbours")
    texts = materialize(classes.select("rep", "text_key").join(bodies_of(source, ends_of(pairs)), ["rep", "text_key"]).select("rep", "body"), "ends")
    steps = schedule(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = tally(steps, np.zeros(0), threshold)
        for block in blocks(batches, "a_body"):
            total += tally(steps, jaccard(block, n), threshold)
        band, step = np.indices(total.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (band, step, total)], names=["band", "step", "total"])

    added = both_bodies(pairs, texts).mapInArrow(run, "band int, step int, total long").groupBy("band", "step").agg(F.sum("total"))
    out = tally(steps, np.zeros(0), threshold)
    for band, step, total in added.collect():
        out[band, step] = total
    return out


def subtree_key(tree: str, hi: str, lo: str, depths: np.ndarray) -> str:
    """In SQL, a hash of the subtree of a signature's prefix at its tree's depth."""
    depth = f"array({', '.join(map(str, depths.tolist()))})[{tree}]"
    return f"CASE WHEN {depth} > 4 THEN xxhash64({tree}, {hi}, shiftrightunsigned({lo}, 16 * (8 - {depth}))) ELSE xxhash64({tree}, shiftrightunsigned({hi}, 16 * (4 - {depth}))) END"


def similar(sets: list[np.ndarray], tile: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets whose Jaccard index reaches the threshold; only pairs across tiles, if asked."""
    size = np.array([len(s) for s in sets])
    doc, gram = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    order = np.argsort(gram, kind="stable")
    doc, gram = doc[order], gram[order]
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    doc, number = doc[keep], (np.cumsum(shared) - 1)[number[keep]]
    both = np.zeros((len(sets), len(sets)), np.float64)
    width = max(1, (4 << 20) // len(sets))
    low, total = 0, int(shared.sum())
    while low < total:
        a, b = np.searchsorted(number, [low, low + width])
        m = np.zeros((len(sets), min(width, total - low)), np.float32)
        m[doc[a:b], number[a:b] - low] = 1
        both += m @ m.T
        low += width
    union = size[:, None] + size[None, :] - both
    good = np.triu(both >= threshold * union - 1e-9, 1)
    if across:
        good &= tile[:, None] != tile[None, :]
    return np.nonzero(good)


def roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id reachable from each of n texts over the given pairs."""
    label = ids.copy()
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        if (label == before).all():
            return label


def verify(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """``id, links, root`` for the texts with links of each piece; pieces come one after the other."""

    def piece(batch: pa.RecordBatch) -> list[tuple[int, int, int]]:
        key, low, high = (batch.column(k)[0].as_py() for k in range(3))
        if batch.num_rows < 2:
            return []
        tile, ids, copies = (batch.column(k).to_numpy() for k in (3, 4, 5))
        keys = batch.column(6).flatten().to_numpy().reshape(len(ids), -1)
        grams, _, ptr = Words(batch.column(7)).ngrams(n)
        i, j = similar([np.unique(grams[a:b]) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)], tile, low != high, threshold)
        same = keys[i] == keys[j]
        own = keys[i, same.argmax(1)] == key  # the first subtree that both share is this one
        i, j = i[own], j[own]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = roots(len(ids), i, j, ids)
        return [(int(ids[k]), int(links[k]), int(root[k])) for k in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        rest: list[pa.RecordBatch] = []  # rows of the piece that the last batch ended in

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["id", "links", "root"])

        def done() -> None:
            if rest:
                out.extend(piece(pa.Table.from_batches(rest).combine_chunks().to_batches()[0]))
                rest.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            piece_of = [batch.column(k).to_numpy() for k in range(3)]
            new = np.zeros(batch.num_rows, bool)
            for c in piece_of:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            if rest and any(rest[-1].column(k)[len(rest[-1]) - 1].as_py() != piece_of[k][0] for k in range(3)):
                done()
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low:
                    done()
                rest.append(batch.slice(low, high - low))
            if len(out) > 10_000:
                yield give()
                out.clear()
        done()
        yield give()

    return rows.mapInArrow(run, "id long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``class_id`` for the ends of ``u``, ``v``: the least id of each connected component.

    Alternating stars: each node hands its larger, then its smaller neighbours to its least one. Edges
    are tables between rounds; there are as many rounds as the log of a component's size, about.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Least neighbours are tables, so that both joins shuffle two inputs and a hot node is split.
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = materialize(small, "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    heads = e.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("class_id")).unionAll(heads)


def join_similar(df: DataFrame, id_column: str, text: str, n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``id``, ``class_id``, ``n_links``, ``text_key`` for each row of ``df``.

    ``class_id`` is the least id of the row's class; ``n_links`` counts the other rows that are equal
    or reach the threshold.
    """
    sig = materialize(signatures(df, id_column, text, n, trees), "signatures")
    classes = materialize(sig.where("id IS NOT NULL").groupBy("text_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig")), "classes")
    body = F.coalesce(F.col(text), F.lit(""))
    source = df.select(F.col(id_column).cast("long").alias("rep"), body.alias("body"))
    forest = materialize(plant(classes, trees), "forest")
    depths = first_step(neighbour_links(forest, classes, source, n, threshold, trees), threshold, trees, recall)
    nodes = forest.select("rep", "size", "tree", F.expr(subtree_key("tree", "hi", "lo", depths)).alias("key"))
    subtrees = nodes.groupBy("key").agg(F.min("tree").alias("tree"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y")).where("n > 1")
    tiles = F.greatest(F.ceil(F.max("n") / tile), F.ceil(F.max("bytes") / tile_bytes)).cast("int")
    kept = subtrees.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "key")).alias("first"), tiles.alias("tiles")).select(F.col("first.key").alias("key"), "tiles")
    members = nodes.join(kept, "key").select("rep", "key", "tiles", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int").alias("tile"))
    members = materialize(members, "members")
    texts = bodies_of(source, members.select("rep").distinct())
    keys = F.expr(f"transform(sequence(0, {trees - 1}), t -> {subtree_key('t', 'sig[2 * t]', 'sig[2 * t + 1]', depths)})")
    whole = classes.join(texts, ["rep", "text_key"]).select("rep", "copies", keys.alias("keys"), "body")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pieces = members.select("*", other).join(whole, "rep").select("key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "rep", "copies", "keys", "body")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(verify(pieces.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b"), n, threshold), "links")
    label = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    told = classes.select("text_key", "rep", "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    told = told.select("text_key", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sig.select("id", "text_key").join(told, "text_key", "left")
    return out.select("id", F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"), F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), "text_key")


def keep_one(df: DataFrame, id_column: str, text: str, **options) -> DataFrame:
    """The rows of ``df`` that stay when one document of each class does, that of the least id.

    Rows with a null id stay. Of rows that repeat a kept id with the same text, one stays.
    """
    joined = join_similar(df, id_column, text, **options)
    key, mark = F.col(id_column).cast("long"), spare(df, "kept_id")
    gone = materialize(joined.where("class_id <> id").select(F.col("id").alias(mark)).distinct(), "gone")
    left = df.join(gone, key == F.col(mark), "left_anti")
    again = materialize(joined.where("id IS NOT NULL AND class_id = id").groupBy(F.col("id").alias(mark)).count().where("count > 1").select(mark), "again")
    if not again.limit(1).count():
        return left
    twice = left.join(again, key == F.col(mark), "left_semi").dropDuplicates([id_column])
    return left.join(again, key == F.col(mark), "left_anti").unionByName(twice)
