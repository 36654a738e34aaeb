"""Operator 2, n-gram Jaccard join by a forest of signature trees.

A document is the set of its distinct word shingles. Equal sets form a class at once. Two classes whose similarity reaches
the threshold share a token among their first ones in any common order of tokens, so each such token roots a tree of the
classes that have it; and at the first token that they share, at places i and j of that order, no more than the lesser of
n - i and m - j tokens can be common. Trees of at most LEAF classes are one leaf: their pairs are joined under these bounds.

The classes of larger trees, which large groups of near copies make, get a second forest of their own. Its order is by how
many of these classes hold a token, counted over their whole sets and rarest first, so what an edit has brought into a copy
comes before what all copies share, and the bound above tells copies apart that are too far from each other. Each class is
compared with one hub, the most central class of the trees it is in, which makes most of a group one component. Then the
trees are walked: below a root are nodes by range of size, below these nodes by finer range of size, room and component,
and every node holds the OR of the token bitmaps, the range of sizes, the most room and the range of components of what lies
under it. Pairs of nodes are walked from the root down, both sides at once, and a pair is dropped when the largest possible
overlap is too small, when the sizes are too far apart, or when all of it is one component already. What is left is compared
exactly, set by set. No link between different components is lost.

Edge cases: null and empty texts, and texts of blanks, have the empty set and no links; repeated rows are one class; a row
without an id never names a component if another row of it has an id; an empty table gives an empty result; further
columns are ignored, whatever their names; sizes of sets have no bound but a task's memory for one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .components import components
from .scratch import arrow_batches, dropped, gathered, written

SHINGLE = 4
PERCENT = 85
#: Longs of a bitmap.
LONGS = 16
#: Tokens that more classes than this hold are ordered last, the most frequent at the end; at most so many are told apart.
FREQUENT, MOST_FREQUENT = 24, 1 << 18
#: Trees of at most this many classes are one leaf.
LEAF = 64
#: Ratio of two neighbouring steps of size and of room in the lower nodes of a tree.
STEP = 1.02
#: Bits of the filters that say which tokens are shared and which documents are wanted.
FILTER_BITS = 1 << 26
#: Rows with texts or signatures that a Python worker gets at once.
BATCH_ROWS = 1000
#: Bytes of a table of pairs, several hundred of them, whose texts are compared in one task.
PAIR_BYTES = 1 << 12
BITS = [f"b{i}" for i in range(LONGS)]


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, offsets = kernels.spaced_words(texts, lower=True)
    grams = kernels.windows(words, width)
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - begin >= width:
            found = np.sort(grams[begin : end - width + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        else:
            yield kernels.windows(words[begin:end], end - begin) + np.uint64(end - begin) if end > begin else np.zeros(0, np.uint64)


def prefix_size(n, percent: int = PERCENT):
    """How many first tokens of a set of n (a number or an array) must hold one of each partner's first tokens; n is over 0."""
    return n - (percent * n + 99) // 100 + 1


def front_size(n, percent: int = PERCENT):
    """How many tokens in order of hash are counted: the first ones, and a quarter more for those that give way to them."""
    return (5 * prefix_size(n, percent) + 3) // 4


def blobs(parts: list[np.ndarray]) -> pa.Array:
    """One binary value for each array."""
    return pa.array([x.tobytes() for x in parts], pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned 64-bit integers of all binary values on end, and the n + 1 offsets of the values in them."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def row_keys() -> list[Column]:
    """128 bits that stand for a row's id and text."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2")]


def signatures(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(_id, k1, k2, n, digest, front, b0..): of every document a key, the size of its set, 128 bits that stand for the set, its front tokens and its bitmap."""
    schema = f"_id {docs.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n long, digest binary, front binary, " + ", ".join(f"{b} long" for b in BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch):
                n, digests, fronts, maps = [], [], [], []
                for found in shingle_sets(part.column("text"), width):
                    n.append(len(found))
                    digests.append(np.array([kernels.mixed(found * np.uint64(3)).sum(dtype=np.uint64), kernels.mixed(found + np.uint64(kernels.SEED)).sum(dtype=np.uint64)]))
                    fronts.append(found[: front_size(len(found), percent)] if len(found) else found)
                    bits = np.zeros(LONGS * 64, bool)
                    bits[(found & np.uint64(LONGS * 64 - 1)).astype(np.int64)] = True
                    maps.append(np.packbits(bits).view(np.int64))
                maps = np.array(maps, np.int64).reshape(-1, LONGS)
                columns = [*(part.column(x) for x in ("_id", "k1", "k2")), pa.array(n, pa.int64()), blobs(digests), blobs(fronts), *[pa.array(maps[:, i]) for i in range(LONGS)]]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "k1", "k2", "n", "digest", "front", *BITS])

    return docs.select(F.col("doc_id").alias("_id"), *row_keys(), "text").mapInArrow(run, schema)


def classes_of(signed: DataFrame) -> DataFrame:
    """One row for each set that is not empty, numbered by ``c``, with the key of a document that has it."""
    first = signed.filter("n > 0").select("digest", "k1", "k2", "n", "front", *BITS).dropDuplicates(["digest"])
    return written(gathered(first, signed).withColumn("c", F.monotonically_increasing_id()), "classes")


def shared_tokens(classes: DataFrame) -> DataFrame:
    """(token, n) of the tokens near the front of two classes or more, counted over all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch, "front"):
                tokens, n = np.unique(unpacked(part.column("front"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int32))], ["token", "n"])

    counted = classes.select("front").mapInArrow(run, "token long, n int").groupBy("token").agg(F.sum("n").alias("n"))
    return written(gathered(counted.filter("n > 1"), classes), "shared-tokens")


def bit_filter(values: DataFrame, column: str) -> np.ndarray:
    """FILTER_BITS bits with those set that a value of ``column`` falls on; its size is fixed, false hits only cost work."""
    place = F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1
    rows = values.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows.collect():  # 4 KB a row, FILTER_BITS / 8 bytes in all
        out[(row["k"] - 1) * 4096 : row["k"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def hits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values fall on a bit that is set."""
    at = np.mod(values.view(np.int64), FILTER_BITS)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def ordered_last(shared: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens and their counts, sorted by token; at most MOST_FREQUENT."""
    late = shared.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token", "n").toPandas()
    tokens = late["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], late["n"].to_numpy(np.int64)[order]


def counts_of(found: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each token that is to be ordered last, 0 for the others."""
    if not len(tokens) or not len(found):
        return np.zeros(len(found), np.int64)
    where = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
    return np.where(tokens[where] == found, counts[where], 0)


def first_tokens(found: np.ndarray, edges: np.ndarray, n: np.ndarray, late: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, set, place) of the first tokens of many sets on end: those not ordered last by hash, then the others by count.

    The tokens of set i, sorted, are found[edges[i]:edges[i + 1]]; n is the size of the whole set.
    """
    own = np.repeat(np.arange(len(n)), np.diff(edges))
    ranked = np.lexsort((counts_of(found, *late), own))  # stable: by hash among equals
    place = np.arange(len(found)) - edges[:-1][own]
    first = place < prefix_size(n, percent)[own]
    return ranked[first], own[first], place[first]


def beyond_front(classes: DataFrame, late, percent: int) -> DataFrame:
    """(c, k1, k2) of the classes with so many tokens ordered last that their first tokens reach beyond their front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch, "front"):
                found, edges = unpacked(part.column("front"))
                n = part.column("n").to_numpy(zero_copy_only=False)
                early = np.concatenate(([0], np.cumsum(counts_of(found, *late.value) == 0)))[edges]
                reach = (np.diff(early) < prefix_size(n, percent)) & (np.diff(edges) < n)
                yield part.select(["c", "k1", "k2"]).filter(pa.array(reach))

    return written(classes.select("c", "k1", "k2", "n", "front").mapInArrow(run, "c long, k1 long, k2 long"), "beyond")


def whole_first_tokens(docs: DataFrame, wanted: DataFrame, classes: DataFrame, late, width: int, percent: int) -> DataFrame:
    """(c, n, tokens, places): the first tokens of the classes ``wanted`` (c, k1, k2), from their whole texts."""
    chosen = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "k1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch.filter(pa.array(hits(chosen.value, batch.column("k1").to_numpy(zero_copy_only=False))))):
                sets = list(shingle_sets(part.column("text"), width))
                n, rows = np.array([len(x) for x in sets]), []
                for found in sets:
                    index, _, place = first_tokens(found, np.array([0, len(found)]), np.array([len(found)]), late.value, percent)
                    rows.append((found[index].view(np.int64), place))
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(n), *[pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (0, 1)]], ["k1", "k2", "n", "tokens", "places"])

    rows = docs.select(*row_keys(), "text").mapInArrow(run, "k1 long, k2 long, n long, tokens array<long>, places array<long>")
    out = written(gathered(rows.join(wanted, ["k1", "k2"]).dropDuplicates(["c"]).select("c", "n", "tokens", "places"), classes), "whole-first-tokens")
    chosen.destroy()
    return out


def forest(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(token, c, n, room, size): the trees, a row for each class of each; ``room`` is the most overlap left from the token on.

    Any order of tokens gives the same links. A token is left out only where no other class has it among its first ones: the
    classes that reach beyond what was counted are looked through before.
    """
    spark = docs.sparkSession
    shared = shared_tokens(classes)
    late = spark.sparkContext.broadcast(ordered_last(shared))
    beyond = beyond_front(classes, late, percent)
    far = whole_first_tokens(docs, beyond, classes, late, width, percent)
    far_rows = far.select("c", "n", F.explode(F.arrays_zip("tokens", "places")).alias("x")).select(F.col("x.tokens").alias("token"), "c", "n", (F.col("n") - F.col("x.places")).alias("room"))
    bits = spark.sparkContext.broadcast(bit_filter(shared.select("token").unionByName(far_rows.select("token")), "token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch, "front"):
                found, edges = unpacked(part.column("front"))
                n, c = (part.column(x).to_numpy(zero_copy_only=False) for x in ("n", "c"))
                index, own, place = first_tokens(found, edges, n, late.value, percent)
                tokens = found[index]
                keep = hits(bits.value, tokens)
                tokens, own, place = tokens[keep], own[keep], place[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens.view(np.int64), c[own], n[own], n[own] - place)], ["token", "c", "n", "room"])

    within = classes.select("c", "n", "front").join(beyond.select("c"), "c", "left_anti").mapInArrow(run, "token long, c long, n long, room long")
    roots = written(within.unionByName(far_rows), "first-tokens")
    late.destroy()
    bits.destroy()
    trees = written(gathered(grown(roots), roots), "trees")
    dropped(shared, beyond, far, roots)
    return trees


def grown(roots: DataFrame) -> DataFrame:
    """The rows of roots (token, c and others) under tokens of two classes or more, with the ``size`` of the tree."""
    return roots.join(roots.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "token")


def near_enough(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def has_room(most: Column, sizes: Column, percent: int) -> Column:
    """Whether an overlap of ``most`` is enough for two sets of ``sizes`` together."""
    return (100 + percent) * most >= percent * sizes


def can_overlap(x: str, y: str, percent: int) -> Column:
    """Whether the bitmaps under aliases x and y leave room for a link: common bits, and tokens that share a bit with another.

    ``low`` and ``high`` are the range of sizes, ``slack`` the most tokens of one set that share a bit with another.
    """
    common = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseAND(F.col(f"{y}.{b}"))) for b in BITS[1:]), F.bit_count(F.col(f"{x}.b0").bitwiseAND(F.col(f"{y}.b0"))))
    return has_room(common + F.least(f"{x}.slack", f"{y}.slack"), F.col(f"{x}.low") + F.col(f"{y}.low"), percent)


def leaves(classes: DataFrame) -> DataFrame:
    """(c, b0.., low, high, slack): a class as a leaf of a tree."""
    pop = sum((F.bit_count(b) for b in BITS[1:]), F.bit_count("b0"))
    return classes.select("c", *BITS, F.col("n").alias("low"), F.col("n").alias("high"), (F.col("n") - pop).alias("slack"))


def leaf_pairs(trees: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of classes in trees of one leaf that may be linked."""
    small = trees.filter(F.col("size") <= LEAF).select("token", "c", "n", "room")
    x, y = small.alias("x"), small.alias("y")
    on = [F.col("x.token") == F.col("y.token"), F.col("x.c") < F.col("y.c"), near_enough(F.col("x.n"), F.col("y.n"), percent), has_room(F.least("x.room", "y.room"), F.col("x.n") + F.col("y.n"), percent)]
    pairs = x.join(y, on).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
    ends = leaves(classes)
    one = pairs.join(ends.withColumnRenamed("c", "a"), "a").alias("x")
    both = one.join(ends.withColumnRenamed("c", "b").alias("y"), [F.col("x.b") == F.col("y.b"), can_overlap("x", "y", percent)])
    return both.select("x.a", "x.b")


def packed_texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(c, packed, size): the compressed text of one document of each of the classes ``wanted`` (c, k1, k2)."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "k1"))

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(hits(bits.value, batch.column("k1").to_numpy(zero_copy_only=False))))
            packed = [pa.compress(x.encode(), codec="zstd", asbytes=True) for x in own.column("text").to_pylist()]
            sizes = pc.binary_length(own.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([own.column("k1"), own.column("k2"), pa.array(packed, pa.binary()), sizes], ["k1", "k2", "packed", "size"])

    texts = docs.filter("text is not null").select(*row_keys(), "text").mapInArrow(carried, "k1 long, k2 long, packed binary, size long")
    out = written(gathered(texts.join(wanted, ["k1", "k2"]).dropDuplicates(["c"]).select("c", "packed", "size"), classes), "texts")
    bits.destroy()
    return out


def text_of(packed: bytes, size: int) -> pa.Array:
    """A packed text as an array of one."""
    return pa.array([pa.decompress(packed, size, codec="zstd", asbytes=True).decode()], pa.large_string())


def linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough, compared set by set; the sets are made from the texts."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for a, b, pa_, pb, sa, sb in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "pa", "pb", "sa", "sb")], strict=True):
                if a not in held:  # rows mostly come sorted by a
                    held = {a: next(shingle_sets(text_of(pa_, sa), width))}
                x, y = held[a], next(shingle_sets(text_of(pb, sb), width))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    bits = texts.sparkSession.sparkContext.broadcast(bit_filter(pairs.select(F.explode(F.array("a", "b")).alias("c")), "c"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(bits.value, batch.column("c").to_numpy(zero_copy_only=False))))

    own = texts.mapInArrow(asked, texts.schema)  # of the texts only those of the pairs are shuffled
    one = pairs.join(own.select(F.col("c").alias("b"), F.col("packed").alias("pb"), F.col("size").alias("sb")), "b")
    both = one.join(own.select(F.col("c").alias("a"), F.col("packed").alias("pa"), F.col("size").alias("sa")), "a")
    both = gathered(both.select("a", "b", "pa", "pb", "sa", "sb"), pairs, file_bytes=PAIR_BYTES)
    out = written(both.mapInArrow(compared, "a long, b long"), "class-links")
    bits.destroy()
    return out


def second_forest(texts: DataFrame, crowded: DataFrame, width: int, percent: int) -> DataFrame:
    """(token, c, n, room, share, size): the trees of the classes ``crowded`` (c), their tokens ordered by exact counts, rarest first.

    ``share`` is the part of a class's tokens that others of them have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, packed, size in zip(*[batch.column(x).to_pylist() for x in ("c", "packed", "size")], strict=True):
                found = next(shingle_sets(text_of(packed, size), width))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), c)), pa.array(np.full(len(found), len(found)))], ["token", "c", "n"])

    tokens = written(texts.join(crowded, "c").mapInArrow(run, "token long, c long, n long"), "crowded-tokens")
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = tokens.join(counted, "token").groupBy("c").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("m", "token"))).alias("held"))
    alone = F.col("n") - F.size("held")
    shared = shared.withColumn("prefix", F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1)
    first = F.slice("held", F.lit(1), F.greatest(F.col("prefix") - alone, F.lit(0)).cast("int"))
    rows = shared.select("c", "n", alone.alias("alone"), (F.size("held") / F.col("n")).alias("share"), F.posexplode(first).alias("at", "x"))
    rows = rows.select("x.token", "c", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("room"), "share")
    rows = written(gathered(rows, tokens), "crowded-first-tokens")
    trees = written(gathered(grown(rows), rows), "crowded-trees")
    dropped(tokens, rows)
    return trees


def spokes(trees: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class b and the hub a of most trees that it is in; the hub of a tree is the class of which others share most."""
    hubs = trees.groupBy("token").agg(F.max(F.struct("share", F.col("c").alias("hub"), F.col("n").alias("m"))).alias("x")).select("token", "x.hub", "x.m")
    common = trees.join(hubs, "token").filter(F.col("c") != F.col("hub")).groupBy("c", "hub").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    best = common.filter(near_enough(F.col("n"), F.col("m"), percent)).groupBy("c").agg(F.max(F.struct("k", "hub"))["hub"].alias("hub"))
    return best.select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct()


def nodes_of(members: DataFrame, *by: str) -> DataFrame:
    """The nodes of one level: OR of bitmaps, range of sizes and of components, most room."""
    return members.groupBy(*by).agg(*[F.bit_or(b).alias(b) for b in BITS], F.min("low").alias("low"), F.max("high").alias("high"), F.max("slack").alias("slack"), F.max("room").alias("room"), F.min("comp0").alias("comp0"), F.max("comp1").alias("comp1"))


def may_link(percent: int) -> list[Column]:
    """Whether two nodes, aliases x and y, may hold a link between different components."""
    near = (100 * F.col("y.high") >= percent * F.col("x.low")) & (100 * F.col("x.high") >= percent * F.col("y.low"))
    mixed = ~((F.col("x.comp0") == F.col("y.comp1")) & (F.col("x.comp1") == F.col("y.comp0")))
    return [near, mixed, has_room(F.least("x.room", "y.room"), F.col("x.low") + F.col("y.low"), percent), can_overlap("x", "y", percent)]


def walked(trees: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of classes in different components that the dual walk of every tree leaves over.

    Levels: token, range of size, finer range of size and of room with the component (those of one class together), class.
    """
    sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
    named = trees.join(labels.join(sizes, "comp").select(F.col("node").alias("c"), "comp"), "c", "left").select("token", "c", "n", "room", F.coalesce("comp", "c").alias("comp"), F.coalesce("comp", F.lit(-1)).alias("own"))
    mixed = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    step = lambda x, ratio: F.floor(F.log(x.cast("double")) / F.log(F.lit(ratio))).cast("int")
    held = named.join(mixed, "token").join(leaves(classes), "c").select(
        "token", "c", *BITS, "low", "high", "slack", "room", F.col("comp").alias("comp0"), F.col("comp").alias("comp1"), "own",
        step(F.col("n"), 100.0 / percent).alias("cell"), step(F.col("n"), STEP).alias("fine"), step(F.greatest("room", F.lit(1)), STEP).alias("left"),
    )
    held = written(gathered(held.withColumn("node", F.xxhash64("token", "cell", "fine", "left", "own")), trees), "tree-leaves")
    cells = nodes_of(held, "token", "cell").alias("x")
    upper = cells.join(cells.alias("y"), [F.col("x.token") == F.col("y.token"), F.col("y.cell").isin(F.col("x.cell"), F.col("x.cell") + 1), *may_link(percent)])
    upper = upper.select("x.token", F.col("x.cell").alias("cell"), F.col("y.cell").alias("next"))
    groups = written(gathered(nodes_of(held, "token", "cell", "node"), held), "tree-nodes")
    x, y = groups.join(upper, ["token", "cell"]).alias("x"), groups.alias("y")
    on = [F.col("x.token") == F.col("y.token"), F.col("x.next") == F.col("y.cell"), (F.col("x.cell") < F.col("y.cell")) | (F.col("x.node") <= F.col("y.node")), *may_link(percent)]
    middle = x.join(y, on).select("x.token", F.col("x.node").alias("from"), F.col("y.node").alias("to"))
    left = held.withColumnRenamed("node", "from").join(middle, ["token", "from"]).alias("x")
    found = left.join(held.alias("y"), [F.col("x.token") == F.col("y.token"), F.col("x.to") == F.col("y.node"), F.col("x.c") != F.col("y.c"), *may_link(percent)])
    out = written(found.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct(), "pairs")
    dropped(held, groups)
    return out


def similarity_classes(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(_id, k1, k2, n, c) of all documents, and (node, comp) of the classes that have links; all is written within."""
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return _similarity_classes(docs, width, percent)


def _similarity_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    signed = written(signatures(docs, width, percent), "signatures")
    classes = classes_of(signed)
    rows = signed.select("_id", "k1", "k2", "n", "digest").join(classes.select("digest", "c"), "digest", "left").drop("digest")
    rows = written(gathered(rows, signed), "rows")
    dropped(signed)
    trees = forest(docs, classes, width, percent)
    near = written(leaf_pairs(trees, classes, percent), "leaf-pairs")
    crowded = written(gathered(trees.filter(F.col("size") > LEAF).select("c").distinct(), trees), "crowded")
    wanted = near.select(F.explode(F.array("a", "b")).alias("c")).unionByName(crowded).distinct()
    wanted = written(gathered(classes.select("c", "k1", "k2").join(wanted, "c"), classes), "wanted")
    texts = packed_texts(wanted, classes, docs)
    deep = second_forest(texts, crowded, width, percent)
    tried = written(gathered(near.unionByName(spokes(deep, percent)).distinct(), near, deep), "tried")
    links = linked(tried, texts, width, percent)
    labels = components(links, made_from=(links,))
    dropped(trees, near, crowded, wanted, tried)
    rest = walked(deep, labels, classes, percent)
    more = linked(rest, texts, width, percent)
    found = components(links.unionByName(more), labels, (links, more))
    dropped(deep, texts, classes, rest, links, more, labels)
    return rows, found


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id) of every row of docs (doc_id, text)."""
    signed, labels = similarity_classes(docs, width, percent)
    rows = signed.join(labels.select(F.col("node").alias("c"), "comp"), "c", "left").select("_id", "k1", "k2", "n", F.coalesce("comp", "c").alias("comp"))
    least = rows.filter("comp is not null").groupBy("comp").agg(F.min("_id").alias("component_id"))
    named = rows.join(least, "comp", "left")
    return named.select(F.col("_id").alias("doc_id"), "k1", "k2", F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"), "comp")


def one_of_each(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without all but one of each group of near duplicates: the one with the smallest id stays.

    Documents without shingles all stay; of rows that are equal in id and text, one stays.
    """
    found = near_duplicates(docs, width, percent)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2").alias("_rank")
    stay = found.filter("n_shingles > 0").groupBy("comp").agg(F.min(rank).alias("_rank")).select("_rank.k1", "_rank.k2")
    stay = written(stay.unionByName(found.filter("n_shingles = 0").select("k1", "k2")).distinct(), "survivors").withColumnsRenamed({"k1": "_1", "k2": "_2"})
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *[k.alias(f"_k{i}") for i, k in enumerate(row_keys())])
    kept = keyed.join(stay, (F.col("_k0") == F.col("_1")) & (F.col("_k1") == F.col("_2")), "left_semi")
    first = F.row_number().over(Window.partitionBy("_k0", "_k1").orderBy(F.lit(0)))
    return kept.withColumn("_n", first).filter("_n = 1").select("_row.*")
