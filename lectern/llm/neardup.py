"""Near-duplicate texts: fingerprints cut into blocks, joined on blocks, verified by Hamming distance.

A text's fingerprint holds ``SIZE`` minima of its distinct runs of ``k`` words, one under each of as many
hash functions; two texts agree in a component with the probability of their similarity. The fingerprint
is cut into ``SIZE / WIDTH`` blocks. By the pigeonhole principle two fingerprints that differ in fewer
components than there are blocks (20) share a block for sure, as do most pairs above a similarity of two thirds. Below, it is a matter of probability: a pair of similarity s misses all blocks with a probability of
(1 - s^WIDTH)^(SIZE / WIDTH), 0.8 % at 0.6 and 0.16 % at 0.65. Pairs that share a block are kept if their Hamming distance is
within what the threshold allows, and then checked exactly on the sets of runs of their texts, which are
made only for texts of such pairs, told by a Bloom filter of their ids where the texts are read.

Texts with the same set of runs are one class: only the class's smallest id takes part in the join, and
members are added afterwards. A block or key of any size is handled by the sort-merge join, whose skewed
partitions the adaptive planner splits on both sides. Of blocks of more than ``LARGE`` texts (a boilerplate makes
such) the fingerprints travel along, and pairs are verified where they are joined, so that only near pairs are
sent on. Blocks of more than ``HOT`` texts are parted further, by sets of five components: texts that share
little besides the boilerplate rarely meet there (at an agreement of 0.2 one pair in 17), and of the pairs of
similarity 0.65 that share no other block about one in 2,000 misses all sets (of those at 0.6 one in 400).

Defined results: null texts and texts with fewer words than asked take part in nothing; a text with fewer
words than ``k`` has no runs and equals no other; repeated ids count once; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import codepoints as cp
from lectern.llm.bloom import bloom, may_hold
from lectern.plans.stage import written

SIZE, WIDTH = 60, 3
#: Blocks of more texts are verified within the join.
LARGE = 256
#: Of blocks of more texts than this, pairs must agree in one of ``REFINED`` sets of ``DEEP`` components besides.
HOT, REFINED, DEEP = 20_000, 200, 5
_SETS = np.array([np.random.default_rng([7, i]).permutation(SIZE)[:DEEP] for i in range(REFINED)])
_SEEDS = cp.mix(np.arange(1, 2 * SIZE + 1, dtype=np.uint64))
_MULTIPLY, _ADD = _SEEDS[:SIZE] | np.uint64(1), _SEEDS[SIZE:]


def _sketch(k: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in cp.passes(b.column("text")):
                start, end, first = cp.words(p)
                hashed, bound = cp.runs(cp.word_hashes(p, start, end), first, k)
                rows = np.flatnonzero((cp.space_counts(p) >= least_words) & (np.diff(bound) > 0))
                if not len(rows):
                    continue
                # Distinct runs of each text, sorted: 32 bits of hash below the text's place in the pass.
                owner = np.repeat(np.arange(len(bound) - 1, dtype=np.uint64), np.diff(bound))
                distinct = np.unique((owner << np.uint64(32)) | (hashed >> np.uint64(32)))
                bound = np.searchsorted(distinct >> np.uint64(32), np.arange(len(bound), dtype=np.uint64))
                mixed = cp.mix(distinct & np.uint64(0xFFFFFFFF))
                # Texts that are left out have no runs or too few words; those without runs would break reduceat.
                full = np.flatnonzero(np.diff(bound) > 0)
                at = bound[full]
                prints = np.stack([np.minimum.reduceat((mixed * m + a) >> np.uint64(32), at) for m, a in zip(_MULTIPLY, _ADD)], axis=1)
                sums = np.stack([np.add.reduceat(mixed, at), np.bitwise_xor.reduceat(mixed * mixed + mixed, at)], axis=1)
                chosen = np.searchsorted(full, rows)
                prints, sums = prints[chosen], sums[chosen]
                pairs = prints.reshape(len(rows), SIZE // WIDTH, WIDTH)
                block = np.arange(SIZE // WIDTH, dtype=np.uint64)[None, :] + np.uint64(1)
                for w in range(WIDTH):
                    block = cp.mix(block * np.uint64(0xD6E8FEB86659FD93) + pairs[:, :, w])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").slice(p.i, p.j - p.i).take(pa.array(rows)),
                        pa.array(sums[:, 0].view(np.int64)),
                        pa.array(sums[:, 1].view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(pa.array((block >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(-1)), SIZE // WIDTH).cast(pa.list_(pa.int32())),
                        pa.array([x.tobytes() for x in prints.astype(np.uint8)], pa.binary()),
                    ],
                    names=["id", "s1", "s2", "blocks", "print"],
                )

    return run


def _runs(k: int, sent):
    """The distinct runs, as 32-bit hashes, of the texts that the broadcast filter of ids lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = may_hold(sent.value, b.column("id").to_numpy(zero_copy_only=False))
            b = b.take(pa.array(np.flatnonzero(near)))
            for p in cp.passes(b.column("text")):
                start, end, first = cp.words(p)
                hashed, bound = cp.runs(cp.word_hashes(p, start, end), first, k)
                owner = np.repeat(np.arange(len(bound) - 1, dtype=np.uint64), np.diff(bound))
                distinct = np.unique((owner << np.uint64(32)) | (hashed >> np.uint64(32)))
                place = np.arange(len(bound), dtype=np.uint64)
                bound = np.searchsorted(distinct >> np.uint64(32), place).astype(np.int32)
                value = (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bound), pa.array(value))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(p.i, p.j - p.i), lists], names=["id", "runs"])

    return run


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a hot block once for each set of components, under a key of block, set and their values."""
    for b in batches:
        for a in range(0, b.num_rows, 4096):
            part = b.slice(a, 4096)
            n = part.num_rows
            prints = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(n, SIZE).astype(np.uint64)
            block = part.column("block").to_numpy(zero_copy_only=False).view(np.uint64)
            key = cp.mix(block[:, None] + np.arange(1, REFINED + 1, dtype=np.uint64)[None, :])
            for i in range(DEEP):
                key = cp.mix(key * np.uint64(0xD6E8FEB86659FD93) + prints[:, _SETS[:, i]])
            row = pa.array(np.repeat(np.arange(n), REFINED))
            columns = [pa.array(key.ravel().view(np.int64)), part.column("id").take(row), part.column("print").take(row)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "id", "print"])


def _near(most_apart: int):
    """Pairs whose prints differ in no more components than allowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, SIZE) for c in ("print_a", "print_b")]
            rows = pa.array(np.flatnonzero((prints[0] != prints[1]).sum(axis=1) <= most_apart))
            yield pa.RecordBatch.from_arrays([b.column("a").take(rows), b.column("b").take(rows)], names=["a", "b"])

    return run


def _alike(threshold: float):
    """Pairs whose sets of runs have the threshold's similarity, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("runs_a", "runs_b")]
            row = np.arange(b.num_rows, dtype=np.uint64) << np.uint64(32)
            both = np.concatenate([np.repeat(row, m) | b.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint32) for c, m in zip(("runs_a", "runs_b"), n)])
            both.sort()
            shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=b.num_rows)
            similarity = shared / np.maximum(n[0] + n[1] - shared, 1)
            rows = pa.array(np.flatnonzero(similarity >= threshold))
            yield pa.RecordBatch.from_arrays([b.column("a").take(rows), b.column("b").take(rows), pa.array(similarity).take(rows)], names=["a", "b", "similarity"])

    return run


def sketches(df: DataFrame, id_col: str, text_col: str, k: int, least_words: int) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    return rows.mapInArrow(_sketch(k, least_words), "id long, s1 long, s2 long, blocks array<int>, print binary")


def near_duplicates(df: DataFrame, id_col: str = "row_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, least_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """Membership (id, class_id) of every text with runs, and the links (a, b, similarity), a < b, between class ids.

    ``class_id`` is the smallest id with the same set of runs. Every pair of different classes at or above the
    threshold is a link, but for the share named at the head of the module.
    """
    sketched = written(sketches(df, id_col, text_col, k, least_words))
    members = sketched.groupBy("s1", "s2").agg(F.min("id").alias("class_id"))
    members = written(sketched.select("id", "s1", "s2").join(members, ["s1", "s2"]).select("id", "class_id").distinct())
    own = members.filter("id = class_id").select("id")
    # Repeated ids count once.
    classes = written(sketched.select("id", "blocks", "print").join(own, "id", "left_semi").dropDuplicates(["id"]))
    block = (F.shiftleft(F.col("place").cast("long"), 32) + F.col("part")).alias("block")
    exploded = classes.select(F.posexplode("blocks").alias("place", "part"), "id", "print")
    blocks, printed_blocks = exploded.select(block, "id"), exploded.select(block, "id", "print")
    sizes = written(blocks.groupBy("block").count().filter(F.col("count") > LARGE))
    large, very = sizes.select("block"), sizes.filter(F.col("count") > HOT).select("block")
    # The largest distance that a pair at the threshold exceeds once in some ten thousand times.
    spread = (threshold * (1 - threshold) / SIZE) ** 0.5
    most_apart = int(np.ceil(SIZE * min(1.0, 1 - threshold + 3.7 * spread)))
    printed = lambda x: classes.select(F.col("id").alias(x), F.col("print").alias(f"print_{x}"))
    small = blocks.join(large, "block", "left_anti")
    side = lambda x: small.select("block", F.col("id").alias(x)).hint("merge")
    pairs = side("a").join(side("b"), "block").filter("a < b").select("a", "b").distinct()
    pairs = pairs.join(printed("a"), "a").join(printed("b"), "b").select("a", "b", "print_a", "print_b")
    hot = printed_blocks.join(sizes.filter(F.col("count") <= HOT).select("block"), "block", "left_semi")
    parted = printed_blocks.join(very, "block", "left_semi").mapInArrow(_refined, "block long, id long, print binary")
    hot = hot.unionAll(parted)
    hot_side = lambda x: hot.select("block", F.col("id").alias(x), F.col("print").alias(f"print_{x}")).hint("merge")
    hot_pairs = hot_side("a").join(hot_side("b"), "block").filter("a < b").select("a", "b", "print_a", "print_b")
    near = pairs.unionAll(hot_pairs).mapInArrow(_near(most_apart), "a long, b long")
    near = written(near.distinct())
    ids = written(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sent = df.sparkSession.sparkContext.broadcast(bloom(ids))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.filter("id is not null and text is not null")
    runs = written(texts.mapInArrow(_runs(k, sent), "id long, runs array<int>").dropDuplicates(["id"]))
    side = lambda x: runs.select(F.col("id").alias(x), F.col("runs").alias(f"runs_{x}"))
    links = near.join(side("a"), "a").join(side("b"), "b").mapInArrow(_alike(threshold), "a long, b long, similarity double")
    return members, links


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (row_id_a, row_id_b), a < b, of members of one class or of linked classes."""
    m = lambda x: members.select(F.col("class_id").alias(f"class_{x}"), F.col("id").alias(f"id_{x}"))
    several = members.groupBy("class_id").count().filter("count > 1").select(F.col("class_id").alias("class_a"))
    inside = m("a").join(several, "class_a").join(m("b"), F.col("class_a") == F.col("class_b")).filter("id_a < id_b").select("id_a", "id_b")
    across = links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b")).join(m("a"), "class_a").join(m("b"), "class_b").select("id_a", "id_b")
    pairs = inside.unionAll(across)
    return pairs.select(F.least("id_a", "id_b").alias("row_id_a"), F.greatest("id_a", "id_b").alias("row_id_b")).distinct()


def groups(members: DataFrame, links: DataFrame, models: DataFrame) -> DataFrame:
    """Of each text that has a near duplicate: its group (the smallest id), the group's size, and how many links its class has.

    Groups are the connected parts of the links, found by alternating large-star and small-star steps, each
    written to the shared folder. ``models`` (id, model) gives the models each group spans.
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = edges.select(F.explode(F.array("u", "v")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    root = connected(edges)
    placed = members.join(root.withColumnRenamed("id", "class_id"), "class_id", "left").join(degree, "class_id", "left")
    placed = placed.select("id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    size = placed.join(models, "id", "left").groupBy("group_id").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("model")).alias("models"))
    return placed.join(size.filter("rows > 1"), "group_id").select(F.col("id").alias("row_id"), "group_id", "rows", "links", "models")


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of the connected part of each end of the edges (u, v), by large-star and small-star steps until nothing changes."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        # large-star: each neighbour larger than u goes to the smallest of u and its neighbours
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: each neighbour not larger than u goes to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        e = written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
        before = now
