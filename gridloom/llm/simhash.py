"""Near duplicates by SimHash: covering masks find every pair of fingerprints within the radius."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import filled, written

BITS = 64
#: Fingerprints in a bucket that are compared with one another in one call; larger buckets are masked further.
BUCKET = 256
#: Free bits from which buckets are compared whatever their size.
FREE = 10
#: Buckets, of 12 bytes each, that are given to every task.
BROADCAST = 100_000
LANES = np.uint64(0x0101010101010101)
#: Candidates of near duplicates: fingerprints of single words, without those that make up this share of all words (at most
#: 1 / COMMON_SHARE words), of so many differing bits. See ``repeated_rows``.
COMMON_SHARE, CANDIDATE_RADIUS = 0.003, 5
#: Share of a text's words that must be left without the common ones; else all count, so that one word doesn't make a fingerprint.
RARE_LEAST = 0.1
#: Words of a shingle and similarity (shared of all distinct shingles) from which two texts are near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Least shingle hashes by which texts of one fingerprint meet, besides the first of them.
LANES_OF_TWINS = 4
#: Least shingle hashes that two texts are compared by first. Texts of 0.8 share fewer than half of these once in 10**8.
SKETCH = 64
#: Bits of a filter of the rows that occur in candidates: it only spares others the way.
FILTER_BITS = 1 << 23
#: Distinct words that a task counts before it passes them on.
FLUSH = 500_000


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The text's SimHash as an unsigned number; 0 if it has no word."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    runs = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))) if len(words) >= width else [b" ".join(words)]
    n = len(runs)
    h = np.zeros(-(-n // 255) * 255, dtype=np.uint64)
    h[:n] = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), dtype=np.uint64, count=n)
    h = h.reshape(-1, 255)  # a byte holds the sum of 255 bits
    sums = np.stack([np.add.reduce(h >> np.uint64(i) & LANES, axis=1).astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64) for i in range(8)])
    ones = np.flatnonzero((sums.T.reshape(-1)) * 2 > n)  # lane j, bit i is bit 8 j + i
    return sum(1 << int(b) for b in ones)


def fingerprints(text: Column, width: int, seed: int) -> Column:
    """Fingerprints as signed longs."""

    @F.pandas_udf("long")
    def computed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, width, seed) for t in batch], dtype=np.uint64).astype(np.int64))

    return computed(text)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """2**(radius + 1) - 1 masks over ``positions``; any ``radius`` positions are all unset in at least one of them.

    Each position has a non-zero vector of radius + 1 bits, and each mask a non-zero vector too: the mask has the
    positions whose vector's scalar product with its own is odd. The vectors of ``radius`` positions don't span the space,
    so some mask's vector is orthogonal to all of them. All positions' vectors have the highest bit and are spread over the
    others, so a mask has about half of the positions, or all.
    """
    half = 1 << radius
    step = int(half * 0.618) | 1
    vectors = [half | k * step % half for k in range(len(positions))]
    return [sum(1 << p for p, v in zip(positions, vectors, strict=True) if (u & v).bit_count() % 2) for u in range(1, 2 * half)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def nearest_forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of places in ``x`` that connect all fingerprints within the radius of one another, by the nearest pairs (Prim's tree without longer edges)."""
    apart = np.bitwise_count(x[:, None] ^ x[None, :])
    best, by, out, at = apart[0].copy(), np.zeros(len(x), dtype=np.int64), [], 0
    best[0] = 255
    open_ = np.arange(len(x)) > 0
    for _ in range(len(x) - 1):
        at = int(best.argmin())
        if best[at] <= radius:
            out.append((int(by[at]), at))
        open_[at] = False
        best[at] = 255
        closer = open_ & (apart[at] < best)
        best[closer] = apart[at][closer]
        by[closer] = at
    return out


def bucket_links(radius: int) -> Column:
    """Of an array of fingerprints, the nearest pairs that connect all that are within the radius of one another, through others too."""

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def linked(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            x = np.sort(np.asarray(group, dtype=np.int64))
            out.append([{"a": int(x[i]), "b": int(x[j])} for i, j in nearest_forest(x.view(np.uint64), radius)])
        return pd.Series(out)

    return linked


def sized(buckets: DataFrame, most: int = BROADCAST) -> DataFrame:
    """``buckets`` (table, key) with a hint for the join with all rows: broadcast if there are at most ``most``, else merged. Left to
    itself, Spark takes the exploded rows for small, as it doesn't count what an explode adds."""
    return F.broadcast(buckets) if buckets.limit(most + 1).count() <= most else buckets.hint("merge")


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` of ``prints`` whose closure connects every pair within the radius.

    Each fingerprint goes to one bucket per covering mask. A bucket of two is compared at once; one of up to BUCKET
    is compared in an array and yields no more links than it has members; a larger one is dealt out anew by covering
    masks over the bits that its mask leaves free. Every level leaves fewer bits free (half of them or less at radius 3), and
    where FREE bits are left, a bucket can't hold more than 2**FREE fingerprints and is compared: no pair is lost and
    no bucket, however hot, has its pairs listed.
    """
    masks = covering_masks(list(range(BITS)), radius)
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that few bytes are still dealt to many tasks: each row becomes one per mask
    rows = prints.repartition(spread, "fp").select("fp", F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("table", "mask")).withColumn("table", F.col("table").cast("long"))
    least, found = min(m.bit_count() for m in masks), None
    while True:
        most = BUCKET if least < BITS - FREE else 1 << FREE
        rows = rows.select("fp", "table", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = written(rows.groupBy("table", "mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets")
        two = sizes.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
        members = rows.join(sized(sizes.filter(f"n between 3 and {most}").select("table", "key")), ["table", "key"]).groupBy("table", "key").agg(F.collect_list("fp").alias("fps"))
        some = members.select(F.explode(bucket_links(radius)("fps")).alias("l")).select("l.a", "l.b")
        found = two.union(some) if found is None else found.union(two).union(some)
        large = sizes.filter(f"n > {most}").select("table", "mask", "key")
        if large.isEmpty():
            return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        # only tables with a large bucket get masks of a further level, each made once
        tables = written(large.select("table", "mask").distinct().select("table", finer(radius)("mask").alias("masks")), "tables")
        least = tables.select(F.min(F.array_min(F.transform("masks", F.bit_count)))).first()[0]
        hot = rows.join(sized(large.select("table", "key")), ["table", "key"]).select("fp", "table")
        further = hot.join(sized(tables, BROADCAST // len(masks)), "table").select("fp", "table", F.posexplode("masks").alias("k", "mask"))
        rows = further.select("fp", (F.col("table") * (len(masks) + 1) + F.col("k") + 1).alias("table"), "mask")


def finer(radius: int) -> Column:
    """Of a mask, those of the next level: it with each covering mask over the bits that it leaves free."""

    @F.pandas_udf("array<long>")
    def made(masks: pd.Series) -> pd.Series:
        out = []
        for m in masks.tolist():
            m &= (1 << BITS) - 1
            free = [p for p in range(BITS) if not m >> p & 1]
            out.append([signed(m | x) for x in covering_masks(free, radius)])
        return pd.Series(out)

    return made


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs`` (a, b): root is the smallest node reachable.

    Each node hooks to its least neighbour if that is smaller, hooks are followed to their ends, and the pairs are rewritten to
    those ends, without the ones that have met. At most half of the nodes are left for the next round, so all rounds together
    take as many rows as a few times the first. Every table is written to the shared folder.
    """
    edges = written(pairs.select("a", "b").filter("a != b").distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "ends")
        while True:
            far = ends.select(F.col("node").alias("root"), F.col("root").alias("far"))
            jumped = written(ends.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "ends")
            if jumped.filter("moved").isEmpty():
                break
            ends = jumped.select("node", "root")
        rounds.append(ends)
        left = edges.join(ends.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(ends.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = written(left.filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = rounds[0]
    for later in rounds[1:]:
        later = later.select(F.col("node").alias("root"), F.col("root").alias("far"))
        labels = written(labels.join(later, "root", "left").select("node", F.coalesce("far", "root").alias("root")), "labels")
    return labels


def named_prints(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of ``rows`` (doc_id, fp); ``root`` names the component."""
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reached = components(links(prints.select("fp"), radius))
    prints = prints.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = prints.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(roots, "root").select("fp", "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Fingerprints of up to ``radius`` differing bits link. Null counts as empty; texts without a word have fingerprint
    zero and link like any other. Texts of fewer than ``width`` words have one shingle, the whole sequence.
    Only distinct fingerprints are compared, so copies cost nothing. Null ids take part; a component has a null id only if
    none of its rows has one. Repeated rows repeat in the result; other columns are not read.
    """
    rows = written(docs.select(F.col(id_col).alias("doc_id"), fingerprints(filled(text_col), width, seed).alias("fp")), "prints")
    return rows.join(named_prints(rows, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def common_words(texts: DataFrame, share: float) -> np.ndarray:
    """Sorted hashes of the words that make up ``share`` of all words of ``texts`` (text): at most 1 / share of them."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(text.encode().lower().split())
                if len(counts) > FLUSH:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)

    def table(counts: Counter[bytes]) -> pd.DataFrame:
        words = np.fromiter(map(xxhash.xxh64_intdigest, counts), dtype=np.uint64, count=len(counts))
        own = pd.DataFrame({"word": words.view(np.int64), "n": np.fromiter(counts.values(), dtype=np.int64, count=len(counts))}).astype({"word": "Int64"})
        return pd.concat([own, pd.DataFrame({"word": pd.array([None], dtype="Int64"), "n": [counts.total()]})])  # no word: all of them

    sums = texts.mapInPandas(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    most = sums.orderBy(F.desc("n")).limit(int(1 / share) + 1).collect()
    total = next((r.n for r in most if r.word is None), 0)
    return np.sort(np.array([r.word for r in most if r.word is not None and r.n >= share * total], dtype=np.int64).view(np.uint64))


def word_fingerprint(text: str, common: np.ndarray) -> int:
    """SimHash of the text's words, repeats included, without the common ones where the others make up RARE_LEAST of them; 0 if it has no word."""
    counts = Counter(text.encode().lower().split())
    if not counts:
        return 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, counts), dtype=np.uint64, count=len(counts))
    n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    rare = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h if len(common) else np.ones(len(h), dtype=bool)
    if n[rare].sum() >= RARE_LEAST * n.sum():
        h, n = h[rare], n[rare]
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # little-endian: bit i of the number stands at i
    ones = n.astype(np.float64) @ bits.astype(np.float64) * 2 > n.sum()
    return sum(1 << int(i) for i in np.flatnonzero(ones))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``width`` words; the whole sequence where it is shorter, none without a word."""
    words = text.encode().lower().split()
    runs = set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))) if len(words) >= width else {b" ".join(words)} if words else set()
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, runs), dtype=np.uint64, count=len(runs)))


def may_be_alike(a: np.ndarray, na: int, b: np.ndarray, nb: int, least: float) -> bool:
    """Whether two texts with ``na`` and ``nb`` shingles, of which ``a`` and ``b`` are the least, can share ``least`` of all; see SKETCH."""
    if min(na, nb) < least * max(na, nb):
        return False
    both = np.union1d(a, b)[:SKETCH]
    return not len(both) or np.isin(both, np.intersect1d(a, b, assume_unique=True)).sum() * 2 >= len(both)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared of all distinct shingles; texts without a word are alike."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def shingle_sets(rows: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(row, n, sketch, set): sorted distinct shingle hashes of the texts of ``asked`` (row), their number and the SKETCH least of them.

    A bit filter of fixed size tells tasks which rows are asked for, so texts are not shuffled; a few others pass it, which does no harm.
    """
    place = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    words = asked.select(F.shiftright(place, 6).alias("word"), (place % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["place"].to_numpy(np.int64)
            batch = batch[(shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
            sets = [shingles(t, width) for t in batch["text"]]
            yield pd.DataFrame({"row": batch["row"].to_numpy(), "n": [len(x) for x in sets], "sketch": [x[:SKETCH].tobytes() for x in sets], "set": [x.tobytes() for x in sets]})

    return rows.select("row", place.alias("place"), "text").mapInPandas(taken, "row long, n int, sketch binary, set binary")


def repeated_rows(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """(row_col): the rows of ``docs`` to drop so that one of each group of near duplicates stays, the one of the smallest id.

    Near duplicates share ``least`` of their distinct shingles of ``width`` words; groups are closed over such links, and every
    link that counts has been checked on both texts' whole shingle sets. The covering masks find the candidates: texts of
    ``least`` differ in one word of fifty or fewer where edits are scattered, so fingerprints of single words are near, and they tell texts
    apart once the few commonest words, which all texts of a language share, are left out. Of the test documents' pairs of 0.8 or more,
    nine of ten or more lie within the radius. Of the candidates in a bucket the nearest pairs that connect them are checked, so there are
    no more links than fingerprints in it, whatever its size. Texts of equal fingerprint are checked with the first of them and with the first that
    shares one of their LANES_OF_TWINS least shingle hashes. ``row_col`` holds unique keys, so ids may be null or
    repeat: rows with an id stay before those without, of equal ids the smallest key stays. Null texts are empty and
    alike; an empty table gives an empty result.
    """
    rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("doc_id"), filled(text_col).alias("text"))
    common = common_words(rows.select("text"), COMMON_SHARE)

    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([word_fingerprint(t, common) for t in texts], dtype=np.uint64).astype(np.int64))

    prints = written(rows.select("row", printed("text").alias("fp")), "prints")
    firsts = written(prints.groupBy("fp").agg(F.min("row").alias("first"), F.count("*").alias("n")), "firsts")
    near = links(firsts.select("fp"), CANDIDATE_RADIUS)
    near = near.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    twins = prints.join(firsts.filter("n > 1"), "fp").select("row", "fp", "first")
    near = written(near.union(twins.filter("row != first").select("first", "row")), "near")

    sets = written(shingle_sets(rows, near.select(F.col("x").alias("row")).union(near.select("y")), width), "shingles", "lz4")
    lanes = F.transform(F.sequence(F.lit(0), F.lit(LANES_OF_TWINS - 1)), lambda i: F.substring(F.col("sketch"), i * 8 + 1, F.lit(8)))
    placed = sets.select("row", "sketch").join(twins.select("row", "fp"), "row").select("row", "fp", F.explode(F.filter(lanes, lambda x: F.octet_length(x) > 0)).alias("value"))
    meet = placed.groupBy("fp", "value").agg(F.min("row").alias("x"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = near.union(placed.join(meet, ["fp", "value"]).filter("x != row").select("x", F.col("row").alias("y"))).distinct()

    numbers = lambda b: np.frombuffer(b, dtype=np.uint64)

    @F.pandas_udf("boolean")
    def possible(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([may_be_alike(numbers(p), m, numbers(q), n, least) for p, m, q, n in zip(a, na, b, nb, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(numbers(p), numbers(q)) >= least for p, q in zip(a, b, strict=True)], dtype=bool)

    # sizes and least hashes settle most pairs; whole sets only travel for the others
    named = lambda k, *cols: sets.select(F.col("row").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in cols])
    both = pairs.join(named("x", "n", "sketch"), "x").join(named("y", "n", "sketch"), "y")
    pairs = written(both.filter(possible("sketch_x", "n_x", "sketch_y", "n_y")).select("x", "y"), "possible")
    both = pairs.join(named("x", "set"), "x").join(named("y", "set"), "y")
    groups = components(written(both.filter(alike("set_x", "set_y")).select(F.col("x").alias("a"), F.col("y").alias("b")), "alike"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    members = groups.select(F.col("node").alias("row"), "root").join(rows.select("row", "doc_id"), "row")
    kept = members.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.row").alias("row"))
    return members.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(row_col))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
