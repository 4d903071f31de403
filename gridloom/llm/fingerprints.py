"""Document fingerprints: every shingle hash below a fixed share of all hashes, so that sketches of any two documents can be compared and merged."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import filled, written

#: Words of a shingle, and the share of all hashes that is retained: one of so many.
WIDTH, ONE_OF = 5, 4
SEED = 42
#: Ranges of the order of documents for each partition of a shuffle, and rows of the sample for each range.
RANGES, SAMPLED = 4, 20
#: A retained hash is kept by its first 36 bits, as nine hex digits.
KEPT_BITS = 36
DIGITS = KEPT_BITS // 4
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str, width: int = WIDTH) -> Iterator[bytes]:
    """Runs of ``width`` words, joined by spaces; of fewer words the whole sequence; none without words. A-Z count as lower case."""
    words = WORDS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    for i in range(max(1, len(words) - width + 1)):
        yield line[starts[i] : ends[min(i + width, len(words)) - 1]]


def sketch(text: str, one_of: int = ONE_OF, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes below 2**64 / ``one_of``, cut to KEPT_BITS, ascending.

    Where none is below, the least hash stays, so that only texts without a word have an empty sketch; ``merged`` drops it again
    once a smaller one is there, so the sketch of a union is the merge of the sketches.
    """
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text, width)], dtype=np.uint64)
    return within(np.unique(hashes >> np.uint64(64 - KEPT_BITS)), one_of)


def within(values: np.ndarray, one_of: int = ONE_OF) -> np.ndarray:
    return values[: max(int(np.searchsorted(values, -(-(1 << KEPT_BITS) // one_of))), min(1, len(values)))]


def merged(a: np.ndarray, b: np.ndarray, one_of: int = ONE_OF) -> np.ndarray:
    """The sketch of all that either document has."""
    return within(np.union1d(a, b), one_of)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller sketch that the larger has, however unequal they are; two empty ones are alike, an empty one is like no other."""
    small = min(len(a), len(b))
    return shared(a, b) / small if small else float(len(a) == len(b))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """What both have, as a share of what either has."""
    both = shared(a, b)
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def encoded(values: np.ndarray) -> str:
    return "".join(f"{v:0{DIGITS}x}" for v in values.tolist())


def decoded(text: str) -> np.ndarray:
    return np.array([int(text[i : i + DIGITS], 16) for i in range(0, len(text), DIGITS)], dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_of: int = ONE_OF, width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, fingerprint. Null counts as the empty text, whose fingerprint is empty; other columns are not read."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([encoded(sketch(t, one_of, width)) for t in texts], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), run(filled(text_col)).alias("fingerprint"))


def compared(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with containment and resemblance of the fingerprints in columns ``a`` and ``b``; a null is an empty one."""

    @F.pandas_udf("containment double, resemblance double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            both = [(decoded(x), decoded(y)) for x, y in zip(left, right, strict=True)]
            yield pd.DataFrame({"containment": [containment(*p) for p in both], "resemblance": [resemblance(*p) for p in both]}, dtype=float)

    once = run.asNondeterministic()
    rest = [c for c in pairs.columns if c not in ("containment", "resemblance")]
    return pairs.select(*rest, once(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))).alias("__likeness")).select(*rest, "__likeness.*")


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by as many, or all there are, of the beginning of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "resemblance_edited", "resemblance_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, resemblance_edited double, resemblance_next double"


def edit_row(doc_id: object, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    """A document's result, given the next one and both sketches."""
    changed = edited(text, following)
    new = sketch(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), sha, encoded(own), encoded(new), containment(own, new), containment(own, other), resemblance(own, new), resemblance(own, other))


def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of a sorted partition (range, extra, doc_id, text): a row is finished when the next one of its range comes. An extra row is the next
    of a range's last one, and is no row of the range itself."""
    last = at = None
    for frame in batches:
        out = []
        for now, extra, i, text in zip(frame["range"], frame["extra"], frame["doc_id"].astype(object), frame["text"], strict=True):
            if now != at:
                at, last = now, None
            if extra and last is None:
                continue
            own = sketch(text)
            if last is not None:
                out.append(edit_row(*last, text, own))
            last = None if extra else (None if pd.isna(i) else int(i), text, own)
        frame = pd.DataFrame(out, columns=RESULT)
        yield frame.astype({"doc_id": "Int64", "n_chars": "Int64", **dict.fromkeys(RESULT[5:], "float64")})


class Ranges:
    """Ranges of the order (none, i, h) of ``keys``, each with some thousands of rows or fewer, and the first row of each.

    A range begins with a row of a sample, whose size is about SAMPLED a range; the sample only says which rows are done together. The driver gets the
    sample, and a row for each range.
    """

    KEY = "struct<none:boolean,i:long,h:long>"

    def __init__(self, keys: DataFrame) -> None:
        number = RANGES * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        picked = F.pmod(F.xxhash64("none", "i", "h"), F.lit(1 << 30)) * F.lit(float(max(1, keys.count()))) < F.lit(float(number * SAMPLED << 30))
        sample = sorted({tuple(r) for r in keys.filter(picked).select("none", "i", "h").collect()})
        self.starts = sample[:: -(-len(sample) // number)][1:] if sample else []
        found = keys.groupBy(self.of(self.key()).alias("range")).agg(F.min(self.key()).alias("first")).orderBy("range").collect()
        self.present = [r["range"] for r in found]
        self.first = [tuple(r["first"]) for r in found]

    @staticmethod
    def key() -> Column:
        return F.struct("none", "i", "h")

    def constant(self, keys: list[tuple]) -> Column:
        """A constant array of keys: one literal, however many there are."""
        return F.from_json(F.lit(json.dumps([{"none": n, "i": i, "h": h} for n, i, h in keys])), f"array<{self.KEY}>")

    def of(self, key: Column) -> Column:
        """The number of starts that are not behind the key, by bisection."""
        starts = self.constant(self.starts)
        half = lambda a: F.shiftright(a["low"] + a["high"], 1)
        before = lambda a: F.get(starts, half(a)) <= key
        inner = lambda a: F.when(a["low"] >= a["high"], a).when(before(a), F.struct((half(a) + 1).alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), half(a).alias("high")))
        rounds = F.sequence(F.lit(0), F.lit(len(self.starts).bit_length()))
        return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.lit(len(self.starts)).alias("high")), lambda a, _: inner(a), lambda a: a["low"])

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` (none, i, h, ...) with range and extra, sorted: each range's first row comes to the range before, as its extra one, too; the
        last range goes before the first."""
        before = [-1] * (max(self.present, default=-1) + 1)
        first: list[tuple] = [(True, 0, 0)] * len(before)
        for k, (at, key) in enumerate(zip(self.present, self.first, strict=True)):
            before[at], first[at] = self.present[k - 1], key
        previous = F.get(F.from_json(F.lit(json.dumps(before)), "array<int>"), F.col("range"))
        head = F.get(self.constant(first), F.col("range")) == self.key()
        own = F.struct(F.col("range").alias("range"), F.lit(False).alias("extra"))
        places = F.when(head, F.array(own, F.struct(previous.alias("range"), F.lit(True).alias("extra")))).otherwise(F.array(own))
        rest = [c for c in rows.columns if c not in ("none", "i", "h")]
        out = rows.withColumn("range", self.of(self.key())).select("none", "i", "h", *rest, F.explode(places).alias("at")).select("at.*", "none", "i", "h", *rest)
        return out.repartition("range").sortWithinPartitions("range", "extra", "none", "i", "h")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: RESULT, of each text, its edited text and the next text in descending order of the id.

    near_edited and near_next are containments, resemblance_edited and resemblance_next the shares of the union. Null counts as the empty
    text. Null ids come last; rows of one id rank by a hash of the text, equal rows anyhow. After the last row comes the first, so a single row is
    its own next. Other columns are not read. An empty table gives an empty result.

    Whole rows are shuffled once, by ranges of the order, and walked in order; the first row of each range goes to the range before as well. Rows equal in
    id and text are in one range.
    """
    doc_id = F.col(id_col).cast("long")
    # ~id falls where the id rises, over all longs
    order = {"none": doc_id.isNull(), "i": F.bitwise_not(F.coalesce(doc_id, F.lit(0))), "h": F.xxhash64(filled(text_col))}
    keys = written(docs.select(*[c.alias(n) for n, c in order.items()]), "keys")
    rows = docs.select(*[c.alias(n) for n, c in order.items()], doc_id.alias("doc_id"), filled(text_col).alias("text"))
    return Ranges(keys).dealt(rows).select("range", "extra", "doc_id", "text").mapInPandas(along, SCHEMA)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
