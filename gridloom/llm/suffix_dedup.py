"""Repeated passages: suffixes sorted in two stages, common prefixes of neighbours, every later copy removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import document_rows, written

#: Length of the strings that count as repeats, and of the anchors inside them; both in bytes.
SPAN, ANCHOR = 100, 32
#: Anchors that compete in a string: the one with the least hash is the string's own.
RIVALS = SPAN - ANCHOR + 1
#: Strings of one document handled at once; longer documents are handled in such parts, which overlap by SPAN - 1 bytes.
PART = 1 << 18
#: Items that a task holds before it passes them on.
FLUSH = 1_000_000
#: Bytes of contexts that are sorted together.
SORTED = 1 << 21
#: Routing: an anchor in more than this share of a hash sample (one document in SAMPLE) is hot.
SAMPLE, HOT_SHARE, HOT_LEAST = 32, 0.002, 16

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(32)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = a * M1
    x += b
    x *= M2
    x ^= x >> M3
    return x


LETTERS = mixed(np.arange(1, 257, dtype=np.uint64), np.arange(7, 263, dtype=np.uint64))


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ANCHOR and of the SPAN bytes that begin at each byte, joined from halves."""
    h, by = LETTERS[data], {}
    for width in (1, 2, 4, 8, 16, 32):
        by[width] = h
        h = mixed(h[:-width], h[width:])
    n = len(data) - SPAN + 1
    return by[32], mixed(mixed(h[:n], by[32][64 : 64 + n]), by[4][96 : 96 + n])


def items_of(data: np.ndarray, ends: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Items of joined parts that end at ``ends``: anchor, content, part, first and last start (in the joined bytes).

    Equal strings have equal least anchors at equal places. Neighbouring starts that have the same anchor form an
    item; its content is all bytes its strings cover. Starts with a hot anchor are items of their own, by their string.
    """
    anchor, span = hashes(data)
    place = np.arange(len(anchor), dtype=np.uint64)
    least = anchor >> np.uint64(24) << np.uint64(24) | place  # the least hash, then the first place
    for width in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-width], least[width:])
    least = np.minimum(least[: len(span)], least[RIVALS - 64 : RIVALS - 64 + len(span)])
    owner = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    part = np.searchsorted(ends, np.arange(len(span)), side="right")
    inside = np.arange(len(span)) + SPAN <= ends[part]
    key = anchor[owner]
    alone = np.isin(key, hot) if len(hot) else np.zeros(len(key), dtype=bool)
    new = np.ones(len(span), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]) | alone[1:]
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(span)) - 1
    ok = inside[lo]
    lo, hi = lo[ok], hi[ok]
    hi = np.minimum(hi, ends[part[lo]] - SPAN)
    where = ((hi - lo).astype(np.uint64) << np.uint64(32)) | (owner[lo] - lo).astype(np.uint64)
    content = mixed(mixed(span[lo], span[hi]), where)
    return np.where(alone[lo], mixed(span[lo], key[lo]), key[lo]), content, part[lo], lo, hi


def parts(docs: Iterator[tuple[tuple[int, int], bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents joined to about PART bytes: bytes, part ends, documents of the parts, and their starts in them."""
    held: list[bytes] = []
    own, at, size = [], [], 0
    for doc, data in docs:
        for i in range(0, max(0, len(data) - SPAN + 1), PART):
            held.append(data[i : i + PART + SPAN - 1])
            own.append(doc)
            at.append(i)
            size += len(held[-1])
            if size >= PART:
                yield joined(held, own, at)
                held, own, at, size = [], [], [], 0
    if held:
        yield joined(held, own, at)


def joined(held: list[bytes], own: list[tuple[int, int]], at: list[int]) -> tuple[np.ndarray, ...]:
    return np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([len(x) for x in held]), np.array(own, dtype=np.int64).reshape(-1, 2), np.array(at, dtype=np.int64)


def items(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(anchor, content, doc, sub, lo, hi, repeat): a task's first item of each anchor and content; later ones as repeats."""
    hots = docs.sparkSession.sparkContext.broadcast(hot)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        texts = (((int(d), int(u)), t.encode()) for b in batches for d, u, t in zip(b["doc"], b["sub"], b["text"], strict=True))
        for data, ends, own, at in parts(texts):
            anchor, content, part, lo, hi = items_of(data, ends, hots.value)
            shift = at[part] - np.append(0, ends[:-1])[part]
            held.append((anchor, content, own[part, 0], own[part, 1], lo + shift, hi + shift))
            size += len(lo)
            if size > FLUSH:
                yield firsts(held)
                held, size = [], 0
        if held:
            yield firsts(held)

    def firsts(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        anchor, content, doc, sub, lo, hi = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((lo, sub, doc, content, anchor))
        anchor, content, doc, sub, lo, hi = anchor[order], content[order], doc[order], sub[order], lo[order], hi[order]
        new = np.ones(len(lo), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(lo)), 0))
        again = (doc != doc[first]) | (sub != sub[first]) | (lo != lo[first])  # a row that repeats its id and text doesn't repeat itself
        spread = np.where(again, mixed(content, lo.astype(np.uint64)), anchor)
        return pd.DataFrame({"anchor": spread.view(np.int64), "content": content.view(np.int64), "doc": doc, "sub": sub, "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "repeat": again})[new | again]

    return docs.mapInPandas(found, "anchor long, content long, doc long, sub long, lo int, hi int, repeat boolean")


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors that occur in more than HOT_SHARE of a hash sample of documents: at most as many as a document's anchors / HOT_SHARE.

    They only decide the way: all documents' strings with such an anchor are compared one by one, by hash, instead of sorted.
    """
    some = docs.filter(F.pmod(F.xxhash64("doc", "sub"), F.lit(SAMPLE)) == 0)
    n = some.count()
    counts = items(some, np.zeros(0, dtype=np.uint64)).filter("not repeat").groupBy("anchor", "doc", "sub").agg(F.lit(1)).groupBy("anchor").count()
    return np.sort(counts.filter(F.col("count") > max(HOT_LEAST, HOT_SHARE * n)).select("anchor").toPandas()["anchor"].to_numpy(np.int64).view(np.uint64))


def two_stage(s: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``s`` in the order of their first SPAN symbols; 0 ends a context and comes first.

    Only suffixes smaller than their successor are sorted directly: by 7 symbols at a time, and only where a group
    still holds different strings (``same``: a hash of the next SPAN symbols). All others are induced: scanning the
    buckets of first symbols in order, the suffix before each one found, if larger, is next in its own bucket.
    """
    n = len(s)
    change = np.append(s[1:] != s[:-1], True)
    nxt = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
    small = np.append(s, 0)[nxt] < np.append(s, 1)[np.minimum(nxt + 1, n)]
    small |= s == 0
    words = np.zeros(n, dtype=np.uint64)
    padded = np.append(s, np.zeros(SPAN + 7, dtype=s.dtype)).astype(np.uint64)
    for i in range(7):
        words = words << np.uint64(9) | padded[i : i + n]
    words = np.append(words, np.zeros(SPAN + 7, dtype=np.uint64))
    direct = np.flatnonzero(small & (s > 0))
    direct = direct[np.argsort(words[direct], kind="stable")]
    todo, group = np.arange(len(direct)), np.zeros(len(direct), dtype=np.int64)
    key = words[direct]
    for depth in range(7, SPAN + 7, 7):
        fresh = np.ones(len(todo), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(fresh) - 1
        starts = np.flatnonzero(fresh)
        if not len(starts):
            break
        h = same[direct[todo]]
        unlike = np.minimum.reduceat(h, starts) != np.maximum.reduceat(h, starts)
        keep = unlike[group]
        todo, group = todo[keep], group[keep]
        if not len(todo):
            break
        key = words[direct[todo] + depth]
        order = np.lexsort((key, group))
        direct[todo] = direct[todo][order]
        key = key[order]
    heads = s[direct]
    induced: dict[int, list[np.ndarray]] = {}
    out = []
    for c in np.unique(s).tolist():
        if c == 0:
            bucket = np.flatnonzero(s == 0)
        else:
            levels = [np.concatenate(induced.pop(c))] if c in induced else []
            while levels and len(levels[-1]):  # runs of the symbol: larger ones come after the next smaller
                before = levels[-1] - 1
                before = before[before >= 0]
                levels.append(before[s[before] == c])
            bucket = np.concatenate([*levels, direct[np.searchsorted(heads, c) : np.searchsorted(heads, c, side="right")]])
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[s[before] > c]
        order = np.argsort(s[before], kind="stable")
        before = before[order]
        symbols, at = np.unique(s[before], return_index=True)
        for symbol, piece in zip(symbols.tolist(), np.split(before, at[1:]), strict=False):
            induced.setdefault(symbol, []).append(piece)
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each suffix of ``order`` has its first SPAN symbols in common with the one before; words have 7 symbols each."""
    like = np.zeros(len(order), dtype=bool)
    alive = np.arange(1, len(order))
    for depth in [*range(0, SPAN - 6, 7), SPAN - 7]:
        alive = alive[words[order[alive] + depth] == words[order[alive - 1] + depth]]
    like[alive] = True
    return like


def repeats(frame: pd.DataFrame) -> pd.DataFrame:
    """Of contexts (doc, sub, lo, context) the strings, as ranges (doc, sub, lo, hi), that another one of them has earlier."""
    data = [bytes(b) for b in frame["context"]]
    sizes = np.array([len(b) for b in data])
    ends = np.cumsum(sizes + 1)  # each context is followed by a 0
    starts = ends - sizes - 1
    s = np.zeros(int(ends[-1]), dtype=np.int64)
    raw = np.frombuffer(b"".join(b + b"\0" for b in data), dtype=np.uint8)
    s[:] = raw.astype(np.int64) + 1
    s[ends - 1] = 0
    same = np.zeros(len(s), dtype=np.uint64)
    if len(s) >= SPAN:
        h = LETTERS[raw] + (s == 0)
        by = {}
        for width in (1, 2, 4, 8, 16, 32):
            by[width] = h
            h = mixed(h[:-width], h[width:])
        n = len(s) - SPAN + 1
        same[:n] = mixed(mixed(h[:n], by[32][64 : 64 + n]), by[4][96 : 96 + n])
        same[n:] = np.arange(1, len(s) - n + 1, dtype=np.uint64)  # these have no whole string: all differ
    order = two_stage(s, same)
    owner = np.searchsorted(ends, np.arange(len(s)), side="right")
    whole = np.arange(len(s)) + SPAN < ends[owner]  # ends before the context's 0
    order = order[whole[order]]
    if not len(order):
        return pd.DataFrame({"doc": [], "sub": [], "lo": [], "hi": []}).astype({"doc": "int64", "sub": "int64", "lo": "int32", "hi": "int32"})
    words = np.zeros(len(s), dtype=np.uint64)
    padded = np.append(s, np.zeros(7, dtype=np.int64)).astype(np.uint64)
    for i in range(7):
        words = words << np.uint64(9) | padded[i : i + len(s)]
    like = common_prefixes(words, order)
    first = np.flatnonzero(~like)
    docs, subs = frame["doc"].to_numpy(np.int64), frame["sub"].to_numpy(np.int64)
    by = np.lexsort((subs, docs))
    docs, subs = docs[by], subs[by]
    fresh = np.append(True, (docs[1:] != docs[:-1]) | (subs[1:] != subs[:-1]))
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.cumsum(fresh) - 1
    docs, subs = docs[fresh], subs[fresh]
    own = owner[order]
    at = frame["lo"].to_numpy(np.int64)[own] + order - starts[own]
    key = rank[own].astype(np.int64) << 40 | at
    earliest = np.minimum.reduceat(key, first)[np.cumsum(~like) - 1]
    again = key > earliest
    doc, at = rank[own][again], at[again]
    place = np.lexsort((at, doc))
    doc, at = doc[place], at[place]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1
    return pd.DataFrame({"doc": docs[doc[lo]], "sub": subs[doc[lo]], "lo": at[lo].astype(np.int32), "hi": at[hi].astype(np.int32)}) if len(at) else pd.DataFrame({"doc": docs[:0], "sub": subs[:0], "lo": at.astype(np.int32), "hi": at.astype(np.int32)})


def sorted_repeats(contexts: DataFrame) -> DataFrame:
    """``repeats`` of all contexts, dealt by anchor; a task sorts whole anchors together, SORTED bytes at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            anchors = batch["anchor"].to_numpy()
            cuts = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
            if held and held[-1]["anchor"].iloc[-1] != anchors[0] and size > SORTED:
                yield repeats(pd.concat(held))
                held, size = [], 0
            # pieces of about SORTED bytes that end where an anchor ends
            lengths = np.cumsum(batch["context"].map(len).to_numpy())
            start = 0
            for c in cuts[1:].tolist():
                if size + lengths[c - 1] - (lengths[start - 1] if start else 0) > SORTED:
                    held.append(batch.iloc[start:c])
                    yield repeats(pd.concat(held))
                    held, size, start = [], 0, c
            held.append(batch.iloc[start:])
            size += int(lengths[-1] - (lengths[start - 1] if start else 0))
        if held:
            yield repeats(pd.concat(held))

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(run, "doc long, sub long, lo int, hi int")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc, sub, lo, hi): starts lo..hi of strings of SPAN bytes in ``docs`` (doc, sub, text) that also start earlier."""
    found = items(docs, hot_anchors(docs)).repartition("anchor")
    alike = Window.partitionBy("anchor", "repeat", "content").orderBy("doc", "sub", "lo")
    found = found.withColumn("first", F.first(F.struct("doc", "sub", "lo")).over(alike.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("later", F.struct("doc", "sub", "lo") > F.col("first"))
    together = Window.partitionBy("anchor", "repeat")
    found = found.withColumn("several", F.min("content").over(together) != F.max("content").over(together))
    found = written(found.filter("repeat or later or several").withColumn("again", F.col("repeat") | F.col("later")).select("anchor", "doc", "sub", "lo", "hi", "again"), "items")
    # the first of each content is compared with the other contents of its anchor
    asked = found.filter("not again").groupBy("doc", "sub").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("asked"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, sub, text, rows in zip(batch["doc"], batch["sub"], batch["text"], batch["asked"], strict=True):
                data = text.encode()
                out += [(r["anchor"], doc, sub, r["lo"], data[r["lo"] : r["hi"] + SPAN]) for r in rows]
            yield pd.DataFrame(out, columns=["anchor", "doc", "sub", "lo", "context"])

    contexts = docs.join(asked, ["doc", "sub"]).select("doc", "sub", "text", "asked").mapInPandas(cut, "anchor long, doc long, sub long, lo int, context binary")
    return found.filter("again").select("doc", "sub", "lo", "hi").union(sorted_repeats(contexts))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, length).

    A byte goes if a string of SPAN bytes covers it that starts earlier too: in a document of smaller id, or before in
    the same one. Strings may overlap and don't cross documents. Null texts are empty; a null id counts as the smallest.
    Id and text name a document: rows equal in both all lose the same bytes and don't count as copies of one another;
    different texts of one id, or without an id, are documents of their own, in the order of a hash of their text. Other columns are not read. An empty table gives an empty result.

    Every string belongs to its least anchor, so equal strings meet. Items with equal content are settled by their first;
    different contents of one anchor are cut out, and their suffixes are sorted in two stages; neighbours with
    SPAN bytes in common are the same string. Anchors in very many documents go by their strings instead, so none gathers.
    """
    rows = document_rows(docs, id_col, text_col)
    ranges = repeated_ranges(rows.select("doc", "sub", "text")).groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, own in zip(batch["doc_id"], batch["text"], batch["ranges"], strict=True):
                data = text.encode()
                spans = []
                if own is not None and len(own):
                    lo, hi = np.array([r["lo"] for r in own]), np.array([r["hi"] for r in own]) + SPAN
                    step = np.bincount(lo, minlength=len(data) + 1) - np.bincount(np.minimum(hi, len(data)), minlength=len(data) + 1)
                    gone = np.cumsum(step[: len(data)]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                    spans = [{"start": int(a), "length": int(b - a)} for a, b in edges]
                    rest = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                else:
                    rest = data
                out.append((doc_id, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), spans))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>"
    return rows.join(ranges, ["doc", "sub"], "left").select("doc_id", "text", "ranges").mapInPandas(kept, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat earlier ones."""
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
