"""Language-model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import filled, small_batches, written

#: Longest context in words of the states that go to all tasks.
DEPTH = 2
#: Words of the deep contexts, which stay tables, and the residue classes of their hash of which one is taken: with one class every deep context is a
#: candidate. SEEN: training positions from which one is a candidate state.
DEEP, SELECT, SEEN = 4, 1, 2
#: Positions of deep contexts that a task of their table holds, on average.
BUCKET = 1_000_000
#: A context is a candidate state if it makes up this share of all positions (so there are at most 1 / STATE_SHARE of a length).
STATE_SHARE = 1e-4
#: A next word is kept with a state if both together make up this share (so the tree has at most DEPTH / NEXT_SHARE entries).
NEXT_SHARE = 2e-6
#: A state is retained if its next words diverge from its parent's by so many nats on average.
DIVERGENCE = 0.01
#: Add-constant of the base model.
BASE = 0.1
#: Distinct words that a task counts before it passes them on.
FLUSH = 4_000_000
#: The end of a document is a token of its own; its key is no word's hash but this fixed number.
END = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number, one to one."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of texts that are split together.
CHUNK = 1 << 16
#: Which bytes are spaces, and the random bits of each byte at each of the first LONG places of a word.
LONG = 64
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
PLACED = mixed(np.arange(256 * LONG, dtype=np.uint64))


def streams(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the tokens of some texts one after another, and how many each text has: about CHUNK bytes at a time, since short arrays cost more than their entries."""
    held, size = [], 0
    for text in texts:
        held.append(text.encode().lower())
        size += len(held[-1])
        if size > CHUNK:
            yield keyed(held)
            held, size = [], 0
    if held:
        yield keyed(held)


def keyed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the lower-cased words (on bytes: A-Z only, and exactly the six ASCII spaces) and the end of each text, and their numbers. A key adds up random bits of its bytes by place."""
    b = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    inside = np.flatnonzero(~SPACE[b])
    if not len(inside):
        return np.full(len(texts), END), np.ones(len(texts), dtype=np.int64)
    starts = np.flatnonzero(np.append(True, inside[1:] != inside[:-1] + 1))
    code = np.arange(len(inside)) - np.repeat(starts, np.diff(starts, append=len(inside)))
    code = code * 256 + b[inside]
    bits = PLACED[np.minimum(code, len(PLACED) - 1)]
    if len(far := np.flatnonzero(code >= len(PLACED))):
        bits[far] = mixed(code[far].astype(np.uint64))
    words = mixed(np.add.reduceat(bits, starts))
    upto = np.searchsorted(inside[starts], np.cumsum([len(t) + 1 for t in texts]))
    n = np.diff(upto, prepend=0) + 1
    keys = np.full(len(words) + len(texts), END)
    keys[np.arange(len(words)) + np.repeat(np.arange(len(texts)), n - 1)] = words
    return keys, n


def tokens(text: str) -> np.ndarray:
    """Keys of one text's tokens."""
    return keyed([text.encode().lower()])[0]


class Numbers:
    """Numbers of common words by their key, -1 for others. Keys are hashes, so their highest bits lead to a bucket of a few sorted keys."""

    def __init__(self, common: np.ndarray) -> None:
        self.common = common
        bits = max(1, (4 * len(common)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted((common >> self.shift).astype(np.int64), np.arange((1 << bits) + 1))
        self.most = int(np.diff(self.start).max()) if len(common) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        head = (keys >> self.shift).astype(np.int64)
        low, out = self.start[head], np.full(len(keys), -1, dtype=np.int64)
        open_ = np.flatnonzero(self.start[head + 1] > low)
        for j in range(self.most):
            at = low[open_] + j
            hit = self.common[at] == keys[open_]
            out[open_[hit]] = at[hit]
            open_ = open_[~hit]
            open_ = open_[low[open_] + j + 1 < self.start[head[open_] + 1]]
            if not len(open_):
                break
        return out


def contexts(numbers: np.ndarray, depth: int, size: int) -> np.ndarray:
    """Code of the ``depth`` words before each token, the farthest first, in base ``size``; -1 if one isn't common or doesn't exist."""
    code, ok = np.zeros(len(numbers), dtype=np.int64), np.ones(len(numbers), dtype=bool)
    for d in range(depth, 0, -1):
        before = np.concatenate([np.full(min(d, len(numbers)), -1), numbers[:-d]])
        ok &= before >= 0
        code = code * size + before
    return np.where(ok, code, -1)


def place(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def deep_contexts(keys: np.ndarray, select: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the DEEP words before a token, and the token's place, where the context is a candidate."""
    n = len(keys) - DEEP
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for d in range(DEEP):
        h = (h ^ keys[d : d + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    ends = np.cumsum(keys == END)
    whole = ends[DEEP - 1 : -1] == np.append(0, ends[: n - 1])  # no end among the words
    at = np.flatnonzero(whole if select == 1 else whole & (h % np.uint64(select) == 0))
    return h[at], at + DEEP


def planes(x: np.ndarray, size: int) -> bytes:
    """The ``size`` low bytes of each number, byte by byte, so that high ones, which are mostly alike, lie together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def squeezed(parts: list[bytes], size: int) -> bytes:
    """Deflated, each ``size`` bytes of a part with codes of their own: runs and skew are all there is to find in planes."""
    z, out = zlib.compressobj(6, zlib.DEFLATED, -15, 9, zlib.Z_RLE), []
    for part in parts:
        for lo in range(0, len(part), size):
            out += [z.compress(part[lo : lo + size]), z.flush(zlib.Z_SYNC_FLUSH)]
    return b"".join(out) + z.flush()


def joined(data: bytes, size: int, n: int) -> np.ndarray:
    """The numbers of ``planes``."""
    x = np.zeros((n, 8), dtype=np.uint8)
    x[:, :size] = np.frombuffer(data, dtype=np.uint8).reshape(size, n).T
    return x.view("<u8").ravel()


class Deep:
    """A task's positions with a candidate context, passed on by bucket: the contexts' hashes, of which 56 bits are kept, lead to the bucket."""

    #: Bytes of a hash's step that are left as they are, those that are packed with what follows, of a word's rank, of a shallow state's number, and of a document's.
    RAW, PACKED = 4, (3, 3, 3, 4)

    def __init__(self, bits: int, select: int) -> None:
        self.bits, self.select, self.size, self.parts = bits, select, 0, []

    def add(self, keys: np.ndarray, ranks: np.ndarray, states: np.ndarray, rows: np.ndarray, train: np.ndarray) -> None:
        """``ranks``: of common words from 1, 0 for others; ``states``: numbers of the longest shallow states."""
        h, at = deep_contexts(keys, self.select)
        rank = ranks[at]
        self.parts.append((h, rank, states[at], rows[at], train[at], np.where(rank == 0, keys[at], np.uint64(0))))
        self.size += len(h)

    def passed(self) -> pd.DataFrame:
        h, rank, state, row, train, key = map(np.concatenate, zip(*self.parts, strict=True))
        self.size, self.parts = 0, []
        order = np.argsort(h)
        h, rank, state, row, train, key = h[order], rank[order], state[order], row[order], train[order], key[order]
        bucket = (h >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(h), dtype=np.uint64)).astype(np.int64)
        h, first, out = h >> np.uint64(8), int(row.min()), []
        for lo, hi in zip(starts := np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), [*starts[1:], len(h)], strict=True):
            # sorted hashes as steps
            step, r = np.diff(h[lo:hi], prepend=np.uint64(0)), rank[lo:hi]
            parts = [planes(x, size) for x, size in zip((step >> np.uint64(8 * self.RAW), r, state[lo:hi], row[lo:hi] - first), self.PACKED, strict=True)]
            packed = squeezed([*parts, np.packbits(train[lo:hi]).tobytes()], hi - lo)
            out.append((int(bucket[lo]), first, planes(step, self.RAW), packed, key[lo:hi][r == 0].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "row", "steps", "packed", "keys"])


def unpacked(r: tuple) -> tuple[np.ndarray, ...]:
    """Hash, rank, state, row, train of each position of a row of ``Deep.passed``, and the keys of its words that aren't common."""
    n, data, at, parts = len(r.steps) // Deep.RAW, zlib.decompress(r.packed, -15), 0, []
    for size in Deep.PACKED:
        parts.append(joined(data[at : at + size * n], size, n))
        at += size * n
    step = joined(r.steps, Deep.RAW, n) | (parts[0] << np.uint64(8 * Deep.RAW))
    train = np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=at), count=n).astype(bool)
    rank, key = parts[1].astype(np.int64), np.zeros(n, dtype=np.uint64)
    key[rank == 0] = np.frombuffer(r.keys, dtype=np.uint64)
    return np.cumsum(step, dtype=np.uint64), rank, parts[2].astype(np.int64), parts[3].astype(np.int64) + r.row, train, key


def deep_scores(frame: pd.DataFrame, tree: Tree) -> pd.DataFrame:
    """(row, rare_one, less, delta) of one bucket: what deep states change in the scores, and how many of a row's rare words they take from the root.

    A state needs SEEN training positions and is retained where the mean logarithm of its training words' probability diverges from what the
    shallow states give. Its words have discounted counts and their share of what is left, which the shallow states distribute.
    """
    h, rank, shallow, row, train, word = map(np.concatenate, zip(*map(unpacked, frame.itertuples(index=False)), strict=True))
    # contexts that training has too seldom are no states
    order = np.argsort(h)
    h, train = h[order], train[order]
    new_state = np.append(True, h[1:] != h[:-1])
    often = np.repeat(np.add.reduceat(train.astype(np.int64), np.flatnonzero(new_state)) >= SEEN, np.diff(np.flatnonzero(new_state), append=len(h)))
    if not often.any():
        return pd.DataFrame({"row": [], "rare_one": [], "less": [], "delta": []})
    h, train, order = h[often], train[often], order[often]
    rank, shallow, row, word = rank[order], shallow[order], row[order], word[order]
    rare, number = rank == 0, np.where(rank > 0, tree.by_count[rank - 1], -1)
    word[~rare] = tree.common[number[~rare]]
    told = tree.told(shallow, number)
    order = np.lexsort((word, h))
    h, word, rare, train, told, row = (x[order] for x in (h, word, rare, train, told, row))
    new_state = np.append(True, h[1:] != h[:-1])
    new_entry = new_state | np.append(True, word[1:] != word[:-1])
    states, entries = np.flatnonzero(new_state), np.flatnonzero(new_entry)
    state, entry = np.cumsum(new_state) - 1, np.cumsum(new_entry) - 1
    total = np.add.reduceat(train.astype(np.int64), states)
    c = np.add.reduceat(train.astype(np.int64), entries)
    kinds = np.bincount(state[entries], c > 0, minlength=len(states))
    m, k = total[state].astype(float), c[entry]
    left = np.maximum(tree.discount * kinds[state] / m, 1e-12)
    own = np.maximum(k - tree.discount, 0) / m
    change = np.where(k > 0, np.log10(np.where(rare, np.maximum(own, 1e-300), own + left * 10.0**told)) - told, np.log10(left))
    gain = np.bincount(state, np.where(train, (change + np.where(rare, np.log10(max(tree.n, 1)), 0)) * np.log(10), 0), minlength=len(states)) / total
    kept = (gain > DIVERGENCE)[state]
    rows, inverse = np.unique(row[kept], return_inverse=True)
    sums = pd.DataFrame({"row": rows, "delta": np.bincount(inverse, change[kept], minlength=len(rows))})
    taken = kept & rare & (k > 0)
    less = pd.DataFrame({"row": row[taken], "rare_one": word[taken].view(np.int64)}).groupby(["row", "rare_one"], as_index=False).size()
    less = pd.DataFrame({"row": less["row"], "rare_one": less["rare_one"].astype("Int64"), "less": -less["size"].astype("Int64")})
    return pd.concat([sums.assign(rare_one=pd.array([None] * len(sums), dtype="Int64"), less=pd.array([None] * len(sums), dtype="Int64")), less.assign(delta=pd.array([None] * len(less), dtype="Float64"))], ignore_index=True)


class Node:
    """The states of one depth as sorted codes, with the log10 weight each leaves to its parent; entries (state, next word) likewise."""

    def __init__(self, states: np.ndarray, left: np.ndarray, entries: np.ndarray, scores: np.ndarray) -> None:
        order, own = np.argsort(states), np.argsort(entries)
        self.states, self.left, self.entries, self.scores = states[order], left[order], entries[own], scores[own]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all training documents. Every task adds up its own words, Spark adds up the tasks'."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for keys, _ in streams(batch["text"]):
                parts.append(keys)
                size += len(keys)
                if size > FLUSH:
                    yield unique(parts)
                    parts, size = [], 0
        if parts:
            yield unique(parts)

    def unique(parts: list[np.ndarray]) -> pd.DataFrame:
        words, n = np.unique(np.concatenate(parts), return_counts=True)
        return pd.DataFrame({"word": words.view(np.int64), "n": n})

    return docs.mapInPandas(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def next_counts(docs: DataFrame, depth: int, states: np.ndarray, common: np.ndarray) -> DataFrame:
    """(at, word, n) of candidate states (their place in ``states``) with the common words after them; word -1: all others."""
    model = docs.sparkSession.sparkContext.broadcast((states, common))
    size = len(common)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, words = model.value
        numbers = Numbers(words)
        member = np.zeros(size + 1, dtype=bool)  # words that stand next in some state, so most places need no search
        member[known % size] = True
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            # the end is in no state, so none reaches from text to text
            for keys, _ in streams(batch["text"]):
                w = numbers.find(keys)
                here = np.flatnonzero(member[np.append(-1, w[:-1])])
                s = place(known, contexts(w, depth, size)[here])
                here, s = here[s >= 0], s[s >= 0]
                parts.append(s * (size + 1) + w[here] + 1)
                held += len(here)
                if held > FLUSH:
                    yield unique(parts)
                    parts, held = [], 0
        if parts:
            yield unique(parts)

    def unique(parts: list[np.ndarray]) -> pd.DataFrame:
        pairs, n = np.unique(np.concatenate(parts), return_counts=True)
        return pd.DataFrame({"pair": pairs, "n": n})

    sums = docs.mapInPandas(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return sums.select(F.expr(f"pair div {size + 1}").alias("at"), (F.col("pair") % (size + 1) - 1).alias("word"), "n")


class Tree:
    """The model: words' counts that are common enough, the root's smoothing, and the retained states of each depth."""

    def __init__(self, n: int, v: int, once: int, twice: int, common: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(common)
        self.n, self.v = n, v
        self.common, self.counts = common[order], counts[order]
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.depths: list[Node] = []
        #: Numbers of the common words, the commonest first, and each one's rank from 1.
        self.by_count = np.argsort(-self.counts, kind="stable")
        self.rank = np.empty(len(common) + 1, dtype=np.int64)
        self.rank[self.by_count], self.rank[-1] = np.arange(1, len(common) + 1), 0

    def root(self, c: np.ndarray) -> np.ndarray:
        """log10 of the root's probability of words with training counts ``c``: absolute discounting, all unknown words as one."""
        if not self.n:
            return np.zeros(len(c))
        unknown = self.discount * self.v / self.n
        return np.log10(np.where(c > 0, (c - self.discount) / self.n, unknown))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + BASE) / (self.n + BASE * (self.v + 1)))

    def add(self, states: np.ndarray, n: np.ndarray, rows: pd.DataFrame, parent_scores: np.ndarray) -> None:
        """Test candidate states of the next depth and retain those that diverge.

        ``rows``: at (index of the state), word, n; ``parent_scores``: log10 probability of each row's word in the parent state.
        """
        at, word, c = rows["at"].to_numpy(np.int64), rows["word"].to_numpy(np.int64), rows["n"].to_numpy(float)
        total = np.maximum(n, 1)
        own = np.maximum(c - self.discount, 0) / total[at]
        left = np.maximum(1 - np.bincount(at, own, minlength=len(states)), 1e-12)
        both = own + left[at] * 10.0**parent_scores
        gain = np.bincount(at, c / total[at] * (np.log(both) - parent_scores * np.log(10)), minlength=len(states)) + (1 - np.bincount(at, c, minlength=len(states)) / total) * np.log(left)
        kept = gain > DIVERGENCE
        self.depths.append(Node(states[kept], np.log10(left[kept]), (states[at] * len(self.common) + word)[kept[at]], np.log10(both[kept[at]])))

    def walk(self, numbers: np.ndarray, codes: dict[int, np.ndarray], longest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: log10 probability as far as retained states give it, and whether the root's is to be added.

        The longest retained suffix state that keeps the word scores it; each longer state passed gives its weight left.
        ``codes``: the contexts' codes by depth. ``longest``, zeros, gets the number of the longest retained state, counted over all depths from 1.
        """
        score, open_, size = np.zeros(len(numbers)), np.ones(len(numbers), dtype=bool), len(self.common)
        for d in sorted(codes, reverse=True):
            if d > len(self.depths) or not len(self.depths[d - 1].states):
                continue
            node, at = self.depths[d - 1], np.flatnonzero(open_ & (codes[d] >= 0))
            s = place(node.states, codes[d][at])
            at, s = at[s >= 0], s[s >= 0]
            if longest is not None:
                longest[at] = np.where(longest[at] > 0, longest[at], 1 + s + sum(len(n.states) for n in self.depths[: d - 1]))
            e = np.where(numbers[at] >= 0, place(node.entries, codes[d][at] * size + numbers[at]), -1)
            hit = e >= 0
            score[at[hit]] += node.scores[e[hit]]
            open_[at[hit]] = False
            score[at[~hit]] += node.left[s[~hit]]
        return score, open_

    def partial(self, numbers: np.ndarray, longest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``walk`` of a text's tokens."""
        return self.walk(numbers, {d: contexts(numbers, d, len(self.common)) for d in range(1, DEPTH + 1)}, longest)

    def told(self, longest: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """log10 probability of words after contexts whose longest retained state is known; for words that aren't common, as far as states give it."""
        codes, before = {d: np.full(len(numbers), -1) for d in range(1, len(self.depths) + 1)}, 1
        for d, node in enumerate(self.depths, 1):
            here = np.flatnonzero((longest >= before) & (longest < before + len(node.states)))
            code = node.states[longest[here] - before]
            for less in range(1, d + 1):
                codes[less][here] = code % len(self.common) ** less
            before += len(node.states)
        part, open_ = self.walk(numbers, codes)
        at = np.flatnonzero(open_ & (numbers >= 0))
        part[at] += self.root(self.counts[numbers[at]].astype(float))
        return part


def learn(docs: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree and the table (word, n) of all training words, which stays a table."""
    words = written(word_counts(docs), "words")
    n, v, once, twice = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    least, frequent = max(2, int(np.ceil(NEXT_SHARE * n))), max(2, STATE_SHARE * n)
    common = words.filter(F.col("n") >= least).toPandas()  # at most 1 / NEXT_SHARE words
    tree = Tree(n, v, once, twice, common["word"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64))
    size = len(tree.common)
    # candidates of depth 1: single words; the end never precedes a word
    states = np.flatnonzero((tree.counts >= frequent) & (tree.common != END))
    for depth in range(1, DEPTH + 1):
        if not len(states):
            break
        found = next_counts(docs, depth, states, tree.common)
        with small_batches(docs.sparkSession):
            found = written(found, "next")
        own = np.zeros(len(states))
        sums = found.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        own[sums["at"]] = sums["n"]
        found = found.filter((F.col("word") >= 0) & (F.col("n") >= least)).toPandas()
        at, word = found["at"].to_numpy(np.int64), found["word"].to_numpy(np.int64)
        # the parent state drops the farthest word
        codes = {d: states[at] % size**d for d in range(1, depth)}
        part, open_ = tree.walk(word, codes)
        tree.add(states, own, found, part + np.where(open_, tree.root(tree.counts[word].astype(float)), 0))
        longer = (found["n"].to_numpy() >= frequent) & (tree.common[word] != END)
        states = np.sort(states[at[longer]] * size + word[longer])
    return tree, words


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id as text) mod ``fold`` is not 0 (a null id counts as the empty text). Tokens are the
    lower-cased words and one end; null texts are empty and have the end alone. A state is a context of up to DEPTH words that
    makes up STATE_SHARE of all positions; it is retained where its next words diverge from its parent's. Its words have
    discounted counts, and what they leave is shared by the parent's distribution; the root leaves its rest to all unknown
    words as one. Contexts of DEEP words are states wherever SEEN training positions have them, however rare that is, if their next
    words diverge: they are found, tested and applied bucket by bucket in a table that grows with the corpus. A token is scored by the longest state of its
    context. The shallow tree's size is bounded by these shares at any corpus size and goes to all tasks;
    the counts of all words, which grow with the corpus, stay a table and are joined by word: a token that
    the tree's common words don't have gets its count there. Rows repeat as given; other columns are not read.
    With nothing to learn from, every token is unknown.
    """
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % fold == 0
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), filled(text_col).alias("text"))
    tree, words = learn(rows.filter("not held_out"))
    model = docs.sparkSession.sparkContext.broadcast(tree)
    bits, select = max(0, int(np.ceil(np.log2(max(1, tree.n / SELECT / BUCKET))))), SELECT

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = model.value
        numbers, deep = Numbers(tree.common), Deep(bits, select)
        base_of, root_of = tree.base(tree.counts.astype(float)), tree.root(tree.counts.astype(float))
        for batch in batches:
            out = []
            of, held, ids, texts = batch["row"].to_numpy(np.int64), batch["held_out"].to_numpy(bool), batch["doc_id"], 0
            for keys, n in streams(batch["text"]):
                here, texts = np.arange(texts, texts + len(n)), texts + len(n)
                starts, text = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
                w = numbers.find(keys)
                longest = np.zeros(len(w), dtype=np.int64)
                part, open_ = tree.partial(w, longest)
                known = w >= 0
                part[known & open_] += root_of[w[known & open_]]
                base = np.add.reduceat(np.where(known, base_of[w], 0.0), starts) if len(base_of) else np.zeros(len(n))
                sums, common = np.add.reduceat(part, starts), np.add.reduceat(known.astype(np.int64), starts)
                # the words of each text that aren't common, with how often each is there and asks the root
                unknown = np.flatnonzero(~known)
                unknown = unknown[np.lexsort((keys[unknown], text[unknown]))]
                first = np.flatnonzero(np.append(True, (keys[unknown][1:] != keys[unknown][:-1]) | (text[unknown][1:] != text[unknown][:-1]))) if len(unknown) else unknown
                rare, times = keys[unknown[first]].view(np.int64), np.diff(first, append=len(unknown))
                to_root = np.add.reduceat(open_[unknown].astype(np.int64), first) if len(first) else times
                cut = np.searchsorted(text[unknown[first]], np.arange(len(n) + 1))
                for t, k in enumerate(here):
                    own = slice(cut[t], cut[t + 1])
                    out.append((of[k] % (1 << bits), of[k], ids[k], held[k], n[t], common[t], base[t], sums[t], rare[own], times[own], to_root[own]))
                deep.add(keys, tree.rank[w], longest, of[here][text], ~held[here][text])
                if deep.size > FLUSH // 4:
                    yield filled_up(deep.passed(), names)
            yield filled_up(pd.DataFrame(out, columns=names[:11]), names)
        if deep.size:
            yield filled_up(deep.passed(), names)

    def filled_up(frame: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        """Documents and deep contexts go one way: each leaves the other's columns null."""
        return frame.assign(**{c: pd.Series([None] * len(frame), dtype=object, index=frame.index) for c in names if c not in frame})[names]

    def settled(frame: pd.DataFrame) -> pd.DataFrame:
        """A bucket's documents as they are, and what its deep contexts change."""
        own = frame["packed"].isna()
        rows = frame.loc[own, names[1:11]].astype({"n_tokens": "int64", "n_common": "int64", "held_out": bool})
        parts = [filled_up(rows, ends)]
        if not own.all():
            parts.append(filled_up(deep_scores(frame.loc[~own, ["row", "steps", "packed", "keys"]], model.value).astype({"row": "int64"}), ends))
        return pd.concat([q.astype(object) for q in parts], ignore_index=True)

    documents = "row long, doc_id string, held_out boolean, n_tokens long, n_common long, base double, part double, rare array<long>, times array<long>, to_root array<long>"
    sent, kept = f"bucket int, {documents}, steps binary, packed binary, keys binary", f"{documents}, rare_one long, less long, delta double"
    names, ends = ([c.split()[0] for c in schema.split(", ")] for schema in (sent, kept))
    # a long with nulls would be a double in pandas, so the id goes as text
    numbered = rows.withColumns({"row": F.monotonically_increasing_id(), "doc_id": F.col("doc_id").cast("string")})
    with small_batches(docs.sparkSession):
        both = written(numbered.mapInPandas(told, sent).groupBy("bucket").applyInPandas(settled, kept), "scored")
    docwise = both.filter("n_tokens is not null").select(*ends[:10]).withColumn("doc_id", F.col("doc_id").cast("long"))
    deep = both.filter("n_tokens is null")
    rare = docwise.select("row", F.explode(F.arrays_zip("rare", "times", "to_root")).alias("r")).select("row", "r.rare", "r.times", "r.to_root")
    rare = rare.union(deep.filter("rare_one is not null").select("row", "rare_one", F.lit(0).cast("long").alias("times"), F.col("less").alias("to_root")))
    # words that training doesn't have match no row and count 0
    rare = rare.join(words.withColumnRenamed("word", "rare"), "rare", "left").withColumn("c", F.coalesce("n", F.lit(0)).cast("double"))
    n, d = float(tree.n), tree.discount
    root = F.log10(F.when(F.col("c") > 0, (F.col("c") - d) / n).otherwise(F.lit(d * tree.v / n))) if tree.n else F.lit(0.0)
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.col("c") + BASE) / (n + BASE * (tree.v + 1)))).alias("more_base"),
        F.sum(F.col("to_root") * root).alias("more_part"),
    )
    zero = F.lit(0)
    deep = deep.filter("delta is not null").groupBy("row").agg(F.sum("delta").alias("delta"))
    return docwise.drop("rare", "times", "to_root").join(sums, "row", "left").join(deep, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(int(tree.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("part") + F.coalesce("more_part", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))).alias("score"),
    )


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a tenth is held out of learning."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
