"""Fingerprints, whitening and the manifest against brute force on small tables, with nulls, repeats, ties, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from gridloom.llm import fingerprints, manifest, whitening


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# whitening


def vector_rows(kind):
    r = random.Random(7)
    dims, n = 6, 300
    basis = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(dims)]
    rows = []
    for i in range(n):
        z = [r.gauss(0, s) for s in (9, 5, 3, 2, 1, 0.5)]
        v = [sum(a * b[j] for a, b in zip(z, basis, strict=True)) for j in range(dims)]
        rows.append((i, [float(np.float32(c)) for c in v]))
    if kind == "copies":
        rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(2000, [c + 1e-6 for c in rows[3][1]])]
    if kind == "wide":
        rows = [(i, [c * 1e9 for c in v]) for i, v in rows]
    if kind == "odd":
        rows += [(3000, None), (3001, []), (3002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3003, [float("nan")] * 6), (3004, [float("inf")] + [0.0] * 5), (3005, [1.0, 2.0]), (None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1]), (3006, [1e30] * 6)]
    return rows


def exact_fit(rows):
    xs = [(i, tuple(int(np.floor(c * 64)) + 1000000 for c in v)) for i, v in rows if v and len(v) == 6 and all(c is not None and abs(c) < 2.0**46 for c in v)]
    fit = sorted({x for _, x in xs})
    n = len(fit)
    s = [sum(x[j] for x in fit) for j in range(6)]
    v = [[sum(Fraction(n * x[i] - s[i], n) * Fraction(n * x[j] - s[j], n) for x in fit) / n for j in range(6)] for i in range(6)]
    return xs, n, s, v


@pytest.mark.parametrize("kind", ["plain", "copies", "wide", "odd"])
def test_whitening_against_exact_fractions(spark, kind):
    rows = vector_rows(kind)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, whitened string, x int").repartition(3)
    got = whitening.whiten(df).collect()
    xs, n, s, v = exact_fit(rows)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in v]))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 6 * len(xs) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    signs = {}
    for i, x in xs:
        y = [n * a - b for a, b in zip(x, s, strict=True)]
        deviation = sum(a * a for a in y)
        for r in by_id[i]:
            k = r.component - 1
            want = float(np.array([float(Fraction(a, n)) for a in y]) @ vectors[:, k]) / values[k] ** 0.5
            assert r.deviation == (deviation if deviation < 2**63 else None)
            assert abs(abs(r.whitened) - abs(want)) < 1e-8
            if abs(want) > 1e-6:
                assert signs.setdefault(k, np.sign(r.whitened * want)) == np.sign(r.whitened * want)
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)


def test_scatter_is_exact(spark):
    rows = vector_rows("wide")
    _, n, s, v = exact_fit(rows)
    x = whitening.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").select("x").distinct()
    count, sums, most = whitening.moments(x, 6)
    assert (count, sums) == (n, s)
    assert whitening.scatter(x, 6, n, s, most) == [[c * n**3 for c in row] for row in v]
    assert len(whitening.needed(n * most * most)) > 5


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    # a constant dimension is no component
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 3.0]) for i in range(5)], schema)).collect()
    assert len(flat) == 5 and {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1) for r in flat)


def test_more_dimensions_than_components(spark):
    r = random.Random(3)
    got = whitening.whiten(spark.createDataFrame([(i, [r.gauss(0, 1 + j / 4) for j in range(20)]) for i in range(80)], "vec_id long, embedding array<float>")).collect()
    assert len(got) == 80 * 16 and got[0].identity_error < 1e-9
    shares = [max(r.explained for r in got if r.component == k) for k in range(1, 17)]
    assert shares == sorted(shares, reverse=True) and sum(shares) < 1


# manifest


def field(v):
    t = None if v is None else str(v)
    return "-" if t is None else f"{len(t.encode())}:{t}"


def climb(nodes):
    """Root of a list of hashes, and for each the runs it passes on its way: (others before, others after)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(ways)):
            k, run = at[i], at[i] // 8 * 8
            ways[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 8])))
            at[i] = k // 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return (nodes[0] if nodes else None), ways


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for row in rows:
        leaf = h(*map(field, row))
        hit = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 3 == 0
        changed = h(*map(field, (*row[:4], row[4] and row[4].translate(lower)))) if hit else leaf
        trees.setdefault(row[2], []).append((row[0], leaf, changed))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    ends = []
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        ends.append(climb([r[1] for r in trees[lang]]))
    root, upper = climb([e[0] for e in ends])
    out = []
    for lang, (subroot, ways), above in zip(langs, ends, upper, strict=True):
        for (i, leaf, changed), way in zip(trees[lang], ways, strict=True):
            way = way + above
            end = changed
            for lo, hi in way:
                end = h(lo, end, hi)
            out.append((i, leaf, subroot, root, h(*[lo + hi for lo, hi in way]), end, end == root))
    return out


def manifest_rows(kind):
    r = random.Random(11)
    say = lambda: "".join(r.choice("abC DÉß漢🙂\n") for _ in range(r.randrange(40)))
    langs = {"many": [f"l{k:02d}" for k in range(19)], "one": ["en"], "odd": ["en", None, "", "-", "é", "z"]}[kind]
    sizes = {"many": 120, "one": 530, "odd": 150}[kind]
    rows = [(i, r.choice(["s", None, ""]), langs[i * i % len(langs)], r.choice([None, 3]), r.choice([say(), say(), None, ""])) for i in range(sizes)]
    if kind == "odd":
        rows += [(None, "s", "en", 1, "A"), (None, "s", "en", 1, "A"), (None, "s", None, 1, "B"), (7, *rows[7][1:]), (8, "s", rows[8][2], 9, "OTHER"), (900, "s", "alone", 1, "X" * 50000)]
    return rows


@pytest.mark.parametrize("kind", ["many", "one", "odd"])
def test_manifest_against_brute_force(spark, kind):
    rows = manifest_rows(kind)
    docs = spark.createDataFrame([(*row, "x", 1, True) for row in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int, tree boolean").repartition(5)
    got = [tuple(r) for r in manifest.document_manifest(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_manifest(rows), key=repr)


def test_places_over_many_ranges(spark):
    """Ranges that adaptive execution doesn't join: places go on from one to the next, in trees that span several."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows = manifest_rows("odd")
        docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
        got = [tuple(r) for r in manifest.document_manifest(docs).collect()]
        assert sorted(got, key=repr) == sorted(brute_manifest(rows), key=repr)
        nodes = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', 'b') tree", "id * 7919 % 3001 x", "cast(id as string) hash")
        placed = manifest.placed(nodes, "tree", ["x", "hash"])
        want = {}
        for r in sorted(placed.collect(), key=lambda r: (r.tree, r.x, r.hash)):
            assert (r.pos, r.n) == (want.get(r.tree, 0), {"a": 1000, "b": 2000}[r.tree])
            want[r.tree] = r.pos + 1
    finally:
        spark.conf.set(key, before)


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.document_manifest(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, None, None, None, None)], [(1, "s", "en", 1, "A"), (2, "s", "de", 1, "B")], [(i, "s", "en", 1, "A") for i in range(9)]):
        got = [tuple(r) for r in manifest.document_manifest(spark.createDataFrame(rows, schema)).collect()]
        assert sorted(got) == sorted(brute_manifest(rows))


# fingerprints


def brute_sketch(text):
    """Retained hashes by the definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    runs = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    hashes = {xxhash.xxh64_intdigest(r.encode(), 42) for r in runs}
    kept = {x >> 28 for x in hashes if x < 2**62} or ({min(hashes) >> 28} if hashes else set())
    return kept


def brute_likeness(a, b):
    return (len(a & b) / min(len(a), len(b)), len(a & b) / len(a | b)) if a and b else (float(a == b),) * 2


def text_rows():
    r = random.Random(5)
    pool = "the of and to in élan Straße 漢字 🙂 can't 42 THE Of x y z q".split()
    say = lambda k: " ".join(r.choice(pool) for _ in range(k))
    rows = [(i, say(r.choice((1, 2, 4, 5, 6, 30, 200)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "ab"), (204, "🙂🙂🙂"), (205, rows[3][1]), (-4, say(5000)), (90, rows[3][1].upper())]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_edits_against_brute_force(spark, parts):
    rows = text_rows()
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, fingerprint string, range int, row string").repartition(parts)
    got = {r.doc_id: r for r in fingerprints.edits(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, q = text or "", after or "", got[i]
        k = len(text) // 3
        changed = text[: len(text) - k] + after[:k]
        own, new, other = map(brute_sketch, (text, changed, after))
        assert (q.n_chars, q.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert q.fingerprint == "".join(f"{v:09x}" for v in sorted(own)) and q.edited_fingerprint == "".join(f"{v:09x}" for v in sorted(new))
        assert (q.near_edited, q.resemblance_edited) == pytest.approx(brute_likeness(own, new))
        assert (q.near_next, q.resemblance_next) == pytest.approx(brute_likeness(own, other))


def test_edits_of_repeats_nulls_and_few_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprints.edits(spark.createDataFrame([], schema)).count() == 0
    (alone,) = fingerprints.edits(spark.createDataFrame([(1, "a b c d e f")], schema)).collect()
    assert alone.near_next == 1.0 and alone.n_chars == 11
    rows = [(None, "a b c"), (None, "a b c"), (5, "x y"), (5, "x y"), (5, "z"), (None, None)]
    got = fingerprints.edits(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got)) == [(False, 5, 1), (False, 5, 3), (False, 5, 3), (True, 0, 0), (True, 0, 5), (True, 0, 5)]


def test_merged_sketches_are_those_of_the_union():
    r = random.Random(9)
    for _ in range(300):
        a, b = (" ".join(r.choice("abcdefgh") for _ in range(r.randrange(12))) for _ in range(2))
        both = set(fingerprints.shingles(a)) | set(fingerprints.shingles(b))
        hashes = sorted({xxhash.xxh64_intdigest(s, 42) >> 28 for s in both})
        want = [v for v in hashes if v < 2**34] or hashes[:1]
        assert fingerprints.merged(fingerprints.sketch(a), fingerprints.sketch(b)).tolist() == want
        assert fingerprints.decoded(fingerprints.encoded(np.array(want, dtype=np.uint64))).tolist() == want


def test_containment_of_very_unequal_documents(spark):
    r = random.Random(1)
    long = [f"w{r.randrange(10**6)}" for _ in range(20000)]
    a, b = " ".join(long), " ".join(long[5000:5400])
    pairs = fingerprints.fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"))
    one = pairs.filter("doc_id = 1").selectExpr("fingerprint a").crossJoin(pairs.filter("doc_id = 2").selectExpr("fingerprint b"))
    got = fingerprints.compared(one, "a", "b").first()
    assert got.containment == 1.0 and got.resemblance < 0.05


# the pipeline's stages beside columns of any name


CLASHES = ["score", "lang_pred", "lang_found", "row_key", "__row", "times_taken", "times", "taken", "size", "__copy", "fp", "root", "rank", "h", "kept"]


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    r = random.Random(2)
    words = {"en": "the of and to in is that it was for".split(), "fr": "le la les des une est dans pour que qui".split()}
    rows = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        rows.append((i, " ".join(r.choice(words[lang]) for _ in range(40)), lang, "ab"[i % 3 > 0], 7, *[f"{c}-{i}" for c in CLASHES]))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    want = {row[0]: row for row in rows}
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        back = got.collect()
        assert back and all(tuple(row) == want[row.doc_id] for row in back), name
    packed = corpus_pipeline.packing_stage(spark, docs, "")
    assert packed.select("doc_id").distinct().count() == 60


def test_near_fingerprints_of_one_cluster_link_at_radius_five(spark):
    from gridloom.llm import simhash

    r = random.Random(8)
    base, free = r.getrandbits(64), r.sample(range(64), 12)
    prints = [simhash.signed(base ^ sum(1 << p for k, p in enumerate(free) if i >> k & 1)) for i in range(4096)]
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 5)
    roots = simhash.components(found)
    assert roots.count() == 4096 and roots.select("root").distinct().count() == 1
    assert all((a ^ b).bit_count() <= 5 for a, b in ((x.a & (1 << 64) - 1, x.b & (1 << 64) - 1) for x in found.limit(2000).collect()))
