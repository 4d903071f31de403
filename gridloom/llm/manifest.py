"""Merkle manifest of a dataset: parents keep the concatenated hashes of their children, and proofs and folds are read off them."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import written

#: Children of a node, as a power of two, and length of a hash as text.
FAN_BITS, DIGEST = 3, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One ancestor on the way up: the hashes of all its children, and which child the way comes from.
PATH = "array<struct<pre string, slot int>>"


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def leaf_hash(**values: Column) -> Column:
    """The hash of a row: every value by its length in bytes and itself, ``-`` where it is null."""
    texts = [v.cast("string") for v in values.values()]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with pos (place within their tree from 0, by ``order``) and n (rows of the tree), written.

    Rows are dealt by ranges of (tree, order), so a tree of any share of the rows is spread over tasks; a row's place is its rank within
    its range plus what its tree has in the ranges before.
    """
    keys = [F.col(tree), *[F.col(c).asc_nulls_first() for c in order]]
    ranges = written(rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(tree, "__range").agg(F.count("*").alias("__rows"))
    whole = Window.partitionBy(tree)
    before = F.sum("__rows").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(tree, "__range", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias("n"))
    rank = F.row_number().over(Window.partitionBy(tree, "__range").orderBy(*keys[1:]))
    ranked = ranges.withColumn("__rank", rank).join(counts, [tree, "__range"])
    return written(ranked.withColumn("pos", F.col("__before") + F.col("__rank") - 1).drop("__range", "__before", "__rank"), "placed")


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, pre, hash) one level above ``nodes`` (tree, pos, n, hash): pre is the concatenation of the children's hashes."""
    children = F.array_sort(F.collect_list(F.struct("pos", "hash")))
    up = nodes.groupBy("tree", F.shiftright("pos", FAN_BITS).alias("up"), F.shiftright(F.col("n") + (1 << FAN_BITS) - 1, FAN_BITS).alias("n"))
    pre = F.array_join(F.transform(children, lambda x: x["hash"]), "")
    return up.agg(pre.alias("pre")).select("tree", F.col("up").alias("pos"), "n", "pre", digest(F.col("pre")).alias("hash"))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels of all trees from the leaves up, each an eighth of the one below, written; a tree ends with the level where n is 1."""
    found, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        found.append(written(parents(found[-1].filter("n > 1").select("tree", "pos", "n", "hash")), f"level-{len(found)}"))
        most = -(-most // (1 << FAN_BITS))
    return found


def tops(found: list[DataFrame]) -> DataFrame:
    """(tree, hash): the last node of each tree."""
    ends = [level.filter("n = 1").select("tree", "hash") for level in found]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def with_paths(found: list[DataFrame], above: DataFrame, *more: str) -> DataFrame:
    """The leaves (tree, pos, n, hash and ``more``) with the columns of ``above`` (tree, path, ...): path leads from the leaf's parent to the
    last node of its tree and goes on with that of ``above``.

    Levels take the ways of their parents from the top down, by joins of eight rows to one; no way is longer than the trees are high.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    ways = None
    for i in reversed(range(len(found))):
        level = found[i].select("tree", "pos", "n", *(["pre"] if i else more), *([] if i else ["hash"]))
        own = level.columns
        here = level.filter("n = 1").join(above, "tree").select(*own, "path", *extra)
        if ways is not None:
            up = ways.select("tree", F.col("pos").alias("__up"), F.col("pre").alias("__pre"), F.col("path").alias("__path"), *extra)
            below = level.filter("n > 1").withColumn("__up", F.shiftright("pos", FAN_BITS)).join(up, ["tree", "__up"])
            step = F.struct(F.col("__pre").alias("pre"), F.pmod("pos", F.lit(1 << FAN_BITS)).cast("int").alias("slot"))
            here = here.unionByName(below.select(*own, F.concat(F.array(step), F.col("__path")).cast(PATH).alias("path"), *extra))
        ways = written(here, f"ways-{i}") if i else here
    return ways


def siblings(path: Column) -> Column:
    """The other children's hashes along a way, level by level upwards, concatenated: every preimage without the way's own slot."""
    return F.array_join(F.transform(path, lambda p: F.concat(F.substring(p["pre"], F.lit(1), p["slot"] * DIGEST), p["pre"].substr(p["slot"] * DIGEST + DIGEST + 1, F.length(p["pre"])))), "")


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to: it replaces its slot in each preimage in turn."""
    return F.aggregate(path, start, lambda h, p: digest(F.overlay(p["pre"], h, p["slot"] * DIGEST + 1)))


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (group, hash and more) with subroot, root and path.

    Each group's leaves are a tree by ``order`` (nulls first; ties by hash, so the tree is a function of the rows), the groups' subroots in order of the
    group (null first, bytewise) are one more. A single node is its own root. An empty table stays empty.
    """
    more = [c for c in leaves.columns if c not in ("group", "hash")]
    # null first, and apart from any group's name
    rows = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "group"), F.lit(""))).drop("group")
    found = levels(placed(rows, "tree", [*order, "hash"]))
    subroots = written(tops(found).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash"), "subroots")
    upper = levels(placed(subroots, "tree", ["of"]))
    root = tops(upper).first()
    above = with_paths(upper, root_row(leaves.sparkSession), "of").select(F.col("of").alias("tree"), "path", F.col("hash").alias("subroot"))
    return with_paths(found, above, *more).withColumn("root", F.lit(root["hash"] if root else None).cast("string")).select(*more, "hash", "subroot", "root", "path")


def root_row(spark: SparkSession) -> DataFrame:
    """The empty way of the topmost node."""
    return spark.range(1).select(F.lit("").alias("tree"), F.array().cast(PATH).alias("path"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def document_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves hash doc_id, source, lang, n_chars and text; nulls have a mark of their own, so null and empty differ. Where 3 divides the id's crc32 (a null id
    counts as empty, so it is among them) the text is tampered with: A-Z become lower case. folded_root is what the tampered leaf, else the leaf itself, leads to with the
    siblings of the untampered tree; verified says whether that is the root, so texts without A-Z stay verified. Null ids come first; rows
    that repeat an id rank by leaf, and rows equal in every field are interchangeable. Other columns are not read.
    """
    values = {c: F.col(c) for c in FIELDS}
    hit = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 0
    tampered = F.when(hit, leaf_hash(**values | {"text": lower_ascii(F.col("text"))}))
    leaves = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("group"), leaf_hash(**values).alias("hash"), tampered.alias("tampered"))
    rows = manifest(leaves, ["doc_id"])
    fold = folded(F.coalesce("tampered", "hash"), F.col("path"))
    out = rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, a tree for each language."""
    return document_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


FIELD = "coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
LEAF = "sha256(" + " || ".join(FIELD.format(c="{text}" if c == "text" else c) for c in FIELDS) + ")"
#: crc32 of the decimal id, bit by bit: each byte comes with seven zeros, and every step divides by the polynomial (a fixed value).
CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, lang, {LEAF.format(text="text")} AS leaf,
         CASE WHEN {CRC} % 3 = 0 THEN {LEAF.format(text=f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} ELSE {LEAF.format(text="text")} END AS now
  FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, level, pos // 8, n),
s AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, n, h FROM s
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 8, n),
a AS MATERIALIZED (
  SELECT doc_id, level, sib.pos AS pos, sib.h AS h, sib.pos = (p.pos >> (3 * level)) AS own
  FROM p JOIN t sib ON p.lang IS NOT DISTINCT FROM sib.lang AND sib.n > 1 AND sib.pos // 8 = (p.pos >> (3 * sib.level)) // 8
  UNION ALL
  SELECT doc_id, 1000 + level, sib.pos, sib.h, sib.pos = (s.pos >> (3 * level))
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN u sib ON sib.n > 1 AND sib.pos // 8 = (s.pos >> (3 * sib.level)) // 8),
w AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step, string_agg(CASE WHEN NOT own THEN h ELSE '' END, '' ORDER BY pos) AS others,
                          string_agg(CASE WHEN pos < mine THEN h ELSE '' END, '' ORDER BY pos) AS lo, string_agg(CASE WHEN pos > mine THEN h ELSE '' END, '' ORDER BY pos) AS hi
                   FROM (SELECT *, max(CASE WHEN own THEN pos END) OVER (PARTITION BY doc_id, level) AS mine FROM a) GROUP BY doc_id, level),
f AS (
  SELECT doc_id, 0 AS step, now AS h FROM p
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(w.lo || f.h || w.hi) FROM f JOIN w ON w.doc_id = f.doc_id AND w.step = f.step + 1),
proofs AS (SELECT doc_id, sha256(string_agg(others, '' ORDER BY step)) AS proof_sha256 FROM w GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM f GROUP BY doc_id)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT h FROM u WHERE n = 1) r ON TRUE JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)
"""
