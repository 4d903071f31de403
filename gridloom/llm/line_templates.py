"""Line dedup: lines parsed by a log-template tree; lines of templates that recur across documents are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import document_rows, written

#: Leading words that lead to a leaf, after the number of words: the same at any size.
DEPTH = 3
#: Slices of a leaf that are parsed on their own before their templates are parsed together: the same at any size.
SLICES = 32
#: Templates of a leaf from which an index by word and place finds those a shape can belong to.
INDEXED = 256
#: Share of equal words from which a line belongs to a template.
SIMILARITY = 0.6
#: Documents in which a template must occur to recur.
DOCUMENTS = 8
WILD = "<*>"


def templates(words: list[list[str]]) -> tuple[list[int], dict[int, str]]:
    """The template of each of a leaf's shapes, all of as many words, in the order given: the number of the shape that founded it;
    and each founder's template in the end.

    A shape goes to the most similar template (the earliest of equals) or founds one; words where the two differ become wild.
    """
    ids: dict[str, int] = {WILD: 0}
    coded = np.array([[ids.setdefault(w, len(ids)) for w in line] for line in words], dtype=np.int32)
    length = coded.shape[1]
    # so many places must agree; of any length - need + 1 places at least one agrees, so the rarest entries of these suffice
    need = next(k for k in range(length + 1) if k / length >= SIMILARITY)
    index: dict[tuple[int, int], list[int]] = {}
    found = np.empty_like(coded)
    founders: list[int] = []
    out = []
    for i, line in enumerate(coded):
        known, some = found[: len(founders)], None
        if len(founders) >= INDEXED:
            if not index:
                for j, row in enumerate(known.tolist()):
                    for key in enumerate(row):
                        index.setdefault(key, []).append(j)
            lists = sorted((index.get(key, []) for key in enumerate(line.tolist())), key=len)[: length - need + 1]
            some = np.unique(np.array([j for x in lists for j in x], dtype=np.int64))
            known = known[some]
        like = (known == line).mean(axis=1) if len(known) else np.zeros(0)
        best = int(like.argmax()) if len(known) else -1
        if best >= 0 and like[best] >= SIMILARITY:
            best = best if some is None else int(some[best])
            differ = np.flatnonzero(found[best] != line)
            if index:  # places that become wild; what they held stays in the index and is only compared in vain
                for p in differ[found[best][differ] != 0].tolist():
                    index.setdefault((p, 0), []).append(best)
            found[best][differ] = 0
        else:
            best = len(founders)
            found[best] = line
            founders.append(i)
            if index:
                for key in enumerate(line.tolist()):
                    index.setdefault(key, []).append(best)
        out.append(founders[best])
    names = list(ids)
    return out, {i: " ".join(names[w] for w in row) for i, row in zip(founders, found.tolist(), strict=False)}


def group_templates(frame: pd.DataFrame) -> pd.DataFrame:
    """shape and template (both hashes of a masked line) of whole groups, one after the other; what a template has become stands with its founder."""
    groups = frame["group"].to_numpy()
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    shapes, masked, n = frame["shape"].to_numpy(), frame["masked"].tolist(), frame["n"].to_numpy()
    template, became = shapes.copy(), list(masked)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
        if hi - lo > 1:
            found, ends = templates([m.split(" ") for m in masked[lo:hi]])
            template[lo:hi] = shapes[lo:hi][found]
            became[lo:hi] = [ends.get(i) for i in range(hi - lo)]
    return pd.DataFrame({"leaf": frame["leaf"], "shape": shapes, "template": template, "n": n, "masked": became})


def parsed_in_order(shapes: DataFrame, group: Column) -> DataFrame:
    """``group_templates`` of ``shapes`` (leaf, shape, n, masked): commonest first, then by text, group by group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            groups = batch["group"].to_numpy()
            if groups[0] == groups[-1] and held and held[-1]["group"].iloc[-1] == groups[0]:
                held.append(batch)  # a group that goes on
                continue
            last = int(np.flatnonzero(groups != groups[-1])[-1]) + 1 if groups[0] != groups[-1] else 0
            if held or last:
                yield group_templates(pd.concat([*held, batch.iloc[:last]], ignore_index=True))
            held = [batch.iloc[last:]]
        if held:
            yield group_templates(pd.concat(held, ignore_index=True))

    dealt = shapes.withColumn("group", group).repartition("group").sortWithinPartitions("group", F.desc("n"), "masked")
    return dealt.mapInPandas(run, "leaf long, shape long, template long, n long, masked string")


def parsed(lines: DataFrame) -> DataFrame:
    """(shape, template) of the shapes of ``lines`` (leaf, shape, masked) whose leaf has enough lines to hold a recurring template.

    Shapes are masked lines: words with a digit are wild. The tree leads by number of words and leading words to a leaf, in which
    templates are found. A leaf's shapes are dealt to SLICES by hash, which are parsed at once, and the templates that the slices found are
    parsed in turn, so the many variants of a common template don't meet in one task.
    """
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("lines"), F.min("shape").alias("least"), F.max("shape").alias("most")).filter(F.col("lines") >= DOCUMENTS)
    leaves = written(leaves, "leaves")
    alone = leaves.filter("least = most").select(F.col("least").alias("shape"), F.col("least").alias("template"))
    shapes = lines.groupBy("leaf", "shape", "masked").agg(F.count("*").alias("n")).join(leaves.filter("least != most").select("leaf"), "leaf")
    slices = written(parsed_in_order(shapes, F.xxhash64("leaf", F.pmod("shape", F.lit(SLICES)))), "slices")
    whole = parsed_in_order(slices.filter("masked is not null").drop("template"), F.col("leaf")).select(F.col("shape").alias("template"), F.col("template").alias("whole"))
    return alone.union(slices.select("shape", "template").join(whole, "template").select("shape", F.col("whole").alias("template")))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text.

    Lines end at line feeds; a line without a word is kept. A line is dropped if its template occurs in DOCUMENTS documents
    or more (rows equal in id and text count as one document, whose lines all go alike; other texts of an id, or without
    one, are documents of their own). Null texts are empty: one line, kept. Other columns are not read; an empty table gives an empty result.
    """
    rows = document_rows(docs, id_col, text_col)
    # most texts and lines have single spaces, no other white space and no digit: they skip the patterns
    text = F.when(F.col("text").rlike("[\\t\\x0b\\x0c\\r]"), F.translate("text", "\t\x0b\x0c\r", "    ")).otherwise(F.col("text"))
    line = F.trim(F.when(F.col("line").contains("  "), F.regexp_replace("line", " +", " ")).otherwise(F.col("line")))
    lines = rows.select("doc", "sub", F.posexplode(F.split(text, "\n")).alias("at", "line")).select("doc", "sub", "at", line.alias("line")).filter("line != ''")
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", WILD)).otherwise(F.col("line"))
    words = F.octet_length("masked") - F.octet_length(F.replace(F.col("masked"), F.lit(" "), F.lit("")))
    lines = lines.select("doc", "sub", "at", masked.alias("masked")).select("doc", "sub", "at", "masked", F.xxhash64("masked").alias("shape"), F.xxhash64(words, F.substring_index("masked", " ", DEPTH)).alias("leaf"))
    lines = written(lines, "lines")
    found = written(parsed(lines.select("leaf", "shape", "masked")), "templates")
    placed = lines.select("doc", "sub", "at", "shape").join(found, "shape").select("doc", "sub", "at", "template")
    recurring = placed.groupBy("template", "doc", "sub").agg(F.lit(1)).groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= DOCUMENTS).select("template")
    gone = placed.join(recurring, "template").groupBy("doc", "sub").agg(F.collect_set("at").alias("gone"))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for t, g in ((t, None if g is None else set(g)) for t, g in zip(texts, gone, strict=True))], dtype=object)

    out = rows.join(gone, ["doc", "sub"], "left")
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    rest = F.coalesce(kept(F.when(F.col("gone").isNotNull(), F.col("text")), "gone"), "text")  # only texts that lose a line go to Python
    return out.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"), rest.alias("kept_text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents with recurring templates dropped: counts, and a digest of what is kept."""
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.octet_length("kept_text").cast("long").alias("kept_bytes"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
