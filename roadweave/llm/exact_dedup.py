"""Exact dedup by deterministic block naming (operator 1), DataFrame functions only.

A text (A-Z lower-cased, UTF-8) is cut into blocks of ``block_bytes``.  Distinct
blocks are sorted and named by integers.  Then adjacent names are paired, the
distinct pairs are sorted and named, and so on, until one name stands for the
document.  Two texts have the same identity (number of rounds, name) if and only
if they are equal, so no digest decides.

Blocks travel once: they are grouped under a 64-bit hash with their smallest and
largest text.  If both are the same, the hash has one block and the short hash
alone carries the name back to the documents; blocks of hashes that hold several
texts are named in a second, usually empty, pass by their whole text.  Every
grouping has a map-side combine, and names return by sort-merge joins that can
be split at hot keys, so thousands of copies are one row per task on the way.

Rounds: log2 of the longest document's blocks; documents leave once they have
one name, so later rounds see the long ones only.

Cases: a null text is empty and equal to the empty text; rows with equal doc_id
count as separate documents of their group, and those with the largest doc_id
all stay; a null doc_id loses to any other; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import UPPER, ascii_lower, materialize, read

BLOCK_BYTES = 4096


def _named(values: DataFrame, columns: list[str], label: str, first: Column) -> DataFrame:
    """Distinct ``values`` with a name: their place in the sorted rows of their partition, and the partition."""
    ordered = values.sortWithinPartitions(*columns)
    return materialize(ordered.withColumn("name", first + F.monotonically_increasing_id()), label)


def _block_names(blocks: DataFrame, hash_bits: int) -> DataFrame:
    """(doc, sha, pos, name) for (doc, sha, pos, block)."""
    short = F.xxhash64("block")
    if hash_bits < 64:
        short = short.bitwiseAND(F.lit((1 << hash_bits) - 1))
    hashed = blocks.withColumn("h", short)
    groups = hashed.groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    ordered = groups.sortWithinPartitions("lo").select(
        "h", (F.lit(2) * F.monotonically_increasing_id()).alias("name"), (F.col("lo") != F.col("hi")).alias("several")
    )
    groups = materialize(ordered, "block-names")
    found = hashed.select("doc", "sha", "pos", "h").join(groups, "h")
    if groups.filter("several").isEmpty():
        return found.select("doc", "sha", "pos", "name")
    shared = hashed.join(groups.filter("several").select("h"), "h", "left_semi")
    texts = _named(shared.select("block").distinct(), ["block"], "block-names", F.lit(0))
    again = shared.join(texts, "block").select("doc", "sha", "pos", (2 * F.col("name") + 1).alias("name"))
    return found.filter(~F.col("several")).select("doc", "sha", "pos", "name").unionByName(again)


def document_names(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per distinct (key, text): doc, sha, rounds, name.  (rounds, name) is the text's identity."""
    whole = docs.select(F.col(key).alias("doc"), ascii_lower(F.col(text)).cast("binary").alias("bytes")).withColumn(
        "sha", F.sha2("bytes", 256)
    )
    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / F.lit(block_bytes)).cast("int"))
    blocks = whole.select(
        "doc",
        "sha",
        F.posexplode(
            F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring("bytes", i * block_bytes + 1, F.lit(block_bytes)))
        ).alias("pos", "block"),
    )
    level = materialize(_block_names(blocks, hash_bits), "names")
    done, rounds = [], 0
    while True:
        pairs = level.groupBy("doc", "sha", F.floor(F.col("pos") / 2).alias("pair")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"),
        )
        single = level.groupBy("doc", "sha").agg(F.max("pos").alias("last"), F.max("name").alias("name"))
        done.append(single.filter("last = 0").select("doc", "sha", F.lit(rounds).alias("rounds"), "name"))
        long = single.filter("last > 0").select("doc", "sha")
        if long.isEmpty():
            return reduce(DataFrame.unionByName, done)
        same = (F.col("p.doc").eqNullSafe(F.col("l.doc"))) & (F.col("p.sha") == F.col("l.sha"))
        pairs = pairs.alias("p").join(long.alias("l"), same, "left_semi")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], "pair-names", F.lit(0))
        named = pairs.join(names, (pairs.a == names.a) & pairs.b.eqNullSafe(names.b))
        level = materialize(named.select("doc", "sha", F.col("pair").alias("pos"), "name"), "names")
        rounds += 1


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    names = materialize(document_names(docs, key, text, block_bytes, hash_bits), "identities")
    rows = docs.select(F.col(key).alias("doc"), F.sha2(ascii_lower(F.col(text)).cast("binary"), 256).alias("sha"))
    same = F.col("r.doc").eqNullSafe(F.col("n.doc")) & (F.col("r.sha") == F.col("n.sha"))
    rows = rows.alias("r").join(names.alias("n"), same).select("r.doc", "r.sha", "n.rounds", "n.name")
    rows = materialize(rows, "identified")
    groups = rows.groupBy("rounds", "name").agg(F.max("doc").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["rounds", "name"]).select(
        F.col("doc").alias(key), "keep_id", "group_size", F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text stays elsewhere; rows repeated with one key and text stay once."""
    kept = exact_groups(docs, key, text).filter("kept").groupBy(F.col(key).alias("kept_key"), "text_sha256").count()
    kept = materialize(kept, "kept")
    sha = F.sha2(ascii_lower(F.col(text)).cast("binary"), 256)
    same = docs[key].eqNullSafe(F.col("kept_key")) & (sha == F.col("text_sha256"))
    out = docs.join(kept.select("kept_key", "text_sha256"), same, "left_semi")
    if kept.filter("count > 1").isEmpty():
        return out
    return out.withColumn("low", ascii_lower(F.col(text))).dropDuplicates([key, "low"]).drop("low")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle_sql() -> str:
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS low FROM documents),
g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY low)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.low) AS text_sha256 FROM t JOIN g USING (low)"""
