"""Merkle dataset manifest: a root over all rows, a proof for each, and a check of a copy against it.

A row's leaf digests its fields; leaves of a source, in order of doc_id, make a tree of fan-out 3, and
the subroots of the sources make one more above them. Trees are cut into superblocks of 3^6
consecutive nodes. A first pass folds each superblock to one node; the nodes of a tree's superblocks
are nodes of the next round, until a tree is one node. On the way back, the nodes of a round and what
their superblocks need from outside (the siblings above, one row a superblock) are cogrouped by
superblock: the stage folds inside, joins inner and outer siblings to a proof, and folds the copy's
leaf along it. No group holds more than 3^6 rows, whatever the sources' sizes, and texts are read
once and never shuffled: only digests are.

Defined results: null fields count as "-"; a null source is a tree of its own, before all others;
null doc_ids come first; rows of one doc_id are ordered by their leaf, and repeated rows are leaves
of their own. A null doc_id's copy is not tampered with in the query. An empty table has no rows.
Columns other than the five are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import number
from .common import CRC_SQL, crc32_sql, cut, join_by_count, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Children of a node, and levels that one superblock folds.
FAN, DEPTH = 3, 6


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: of each field "-" if null, else its length in UTF-8 bytes, a colon and its value."""

    def spelled(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(spelled, fields)), 256)


def leaves(docs: DataFrame, copied_text: Column | None = None) -> DataFrame:
    """tree, doc_id, leaf, claim: the claim is the leaf of the copy, whose text may differ; trees sort as sources, null first."""
    own = [F.col(c) for c in FIELDS]
    claim = leaf([*own[:-1], F.col("text") if copied_text is None else copied_text])
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    return docs.select(tree.alias("tree"), "doc_id", leaf(own).alias("leaf"), claim.alias("claim"))


def _digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _height(n: int) -> int:
    """Levels from n nodes to one."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * FAN
    return levels


def _tower(nodes: list[str], n: int, depth: int) -> list[list[str]]:
    """The levels of a superblock of a tree of n nodes; the last has one node."""
    levels = [nodes]
    for _ in range(min(depth, _height(n))):
        low = levels[-1]
        levels.append([_digest(low[i : i + FAN]) for i in range(0, len(low), FAN)])
    return levels


def _siblings(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """What stands left and right of a node's ancestors in their runs, level by level."""
    for level in levels[:-1]:
        first = at - at % FAN
        yield "".join(level[first:at]), "".join(level[at + 1 : first + FAN])
        at //= FAN


def _block(depth: int) -> Column:
    return F.expr(f"pos div {FAN**depth}").alias("block")


def superblocks(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """tree, pos, n, hash of the superblocks of nodes (tree, pos, n, hash), n being the number of nodes of the tree."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        top = _tower(pdf.sort_values("pos")["hash"].tolist(), n, depth)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // FAN**depth)], "hash": [top]})

    return nodes.select("tree", "pos", "n", "hash").groupBy("tree", _block(depth)).applyInPandas(fold, "tree string, pos long, n long, hash string")


PROVED = "tree string, pos long, doc_id long, hash string, proof string, subroot string, root string, folded string"


def joined(nodes: DataFrame, outer: DataFrame, depth: int = DEPTH) -> DataFrame:
    """PROVED of nodes (tree, pos, n, doc_id, hash, claim) by what their superblocks (tree, pos) know: proof, subroot and root.

    A proof is one string: levels parted by "/", in each the siblings to the left, "|", and those to the right.
    """

    def prove(key: tuple, inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        levels = _tower(inner["hash"].tolist(), int(inner["n"].iloc[0]), depth)
        beyond = above["proof"].iloc[0]
        outside = [tuple(x.split("|")) for x in beyond.split("/")] if beyond else []
        proofs, folded = [], []
        for i, claim in enumerate(inner["claim"]):
            steps = [*_siblings(levels, i), *outside]
            for left, right in steps:
                claim = _digest([left, claim, right])
            proofs.append("/".join([f"{left}|{right}" for left, right in steps]))
            folded.append(claim)
        return inner[["tree", "pos", "doc_id", "hash"]].assign(proof=proofs, subroot=above["subroot"].iloc[0], root=above["root"].iloc[0], folded=folded)

    mine = nodes.withColumn("block", _block(depth)).groupBy("tree", "block")
    theirs = outer.select("tree", F.col("pos").alias("block"), "proof", "subroot", "root").groupBy("tree", "block")
    return mine.cogroup(theirs).applyInPandas(prove, PROVED)


def tops(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """tree, pos, proof, root of nodes (tree, pos, n, hash), each within its own tree; a round for every so many levels."""
    blocks = cut(superblocks(nodes, depth))
    if blocks.filter("n > 1").isEmpty():
        above = blocks.select("tree", "pos", F.lit("").alias("proof"), F.col("hash").alias("root"))
    else:
        above = tops(blocks, depth)
    known = nodes.select("tree", "pos", "n", F.lit(None).cast("long").alias("doc_id"), "hash", F.col("hash").alias("claim"))
    return joined(known, above.withColumn("subroot", F.col("root")), depth).select("tree", "pos", "proof", "root")


def manifest(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof and folded (the root that the claim leads to) of rows (tree, doc_id, leaf, claim)."""
    numbered = number(cut(rows), ["tree", "doc_id", "leaf"], "no")
    trees = cut(numbered.groupBy("tree").agg(F.min("no").alias("first"), F.count("*").alias("n")))
    total = trees.agg(F.sum("n")).first()[0] or 0
    placed = join_by_count(numbered, trees.withColumn("many", F.col("n")), ["tree"], "many", total)
    nodes = cut(placed.select("tree", (F.col("no") - F.col("first")).alias("pos"), "n", "doc_id", F.col("leaf").alias("hash"), "claim"))

    blocks = cut(superblocks(nodes, depth))
    inner = cut(tops(blocks, depth))
    subroots = cut(inner.groupBy("tree").agg(F.min("root").alias("hash"), F.count("*").alias("many")))
    ranked = cut(number(subroots, ["tree"], "no").select("tree", (F.col("no") - 1).alias("pos"), F.lit(subroots.count()).cast("long").alias("n"), "hash", "many"))
    over = tops(ranked.withColumn("tree", F.lit("")), depth).select("pos", F.col("proof").alias("over"), "root")
    named = cut(ranked.join(over, "pos").select("tree", "many", F.col("hash").alias("subroot"), "over", "root"))
    proof = F.concat_ws("/", F.nullif("proof", F.lit("")), F.nullif("over", F.lit("")))
    outer = join_by_count(inner.drop("root"), named, ["tree"], "many", inner.count()).select("tree", "pos", proof.alias("proof"), "subroot", "root")
    return joined(nodes, outer, depth).select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "proof", "folded")


def tampered(text: str = "text") -> Column:
    """The query's copy: of every second row by the digest of its id, the text without line ends."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(picked, F.lit(False)), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(F.col(text))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    found = manifest(leaves(table(spark, sf_dir, "documents"), tampered()), depth)
    siblings = F.translate("proof", "|/", "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    spelled = [f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END" for c in [*FIELDS[:-1], text]]
    return f"sha256({' || '.join(spelled)})"


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
docs AS (
  SELECT *, CASE WHEN {crc32_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS copied
  FROM documents, crc),
leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {_leaf_sql('text')} AS leaf, {_leaf_sql('copied')} AS claim FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
inner_up AS (
  SELECT tree, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM inner_up WHERE n > 1 GROUP BY tree, level, pos // 3, n),
subroots AS (SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n FROM inner_up WHERE n = 1),
outer_up AS (
  SELECT 0 AS level, place AS pos, n, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM outer_up WHERE n > 1 GROUP BY level, pos // 3, n),
runs AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM inner_up a JOIN inner_up b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos),
outer_runs AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM outer_up a JOIN outer_up b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.level, a.pos),
steps AS (
  SELECT p.tree, p.pos, r.level AS step, r.l, r.r FROM placed p JOIN runs r ON r.tree = p.tree AND r.pos = p.pos // CAST(3 ** r.level AS BIGINT)
  UNION ALL SELECT p.tree, p.pos, s.height + r.level, r.l, r.r FROM placed p JOIN subroots s ON s.tree = p.tree JOIN outer_runs r ON r.pos = s.place // CAST(3 ** r.level AS BIGINT)),
proofs AS (SELECT tree, pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof, count(*) AS n_steps FROM steps GROUP BY tree, pos),
folds AS (
  SELECT tree, pos, 0 AS step, claim AS h FROM placed
  UNION ALL SELECT f.tree, f.pos, f.step + 1, sha256(s.l || f.h || s.r) FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, coalesce(x.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN outer_up t ON t.n = 1 LEFT JOIN proofs x ON x.tree = p.tree AND x.pos = p.pos
JOIN folds f ON f.tree = p.tree AND f.pos = p.pos AND f.step = coalesce(x.n_steps, 0)
"""
