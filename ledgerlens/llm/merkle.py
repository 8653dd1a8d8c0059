"""Merkle manifest of a dataset: a tree of SHA-256 digests per group of rows, and one over the groups' roots.

A row's leaf is the digest of its fields. Leaves of a group stand in key order; 16 consecutive nodes (the last run may be
shorter) become the digest of their digests, until one is left, the group's subroot. Subroots in group order likewise give
the root. A row's proof is the digests of its siblings on every level: with them anyone who holds the row can recompute
the root, and a changed row gives another one.

Every level is one self-join: a slot-zero node asks for the nodes at its own index plus each slot offset of its run, an
equijoin on (tree, index) finds them, and the slot-zero rows with the digests they got emit the parents. Keys are
(tree, index), so a group with a third of all rows is spread like any other. Positions in a group come from a range
partitioning by (group, key, leaf) whose partitions are counted, never from a window over a group. Proof paths go down the
levels once per run, not once per row: all rows of a run share them, and the shuffle carries levels x 16 digests for 16 rows.

The driver sees the largest group's size (for the number of levels) and the root. Levels are tables in the shared folder.

Nulls: a null field is ``-``, a null group is the first, a null key comes first in its group. Rows with equal group and key
stand in order of their leaves; rows equal in every field have the same leaf, and which of them gets which position changes
no digest. One row: its leaf is the root, the proof is the digest of nothing. Empty table: no rows. Long texts are hashed
whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored
from ledgerlens.llm.numbering import positions

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EMPTY = "array<struct<digests:array<string>,slot:int>>"


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields, each ``-`` or its UTF-8 byte count, ``:`` and value."""
    parts = []
    for c in fields:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def tree_name(group: Column) -> Column:
    """A text without nulls that sorts as the group does, null first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


@dataclass(frozen=True)
class Trees:
    """``leaves`` (tree, idx, n, digest and what the rows carry), ``levels[k]`` (tree, run, n, digests), ``roots`` (tree, digest)."""

    leaves: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def build(leaves: DataFrame, fanout: int = FANOUT) -> Trees:
    """The levels above ``leaves`` (tree, idx, n, digest)."""
    nodes = leaves.select("tree", "idx", "n", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], nodes.where("n = 1")
    while most > 1:
        live = nodes.where("n > 1")
        offset = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(fanout - 1).cast("long"), F.col("n") - 1 - F.col("idx"))))
        zero = live.where(F.col("idx") % fanout == 0).select("tree", "n", F.col("idx").alias("start"), offset.alias("slot"))
        wanted = zero.withColumn("idx", F.col("start") + F.col("slot"))
        met = wanted.join(live.select("tree", "idx", "digest"), ["tree", "idx"])
        runs = met.groupBy("tree", "start").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("slot", "digest"))).alias("met"))
        level = stored(
            runs.select("tree", F.floor(F.col("start") / fanout).alias("run"), "n", F.transform("met", lambda m: m["digest"]).alias("digests")),
            f"merkle-level-{len(levels)}",
        )
        levels.append(level)
        nodes = level.select("tree", F.col("run").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.array_join("digests", ""), 256).alias("digest"))
        roots = roots.unionByName(nodes.where("n = 1"))
        most = -(-most // fanout)
    return Trees(leaves, levels, roots.select("tree", "digest"))


def with_paths(trees: Trees, above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``trees.leaves`` with ``path``: for each level from the leaf's run up, the run's digests and the own slot in it.

    ``above`` (tree, path and more) has what follows a tree's root; its other columns are added to the leaves.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    rest = above.select(F.col("tree").alias("up_tree"), F.col("path").alias("up_path"), *[F.col(c).alias(f"up_{c}") for c in more])
    carried = [F.col(f"up_{c}").alias(c) for c in more]

    def joined(below: DataFrame, at: str, one: Column, up: DataFrame | None) -> DataFrame:
        """Rows of ``below`` with the path above them; ``one``: they stand right under their tree's root."""
        tops = below.where(one).join(rest, F.col("tree") == F.col("up_tree"))
        out = tops.select(below["*"], F.col("up_path").alias("path"), *carried)
        if up is not None:
            runs = up.select(F.col("tree").alias("up_tree"), F.col("run").alias("up_run"), F.col("digests").alias("up_digests"), F.col("path").alias("up_path"), *[F.col(c).alias(f"up_{c}") for c in more])
            met = below.where(~one).join(runs, (F.col("tree") == F.col("up_tree")) & (F.floor(F.col(at) / fanout) == F.col("up_run")))
            step = F.struct(F.col("up_digests").alias("digests"), (F.col(at) % fanout).cast("int").alias("slot"))
            out = out.unionByName(met.select(below["*"], F.concat(F.array(step), F.col("up_path")).alias("path"), *carried))
        return out

    up = None
    for k in reversed(range(len(trees.levels))):
        up = joined(trees.levels[k], "run", F.col("n") <= fanout, up)
        if k:
            up = stored(up, f"merkle-paths-{k}")
    return joined(trees.leaves, "idx", F.col("n") == 1, up)


def siblings(path: Column) -> Column:
    """The other digests of every run, level by level, left to right, as one text."""
    return F.array_join(F.flatten(F.transform(path, lambda p: F.filter(p["digests"], lambda d, i: i != p["slot"]))), "")


def folded(path: Column, digest: Column) -> Column:
    """The root that ``digest`` in the place of the own leaf leads to."""
    def put(p: Column, own: Column) -> Column:
        return F.sha2(F.array_join(F.transform(p["digests"], lambda d, i: F.when(i == p["slot"], own).otherwise(d)), ""), 256)

    return F.aggregate(path, digest, lambda own, p: put(p, own))


def manifest(rows: DataFrame, order: list[str]) -> tuple[DataFrame, str | None]:
    """(rows with ``path``, ``subroot``; root). ``rows``: tree, digest, the columns of ``order`` and others to carry."""
    placed = stored(positions(rows, [*order, "digest"]), "merkle-leaves")
    trees = build(placed)
    groups = stored(trees.roots, "merkle-subroots")
    # the groups are the leaves of the top tree
    tops = positions(groups.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"])
    top = build(stored(tops, "merkle-groups"))
    root = top.roots.select("digest").first()
    ends = top.leaves.select("tree").distinct().withColumn("path", F.array().cast(EMPTY))
    above = with_paths(top, ends).select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"))
    return with_paths(trees, stored(above, "merkle-group-paths")), root[0] if root else None


def document_manifest(documents: DataFrame) -> tuple[DataFrame, str | None]:
    """Manifest of documents by source and ``doc_id``, with ``tampered``, the leaf of the document after the test change.

    The change lower-cases A-Z in the text of documents whose crc32(doc_id) 5 divides; others keep their leaf.
    """
    fields = {f: F.col(f) for f in FIELDS}
    changed = fields | {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))}
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), tree_name(F.col("source")).alias("tree"),
        leaf(list(fields.values())).alias("digest"), leaf(list(changed.values())).alias("tampered"),
    )
    return manifest(rows, ["doc_id"])


def verified(documents: DataFrame) -> DataFrame:
    """One row per document: its leaf, subroot, root, digest of its proof, and the root its tampered leaf folds to."""
    placed, root = document_manifest(documents)
    out = placed.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("path"), F.col("tampered")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _encoded(fields: tuple[str, ...], text: str) -> str:
    def one(f: str) -> str:
        v = text if f == "text" else f"CAST({f} AS VARCHAR)"
        return f"coalesce(CAST(octet_length(encode({v})) AS VARCHAR) || ':' || {v}, '-')"

    return " || ".join(one(f) for f in fields)


#: crc32 bit by bit over the digits of doc_id
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), CAST(4294967295 AS BIGINT)))"""

OP13_SQL = f"""
WITH RECURSIVE changed AS (
  SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed_text FROM documents
), leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, sha256({_encoded(FIELDS, 'text')}) AS leaf,
    sha256({_encoded(FIELDS, 'changed_text')}) AS tampered FROM changed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS row_id, count(*) OVER (PARTITION BY tree) AS n,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), up AS (
  SELECT 0 AS k, tree, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT k + 1, tree, idx // 16, max((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY k, tree, idx // 16
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS k, idx, n, digest FROM subroots
  UNION ALL
  SELECT k + 1, idx // 16, max((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY k, idx // 16
), fold AS (
  SELECT row_id, 0 AS k, tree, idx, tampered AS digest FROM placed
  UNION ALL
  SELECT f.row_id, f.k + 1, f.tree, f.idx // 16, sha256(string_agg(CASE WHEN u.idx = f.idx THEN f.digest ELSE u.digest END, '' ORDER BY u.idx))
  FROM fold f JOIN up u ON u.k = f.k AND u.tree = f.tree AND u.idx // 16 = f.idx // 16 AND u.n > 1 GROUP BY f.row_id, f.k, f.tree, f.idx
), folded AS (
  SELECT row_id, tree, arg_max(digest, k) AS digest FROM fold GROUP BY row_id, tree
), climb AS (
  SELECT f.row_id, 0 AS k, s.idx, f.digest FROM folded f JOIN subroots s USING (tree)
  UNION ALL
  SELECT f.row_id, f.k + 1, f.idx // 16, sha256(string_agg(CASE WHEN u.idx = f.idx THEN f.digest ELSE u.digest END, '' ORDER BY u.idx))
  FROM climb f JOIN top u ON u.k = f.k AND u.idx // 16 = f.idx // 16 AND u.n > 1 GROUP BY f.row_id, f.k, f.idx
), proven AS (
  SELECT row_id, arg_max(digest, k) AS folded_root FROM climb GROUP BY row_id
), others AS (
  SELECT f.row_id, 0 AS part, f.k, u.idx, u.digest FROM fold f JOIN up u ON u.k = f.k AND u.tree = f.tree AND u.idx // 16 = f.idx // 16 AND u.idx <> f.idx AND u.n > 1
  UNION ALL
  SELECT f.row_id, 1, f.k, u.idx, u.digest FROM climb f JOIN top u ON u.k = f.k AND u.idx // 16 = f.idx // 16 AND u.idx <> f.idx AND u.n > 1
), proof AS (
  SELECT row_id, string_agg(digest, '' ORDER BY part, k, idx) AS siblings FROM others GROUP BY row_id
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(o.siblings, '')) AS proof_sha256, v.folded_root, v.folded_root = r.digest AS verified
FROM placed p JOIN subroots s USING (tree) JOIN proven v USING (row_id) LEFT JOIN proof o USING (row_id) CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
"""
