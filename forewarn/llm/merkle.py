"""Merkle manifest of a document table, its proofs checked by a recursive query.

Each document is a leaf: the digest of its fields. The leaves of a language, in the order of their ids, form a tree of
pairs; the trees' tops, in the order of the languages, form one more. Levels are built bottom up and stored as node
rows that name their parent. A stored row stands ``STRIDE`` levels below its parent and holds the siblings between
them, so a tree of billions of leaves has few stored levels. A recursive query then climbs from every leaf to the
root: each step appends siblings to the leaf's proof and folds the digest that the leaf has now.

A null field differs from an empty one. Null ids come first in their language, rows that agree in language, id and
leaf are told apart by their place only, and a null language is a tree of its own, before the others. A row without
id, or without ``n_chars``, is never tampered with. An empty table has no root and gives no rows; other columns of the
table don't matter. Texts of any length pass the digest whole.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.llm.common import stage_table
from forewarn.llm.ranking import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels between a stored node and its parent; one task row holds the 2^STRIDE nodes of a tile.
STRIDE = 6

_TOP = "top"


def _field(value: Column) -> Column:
    """A field as text that no other list of fields can give."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[_field(value) for value in fields]), 256)


def _hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def one_char_more(fields: dict[str, Column]) -> dict[str, Column]:
    """Tampering: ``n_chars`` grows by one where 7 divides the CRC of the id."""
    chosen = F.crc32(fields["doc_id"].cast("string").cast("binary")) % 7 == 0
    more = fields["n_chars"].cast("decimal(20,0)") + 1
    return fields | {"n_chars": F.when(chosen, more.cast("string")).otherwise(fields["n_chars"].cast("string"))}


def leaves(docs: DataFrame, tamper: Callable[[dict[str, Column]], dict[str, Column]] = one_char_more) -> DataFrame:
    """``tree``, ``doc_id``, ``leaf`` and ``changed`` (the leaf after tampering, null if it stays)."""
    fields = {name: F.col(name) for name in FIELDS}
    # "-" is before "=" and no language can look like null.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    after = tamper(fields)
    same = F.lit(True)
    for name in FIELDS:
        if after[name] is not fields[name]:
            same &= after[name].cast("string").eqNullSafe(fields[name].cast("string"))
    return docs.select(
        tree.alias("tree"),
        "doc_id",
        F.unhex(_leaf([fields[name] for name in FIELDS])).alias("leaf"),
        F.when(~same, F.unhex(_leaf([after[name] for name in FIELDS]))).alias("changed"),
    )


def _pairs(level: Column) -> Column:
    """The next level: two consecutive digests become one, a last single one too."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")),
        lambda i: F.unhex(
            F.sha2(F.concat(_hexed(F.get(level, i * 2)), F.coalesce(_hexed(F.get(level, i * 2 + 1)), F.lit(""))), 256)
        ),
    )


def _sibling(level: Column, at: Column) -> Column:
    other = at.bitwiseXOR(F.lit(1))
    left = at.bitwiseAND(F.lit(1)) == 1
    # A lone node has an empty sibling: it is hashed by itself.
    return F.struct(left.alias("left"), F.coalesce(F.get(level, other), F.lit(b"")).alias("digest"))


def _tiles(nodes: DataFrame, keep: Sequence[str], stride: int) -> DataFrame:
    """Each tile of 2^stride neighbours, once for each level: ``members``, ``at_0`` ... ``at_<stride>``."""
    tile = nodes.groupBy("tree", "total", F.shiftright("place", stride).alias("tile")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", *keep))).alias("members")
    )
    tile = tile.withColumn("at_0", F.transform("members", lambda member: member["digest"]))
    for level in range(stride):
        # A tree of one node has no further level.
        grows = F.col("total") > F.lit(1 << level)
        at = F.col(f"at_{level}")
        tile = tile.withColumn(f"at_{level + 1}", F.when(grows, _pairs(at)).otherwise(at))
    return tile


def _node_rows(tiles: DataFrame, ident: Column, above: Column, keep: Sequence[str], stride: int) -> DataFrame:
    """Node rows ``node``, ``digest``, ``parent`` and ``path``, the siblings up to the parent."""
    paths = []
    for level in range(stride):
        here = F.shiftright(F.col("place").cast("int"), level)
        paths.append(F.when(F.col("total") > F.lit(1 << level), _sibling(F.col(f"at_{level}"), here)))
    rows = tiles.select("*", F.posexplode("members").alias("place", "member"))
    return rows.select(
        "tree",
        "member.digest",
        *[f"member.{name}" for name in keep],
        ident.alias("node"),
        above.alias("parent"),
        F.array_compact(F.array(*paths)).alias("path"),
    )


def build(leaf_rows: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, DataFrame, str | None]:
    """Stored levels of all trees: the leaves' node rows, all other node rows, and the root (None without leaves).

    The driver runs one pass for each stored level and reads the root, one digest.
    """
    placed = ranked(stage_table(leaf_rows, "merkle-leaves"), "tree", ["doc_id", "leaf"], "merkle-order")
    placed = placed.withColumnRenamed("leaf", "digest")
    bottom, upper, tops = _forest(placed, ["doc_id", "changed"], F.concat(F.lit("top:"), "tree"), stride)
    # The trees' tops are the leaves of the last tree; ``named`` is their language's tree.
    last = tops.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("named"), "digest")
    last = ranked(stage_table(last, "merkle-tops"), "tree", ["named"], "merkle-top-order")
    top_nodes, top_upper, root = _forest(last, ["named"], F.lit(None).cast("string"), stride)
    top_nodes = top_nodes.withColumn("node", F.concat(F.lit("top:"), "named")).withColumn("is_top", F.lit(True))
    nodes = stage_table(top_nodes.select("node", "parent", "digest", "path", "is_top"), "merkle-top-nodes")
    for rows in (*upper, *top_upper):
        nodes = nodes.unionByName(rows.select("node", "parent", "digest", "path", F.lit(False).alias("is_top")))
    found = root.first()
    return bottom, nodes, found and found["digest"].hex()


def _forest(
    leaves_placed: DataFrame, keep: Sequence[str], out: Column, stride: int
) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Node rows of the leaves, node rows of each stored level above, and each tree's top digest.

    ``out`` names the parent of a tree's top.
    """
    level, upper, tops, nodes = 0, [], None, leaves_placed
    bottom = None
    while True:
        kept = keep if level == 0 else []
        tiles = stage_table(_tiles(nodes, kept, stride), "merkle-tiles")
        over = F.concat(F.lit(f"{level + 1}:"), F.col("tile").cast("string"), F.lit(":"), "tree")
        place = F.shiftleft("tile", stride) + F.col("place")
        ident = F.concat(F.lit(f"{level}:"), place.cast("string"), F.lit(":"), "tree")
        single = F.col("total") <= F.lit(1 << stride)
        rows = _node_rows(tiles, ident, F.when(single, out).otherwise(over), kept, stride)
        if level == 0:
            bottom = rows
        else:
            upper.append(rows)
        summit = F.get(f"at_{stride}", F.lit(0)).alias("digest")
        done = tiles.where(single).select("tree", summit)
        tops = done if tops is None else tops.unionByName(done)
        rest = tiles.where(~single)
        if rest.isEmpty():
            return bottom, upper, tops
        nodes = rest.select(
            "tree",
            F.col("tile").alias("place"),
            F.ceil(F.col("total") / F.lit(1 << stride)).alias("total"),
            summit,
        )
        level += 1


_FOLD = """aggregate({path}, {start}, (acc, s) -> sha2(
    CASE WHEN s.left THEN concat(lower(hex(s.digest)), acc) ELSE concat(acc, lower(hex(s.digest))) END, 256))"""
_SIBLINGS = "aggregate({path}, {start}, (acc, s) -> concat(acc, s.digest))"

_CLIMB = f"""
WITH RECURSIVE climb(doc_id, leaf, subroot, folded, proof, parent) AS (
  SELECT doc_id, digest, CAST(NULL AS BINARY),
         {_FOLD.format(path="path", start="lower(hex(coalesce(changed, digest)))")},
         {_SIBLINGS.format(path="path", start="CAST('' AS BINARY)")},
         parent
  FROM {{bottom}}
  UNION ALL
  SELECT c.doc_id, c.leaf, coalesce(c.subroot, CASE WHEN n.is_top THEN n.digest END),
         {_FOLD.format(path="n.path", start="c.folded")},
         {_SIBLINGS.format(path="n.path", start="c.proof")},
         n.parent
  FROM climb c JOIN {{nodes}} n ON c.parent = n.node)
SELECT doc_id, leaf, subroot, folded, proof FROM climb WHERE parent IS NULL"""


def climb(spark: SparkSession, bottom: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each leaf's way to the root: ``leaf``, ``subroot``, ``folded`` and ``proof`` (digests, joined).

    Spark stops recursive queries at a number of rows by default; here every row is wanted, so the bound is lifted
    while the result is written.
    """
    bound = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(bound)
    spark.conf.set(bound, "-1")
    try:
        return stage_table(spark.sql(_CLIMB, bottom=bottom, nodes=nodes), "merkle-climb")
    finally:
        spark.conf.set(bound, before)


def manifest(
    docs: DataFrame,
    tamper: Callable[[dict[str, Column]], dict[str, Column]] = one_char_more,
    stride: int = STRIDE,
) -> DataFrame:
    """A row for each document: its leaf, subroot, root, proof and whether the proof still leads to the root."""
    bottom, nodes, root = build(leaves(docs, tamper), stride)
    climbed = climb(docs.sparkSession, bottom, nodes)
    root = F.lit(root).cast("string")
    return climbed.select(
        "doc_id",
        _hexed(F.col("leaf")).alias("leaf"),
        _hexed(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(_hexed(F.col("proof")), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )
