"""Merkle manifest of a table as a persistent tree: every changed row makes a version that copies only its own ancestors.

Leaves of one tree (a language) get positions by a range shuffle. Aligned blocks of 8^3 leaves are folded each in one small group; block roots
are the leaves of the next round, so a tree of any size takes a few rounds (512 times smaller each) and no group exceeds one block. The roots of
the trees are the leaves of one last tree. A second walk, from the root down, hands every block the siblings above it, one short row a block.
With these a version copies its ancestors inside the block and goes on with its upper ancestors there; all other nodes are shared.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Children of a node, and levels folded in one block.
FAN, HEIGHT = 8, 3
BLOCK = FAN ** HEIGHT
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` nodes: a run of eight or fewer, even of one, becomes one node while several are left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def grow(nodes: list[str], height: int) -> list[list[str]]:
    """The levels of a block, its nodes first."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest(*below[k:k + FAN]) for k in range(0, len(below), FAN)])
    return levels


def path_of(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Siblings left and right of a node, level by level up to its block's root."""
    out = []
    for below in levels[:-1]:
        first = at - at % FAN
        out.append(("".join(below[first:at]), "".join(below[at + 1:first + FAN])))
        at //= FAN
    return out


def copied(path: list[tuple[str, str]], node: str) -> list[str]:
    """The nodes that a version with this node copies: its ancestors. All others are those of the tree it comes from."""
    out = []
    for left, right in path:
        node = digest(left, node, right)
        out.append(node)
    return out


def packed(path: list[tuple[str, str]]) -> str:
    """A path as text: ``left|right`` by level, each ended by ``;``."""
    return "".join(f"{a}|{b};" for a, b in path)


def unpacked(path: str) -> list[tuple[str, str]]:
    return [tuple(p.split("|")) for p in path.split(";")[:-1]]


def field(c: Column) -> Column:
    """A value's bytes in a leaf: ``-`` for null, else its length in UTF-8 bytes, a colon and the value."""
    c = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf_of(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place in ``tree`` by ``order`` (null first, rows equal in all of it in any order), and ``n``, the size of the tree.

    Rows are dealt by range, sorted and written once, so places come from counts of the ranges: no tree is one task.
    """
    base = nodes.withColumn("tie", F.monotonically_increasing_id())
    by = ["tree", *order, "tie"]
    ranged = materialise(base.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()).drop("tie"), "ranged")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    counts = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    w = Window.partitionBy("tree").orderBy("part")
    spans = counts.select("tree", "part", (F.sum("k").over(w) - F.col("k") - F.col("first")).alias("shift"), F.sum("k").over(Window.partitionBy("tree")).alias("n"))
    return ranged.join(spans, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).cast("long").alias("block")


def _sorted(group: pd.DataFrame) -> tuple[pd.DataFrame, list[list[str]]]:
    g = group.sort_values("pos")
    return g, grow([bytes(h).hex() for h in g["hash"]], min(HEIGHT, depth(int(g["n"].iloc[0]))))


def rise(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of a forest (tree, pos, n, hash): the given nodes, then block roots, down to one node a tree. Each round is written to the shared folder."""
    def root(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g, levels = _sorted(group)
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-int(g["n"].iloc[0]) // BLOCK)], "hash": [bytes.fromhex(levels[-1][0])]})

    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0]
    while most is not None:
        up = rounds[-1].select("tree", "pos", "n", "hash").groupBy("tree", _block()).applyInPandas(root, "tree string, pos long, n long, hash binary")
        rounds.append(materialise(up, "blocks"))
        most = -(-most // BLOCK)
        if most == 1:
            break
    return rounds


_ABOVE = "tree string, block long, path string, subroot string, root string"


def descend(nodes: DataFrame, above: DataFrame, emit, schema: str) -> DataFrame:
    """One round down: every block meets the row of ``above`` that holds its siblings; ``emit(group, paths, above)`` makes the rows."""
    def walk(key: tuple, group: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        g, levels = _sorted(group)
        top = over.iloc[0]
        return emit(g, [path_of(levels, k) for k in range(len(g))], top)

    return nodes.groupBy("tree", _block()).cogroup(above.groupBy("tree", "block")).applyInPandas(walk, schema)


def _child(g: pd.DataFrame, paths: list, top: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"tree": g["tree"], "block": g["pos"], "path": [packed(p) + top["path"] for p in paths], "subroot": top["subroot"], "root": top["root"]})


def _subroot(g: pd.DataFrame, paths: list, top: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"tree": g["name"], "block": 0, "path": [packed(p) + top["path"] for p in paths], "subroot": [bytes(h).hex() for h in g["hash"]], "root": top["root"]})


_RESULT = "doc_id string, leaf string, subroot string, root string, path string, changed boolean, copies array<string>"


def _version(g: pd.DataFrame, paths: list, top: pd.Series) -> pd.DataFrame:
    upper, rows = unpacked(top["path"]), []
    for doc_id, leaf, found, path in zip(g["doc_id"], g["hash"], g["found"], paths):
        leaf, now = bytes(leaf).hex(), None if found is None else bytes(found).hex()
        inside = [now or leaf, *copied(path, now or leaf)]
        # the version's nodes inside the block, then its ancestors above it
        rows.append((doc_id, leaf, top["subroot"], top["root"], packed(path) + top["path"], now is not None, inside + copied(upper, inside[-1])))
    return pd.DataFrame(rows, columns=["doc_id", "leaf", "subroot", "root", "path", "changed", "copies"])


def manifest(docs: DataFrame, changed: Column | None = None, changed_text: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot (of its ``lang``), root, path (siblings, see :func:`packed`), changed, copies.

    ``copies`` are the nodes of the row's version from its leaf up to the version's root: those of a row whose text is now ``changed_text`` where
    ``changed``, and those of the tree itself for any other row. A row is intact if the last one is ``root``.

    A tree is a language, null languages are one of their own and come first. Leaves ascend by doc_id (null first), rows of one doc_id by their
    hash; equal rows have equal leaves, so their order does not matter. Null fields are ``-``, an empty text is ``0:``; texts are hashed whole.
    Other columns are ignored; an empty table gives an empty table.
    """
    leaf = leaf_of()
    found = F.when(changed, leaf_of(text=changed_text)) if changed is not None else F.lit(None).cast("string")
    tree = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))  # "-" sorts before "="
    leaves = materialise(docs.select(*FIELDS).select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), F.unhex(leaf).alias("hash"), F.unhex(found).alias("found")), "leaves")
    trees = rise(numbered(leaves, ["id", "hash"]).select("tree", "pos", "n", "hash", F.col("id").cast("string").alias("doc_id"), "found"))
    if len(trees) == 1:
        return docs.sparkSession.createDataFrame([], _RESULT).withColumn("doc_id", F.col("doc_id").cast("long"))
    tops = trees[-1].select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "hash")
    top = rise(materialise(numbered(tops, ["name"]), "subroots"))
    above = top[-1].select("tree", F.col("pos").alias("block"), F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("hash")).alias("root"))
    for nodes in top[-2:0:-1]:
        above = descend(nodes, above, _child, _ABOVE)
    above = descend(top[0], above, _subroot, _ABOVE)
    for nodes in trees[-2:0:-1]:
        above = descend(nodes, above, _child, _ABOVE)
    return descend(trees[0], above, _version, _RESULT).withColumn("doc_id", F.col("doc_id").cast("long"))


def versions(found: DataFrame) -> DataFrame:
    """The nodes that the versions of changed rows own: doc_id, level (0 for the leaf), hash. Every other node of a version is the tree's."""
    return found.where("changed").select("doc_id", F.posexplode("copies").alias("level", "hash"))


def verification(found: DataFrame) -> DataFrame:
    """Digest of :func:`manifest`: doc_id, leaf, subroot, root, proof_sha256 (of all siblings), folded_root (the version's), verified."""
    folded = F.element_at("copies", -1)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.translate("path", "|;", ""), 256).alias("proof_sha256"), folded.alias("folded_root"),
                        (folded == F.col("root")).alias("verified"))


def every_third(doc_id: str = "doc_id") -> Column:
    """Rows whose id's crc32 is divisible by three; a null id never is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def lower_ascii(text: str = "text") -> Column:
    return F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
