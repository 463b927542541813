"""A manifest of a table: Merkle trees of its rows by group, one tree over the groups, and a proof for every row.

Rows become leaves, ordered inside their group (``lang``) and numbered without any single
task seeing a whole group. Bottom up, every level is written: one aggregation by parent
makes the level above, and each parent keeps the digests of its children. Top down, the
parents of a level hand each child its siblings in front of what they inherited themselves,
and children join that by (group, position). A parent has ARITY children at most, so no
list grows with the table, and levels halve: both ways move about twice the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Children of a node.
ARITY = 2
#: On the way down every so many levels are one plan; then what was reached is written.
WRITTEN = 6
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose crc32 of doc_id this divides are tampered with.
TAMPERED = 7
_SIBLINGS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 length, a colon and itself; a hyphen for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row's FIELDS, some of them replaced."""
    return F.sha2(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def build(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """Levels of the trees above ``leaves``, from the leaves up, each written before the next one is made.

    ``leaves`` (a written table): grp, pos (0 to n-1 in the group), n, node. Further levels
    have kids too, the digests of a node's children. The top of a group is its row with
    n = 1; it stands on the level where the group has one node, and on none above.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves]
    while most > 1:
        below = levels[-1].where("n > 1").select("grp", F.expr(f"pos div {arity}").alias("pos"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.struct(F.col("pos").alias("at"), "node").alias("kid"))
        up = below.groupBy("grp", "pos", "n").agg(F.array_sort(F.collect_list("kid"))["node"].alias("kids"))
        levels.append(common.settle(up.select("grp", "pos", "n", F.sha2(F.array_join("kids", ""), 256).alias("node"), "kids"), "level"))
        most = -(-most // arity)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """grp and node of every group's top."""
    found = levels[0].where("n = 1").select("grp", "node")
    for level in levels[1:]:
        found = found.union(level.where("n = 1").select("grp", "node"))
    return found


def push(levels: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with ``proof``: what stands left and right of a node on its way up, from the leaf's level on, then what ``above`` (grp, proof) gives the group's top.

    Each child puts its siblings before the proof of its parent.
    """
    reached = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        held = level.where("n = 1").join(above, "grp")
        if reached is not None:
            held = held.unionByName(level.where("n > 1").join(reached, ["grp", "pos"]))
        if depth == 0:
            return held
        child = held.select("grp", "pos", "kids", "proof", F.posexplode("kids").alias("i", "kid"))
        siblings = F.struct(F.array_join(F.slice("kids", F.lit(1), F.col("i")), "").alias("left"), F.array_join(F.slice("kids", F.col("i") + 2, F.lit(arity)), "").alias("right"))
        reached = child.select("grp", (F.col("pos") * arity + F.col("i")).alias("pos"), F.concat(F.array(siblings), F.col("proof")).alias("proof"))
        if depth > 1 and depth % WRITTEN == 1:
            reached = common.settle(reached, "reached")
    return held


def fold(leaf_digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf_digest, lambda have, s: F.sha2(F.concat(s["left"], have, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, lang, leaf, changed, subroot, root and proof of every row.

    ``changed`` is the leaf as tampering leaves it: n_chars one higher where TAMPERED divides
    the crc32 of doc_id, else the leaf itself. Null values are hashed as a hyphen (so a null
    differs from an empty text); a null lang is the first group, a null doc_id the first
    leaf of its group and never tampered with; a null n_chars stays null. Rows that share a
    doc_id stand in the order of their digests, and equal rows have one leaf each, side by
    side, with proofs of their own. Texts of any length are hashed whole, where they are
    read; only digests move. An empty table gives no rows. Other columns, clashing names
    included, are not read.
    """
    rows = common.pick(docs, *FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    later = F.col("n_chars").cast("decimal(20,0)") + 1
    rows = rows.select("lang", "doc_id", leaf().alias("node"), F.when(tampered, leaf(n_chars=later)).otherwise(leaf()).alias("changed"))
    rows, _ = common.row_numbers(rows, [F.col("lang"), F.col("doc_id"), F.col("node")])
    groups = common.settle(rows.groupBy("lang").agg(F.min("row_no").alias("first"), F.count("*").alias("n")), "groups")
    groups, n_groups = common.row_numbers(groups, [F.col("lang")])
    groups = common.settle(groups.select(F.col("lang").alias("g"), "first", "n", F.col("row_no").alias("grp")), "groups")
    leaves = rows.join(groups, rows["lang"].eqNullSafe(groups["g"])).select("grp", (F.col("row_no") - F.col("first")).alias("pos"), "n", "node", "doc_id", "lang", "changed")
    levels = build(common.settle(leaves, "level"), arity)

    subroots = common.settle(tops(levels).withColumnRenamed("grp", "pos").select(F.lit(0).cast("long").alias("grp"), "pos", F.lit(n_groups).cast("long").alias("n"), "node"), "level")
    upper = build(subroots, arity)
    root = tops(upper).select("node").first()
    start = docs.sparkSession.range(1).select(F.col("id").alias("grp"), F.array().cast(_SIBLINGS).alias("proof"))
    above = common.settle(push(upper, start, arity).select(F.col("pos").alias("grp"), "node", "proof"), "above")
    proven = push(levels, above.select("grp", "proof"), arity)
    subroot = above.select(F.col("grp").alias("g"), F.col("node").alias("subroot"))
    out = proven.join(subroot, F.col("grp") == F.col("g"))
    return out.select("doc_id", "lang", F.col("node").alias("leaf"), "changed", "subroot", F.lit(root["node"] if root else None).cast("string").alias("root"), "proof")


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, digest of the proof and tamper check of every row of ``documents``; see ``manifest`` for nulls, ties and empty tables."""
    rows = manifest(common.read(spark, sf_dir, "documents"))
    folded = rows.withColumn("folded_root", fold(F.col("changed"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


#: Recursive queries climb the trees, then the proofs; crc32 is worked out bit by bit.
op13_sql = f"""
WITH RECURSIVE docs AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1)))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256({" || ".join(_sql_field(f) for f in FIELDS)}) AS leaf,
    sha256({" || ".join(_sql_field(f) if f != "n_chars" else "CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 THEN " + _sql_field("(n_chars::HUGEINT + 1)") + " ELSE " + _sql_field("n_chars") + " END" for f in FIELDS)}) AS changed
  FROM docs),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up AS (
  SELECT grp, 0 AS lvl, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT grp, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY grp, lvl, pos // 2, n),
subroots AS (SELECT grp, node FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, grp AS pos, (SELECT count(*) FROM subroots) AS n, node FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
-- where a leaf's way goes: step, place, and the sibling there
way AS (
  SELECT p.grp, p.pos AS leaf_pos, u.lvl, u.pos AS place, s.node AS sibling
  FROM placed p JOIN up u ON u.grp = p.grp AND u.n > 1 AND u.pos = p.pos >> u.lvl
  LEFT JOIN up s ON s.grp = u.grp AND s.lvl = u.lvl AND s.pos = xor(u.pos, 1)
  UNION ALL
  SELECT p.grp, p.pos, 1000 + t.lvl, t.pos, s.node
  FROM placed p JOIN top t ON t.n > 1 AND t.pos = p.grp >> t.lvl
  LEFT JOIN top s ON s.lvl = t.lvl AND s.pos = xor(t.pos, 1)),
steps AS (SELECT grp, leaf_pos, row_number() OVER (PARTITION BY grp, leaf_pos ORDER BY lvl) AS step, place, sibling FROM way),
fold AS (
  SELECT grp, pos, 1 AS step, changed AS have FROM placed
  UNION ALL
  SELECT f.grp, f.pos, f.step + 1, sha256(CASE WHEN s.place % 2 = 1 THEN coalesce(s.sibling, '') || f.have ELSE f.have || coalesce(s.sibling, '') END)
  FROM fold f JOIN steps s ON s.grp = f.grp AND s.leaf_pos = f.pos AND s.step = f.step),
proofs AS (SELECT grp, leaf_pos AS pos, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof FROM steps GROUP BY ALL),
roots AS (SELECT grp, pos, arg_max(have, step) AS folded_root FROM fold GROUP BY ALL)
SELECT p.doc_id, p.leaf, r.node AS subroot, (SELECT node FROM top WHERE n = 1) AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.folded_root,
  f.folded_root = (SELECT node FROM top WHERE n = 1) AS verified
FROM placed p JOIN subroots r ON r.grp = p.grp JOIN roots f ON f.grp = p.grp AND f.pos = p.pos LEFT JOIN proofs q ON q.grp = p.grp AND q.pos = p.pos
"""
