"""Merkle manifest of a dataset: a root digest, and for every row a proof that leads to it.

Rows are leaves.  Per group they stand in order of their key, and every ``fan``
nodes in a row have one parent, level by level, until one node is left; those
of the groups are joined in the same way.

Siblings come from windows: at level l the nodes stand on every ``fan ** l``-th
row, so a node's siblings are ``lag`` and ``lead`` by fixed multiples of that,
masked by the node's slot in its run and by the rows there are; the run's first
row hashes the parent.  A window holds ``CHUNK`` rows at most: whole subtrees of
a group are climbed apart, their roots are the leaves of the next round, and
what a subtree's root still needs to reach the top is joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordclips.llm.catalog import query, table
from wordclips.session import stored

FAN = 2
#: Rows in a window at most; subtrees have the largest power of the fan within it.
CHUNK = 1024
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NOTHING = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column | str) -> Column:
    """Digest of values, each as ``-`` if null, else its UTF-8 bytes' number, ``:`` and itself."""
    def said(value: Column | str) -> Column:
        text = (F.col(value) if isinstance(value, str) else value).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*[said(v) for v in values])


def _levels(fan: int, chunk: int) -> int:
    n = 1
    while fan ** (n + 1) <= chunk:
        n += 1
    return n


def _placed(nodes: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``pos`` (from 0, along ``order`` in each ``g``) and ``m`` (rows of the ``g``).

    Rows are dealt out by ranges of ``order``, ranked in each range, and the
    ranges counted; no group is sorted in one task.  Rows equal in all of
    ``order`` are interchangeable.
    """
    dealt = stored(nodes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    near = Window.partitionBy("g", "part")
    counts = dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("k"))
    far = Window.partitionBy("g")
    before = counts.select("g", "part", F.sum("k").over(far).alias("m"), (F.sum("k").over(
        far.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")).alias("before"))
    return dealt.withColumn("at", F.row_number().over(near.orderBy(*order))).join(before, ["g", "part"]) \
        .withColumn("pos", F.col("before") + F.col("at") - 1).drop("part", "at", "before")


def climb(nodes: DataFrame, fan: int, chunk: int) -> DataFrame:
    """Climb as many levels as fit in a chunk: add ``block``, ``path`` and, on a block's first row, ``top``.

    ``nodes`` has g, pos, m and node.  ``path`` holds, level by level, the digests
    left and right of the row's ancestor in its run; none for a level at which the
    group has one node left.
    """
    levels = _levels(fan, chunk)
    size = fan ** levels
    rows = nodes.withColumn("block", F.expr(f"pos div {size}")).withColumn("__n0", F.col("node"))
    w = Window.partitionBy("g", "block").orderBy("pos")
    mine = F.col("pos") % size
    for level in range(levels):
        step, node = fan ** level, f"__n{level}"
        slot = F.floor(mine / step) % fan
        live = F.col("m") > step                # more than one node at this level
        left = F.concat(*[F.coalesce(F.when(slot >= d, F.lag(node, d * step).over(w)), F.lit(""))
                          for d in range(fan - 1, 0, -1)])
        right = F.concat(*[F.coalesce(F.when(slot + d < fan, F.lead(node, d * step).over(w)), F.lit(""))
                           for d in range(1, fan)])
        rows = rows.withColumn(f"__p{level}", F.when((mine % step == 0) & live, F.struct(
            left.alias("left"), right.alias("right"))))
        pair = F.col(f"__p{level}")
        parent = F.when(live, digest(pair["left"], F.col(node), pair["right"])).otherwise(F.col(node))
        rows = rows.withColumn(f"__n{level + 1}", F.when(mine % (step * fan) == 0, parent))
    # The row of the ancestor at each level is the last one above that has a node there.
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = [F.last(f"__p{level}", True).over(upto) for level in range(levels)]
    return rows.select(*nodes.columns, "block", F.filter(F.array(*path), lambda x: x.isNotNull()).alias("path"),
                       F.col(f"__n{levels}").alias("top"))


def _grown(nodes: DataFrame, most: int, fan: int, chunk: int) -> DataFrame:
    """``nodes`` (g, pos, m, node) with ``path`` up to the group's last node, ``end``."""
    size = fan ** _levels(fan, chunk)
    near = climb(nodes, fan, chunk)
    tops = near.where(F.col("pos") % size == 0).select(
        "g", F.col("block").alias("pos"), F.ceil(F.col("m") / size).alias("m"), F.col("top").alias("node"))
    if most > size:
        far = _grown(stored(tops, "tops"), -(-most // size), fan, chunk)
        ends = far.select("g", F.col("pos").alias("block"), F.col("path").alias("__far"), "end")
    else:
        ends = tops.select("g", F.col("pos").alias("block"), F.array().cast(NOTHING).alias("__far"), F.col("node").alias("end"))
    return near.join(ends, ["g", "block"]).withColumn("path", F.concat("path", "__far")).drop("__far", "block", "top")


def grow(leaves: DataFrame, key: str, group: str, fan: int = FAN, chunk: int = CHUNK) -> DataFrame:
    """``leaves`` (with columns ``key``, ``group`` and ``leaf``) with ``path``, ``subroot`` and ``root``.

    Leaves ascend by ``key`` in each ``group``, null first, those of one key by
    digest; groups ascend bytewise as strings, null first and a group of its own.
    ``path`` has one (left, right) for each level up to the root: the digests of
    the run's other nodes.  Further columns stay, but for such named g, pos, m,
    node, part, at, before, block, top, end, k, path, subroot and root, which
    raise a ValueError.  An empty table has no rows and no root.
    """
    if fan < 2 or chunk < fan:
        raise ValueError("a run has two nodes at least, and fits in a chunk")
    taken = {"g", "pos", "m", "node", "part", "at", "before", "block", "top", "end", "k", "path", "subroot", "root"}
    if clash := sorted(taken & set(leaves.columns)):
        raise ValueError(f"columns {clash} are this operator's own; rename them")
    named = leaves.withColumn("g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))) \
        .withColumn("node", F.col("leaf"))
    placed = _placed(named, [key, "leaf"], "leaves")
    most = placed.agg(F.max("m")).first()[0] or 0
    rows = _grown(placed, most, fan, chunk)
    groups = rows.where("pos = 0").select(F.col("g").alias("name"), F.col("end").alias("node"), F.lit("").alias("g"))
    over = _placed(groups, ["name"], "subroots")
    wide = over.agg(F.max("m")).first()[0] or 0
    upper = _grown(over, wide, fan, chunk).select(F.col("name").alias("g"), F.col("path").alias("__up"), F.col("end").alias("root"))
    return rows.join(upper, "g").withColumn("path", F.concat("path", "__up")).withColumnRenamed("end", "subroot") \
        .select(*leaves.columns, "path", "subroot", "root")


def proof(path: Column | str) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(leaf_: Column, path: Column | str) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf_, lambda node, x: digest(x["left"], node, x["right"]))


#: crc32 of the decimal doc_id, byte by byte and bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(
  [4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                             lambda c, z: xor(c >> 1, (c & 1) * 3988292384::BIGINT))))"""

OP13_SQL = f"""
WITH RECURSIVE said AS (
  SELECT doc_id, lang, n_chars, coalesce({_CRC} % 7 = 0, false) AS off,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + off::INT)::VARCHAR) || ':' || (n_chars + off::INT), '-') || tail) AS other
  FROM said),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS m FROM leaves),
tree AS (
  SELECT 0 AS level, lang, pos, m, leaf AS node FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 2, (m + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM tree WHERE m > 1 GROUP BY level, lang, pos // 2, m),
subs AS (SELECT lang, node AS subroot, level AS depth FROM tree WHERE m = 1),
ranked AS (
  SELECT lang, subroot, depth, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS turn,
         count(*) OVER () AS m FROM subs),
above AS (
  SELECT 0 AS level, turn, m, subroot AS node FROM ranked
  UNION ALL
  SELECT level + 1, turn // 2, (m + 1) // 2, sha256(string_agg(node, '' ORDER BY turn))
  FROM above WHERE m > 1 GROUP BY level, turn // 2, m),
tops AS (SELECT node AS root, level AS height FROM above WHERE m = 1),
known AS (
  SELECT p.doc_id, p.lang, p.pos, p.leaf, p.other, r.subroot, r.depth, r.turn, t.root, t.height
  FROM placed p JOIN ranked r ON p.lang IS NOT DISTINCT FROM r.lang CROSS JOIN tops t),
inner_steps AS (SELECT *, unnest(range(depth)) AS level FROM known),
outer_steps AS (SELECT *, unnest(range(height)) AS level FROM known),
steps AS (
  SELECT k.doc_id, k.lang, k.pos, k.level, k.pos >> k.level AS slot, t.node
  FROM inner_steps k LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM k.lang AND t.level = k.level
       AND t.pos = xor(k.pos >> k.level, 1)
  UNION ALL
  SELECT k.doc_id, k.lang, k.pos, k.depth + k.level, k.turn >> k.level, a.node
  FROM outer_steps k LEFT JOIN above a ON a.level = k.level AND a.turn = xor(k.turn >> k.level, 1)),
paths AS (
  SELECT doc_id, lang, pos, list(CASE WHEN node IS NULL THEN '' WHEN slot % 2 = 1 THEN 'L' || node ELSE 'R' || node END
                                 ORDER BY level) AS path FROM steps GROUP BY doc_id, lang, pos),
folded AS (
  SELECT k.*, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x[2:]), '')) AS proof_sha256,
         list_reduce([k.other] || coalesce(path, []), lambda node, x: sha256(
           CASE WHEN x = '' THEN node WHEN x[1] = 'L' THEN x[2:] || node ELSE node || x[2:] END)) AS folded_root
  FROM known k LEFT JOIN paths p ON k.doc_id IS NOT DISTINCT FROM p.doc_id AND k.lang IS NOT DISTINCT FROM p.lang AND k.pos = p.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark, sf_dir):
    """Contract: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    off = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))
    changed = [F.col(c) + off.cast("int") if c == "n_chars" else F.col(c) for c in COLUMNS]
    leaves = docs.select("doc_id", "lang", leaf(*COLUMNS).alias("leaf"), F.when(off, leaf(*changed)).alias("tampered"))
    out = grow(leaves, "doc_id", "lang").withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), "path"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof("path").cast("binary"), 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
