"""A Merkle manifest of a table: leaves by row, subroots by language, one root, and a proof for every row.

Every row is a leaf: the hash of its five columns, each told with its length. The leaves of a language are numbered by
``doc_id`` in many tasks. A level is one window: rows of a group and parent index, ordered, with the full frame, whose
``collect_list`` gives the parent's preimage and, without the own entry, the siblings; one row of each parent goes on.
A window holds at most ``FAN`` rows, so a language with a third of all rows is spread like any other. The subroots are
the leaves of one more tree of the same kind. On the way down every node gets the sibling entries of its parent by a
join on group and parent index, so proofs have as many entries as there are levels. Proofs are folded by SQL functions.

Nulls in any column count as ``-``; a null language is a group of its own, the first. Null ids come first within their
language and are not tampered. Rows with equal ids are ordered by their leaf; rows equal in all columns get proofs of
neighbouring places. Texts may be of any length. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlight.operators.positions import numbered

from .common import forget, settle

FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def told(value: Column) -> Column:
    """A value with its length in UTF-8 bytes, ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, g, leaf, altered``: the leaf, and the leaf of the row as it may have been tampered with; ``g`` orders as the language, null first."""
    row = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    of = lambda **changed: digest(*map(told, (row | changed).values()))
    tampered = F.crc32(row["doc_id"].cast("string")) % 3 == 0
    group = F.coalesce(F.concat(F.lit("+"), row["lang"]), F.lit(""))
    return docs.select(row["doc_id"].cast("long").alias("doc_id"), group.alias("g"), of().alias("leaf"), F.when(tampered, of(text=F.translate("text", UPPER, LOWER))).alias("altered"))


def climb(nodes: DataFrame, own: list[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The levels over ``g, pos, n, hash`` (n: nodes of the group), and ``g, height, hash`` of the last node of each group.

    A level has ``g, pos, up, left, right`` of its nodes in groups with several: ``up`` is the parent's place, ``left``
    and ``right`` the siblings' hashes. The first level keeps the columns ``own``.
    """
    levels, last = [], nodes.where("n = 1").select("g", F.lit(0).alias("height"), "hash")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        family = Window.partitionBy("g", "up").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = (F.col("pos") % FAN).cast("int")
        joined = lambda start, length: F.array_join(F.slice("run", start, length), "")
        seen = nodes.where("n > 1").withColumn("up", F.floor(F.col("pos") / FAN)).withColumn("run", F.collect_list("hash").over(family))
        level = settle(seen.select("g", "pos", "up", "n", *own, joined(F.lit(1), at).alias("left"), joined(at + 2, F.lit(FAN)).alias("right"), F.when(at == 0, digest(F.array_join("run", ""))).alias("parent")), "level")
        levels.append(level)
        nodes, own, most = level.where("parent is not null").select("g", F.col("up").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), F.col("parent").alias("hash")), [], -(-most // FAN)
        last = last.unionByName(nodes.where("n = 1").select("g", F.lit(len(levels)).alias("height"), "hash"))
    return levels, last


def descend(levels: list[DataFrame], last: DataFrame, own: list[str], carried: list[str]) -> DataFrame:
    """``own, path, carried`` of the first level: the sibling entries up to the group's last node, then those in ``path`` of ``last``."""
    ends = lambda height: last.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("pos"), "path", *carried)
    above = None
    for height in range(len(levels), 0, -1):
        above = ends(height) if above is None else above.unionByName(ends(height))
        kept = own if height == 1 else ["g", "pos"]
        parents = above.select(F.col("g").alias("_g"), F.col("pos").alias("_up"), F.col("path").alias("_path"), *carried)
        met = levels[height - 1].join(parents, (F.col("g") == F.col("_g")) & (F.col("up") == F.col("_up")))
        above = met.select(*kept, F.concat(F.array(F.struct("left", "right")), "_path").alias("path"), *carried)
    return above


def prove(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    own = ["doc_id", "leaf", "altered"]
    hashed = settle(leaves(docs), "leaves")
    placed = numbered(hashed, ["doc_id", "leaf"], ["g"], "pos")
    sizes = settle(hashed.groupBy(F.col("g").alias("_g")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    nodes = placed.join(sizes, F.col("g") == F.col("_g")).withColumn("hash", F.col("leaf"))
    levels, last = climb(nodes, own)
    subroots = settle(last, "subroots")
    # the tree over the subroots
    langs = sizes.count()
    top = numbered(subroots, ["g"], name="pos").select(F.lit("").alias("g"), "pos", F.lit(langs).alias("n"), "hash", F.col("g").alias("lang_g"), "height")
    entry = ["lang_g", "height", "hash"]
    steps, end = climb(top, entry)
    path = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    root = end.select("g", "height", path.alias("path"), F.col("hash").alias("root"))
    if steps:
        way = descend(steps, root, entry, ["root"])
    else:  # one subroot at most, which is the root
        way = top.select(*entry, path.alias("path"), F.col("hash").alias("root"))
    tops = settle(way.select(F.col("lang_g").alias("g"), "height", "path", F.col("hash").alias("subroot"), "root"), "tops")
    forget(hashed, subroots, *steps)
    alone = nodes.where("n = 1").select("g", *own).join(tops.where("height = 0"), "g").select(*own, "path", "subroot", "root")
    proven = alone.unionByName(descend(levels, tops, own, ["subroot", "root"])) if levels else alone
    folded = F.aggregate("path", F.coalesce("altered", "leaf"), lambda h, x: digest(x["left"], h, x["right"]))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same in DuckDB: levels by recursion, the check sum bit by bit.
ORACLE = """
WITH RECURSIVE named AS (
  SELECT *, coalesce('+' || lang, '') AS g, CAST(doc_id AS VARCHAR) AS id FROM documents
), crcs AS (
  SELECT id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, 8 * length(id)),
    lambda i : CAST((ascii(substr(id, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT))),
    lambda c, b : xor(c >> 1, (xor(c, b) & 1) * 3988292384))) % 3 = 0 AS altered
  FROM (SELECT DISTINCT id FROM named WHERE id IS NOT NULL)
), fields AS (
  SELECT n.doc_id, g, coalesce(CAST(strlen(n.id) AS VARCHAR) || ':' || n.id, '-') || coalesce(CAST(strlen(source) AS VARCHAR) || ':' || source, '-')
    || coalesce(CAST(strlen(lang) AS VARCHAR) || ':' || lang, '-') || coalesce(CAST(strlen(CAST(n_chars AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    text, CASE WHEN c.altered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM named n LEFT JOIN crcs c ON n.id = c.id
), leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(CAST(strlen(other) AS VARCHAR) || ':' || other, '-')) AS start FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
), low(lvl, g, pos, n, h) AS (
  SELECT 0, g, pos, n, leaf FROM placed
  UNION ALL
  SELECT lvl + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lvl, g, pos // 8, n
), subroots AS (
  SELECT lvl, g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 8, n
), nodes AS (
  SELECT g, lvl, pos, n, h FROM low WHERE n > 1
  UNION ALL
  SELECT s.g, s.lvl + x.lvl, x.pos, x.n, x.h FROM high x JOIN subroots s ON x.n > 1 AND x.pos // 8 = (s.pos // CAST(pow(8, x.lvl) AS BIGINT)) // 8
), runs AS (
  SELECT g, lvl, pos // 8 AS up, list(h ORDER BY pos) AS run FROM nodes GROUP BY g, lvl, pos // 8
), walk(doc_id, leaf, g, lvl, pos, toppos, h, proof) AS (
  SELECT p.doc_id, p.leaf, p.g, 0, p.pos, s.pos, p.start, '' FROM placed p JOIN subroots s ON p.g = s.g
  UNION ALL
  SELECT w.doc_id, w.leaf, w.g, w.lvl + 1, place // 8, w.toppos,
    sha256(array_to_string(r.run[1:place % 8], '') || w.h || array_to_string(r.run[place % 8 + 2:8], '')),
    w.proof || array_to_string(r.run[1:place % 8], '') || array_to_string(r.run[place % 8 + 2:8], '')
  FROM (SELECT w.*, CASE WHEN w.lvl = s.lvl THEN w.toppos ELSE w.pos END AS place FROM walk w JOIN subroots s ON w.g = s.g) w
  JOIN runs r ON r.g = w.g AND r.lvl = w.lvl AND r.up = w.place // 8
), heights AS (
  SELECT g, max(lvl) + 1 AS height FROM nodes GROUP BY g
)
SELECT w.doc_id, w.leaf, s.h AS subroot, x.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = x.h AS verified
FROM walk w JOIN subroots s ON w.g = s.g JOIN (SELECT h FROM high WHERE n = 1) x ON true LEFT JOIN heights t ON t.g = w.g
WHERE w.lvl = coalesce(t.height, 0)
"""
