"""Merkle manifest of a dataset: a leaf per row, a binary tree per group, a tree over the groups, proofs of membership.

H is the lower-case hexadecimal SHA-256 of its inputs' concatenation, digests as hexadecimal text. A leaf is H of the
row's fields, each `-` if null, else its UTF-8 bytes' count, `:` and itself. In each group leaves ascend by the order
column; while several nodes remain, every two consecutive ones (the last run may have one) become their H. What remains
is the group's subroot; subroots ascend by group (null first, by UTF-8 bytes) and give the root in the same way.

Method: parent-preimage paths. A parent's preimage, its children's digests side by side, is what is stored. 2**TIER
consecutive nodes and all parents above them inside that block are one row, so N leaves need N / 63 further rows in
log N / TIER rounds. Going down again, each block joins the block above it and takes the preimages from its own top to
the root. Leaves join their block: their path is the block's preimages at their place, then the block's ancestors. A
sibling is a preimage without the leaf's own slot of 64 characters; a replacement is folded to a root by splicing each
digest into that slot of the next preimage.

No task holds a group: places are counts of ranges of (group, order, leaf) plus places in a range. Rows of one order
value are ordered by leaf, null orders come last. Equal rows are leaves of their own. Null fields and groups are
defined above; an empty table gives no rows; columns that are not asked for are never read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, written

#: Levels that one block holds; its 2**TIER nodes and their parents are a row of about 130 * 2**TIER bytes.
TIER = 6
DIGEST = 64
_PLACE = (1 << 33) - 1


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def _levels(n: Column) -> Column:
    """How many levels of a block lie below its top when its group has n nodes there."""
    return F.least(F.lit(TIER), F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0))


def excised(pre: Column, slot: Column) -> Column:
    """A preimage without the digest in a slot: that digest's siblings."""
    return F.concat(F.substring(pre, F.lit(1), slot * DIGEST), F.substring(pre, (slot + 1) * DIGEST + 1, F.lit(DIGEST)))


def spliced(pre: Column, slot: Column, own: Column) -> Column:
    """A preimage with another digest in a slot."""
    return F.concat(F.substring(pre, F.lit(1), slot * DIGEST), own, F.substring(pre, (slot + 1) * DIGEST + 1, F.lit(DIGEST)))


def siblings(path: Column) -> Column:
    """All siblings of a path (array of pre, slot), level by level."""
    return F.array_join(F.transform(path, lambda p: excised(p["pre"], p["slot"])), "")


def folded(path: Column, own: Column) -> Column:
    """The root that a leaf's digest gives along a path."""
    return F.aggregate(path, own, lambda now, p: digest(spliced(p["pre"], p["slot"], now)))


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `pos` (from 0, in the order of `keys` inside equal values of the first) and `n` (rows of that value).

    Rows are range-partitioned, so a value that most rows have takes many tasks; equal rows are parted by where they
    are read. The written ranges fix the places: a lost task computes the same ones again.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_PLACE)))
    first = keys[0]
    counts = ranged.groupBy(first, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(first).orderBy("_part")  # a row per range: no more than there are tasks
    all_of = Window.partitionBy(first)
    counts = cut(counts.select(first, "_part", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(all_of).alias("n")))
    return ranged.join(counts, [first, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _block(nodes: DataFrame) -> DataFrame:
    """key, block, n, top and levels (the preimages of each level, bottom up) of nodes (key, pos, n, digest)."""
    rows = nodes.groupBy("key", F.shiftright("pos", TIER).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("of"))  # 2**TIER at most
    start = F.struct(F.transform("of", lambda x: x["digest"]).alias("now"), F.array().cast("array<array<string>>").alias("levels"))

    def up(state: Column, _: Column) -> Column:
        now = state["now"]
        pre = F.transform(F.sequence(F.lit(0), F.ceil(F.size(now) / 2).cast("int") - 1), lambda i: F.concat(F.get(now, 2 * i), F.coalesce(F.get(now, 2 * i + 1), F.lit(""))))
        return F.struct(F.transform(pre, digest).alias("now"), F.concat(state["levels"], F.array(pre)).alias("levels"))

    steps = F.when(_levels(F.col("n")) > 0, F.sequence(F.lit(1), _levels(F.col("n")))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("built", F.aggregate(steps, start, up))
    return rows.select("key", "block", "n", F.get(F.col("built.now"), F.lit(0)).alias("top"), F.col("built.levels").alias("levels"))


def _path(levels: Column, pos: Column) -> Column:
    """The preimages of a block above its node of place `pos`, each with the slot of what lies below."""
    at = pos.bitwiseAND(F.lit((1 << TIER) - 1)).cast("int")
    return F.transform(levels, lambda level, k: F.struct(F.get(level, F.call_function("shiftright", at, k + 1)).alias("pre"), F.call_function("shiftright", at, k).bitwiseAND(F.lit(1)).alias("slot")))


def _forest(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of all tiers of nodes (key, pos, n, digest), bottom up; in the last each key has one block."""
    tiers = []
    while True:
        tiers.append(written(_block(nodes), "blocks"))
        if tiers[-1].where(F.col("n") > 1 << TIER).isEmpty():
            return tiers
        nodes = tiers[-1].select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << TIER)).alias("n"), F.col("top").alias("digest"))


def _with_ancestors(tiers: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest blocks with `up`, the path from their top to the root, and their key's columns in roots (key, up, ...)."""
    names = [c for c in roots.columns if c not in ("key", "up")]
    blocks = tiers[-1].join(roots, "key")
    for tier in reversed(tiers[:-1]):
        above = blocks.select("key", F.col("block").alias("_above"), F.col("levels").alias("_levels"), F.col("up").alias("_up"), *names)
        joined = tier.withColumn("_above", F.shiftright("block", TIER)).join(above, ["key", "_above"])
        blocks = joined.withColumn("up", F.concat(_path(F.col("_levels"), F.col("block")), F.col("_up"))).drop("_above", "_levels", "_up")
    return blocks


def manifest(df: DataFrame, fields: list[Column], group: Column, order: Column, keep: dict[str, Column]) -> DataFrame:
    """The columns `keep` of each row of df, leaf, subroot, root, and path: its ancestors' preimages with the slots of
    what lies below them, bottom up. `siblings` and `folded` read a path."""
    rows = df.select(*[c.alias(f"keep_{k}") for k, c in keep.items()], F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("key"), order.alias("_order"), leaf(fields).alias("digest"))
    leaves = written(rows, "leaves").withColumn("_null", F.col("_order").isNull())
    leaves = placed(leaves, ["key", "_null", "_order", "digest"]).drop("_null", "_order")
    tiers = _forest(leaves.select("key", "pos", "n", "digest"))

    tops = placed(tiers[-1].select(F.lit("").alias("all"), F.col("key").alias("group"), F.col("top").alias("digest")), ["all", "group"])
    tops = tops.select(F.col("all").alias("key"), "group", "pos", "n", "digest")
    above = _forest(tops.select("key", "pos", "n", "digest"))
    of_all = above[-1].select("key", F.array().cast("array<struct<pre:string,slot:int>>").alias("up"), F.col("top").alias("root"))
    over = _with_ancestors(above, of_all).select("key", "block", "levels", "up", "root")
    roots = tops.withColumn("block", F.shiftright("pos", TIER)).join(over, ["key", "block"])
    roots = cut(roots.select(F.col("group").alias("key"), F.concat(_path(F.col("levels"), F.col("pos")), F.col("up")).alias("up"), "root", F.col("digest").alias("subroot")))

    blocks = _with_ancestors(tiers, roots).select("key", "block", "levels", "up", "subroot", "root")
    joined = leaves.withColumn("block", F.shiftright("pos", TIER)).join(blocks, ["key", "block"])
    path = F.concat(_path(F.col("levels"), F.col("pos")), F.col("up"))
    return joined.select(*[F.col(f"keep_{k}").alias(k) for k in keep], F.col("digest").alias("leaf"), "subroot", "root", path.alias("path"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and folded roots of all documents, grouped by lang; where 7 divides the CRC-32 of doc_id, a leaf of
    one more character is folded instead of the row's own."""
    docs = table(spark, sf_dir, "documents")
    own = {c: F.col(c) for c in FIELDS}
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    other = F.when(altered, leaf([*(own | {"n_chars": F.col("n_chars") + 1}).values()]))
    rows = manifest(docs, [*own.values()], F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "other": other})
    rows = rows.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded(F.col("path"), F.coalesce("other", "leaf")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"

#: Both trees level by level; a tampered leaf is folded along its siblings.
SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS key, {_LEAF} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND
      xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0
      THEN {_LEAF.replace("n_chars::VARCHAR", "(n_chars + 1)::VARCHAR")} END AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, {_LEAF}) - 1 AS pos
  FROM documents, crc),
low AS (
  SELECT key, 0 AS level, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT key, any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM low) WHERE n > 1 GROUP BY key, pos // 2),
height AS MATERIALIZED (SELECT key, max(level) AS top FROM low GROUP BY key),
subroots AS MATERIALIZED (SELECT key, top, h, row_number() OVER (ORDER BY encode(key)) - 1 AS rank FROM low JOIN height USING (key) WHERE level = top),
high AS (
  SELECT 0 AS level, rank AS pos, h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY pos // 2),
summit AS (SELECT max(level) AS top FROM high),
steps AS MATERIALIZED (
  SELECT l.key, l.pos, level, (l.pos >> level) & 1 AS slot, coalesce(h, '') AS sibling
  FROM leaves l JOIN height USING (key), LATERAL (SELECT unnest(range(top)) AS level)
  LEFT JOIN (SELECT key AS k, level AS v, pos AS p, h FROM low) ON k = l.key AND v = level AND p = xor(l.pos >> level, 1)
  UNION ALL
  SELECT l.key, l.pos, s.top + level, (s.rank >> level) & 1, coalesce(o.h, '')
  FROM leaves l JOIN subroots s USING (key), summit m, LATERAL (SELECT unnest(range(m.top)) AS level)
  LEFT JOIN (SELECT level AS v, pos AS p, h FROM high) o ON v = level AND p = xor(s.rank >> level, 1)),
paths AS (
  SELECT l.key, l.pos, list(struct_pack(slot := slot, sibling := sibling) ORDER BY level) FILTER (WHERE level IS NOT NULL) AS path
  FROM leaves l LEFT JOIN steps s ON s.key = l.key AND s.pos = l.pos GROUP BY l.key, l.pos),
done AS (
  SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM high WHERE level = (SELECT top FROM summit)) AS root,
    sha256(coalesce(list_aggregate(list_transform(path, lambda p: p.sibling), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce([coalesce(other, leaf)] || coalesce(list_transform(path, lambda p: p.slot || p.sibling), []), lambda c, p: sha256(CASE WHEN p[1] = '1' THEN p[2:] || c ELSE c || p[2:] END)) AS folded_root
  FROM leaves l JOIN paths USING (key, pos) JOIN subroots s USING (key))
SELECT *, folded_root = root AS verified FROM done
"""
