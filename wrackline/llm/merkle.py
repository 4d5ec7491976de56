"""Merkle manifest of a table: a hash tree for each group of rows, a tree over the groups' roots, and a proof for every row.

Leaves are ordered within their group by a range sort; a leaf's place is its place in its sorted partition plus the counts
of the partitions before it, so no group, however large, has to pass through one task. Aligned blocks of fanout^block_levels
leaves are hashed locally. From there on the blocks are partners in a butterfly: in each round the fanout neighbouring nodes
of a run send their roots to one another, the k-th block of a node to the k-th block of every sibling (a shorter node's
blocks serve several). Every block hashes the run itself and so holds the ancestor and the siblings that its proofs need:
after the last round each block has the upper part of all its proofs, and nothing is handed down again. The rounds go on
over the groups' roots in the same way. A block's state is a few kilobytes; texts are hashed where they lie and never move.

Rounds are stored, so a lost executor repeats one round at most. No round collects more than one run into a row.

Defined results: a null value is hashed as `-`, any other as its UTF-8 byte count, `:` and its text, so an empty text is
`0:` and differs from null; very long texts are hashed whole; a null group is a group of its own and comes first; leaves of
equal ids (null ids first) are ordered by leaf, and repeated rows are leaves of their own with equal hashes; a group of one
row has its leaf as its root, and a table of one group has that group's root as root. Where several nodes remain, a run of
one is hashed, too. An empty table gives an empty result. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, drop_stored, fold, stored, table

FANOUT, BLOCK_LEVELS = 16, 3
#: The places of partitions in groups are broadcast up to this many (some 60 bytes each); beyond it they are joined in a shuffle.
BROADCAST_STARTS = 200_000
#: Receivers of one message are listed in steps of so many.
STEP = 1024
_PATH = "array<struct<left:array<string>,right:array<string>>>"


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def _sorted(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in order over all partitions: part numbers them, at is the place in the table of partitions."""
    keyed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stored(keyed, "sorted").withColumn("part", F.shiftright("at", 33))


def _layout(leaves: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Leaves with their place in the group (pos) and block number (g), and groups with first block, number of blocks and rank."""
    leaves = _sorted(leaves, ["tree", "id", "leaf", "tie"])
    runs = stored(leaves.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("low")), "runs")
    trees = _sorted(runs.groupBy("tree").agg(F.sum("n").alias("n")).withColumn("n_blocks", F.ceil(F.col("n") / size)), ["tree"])
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = trees.groupBy("part").agg(F.count("*").alias("c"), F.sum("n_blocks").alias("b"), F.min("at").alias("low"))
    over_parts = earlier(Window.partitionBy(F.lit(0)).orderBy("part"))
    none = F.lit(0).cast("bigint")
    totals = totals.select("part", "low", *[F.coalesce(F.sum(c).over(over_parts), none).alias(f"before_{c}") for c in "cb"])
    inside = F.coalesce(F.sum("n_blocks").over(earlier(Window.partitionBy("part").orderBy("at"))), none)
    trees = stored(
        trees.withColumn("inside", inside).join(totals, "part")
        .select("tree", "n_blocks", (F.col("before_b") + F.col("inside")).alias("first"), (F.col("before_c") + F.col("at") - F.col("low")).alias("rank")),
        "trees",
    )
    before = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("tree").orderBy("part"))), none)
    starts = stored(runs.select("tree", "part", (before - F.col("low")).alias("shift")).join(trees, "tree"), "starts")
    placed = leaves.join(F.broadcast(starts) if starts.count() <= BROADCAST_STARTS else starts, ["tree", "part"])
    pos = F.col("at") + F.col("shift")
    return placed.withColumn("pos", pos).withColumn("g", F.col("first") + F.expr(f"pos div {size}")).drop("at", "part", "shift", "tie", "tree"), trees


def _hex(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: list[str], alone: bool, fanout: int, block_levels: int) -> list[list[str]]:
    """The nodes of a block, level by level; a block that holds its whole group ends when one node remains."""
    levels = [nodes]
    while len(levels) <= block_levels and not (alone and len(levels[-1]) == 1):
        last = levels[-1]
        levels.append([_hex(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def _block_roots(leaves: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        top = _levels(block["leaf"].to_pylist(), block["n_blocks"][0].as_py() == 1, fanout, block_levels)[-1]
        return block.select(["g", "first", "n_blocks", "rank"]).slice(0, 1).append_column("h", pa.array(top, pa.string()))

    rows = leaves.select("g", "pos", "leaf", "first", "n_blocks", "rank")
    return rows.groupBy("g").applyInArrow(run, "g bigint, first bigint, n_blocks bigint, rank bigint, h string")


def _round(state: DataFrame) -> DataFrame:
    """One exchange. state has runs (start and end block of every node of the run), slot (the own node's place in it) or NULL where a tree is done."""
    rest = state.where("runs IS NULL").drop("runs", "slot")
    own = F.element_at("runs", F.col("slot") + 1)
    sent = state.where("runs IS NOT NULL").withColumns({"o": F.col("g") - own["start"], "m": own["end"] - own["start"]})
    sent = sent.select("*", F.inline("runs"))
    low, last = F.col("start") + F.col("o"), F.col("end") - 1
    sent = sent.withColumn("low", F.explode(F.when(low <= last, F.sequence(low, last, F.col("m") * STEP))))
    sent = sent.withColumn("to", F.explode(F.sequence("low", F.least(F.col("low") + F.col("m") * (STEP - 1), last), F.col("m"))))
    kept = F.when(F.col("to") == F.col("g"), F.struct("first", "n_blocks", "rank", "path", "subroot", "slot")).alias("kept")
    got = sent.select("to", F.struct("slot", "h").alias("node"), kept).groupBy("to").agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.first("kept", ignorenulls=True).alias("kept"))
    side = lambda test: F.transform(F.filter("nodes", lambda x: test(x["slot"], F.col("kept.slot"))), lambda x: x["h"])
    step = F.struct(side(lambda a, b: a < b).alias("left"), side(lambda a, b: a > b).alias("right"))
    found = got.select(
        F.col("to").alias("g"), "kept.first", "kept.n_blocks", "kept.rank", F.sha2(F.array_join("nodes.h", ""), 256).alias("h"), F.concat("kept.path", F.array(step)).alias("path"), "kept.subroot"
    )
    return found.unionByName(rest.select(found.columns))


def _butterfly(blocks: DataFrame, trees: DataFrame, fanout: int) -> DataFrame:
    """(g, subroot, root, path) of every block: path has the siblings of its node at each level above the block."""
    n_trees, most = trees.agg(F.count("*"), F.max("n_blocks")).first()
    none = F.lit(None).cast("string")
    state = stored(blocks.withColumns({"path": F.array().cast(_PATH), "subroot": none}), "round")

    def advance(step: DataFrame) -> DataFrame:
        then = stored(_round(step), "round")
        drop_stored(state)
        return then

    width = 1
    while most is not None and width < most:  # within groups: ranges of blocks follow from their numbers
        node = F.expr(f"(g - first) div {width}")
        count = F.ceil(F.col("n_blocks") / width)
        low = node - node % fanout
        at = lambda j, w=width: F.col("first") + F.least(j * w, F.col("n_blocks"))
        runs = F.transform(F.sequence(low, F.least(low + fanout, count) - 1), lambda j: F.struct(at(j).alias("start"), at(j + 1).alias("end")))
        state = advance(state.withColumns({"runs": F.when(count > 1, runs), "slot": (node % fanout).cast("int")}))
        width *= fanout
    named = state.withColumn("subroot", F.col("h"))
    width = 1
    while width < n_trees:  # over groups: ranges of blocks from the layout, joined by group and stretch of blocks
        node = F.expr(f"rank div {width}")
        nodes = trees.groupBy(node.alias("node")).agg(F.min("first").alias("start"), F.max(F.col("first") + F.col("n_blocks")).alias("end"))
        ofs = nodes.groupBy(F.expr(f"node div {fanout}").alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "start", "end"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("runs"))
        spread = trees.select("rank", F.expr(f"rank div {width * fanout}").alias("run"), F.explode(F.expr(f"sequence(0, (n_blocks - 1) div {STEP})")).alias("stretch")).join(ofs, "run").drop("run")
        rows = named.withColumn("stretch", F.expr(f"(g - first) div {STEP}")).join(spread, ["rank", "stretch"]).drop("stretch")
        state = named = advance(rows.withColumn("slot", (node % fanout).cast("int")))
        width *= fanout
    return named.select("g", "subroot", F.col("h").alias("root"), "path")


def manifest(df: DataFrame, group_col: str = "source", id_col: str = "doc_id", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), carry: Sequence[str] = (), fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """id, leaf, subroot, root and path of every row, and the carried columns in a struct `carried`.

    path: for each level from the leaf to the root, the hashes left and right of the own node within its run.
    columns: what a leaf covers, in this order.
    """
    tree = F.coalesce(F.concat(F.lit("="), df[group_col].cast("string")), F.lit(""))
    own = F.struct(*[df[c] for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    leaves = stored(df.select(tree.alias("tree"), df[id_col].alias("id"), leaf_hash([df[c] for c in columns]).alias("leaf"), own.alias("carried"), F.monotonically_increasing_id().alias("tie")), "leaves")
    placed, trees = _layout(leaves, fanout**block_levels)
    upper = _butterfly(_block_roots(placed, fanout, block_levels), trees, fanout)
    path_type = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        nodes = block["leaf"].to_pylist()
        levels = _levels(nodes, block["n_blocks"][0].as_py() == 1, fanout, block_levels)
        top, paths = above["path"][0].as_py(), []
        for i in range(len(nodes)):
            path = []
            for level in levels[:-1]:
                start = i - i % fanout
                path.append({"left": level[start:i], "right": level[i + 1 : start + fanout]})
                i //= fanout
            paths.append(path + top)
        same = lambda c: pa.array([above[c][0].as_py()] * len(nodes), pa.string())
        return pa.table({"id": block["id"], "carried": block["carried"], "leaf": block["leaf"], "subroot": same("subroot"), "root": same("root"), "path": pa.array(paths, path_type)})

    fields = T._parse_datatype_string(f"leaf string, subroot string, root string, path {_PATH}").fields
    schema = T.StructType([T.StructField("id", placed.schema["id"].dataType), T.StructField("carried", placed.schema["carried"].dataType), *fields])
    return placed.select("g", "pos", "id", "carried", "leaf", "n_blocks").groupBy("g").cogroup(upper.groupBy("g")).applyInArrow(run, schema)


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its path."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(F.array_join(p["left"], ""), h, F.array_join(p["right"], "")), 256))


def path_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda p: F.concat(p["left"], p["right"]))), ""), 256)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), ascii_lower(F.col("text"))])
    docs = docs.withColumn("tampered_leaf", F.when(fold(F.col("doc_id"), 5) == 0, tampered))
    rows = manifest(docs, carry=["tampered_leaf"])
    folded = rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), fold_path(F.coalesce("carried.tampered_leaf", "leaf"), F.col("path")).alias("folded_root")
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 7, top_levels: int = 5) -> str:
    """Each level of the trees of up to 16^levels rows and 16^top_levels sources as a table of its own."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join([enc('doc_id'), enc('source'), enc('lang'), enc('n_chars'), text])})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 bit by bit over the decimal digits of doc_id
    step = "list_reduce(list_prepend({x}, range(8)::UBIGINT[]), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda s: ascii(s)::UBIGINT)), "
        f"lambda a, b: CASE WHEN b = 0 THEN a ELSE {step.format(x='xor(a, b)')} END), 4294967295::UBIGINT)"
    )
    node = "string_agg(h, '') OVER (PARTITION BY s, i // 16 ORDER BY i ROWS BETWEEN {})"
    sides = lambda k: f"""n{k} AS MATERIALIZED (SELECT s, i, h, count(*) OVER (PARTITION BY s) > 1 AS more, coalesce({node.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS lft,
  coalesce({node.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS rgt FROM l{k})"""  # noqa: E731
    up = lambda k: f"l{k + 1} AS (SELECT s, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM n{k} WHERE more GROUP BY 1, 2)"
    ctes = [f"""d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS s, {leaf(enc('text'))} AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN {leaf(enc(low))} ELSE {leaf(enc('text'))} END AS other FROM documents)""",
        "p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "l0 AS (SELECT s, i, leaf AS h FROM p)"]
    for k in range(levels):
        ctes += [sides(k), up(k)]
    ctes.append(f"sub AS MATERIALIZED ({' UNION ALL '.join(f'SELECT s, h FROM n{k} WHERE NOT more' for k in range(levels))} UNION ALL SELECT s, h FROM l{levels})")
    top = levels + 1
    ctes.append(f"l{top} AS (SELECT '' AS s, row_number() OVER (ORDER BY s) - 1 AS i, h FROM sub)")
    ctes.append("ranks AS (SELECT s AS tree, row_number() OVER (ORDER BY s) - 1 AS r FROM sub)")
    for k in range(top, top + top_levels):
        ctes += [sides(k), up(k)]
    ctes.append(f"rt AS ({' UNION ALL '.join(f'SELECT h AS root FROM n{k} WHERE NOT more' for k in range(top, top + top_levels))} UNION ALL SELECT h FROM l{top + top_levels})")
    ctes.append("f0 AS (SELECT p.*, r, '' AS proof, other AS f FROM p JOIN ranks ON tree = p.s)")
    at = [(k, f"n{k}.s = x.s AND n{k}.i = x.i // {16**k}") for k in range(levels)] + [(k, f"n{k}.i = x.r // {16 ** (k - top)}") for k in range(top, top + top_levels)]
    for j, (k, on) in enumerate(at):
        ctes.append(f"""f{j + 1} AS (SELECT x.* EXCLUDE (proof, f), x.proof || coalesce(lft || rgt, '') AS proof, CASE WHEN lft IS NULL THEN x.f ELSE sha256(lft || x.f || rgt) END AS f
  FROM f{j} x LEFT JOIN n{k} ON more AND {on})""")
    last = len(at)
    return f"""WITH {', '.join(ctes)} SELECT doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM f{last} JOIN sub USING (s), rt"""


OP12_SQL = _sql()
