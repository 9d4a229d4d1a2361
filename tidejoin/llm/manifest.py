"""Merkle manifest of a dataset: one root for a table, and for every row the proof that it belongs to it.

A leaf is the hash of a row's values, each with its length. Leaves of a group (a language) in order of
their ids make a tree: every FANOUT consecutive nodes become the hash of their digests, the last ones
even if fewer, until one node is left, the group's subroot. Subroots in order of the groups make a tree
of the same kind, whose last node is the root. A proof is what stands beside a row's node on each level,
leaf to root.

Plan: hashes are JVM functions in the scan, so texts are not shuffled; what is, is ids and digests. Rows
get their places by a range sort with counted offsets: a language that holds a third of all rows, or all,
is dealt over all tasks. Bottom-up, a level is one aggregation of the level below into runs of FANOUT,
persisted with the digests of its run. Top-down, each persisted level joins its runs to the proofs of
their parents; a child gets what stands beside it in its run ahead of the proof suffix that its parent
has inherited. Groups of any number are handled like rows: nothing comes to the driver but the number of
nodes in the largest tree.

Defined results: null is `-`, other values are their number of UTF-8 bytes, `:` and the value; rows
without an id come first, equal ids by their leaf; equal rows are leaves side by side; rows without an
id are never tampered with; an empty table has no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidejoin.llm.staging import few, staged

FANOUT = 8
#: Nodes up to which a level's proofs, of some KB each, are broadcast to the level below.
SMALL = 4_096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*values: Column) -> Column:
    """The hash of a row's values."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows with pos: the place of a row in its group, from 0, by a range sort whose parts are counted."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in group]
    dealt = staged(rows.repartitionByRange(parts, *keys, *order).withColumn("part", F.spark_partition_id()), "manifest-sorted")
    inside = Window.partitionBy("part", *group).orderBy(*order)
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    sizes = dealt.groupBy("part", *group).agg(F.count("*").alias("n"))
    sizes = sizes.select(F.col("part").alias("p"), *(F.col(c).alias(f"of_{c}") for c in group), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    same = F.col("part") == F.col("p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    met = dealt.withColumn("pos", F.row_number().over(inside) - 1).join(few(sizes, SMALL), same)
    return met.withColumn("pos", (F.col("pos") + F.col("start")).cast("long")).drop("part", "p", "start", *(f"of_{c}" for c in group))


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def build(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The persisted levels of the trees over leaves (tree, pos, hash, others...), and (tree, root).

    A level is (tree, up, hash, run): the node `up`, and its run, the nodes below it in order, each with pos and
    hash. Trees with a lone node rise no further; `others` of the leaves stay in the lowest level's runs.
    """
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    carried = [c for c in leaves.columns if c != "tree"]
    nodes = leaves.join(few(sizes, SMALL), "tree").select("tree", "n", F.struct(*carried).alias("node"))
    roots = nodes.where("n = 1").select("tree", F.col("node.hash").alias("root"))
    levels = []
    while largest > 1:
        runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("node.pos") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list("node")).alias("run"), F.first("n").alias("n"))
        runs = staged(runs.select("tree", "up", F.sha2(_joined(F.col("run.hash")), 256).alias("hash"), "run", F.ceil(F.col("n") / FANOUT).alias("n")), f"manifest-{name}-{len(levels)}")
        levels.append(runs.select("tree", "up", "hash", "run"))
        nodes = runs.select("tree", "n", F.struct(F.col("up").alias("pos"), "hash").alias("node"))
        roots = roots.union(nodes.where("n = 1").select("tree", "node.hash"))
        largest = -(-largest // FANOUT)
    return levels, roots


def _beside(run: Column, at: Column) -> Column:
    """What stands before and behind a node in its run, as a step of a proof."""
    hashes = F.transform(run, lambda x: x["hash"])
    before = _joined(F.slice(hashes, F.lit(1), at))
    behind = F.when(at + 1 < F.size(run), _joined(F.slice(hashes, at + 2, F.lit(FANOUT)))).otherwise(F.lit(""))
    return F.array(F.struct(before.alias("before"), behind.alias("behind")))


def proofs(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, root: str = "root") -> DataFrame:
    """(tree, leaf columns..., proof, what tops has) for every leaf, pushed from tops (tree, proof, others...), one row a tree, down to it.

    Each level's children put what stands beside them ahead of the proof that their parent has.
    """
    carried = [c for c in leaves.columns if c != "tree"]
    others = [c for c in tops.columns if c not in ("tree", "proof")]
    # a tree's own node stands on the level above its highest runs, where its place is 0
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    tops = staged(tops.join(sizes, "tree"), "manifest-tops")
    height = sum(((F.col("n") > FANOUT**level).cast("int") for level in range(len(levels))), F.lit(0))
    tops = tops.withColumn("height", height).drop("n")
    known: DataFrame | None = None
    for level in range(len(levels), 0, -1):
        begun = tops.where(F.col("height") == level).select("tree", F.lit(0).cast("long").alias("at"), "proof", *others)
        parents = begun if known is None else known.union(begun)
        runs = levels[level - 1].select("tree", F.col("up").alias("at"), "run")
        met = runs.join(few(parents, SMALL) if level > 1 else parents, ["tree", "at"])
        child = met.select("tree", "run", "proof", *others, F.posexplode("run").alias("place", "child"))
        pushed = F.concat(_beside(F.col("run"), F.col("place")), "proof").alias("proof")
        if level > 1:
            known = staged(child.select("tree", F.col("child.pos").alias("at"), pushed, *others), f"manifest-proofs-{level}")
        else:
            known = child.select("tree", *(F.col(f"child.{c}").alias(c) for c in carried), pushed, *others)
    lone = leaves.join(tops.where("height = 0").drop("height"), "tree").select("tree", *carried, "proof", *others)
    return lone if known is None else known.union(lone)


def folded(hash: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, hash, lambda node, step: F.sha2(F.concat(step["before"], node, step["behind"]), 256))


def manifest(rows: DataFrame, values: list[str], tampered: Column | None = None, tamper: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified, steps) for every row.

    values: the columns of a leaf, in order. tampered: for which rows the text is replaced by `tamper` before the root is
    recomputed from the row and its original proof, as an auditor would; verified: whether that is the root.
    """
    text = F.col(text_col).cast("string")
    now = [F.col(c) if c != text_col else text for c in values]
    whole = leaf(*now)
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(*(c if name != text_col else tamper for name, c in zip(values, now, strict=True))))
    rows = rows.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("group"), whole.alias("hash"), changed.alias("changed"))
    # a group is a tree; what stands for it is its name, and null has a mark of its own
    rows = rows.withColumn("tree", F.coalesce(F.concat(F.lit("+"), "group"), F.lit("-")))
    leaves = placed(rows, ["tree"], [F.col("id").asc_nulls_first(), F.col("hash").asc()]).select("tree", "pos", "hash", "id", "changed")
    leaves = staged(leaves, "manifest-leaves")
    levels, subroots = build(leaves, "rows")
    subroots = staged(subroots.select("tree", F.col("root").alias("hash")), "manifest-subroots")
    top = placed(subroots.select(F.lit("").alias("one"), "tree", "hash"), ["one"], [(F.col("tree") != "-").asc(), F.col("tree").cast("binary").asc()])
    top = top.select(F.col("one").alias("tree"), "pos", "hash", F.col("tree").alias("group"))
    upper_levels, roots = build(top, "groups")
    none = F.array().cast("array<struct<before: string, behind: string>>")
    begun = roots.select("tree", "root", none.alias("proof"))
    tops = proofs(top, upper_levels, begun).select(F.col("group").alias("tree"), "proof", F.col("hash").alias("subroot"), "root")
    out = proofs(leaves, levels, tops)
    digest = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["behind"])), ""), 256)
    out = out.select(
        F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", digest.alias("proof_sha256"),
        folded(F.coalesce("changed", "hash"), F.col("proof")).alias("folded_root"), F.size("proof").alias("steps"),
    )
    return out.select(id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "steps")


#: Columns of documents in the order of a leaf.
VALUES = ["doc_id", "source", "lang", "n_chars", "text"]


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, where each third document by its hash has its capitals lowered."""
    every = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, VALUES, F.coalesce(every, F.lit(False)), F.translate(F.col("text").cast("string"), UPPER, LOWER))


def sql(levels: int = 8, group_levels: int = 4) -> str:
    """DuckDB's form of the query over documents, for as many as FANOUT ** levels rows of a language; each step of a tree is a table."""
    crc = "SELECT range AS i, range AS x FROM range(256)"
    for _ in range(8):
        crc = f"SELECT i, CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM ({crc})"
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    hashed = lambda text: "sha256(" + " || ".join(value(c if c != "text" else text) for c in VALUES) + ")"
    parts = [
        f"crcs AS ({crc})",
        """crc AS (SELECT DISTINCT doc_id::VARCHAR AS id, 0 AS pos, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
 UNION ALL SELECT id, pos + 1, xor(c >> 8, x) FROM crc JOIN crcs ON i = (xor(c, ascii(substr(id, pos + 1, 1))) & 255) WHERE pos < strlen(id))""",
        "third AS (SELECT id FROM crc WHERE pos = strlen(id) AND xor(c, 4294967295) % 3 = 0)",
        f"""leaves AS (SELECT doc_id, lang, {hashed("text")} AS leaf, CASE WHEN third.id IS NULL THEN {hashed("text")} ELSE {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} END AS x
 FROM documents LEFT JOIN third ON third.id = doc_id::VARCHAR)""",
        "d0 AS (SELECT *, '' AS proof, lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM leaves)",
        "n0 AS (SELECT tree, p, leaf AS h, n FROM d0)",
    ]

    def climb(d: str, nodes: str, height: int, tag: str) -> tuple[str, str]:
        """The tables of a tree's levels: rows with their proofs so far, and nodes with the root."""
        for k in range(height):
            run, up, rows = f"r{tag}{k}", f"n{tag}{k + 1}", f"d{tag}{k + 1}"
            parts.append(f"{run} AS (SELECT tree, p // 8 AS up, sha256(string_agg(h, '' ORDER BY p)) AS h, list(h ORDER BY p) AS run, (n + 7) // 8 AS n FROM {nodes} WHERE n > 1 GROUP BY tree, p // 8, n)")
            parts.append(f"{up} AS (SELECT tree, up AS p, h, n FROM {run} UNION ALL SELECT * FROM {nodes} WHERE n = 1)")
            before, behind = "coalesce(array_to_string(run[1:p % 8], ''), '')", "coalesce(array_to_string(run[p % 8 + 2:8], ''), '')"
            parts.append(f"""{rows} AS (SELECT doc_id, lang, leaf, CASE WHEN run IS NULL THEN x ELSE sha256({before} || x || {behind}) END AS x, CASE WHEN run IS NULL THEN proof ELSE proof || {before} || {behind} END AS proof,
 d.tree AS tree, p // 8 AS p, CASE WHEN run IS NULL THEN d.n ELSE r.n END AS n FROM {d} d LEFT JOIN {run} r ON d.tree IS NOT DISTINCT FROM r.tree AND p // 8 = up AND d.n > 1)""")
            d, nodes = rows, up
        return d, nodes

    d, nodes = climb("d0", "n0", levels, "")
    parts.append(f"subroots AS (SELECT tree AS lang, h AS subroot, row_number() OVER (ORDER BY tree IS NOT NULL, tree) - 1 AS p, count(*) OVER () AS n FROM {nodes})")
    parts.append("ng0 AS (SELECT 0 AS tree, p, subroot AS h, n FROM subroots)")
    parts.append(f"dg0 AS (SELECT doc_id, {d}.lang AS lang, leaf, x, proof, 0 AS tree, s.p AS p, s.n AS n FROM {d} JOIN subroots s ON {d}.lang IS NOT DISTINCT FROM s.lang)")
    d, nodes = climb("dg0", "ng0", group_levels, "g")
    return f"""WITH RECURSIVE {", ".join(parts)}
SELECT doc_id, leaf, s.subroot AS subroot, t.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = t.h AS verified FROM {d} d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang CROSS JOIN {nodes} t"""


SQL = sql()
