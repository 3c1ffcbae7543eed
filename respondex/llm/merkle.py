"""Merkle manifest of a table: digests in runs of sixteen, one tree per source, one above.

Leaves are put in order by one range sort; a level is an aggregate over runs of sixteen, so a
hot source is many groups. What is built is kept as node rows that know their parent. A
recursive query then climbs from every leaf to the root. Sixteen leaves of one run climb in
one row: their siblings above the run are the same and are appended once, while each leaf
folds a digest of its own. All climbers meet at the top, so a node has as many copies as it
needs for each to serve a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respondex.llm.shared import lower_ascii, passing, written
from respondex.operators.keys import assign_ids

RUN = 16
#: Rows of climbers that one copy of a node serves.
CLIMBERS = 4096
#: The tree above the sources.
_TOP = -1
_BYTES = 32

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Manifest:
    """``runs``: tree, run, n_leaves, kids (place, leaf, claim, doc_id), digest, up: the
    lowest nodes. ``nodes``: tree, level, idx, children, digest, up: all nodes above, where
    up is tree, level, idx, place and parts of the parent, null at the root.
    ``sources``: source, tree, n_leaves, subroot. ``root``: hex, null without rows."""

    runs: DataFrame
    nodes: DataFrame
    sources: DataFrame
    root: str | None


def digest(data: Column) -> Column:
    """Binary sha256 of the hexadecimal form of concatenated digests."""
    return F.unhex(F.sha2(F.lower(F.hex(data)), 256))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Binary sha256 over all values: ``-`` for null, else byte count, colon, value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda done, d: F.concat(done, d))


def _others(children: Column, place: Column) -> tuple[Column, Column]:
    """What stands before and after one digest of a run."""
    before = F.substring(children, F.lit(1), _BYTES * place)
    return before, F.substring(children, _BYTES * place + _BYTES + 1, F.lit(_BYTES * RUN))


def _levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes above (tree, level, idx, n_nodes, digest, weight), level by level, and the roots.

    ``most`` is the number of nodes of the largest tree. Level by level only a sixteenth is
    left, and each is written, so the loop ends after a few rounds on ever smaller tables.
    """
    runs, roots = [], nodes.where("n_nodes = 1")
    while most > 1:
        kids = F.array_sort(F.collect_list(F.struct((F.col("idx") % RUN).alias("at"), "digest")))
        grouped = (
            nodes.where("n_nodes > 1")
            .groupBy("tree", "level", "n_nodes", F.expr(f"idx div {RUN}").alias("run"))
            .agg(kids.alias("kids"), F.sum("weight").alias("weight"))
        )
        made = grouped.select(
            "tree",
            (F.col("level") + 1).alias("level"),
            F.col("run").alias("idx"),
            F.ceil(F.col("n_nodes") / RUN).alias("n_nodes"),
            _joined(F.transform("kids", lambda k: k["digest"])).alias("children"),
            "weight",
        )
        level = written(made.select("*", digest(F.col("children")).alias("digest")), "merkle-level")
        runs.append(level)
        nodes = level.drop("children")
        roots = roots.unionByName(nodes.where("n_nodes = 1"))
        most = -(-most // RUN)
    return runs, roots


def _with_parents(nodes: DataFrame, parents: DataFrame, n_sources: int) -> DataFrame:
    """``nodes`` with ``up``; a source's root stands under the tree above the sources."""
    inside, below_top = F.col("n_nodes") > 1, (F.col("tree") != _TOP) & F.lit(n_sources > 1)
    at = F.when(inside, F.col("idx")).when(below_top, F.col("tree"))
    placed = nodes.select(
        "*",
        F.when(inside, F.col("tree")).when(below_top, F.lit(_TOP)).cast("long").alias("_tree"),
        F.when(inside, F.col("level") + 1).when(below_top, F.lit(1)).alias("_level"),
        F.floor(at / RUN).alias("_idx"),
        (at % RUN).cast("int").alias("_place"),
    )
    known = parents.select(
        F.col("tree").alias("_tree"),
        F.col("level").alias("_level"),
        F.col("idx").alias("_idx"),
        F.ceil(F.col("weight") / CLIMBERS).alias("_parts"),
    )
    up = F.struct(
        F.col("_tree").alias("tree"),
        F.col("_level").alias("level"),
        F.col("_idx").alias("idx"),
        F.col("_place").alias("place"),
        F.col("_parts").alias("parts"),
    )
    return placed.join(known, ["_tree", "_level", "_idx"], "left").select(
        *nodes.columns, F.when(F.col("_tree").isNotNull(), up).alias("up")
    )


def build(leaves: DataFrame) -> Manifest:
    """The manifest of (source, doc_id, leaf, claim), digests in binary.

    Leaves ascend by doc_id, null first; rows that repeat an id go by their leaves, and rows
    alike in both are interchangeable. A null source is a tree of its own, the first. A lone
    leaf is its source's root, and a lone source's root is the root. ``claim`` may be null:
    the leaf that somebody holds instead of the right one.
    """
    first = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first()]
    # Written before the sort, whose sampling would read and hash all texts once more.
    ordered = assign_ids(written(leaves, "merkle-leaves"), [*first, F.col("leaf")], "_n", 0)
    sizes = written(
        ordered.groupBy("source").agg(F.min("_n").alias("first_n"), F.count("*").alias("n_leaves")),
        "merkle-sizes",
    )
    sources = written(
        assign_ids(sizes, [F.col("source").asc_nulls_first()], "tree", 0), "merkle-sources"
    )
    total = sources.agg(F.count("*"), F.max("n_leaves")).first()
    n_sources, most = total[0], total[1] or 0
    placed = ordered.alias("a").join(
        sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))
    )
    at = F.col("_n") - F.col("first_n")
    kid = F.struct((at % RUN).cast("int").alias("place"), "leaf", "claim", "doc_id")
    run = F.floor(at / RUN)
    runs = written(
        placed.groupBy("tree", "n_leaves", run.alias("run")).agg(
            F.array_sort(F.collect_list(kid), _by_place).alias("kids")
        ),
        "merkle-runs",
    )
    children = _joined(F.transform("kids", lambda k: k["leaf"]))
    lowest = runs.select(
        "tree",
        F.lit(1).alias("level"),
        F.col("run").alias("idx"),
        F.ceil(F.col("n_leaves") / RUN).alias("n_nodes"),
        F.when(F.col("n_leaves") == 1, children).otherwise(digest(children)).alias("digest"),
        F.lit(1).cast("long").alias("weight"),
    )
    lowest = written(lowest, "merkle-lowest")
    inner, subroots = _levels(lowest, -(-most // RUN))
    subroots = written(subroots, "merkle-subroots")
    above, roots = _levels(
        subroots.select(
            F.lit(_TOP).cast("long").alias("tree"),
            F.lit(0).alias("level"),
            F.col("tree").alias("idx"),
            F.lit(n_sources).cast("long").alias("n_nodes"),
            "digest",
            "weight",
        ),
        n_sources,
    )
    root = roots.select(F.lower(F.hex("digest"))).first()
    columns = ["tree", "level", "idx", "n_nodes", "children", "digest", "weight"]
    empty = lowest.select(*[c for c in columns if c != "children"]).where("false")
    nodes = empty.select("*", F.lit(b"").alias("children")).select(*columns)
    for level in [*inner, *above]:
        nodes = nodes.unionByName(level.select(*columns))
    linked = _with_parents(lowest, nodes, n_sources)
    return Manifest(
        runs.join(
            linked.select("tree", F.col("idx").alias("run"), "digest", "up"), ["tree", "run"]
        ),
        _with_parents(nodes, nodes, n_sources),
        sources.join(
            subroots.select("tree", F.col("digest").alias("subroot")), "tree"
        ).select("source", "tree", "n_leaves", "subroot"),
        root[0] if root else None,
    )


def _by_place(a: Column, b: Column) -> Column:
    return a["place"] - b["place"]


_CLIMB = f"""
WITH RECURSIVE climb(tree, run, folded, siblings, up) AS (
    SELECT tree, run, folded, siblings, up FROM {{starts}}
    UNION ALL
    SELECT tree, run,
           transform(folded, f -> unhex(sha2(lower(hex(concat(left_part, f, right_part))), 256))),
           concat(siblings, left_part, right_part), next_up
    FROM (
        SELECT c.tree, c.run, c.folded, c.siblings, n.up AS next_up,
               substring(n.children, 1, {_BYTES} * c.up.place) AS left_part,
               substring(n.children, {_BYTES} * c.up.place + {_BYTES + 1}) AS right_part
        FROM climb c JOIN {{nodes}} n
          ON n.tree = c.up.tree AND n.level = c.up.level AND n.idx = c.up.idx
         AND n.part = pmod(xxhash64(c.tree, c.run), c.up.parts)
    )
)
SELECT tree, run, folded, siblings FROM climb WHERE up IS NULL
"""
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def climb(manifest: Manifest) -> DataFrame:
    """tree, run, folded, siblings: for each run, the root that each of its leaves folds to,
    from its claim or else its leaf, and all siblings from above the run to the root."""
    spark: SparkSession = manifest.runs.sparkSession
    leaves = F.transform("kids", lambda k: k["leaf"])
    claim = F.col("n_leaves") == 1

    def fold(kid: Column) -> Column:
        before, after = _others(F.col("_children"), kid["place"])
        held = F.coalesce(kid["claim"], kid["leaf"])
        return F.when(claim, held).otherwise(digest(F.concat(before, held, after)))

    starts = written(
        manifest.runs.select("*", _joined(leaves).alias("_children")).select(
            "tree",
            "run",
            F.transform("kids", fold).alias("folded"),
            F.lit(b"").alias("siblings"),
            "up",
        ),
        "merkle-starts",
    )
    # One copy of a node for so many climbers; the copies are as many as the climbers need.
    parts = F.greatest(F.ceil(F.col("weight") / CLIMBERS), F.lit(1))
    nodes = written(
        manifest.nodes.select(
            "tree",
            "level",
            "idx",
            "children",
            "up",
            F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"),
        ),
        "merkle-nodes",
    )
    before = spark.conf.get(_ROW_LIMIT, None)
    # Spark stops a recursion at a million rows unless told otherwise.
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        return written(spark.sql(_CLIMB, starts=starts, nodes=nodes), "merkle-climb")
    finally:
        spark.conf.unset(_ROW_LIMIT) if before is None else spark.conf.set(_ROW_LIMIT, before)


def proofs(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    tampered: Column | None = None,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row per row.

    A leaf is the digest of ``fields``. Where ``tampered`` (on the columns of ``docs``) is
    true, the leaf that climbs has A-Z of ``text`` in lower case; a text without such letters
    is not changed by that and is verified. ``proof_sha256`` is over all siblings from the
    leaf's run to the root, that of a lone leaf over nothing. Digests are lower-case hex.

    Nulls in any column are values of their own, and differ from empty texts. Rows that repeat
    an id or a whole row are leaves of their own. Other columns don't count. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    column = {f: F.col(f"`{f}`") for f in {*fields, doc_id, source, text}}
    changed = column | {text: lower_ascii(column[text])}
    wrong = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(
        column[source].cast("string").alias("source"),
        column[doc_id].alias("doc_id"),
        leaf_digest([column[f] for f in fields]).alias("leaf"),
        F.when(wrong, leaf_digest([changed[f] for f in fields])).alias("claim"),
    )
    with passing(spark):
        manifest = build(leaves)
        folded = climb(manifest)
        done = manifest.runs.join(folded, ["tree", "run"]).join(
            manifest.sources.select("tree", "subroot"), "tree"
        )
        each = F.transform(
            "kids",
            lambda k, i: F.struct(
                k["doc_id"].alias("doc_id"),
                k["leaf"].alias("leaf"),
                F.concat(
                    *_others(F.col("_children"), k["place"]), F.col("siblings")
                ).alias("siblings"),
                F.get("folded", i).alias("folded"),
            ),
        )
        rows = done.select(
            "*", _joined(F.transform("kids", lambda k: k["leaf"])).alias("_children")
        ).select("subroot", F.inline(each))
        hexed = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "siblings", "folded")}
        root = F.lit(manifest.root).cast("string")
        return written(
            rows.select(
                "doc_id",
                hexed["leaf"].alias("leaf"),
                hexed["subroot"].alias("subroot"),
                root.alias("root"),
                F.sha2(hexed["siblings"], 256).alias("proof_sha256"),
                hexed["folded"].alias("folded_root"),
                (hexed["folded"] == root).alias("verified"),
            ),
            "merkle-proofs",
            keep=True,
        )


def manifest_of(
    docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", source: str = "source"
) -> Manifest:
    """The manifest alone, to be stored next to the data."""
    return build(
        docs.select(
            F.col(f"`{source}`").cast("string").alias("source"),
            F.col(f"`{doc_id}`").alias("doc_id"),
            leaf_digest([F.col(f"`{f}`") for f in fields]).alias("leaf"),
            F.lit(None).cast("binary").alias("claim"),
        )
    )
