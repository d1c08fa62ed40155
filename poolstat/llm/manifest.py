"""Merkle dataset manifest: one binary tree of digests for each language, and one over the trees' roots.

Parents are built as events: a child's digest that arrives opens or completes its partial parent, whose arity follows
from the size of the tree; a complete parent is emitted and arrives in turn at its own parent. First every task combines
what it holds of the sorted leaves, as a combiner before a shuffle does; the children of parents left open, a few for
each task and level, are the frontier, which is reshuffled by an ancestor SPAN levels further up until nothing is open.
A proof follows the links back: from the root down, SPAN levels a shuffle, every child gets its sibling before its
parent's path.

No language, and no key of another kind, is held by one task: leaves are numbered by range, a key of a round has
2 ** SPAN nodes at most. Each round is a written table, so a lost executor repeats one round at most.

Defined results: a null field is `-`; null lang is a tree of its own, first; null doc_ids come first, rows of one doc_id
are ordered by leaf digest, equal rows are leaves of their own (interchangeable); texts of any length are digested
whole; a tree of one leaf is that leaf; a leaf without siblings has the digest of the empty text as proof_sha256; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: levels that one shuffle resolves; rows of numbering tables that are broadcast
SPAN, MAX_BROADCAST = 10, 100_000
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, n long, level int, idx long, digest string, kids array<string>"
HEAD = ["path", "tpos", "tn", "subroot", "root"]


def digest_of(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row's fields; `changed` replaces fields by name."""
    return F.sha2(F.concat(*[field(changed.get(f, F.col(f))) for f in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, tampered (the leaf with one more char told, null where the row is left as it is), row."""
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    tree = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "lang"))  # in UTF-8 order, null first
    own = docs.select(*FIELDS)
    return own.select(
        tree.alias("tree"), "doc_id", leaf_digest().alias("leaf"),
        F.when(touched, leaf_digest(n_chars=F.col("n_chars") + 1)).alias("tampered"), F.monotonically_increasing_id().alias("row"),
    )


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos (from 0 within its tree, by `order`) and n (the tree's size): sorted by range, counted by range and tree."""
    at = written(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_part", F.shiftright("_at", 33))
    counts = at.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(counts.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("n")))
    small = starts.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    out = at.join(F.broadcast(starts) if small else starts, ["tree", "_part"])
    return out.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def size_at(n: int, level: int) -> int:
    """Nodes of a level of a tree with n leaves."""
    return -(-n >> level)


class Parents:
    """Combiner: partial parents, each with the digests of the children that have arrived, by index."""

    def __init__(self):
        self.open: dict[tuple, dict[int, str]] = {}
        self.made: list[tuple] = []

    def arrive(self, tree: str, n: int, level: int, idx: int, digest: str):
        while size_at(n, level) > 1:
            key = (tree, n, level, idx >> 1)
            kids = self.open.setdefault(key, {})
            kids[idx] = digest
            if len(kids) < min(2, size_at(n, level) - 2 * (idx >> 1)):
                return
            del self.open[key]
            own = [kids[i] for i in sorted(kids)]
            level, idx, digest = level + 1, idx >> 1, digest_of(*own)
            self.made.append((tree, n, level, idx, digest, own))

    def emitted(self) -> list[tuple]:
        made, self.made = self.made, []
        return made

    def frontier(self) -> list[tuple]:
        """Children of the parents left open."""
        return [(tree, n, level, idx, digest, None) for (tree, n, level, _), kids in self.open.items() for idx, digest in kids.items()]


def combine(parts):
    state, columns = Parents(), ["tree", "n", "level", "idx", "digest", "kids"]
    for part in parts:
        for row in zip(*(part[c] for c in columns[:5])):
            state.arrive(*row)
        yield pd.DataFrame(state.emitted(), columns=columns)
    yield pd.DataFrame(state.frontier(), columns=columns)


def build(places: DataFrame) -> DataFrame:
    """places(tree, pos, n, leaf) -> every parent: tree, n, level, idx, digest, kids (its children's digests)."""
    step = written(places.select("tree", "n", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("digest")).mapInPandas(combine, NODE))
    nodes, turn = step.where("kids is not null"), 0
    while not (frontier := step.where("kids is null")).isEmpty():
        turn += 1
        ancestor = F.expr(f"shiftright(idx, cast(greatest({SPAN * turn} - level, 0) as int))")
        step = written(frontier.drop("kids").repartition("tree", ancestor).mapInPandas(combine, NODE))
        nodes = nodes.union(step.where("kids is not null"))
    return nodes


def roots(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, digest of its root, n: the parent that is its level's only node, or the only leaf."""
    top = nodes.where("shiftleft(1L, level) >= n").select("tree", "digest", "n")
    return top.union(places.where("n = 1").select("tree", F.col("leaf").alias("digest"), "n"))


def paths_within(part: pd.DataFrame) -> tuple[dict[tuple[int, int], str], tuple]:
    """Paths (siblings from the node up, joined) of every node of a group from its links, and the group's head."""
    head = part[part["kind"] == 0].iloc[0]
    paths = {(int(head["level"]), int(head["idx"])): head["path"]}
    links = part[part["kind"] == 1].sort_values("level", ascending=False)
    for level, idx, kids in zip(links["level"], links["idx"], links["kids"]):
        above = paths[level, idx]
        for k in range(len(kids)):
            paths[level - 1, 2 * idx + k] = "".join(kids[1 - k : 2 - k] if len(kids) > 1 else []) + above
    return paths, tuple(head[c] for c in HEAD[1:])


def heads_at(low: int):
    """Group -> the heads of the groups below: its nodes of level `low` with their paths."""

    def down(part: pd.DataFrame) -> pd.DataFrame:
        paths, head = paths_within(part)
        tree, n = part["tree"].iloc[0], part["n"].iloc[0]
        return pd.DataFrame([(tree, n, low, idx, path, *head) for (level, idx), path in paths.items() if level == low], columns=["tree", "n", "level", "idx", *HEAD])

    return down


def proofs(places: DataFrame, nodes: DataFrame, heads: DataFrame, finish, schema: str) -> DataFrame:
    """finish(leaves of a group, their paths, head) for every leaf; heads(tree, n, path, tpos, tn, subroot, root) start at the trees' roots.

    A band has SPAN levels; its groups are the blocks below one node of its top level, each with that node's path."""
    highest = heads.agg(F.max("n")).first()[0] or 0
    bands = max(1, -(-(max(highest, 1) - 1).bit_length() // SPAN))
    own_band = F.expr(f"greatest(cast((length(bin(n - 1)) - 1) / {SPAN} as int), 0)")  # of the tree's highest links
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    tops = heads.select("tree", "n", own_band.alias("_band"), height.cast("int").alias("level"), F.lit(0).cast("long").alias("idx"), *HEAD)
    start = {c: F.lit(None).cast(t) for c, t in {"kids": "array<string>", "doc_id": "string", "leaf": "string", "tampered": "string"}.items()}
    rows = ["tree", "n", "kind", "level", "idx", "block", *HEAD, *start]
    came = None
    for band in reversed(range(bands)):
        low, high = SPAN * band, SPAN * (band + 1)
        head = tops.where(F.col("_band") == band).drop("_band")
        head = (head.unionByName(came) if came is not None else head).withColumns({"kind": F.lit(0), "block": F.expr(f"shiftright(idx, cast(greatest({high} - level, 0) as int))")} | start)
        none = {c: F.lit(None).cast(t) for c, t in zip(HEAD, ["string", "long", "long", "string", "string"])}
        links = nodes.where((F.col("level") > low) & (F.col("level") <= high)).withColumns({"kind": F.lit(1), "block": F.expr(f"shiftright(idx, cast({high} - level as int))")} | none | {c: start[c] for c in ("doc_id", "leaf", "tampered")})
        group = head.select(rows).union(links.select(rows))
        if band:
            came = written(group.groupBy("tree", "block").applyInPandas(heads_at(low), "tree string, n long, level int, idx long, path string, tpos long, tn long, subroot string, root string"))
            continue
        own = places.withColumns({"kind": F.lit(2), "level": F.lit(0), "idx": F.col("pos"), "block": F.shiftright("pos", SPAN), "kids": start["kids"]} | none)
        own = own.withColumn("doc_id", F.col("doc_id").cast("string") if "doc_id" in own.columns else start["doc_id"])  # text: pandas would make floats of longs beside nulls
        group = group.union(own.select(rows))

        def last(part: pd.DataFrame) -> pd.DataFrame:
            paths, head = paths_within(part)
            found = part[part["kind"] == 2]
            return finish(found, [paths[0, i] for i in found["idx"]], head)

        return group.groupBy("tree", "block").applyInPandas(last, schema)


def folded(digest: str, path: str, places: list[tuple[int, int]]) -> str:
    """Root that a leaf and the siblings of its path lead to; places: (position, leaves) of the tree and of the tree above it."""
    at = 0
    for pos, n in places:
        while n > 1:
            if pos & 1 or pos + 1 < n:
                other, at = path[at : at + 64], at + 64
                digest = digest_of(other, digest) if pos & 1 else digest_of(digest, other)
            else:
                digest = digest_of(digest)
            pos, n = pos >> 1, -(-n // 2)
    return digest


def top_paths(part: pd.DataFrame, paths: list[str], head: tuple) -> pd.DataFrame:
    return pd.DataFrame({"name": part["tampered"], "path": paths, "tpos": part["idx"], "tn": part["n"], "subroot": part["leaf"], "root": head[3]})


def checked(part: pd.DataFrame, paths: list[str], head: tuple) -> pd.DataFrame:
    tpos, tn, subroot, root = head
    out = []
    for doc_id, pos, n, leaf, tampered, path in zip(part["doc_id"], part["idx"], part["n"], part["leaf"], part["tampered"], paths):
        got = folded(tampered if isinstance(tampered, str) else leaf, path, [(int(pos), int(n)), (int(tpos), int(tn))])
        out.append((doc_id, leaf, subroot, root, digest_of(path), got, got == root))
    return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(places of the leaves, parents of the trees, places of the trees' roots, parents above them)."""
    places = placed(leaves(docs), "doc_id", "leaf", "row")
    nodes = build(places)
    subroots = roots(places, nodes).select(F.lit("").alias("tree"), F.col("tree").alias("tampered"), F.col("digest").alias("leaf"))
    above = placed(subroots, "tampered")  # the tree's name
    return places, nodes, above, build(above)


def op11(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    places, nodes, above, top = manifest(docs)
    nothing = F.lit(None).cast("long")
    summit = roots(above, top).select("tree", "n", F.lit("").alias("path"), nothing.alias("tpos"), nothing.alias("tn"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    heads = proofs(above, top, summit, top_paths, "name string, path string, tpos long, tn long, subroot string, root string")
    sizes = roots(places, nodes).select(F.col("tree").alias("name"), "n")
    heads = written(heads.join(sizes, "name").select(F.col("name").alias("tree"), "n", *HEAD))
    out = proofs(places, nodes, heads, checked, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def sql(levels: int = 24) -> str:
    """op11's rows in SQL, level by level; for trees of up to 2 ** levels leaves."""
    told = lambda c: f"case when {c} is null then '-' else octet_length(encode({c}::varchar))::varchar || ':' || {c} end"
    leaf = lambda chars: "sha256(" + " || ".join(told(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"
    bits = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295)"
    grown = lambda name: "".join(
        f", {name}{k} as (select tree, pos >> 1 as pos, case when max(n) = 1 then min(d) else sha256(string_agg(d, '' order by pos)) end d, any_value((n + 1) >> 1) as n from {name}{k - 1} group by tree, pos >> 1)"
        for k in range(1, levels + 1)
    )
    every = lambda name: " union all ".join(f"select {k} as level, tree, pos, d from {name}{k} where n > 1" for k in range(levels))
    steps = lambda name: (
        f"(select o.tree, o.pos, coalesce(list(case when s.d is null then 'N' when (o.pos >> k.level) & 1 = 1 then 'L' || s.d else 'R' || s.d end order by k.level), []) as steps "
        f"from {name}0 o join (select distinct level, tree from {name}_all) k on k.tree = o.tree left join {name}_all s on s.tree = o.tree and s.level = k.level and s.pos = xor(o.pos >> k.level, 1) group by 1, 2)"
    )
    return f"""with own as (
 select doc_id, coalesce('=' || lang, '-') as tree, {leaf("n_chars")} as d, case when n_chars is not null and {crc} % 7 = 0 then {leaf("(n_chars + 1)")} end as tampered from documents
), a0 as (
 select *, row_number() over (partition by tree order by doc_id nulls first, d) - 1 as pos, count(*) over (partition by tree) as n from own
){grown("a")}, a_all as ({every("a")}), b0 as (
 select '' as tree, tree as name, d, row_number() over (order by tree) - 1 as pos, count(*) over () as n from a{levels}
){grown("b")}, b_all as ({every("b")}), full_ as (
 select a0.doc_id, a0.d as leaf, a0.tampered, b0.d as subroot, r.d as root, list_concat(coalesce(x.steps, []), coalesce(y.steps, [])) as steps
 from a0 join b0 on b0.name = a0.tree cross join b{levels} r left join {steps("a")} x on x.tree = a0.tree and x.pos = a0.pos left join {steps("b")} y on y.pos = b0.pos
), told as (
 select *, list_reduce(list_prepend(coalesce(tampered, leaf), steps), lambda s, x: case x[1] when 'L' then sha256(x[2:] || s) when 'R' then sha256(s || x[2:]) else sha256(s) end) as folded_root from full_
)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from told"""
