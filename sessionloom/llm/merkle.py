"""Merkle manifest of a corpus: a tree per source, a tree over the sources, and every document's proof.

The trees are built level by level: three consecutive nodes of a level are one small group, so no task
ever holds a source. Proofs come from pointer jumping. A node starts with the siblings of its own run and
a pointer to its parent; a self-join on the pointer appends the segment of the node pointed at and takes
over its pointer, so the distance doubles with every round and a tree of depth D needs log2 D rounds. Only
nodes with a descendant at the present distance can still be pointed at; all others leave the joined side,
which therefore shrinks from a half of the leaves to a few rows that Spark broadcasts by their file size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.tables import table
from sessionloom.operators.ranking import with_row_number
from sessionloom.sources.scratch import materialise

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars")
SUBROOT, DONE = -1, -2  # levels of node names that are no level of a tree
RESULT = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)
_NODE = "struct<key:string,level:int,idx:bigint>"
_STEPS = "array<struct<before:binary,after:binary>>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(text: Column) -> Column:
    """SHA-256 as 32 bytes, half the size of its hex text."""
    return F.unhex(F.sha2(text, 256))


def _field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _node(key: Column, level: Column, idx: Column) -> Column:
    return F.struct(key.alias("key"), level.alias("level"), idx.alias("idx")).cast(_NODE)


def leaf_digests(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, leaf, shown)`` per row; ``shown`` is the leaf of the text that is put to the proof.

    ``key`` orders the sources, null first, then bytewise. Where crc32 of the decimal doc_id is even the
    line feeds of the shown text are gone; a null doc_id is never tampered with.
    """
    head = [_field(F.col(c)) for c in FIELDS]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    hashed = docs.select(
        key.alias("key"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        _digest(F.concat(*head, _field(F.col("text")))).alias("leaf"),
        F.when(tampered, _digest(F.concat(*head, _field(cut)))).alias("other"),
    )
    return hashed.select("key", "doc_id", "leaf", F.coalesce("other", "leaf").alias("shown"))


def _runs(nodes: DataFrame) -> DataFrame:
    """Consecutive nodes in runs of FANOUT, with the height of the parent above its deepest leaf."""
    member = F.struct(*[c for c in nodes.columns if c not in ("key", "level", "n")])
    run = F.floor(F.col("idx") / FANOUT).cast("bigint").alias("run")
    return nodes.filter("n > 1").groupBy("key", "level", "n", run).agg(
        F.sort_array(F.collect_list(member)).alias("members"), (F.max("high") + 1).alias("high")
    )


def _parents(runs: DataFrame) -> DataFrame:
    joined = F.concat_ws("", F.transform("members", lambda m: _hex(m["digest"])))
    return runs.select(
        "key",
        (F.col("level") + 1).alias("level"),
        F.floor((F.col("n") + FANOUT - 1) / FANOUT).cast("bigint").alias("n"),
        F.col("run").alias("idx"),
        _digest(joined).alias("digest"),
        "high",
    )


def _levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """All runs, level by level, and the nodes that are alone on their level."""
    tops = [nodes.filter("n = 1").select("key", "digest", "high")]
    levels = []
    while most > 1:
        runs = materialise(_runs(nodes), "runs")
        levels.append(runs)
        nodes = _parents(runs)
        tops.append(nodes.filter("n = 1").select("key", "digest", "high"))
        most = -(-most // FANOUT)
    return levels, reduce(DataFrame.unionByName, tops)


def _children(runs: DataFrame) -> DataFrame:
    """The members of the runs with their siblings before and after them and a pointer to the parent.

    ``last`` tells that the parent is the top of its tree.
    """
    none = F.lit(b"")
    at = F.col("at")
    sibling = [F.coalesce(F.get("members", F.lit(j))["digest"], none) for j in range(FANOUT)]
    before = F.concat(*[F.when(at > j, sibling[j]).otherwise(none) for j in range(FANOUT)])
    after = F.concat(*[F.when(at < j, sibling[j]).otherwise(none) for j in range(FANOUT)])
    single = runs.select("*", F.posexplode("members").alias("at", "member"))
    return single.select(
        "key",
        "level",
        "member.*",
        F.array(F.struct(before.alias("before"), after.alias("after"))).cast(_STEPS).alias("steps"),
        _node(F.col("key"), F.col("level") + 1, F.col("run")).alias("parent"),
        (F.col("n") <= FANOUT).alias("last"),
    )


def _finished(idx: Column) -> Column:
    """A pointer that meets no node. Each has a number of its own, so that they don't share a task."""
    return _node(F.lit(""), F.lit(DONE), idx)


def _jump(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Append the segment of the node pointed at, and point where it points."""
    there = targets.select(
        F.col("node").alias("__at"),
        F.col("steps").alias("__steps"),
        F.col("pointer").alias("__pointer"),
        F.col("subroot").alias("__subroot"),
    )
    own = [c for c in nodes.columns if c not in ("steps", "pointer", "subroot")]
    return nodes.join(there, F.col("pointer") == F.col("__at"), "left").select(
        *own,
        F.concat("steps", F.coalesce("__steps", F.array().cast(_STEPS))).alias("steps"),
        F.when(F.col("__at").isNull(), F.col("pointer")).otherwise(F.col("__pointer")).alias("pointer"),
        F.coalesce("subroot", "__subroot").alias("subroot"),
    )


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether the row as shown still folds to the root.

    A leaf hashes doc_id, source, lang, n_chars and text. Leaves of a source ascend by doc_id (null
    first), rows that share a doc_id by their leaf, so equal rows are interchangeable. Nulls are fields
    ``-``, an empty text is ``0:``; a table without rows gives none. Other columns are not looked at.
    ``proof_sha256`` hashes the siblings from the leaf to the root, ``folded_root`` is what the shown
    leaf and these siblings give.
    """
    spark = docs.sparkSession
    numbered = with_row_number(leaf_digests(docs), ["doc_id", "leaf", "shown"], ["key"], "__place")
    alone = F.when(F.col("group_rows") == 1, F.lit(1)).otherwise(F.lit(0))  # such a leaf points at itself
    leaves = materialise(
        numbered.select(
            "key", F.lit(0).alias("level"), F.col("group_rows").alias("n"), (F.col("__place") - 1).alias("idx"),
            F.col("leaf").alias("digest"), "doc_id", "shown", alone.alias("high"),
        ),
        "leaves",
    )
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        return spark.createDataFrame([], RESULT)
    runs, tops = _levels(leaves, most)
    placed = materialise(with_row_number(tops, ["key"], (), "__place"), "subroots")
    sources = placed.select(
        F.lit("").alias("key"), F.lit(0).alias("level"), F.col("group_rows").alias("n"),
        (F.col("__place") - 1).alias("idx"), "digest", F.col("key").alias("of"), "high",
    )
    upper, root = _levels(sources, sources.agg(F.max("n")).first()[0])
    root = root.first()  # one row: the root has no sibling

    subroot = lambda key: _node(key, F.lit(SUBROOT), F.lit(0))
    # The subroot of a single source is the root, so its tree ends there.
    top_of_source = subroot(F.col("key")) if upper else _finished(F.col("idx"))
    unknown = F.lit(None).cast("binary")

    def below(level: DataFrame, *extra: str) -> DataFrame:
        """Nodes of a source's tree."""
        up = F.when(F.col("last"), top_of_source).otherwise(F.col("parent"))
        return _children(level).select(
            _node(F.col("key"), F.col("level"), F.col("idx")).alias("node"),
            "steps", up.alias("pointer"), unknown.alias("subroot"), "high", *extra,
        )

    def above(level: DataFrame, first: bool) -> DataFrame:
        """Nodes of the tree over the sources; its leaves are the subroots."""
        name = subroot(F.col("of")) if first else _node(F.col("key"), F.col("level"), F.col("idx"))
        up = F.when(F.col("last"), _finished(F.col("idx"))).otherwise(F.col("parent"))
        return _children(level).select(
            name.alias("node"), "steps", up.alias("pointer"),
            (F.col("digest") if first else unknown).alias("subroot"), "high",
        )

    no_steps = F.array().cast(_STEPS)
    inner = [below(level) for level in runs[1:]] + [above(level, i == 0) for i, level in enumerate(upper)]
    singles = leaves.filter("n = 1").select(
        no_steps.alias("steps"), top_of_source.alias("pointer"), unknown.alias("subroot"),
        F.col("digest").alias("leaf"), "doc_id", "shown",
    )
    proofs = [singles] + [
        below(level, "digest", "doc_id", "shown").select(
            "steps", "pointer", "subroot", F.col("digest").alias("leaf"), "doc_id", "shown"
        )
        for level in runs[:1]
    ]
    proof = reduce(DataFrame.unionByName, proofs)
    distance = 1
    while inner:
        found = reduce(DataFrame.unionByName, inner) if distance == 1 else _jump(
            targets.filter(F.col("high") >= distance), targets
        )
        targets = materialise(found, "nodes")
        proof = _jump(proof, targets)
        distance *= 2
        if distance >= root.high:
            break

    top = bytes(root.digest).hex()
    folded = F.aggregate(
        "steps",
        _hex(F.col("shown")),
        lambda below_it, s: F.sha2(F.concat(_hex(s["before"]), below_it, _hex(s["after"])), 256),
    )
    siblings = F.concat_ws("", F.transform("steps", lambda s: _hex(F.concat(s["before"], s["after"]))))
    folds = proof.select(
        "doc_id",
        _hex(F.col("leaf")).alias("leaf"),
        F.coalesce(_hex(F.col("subroot")), F.lit(top)).alias("subroot"),
        F.lit(top).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return folds.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


# SQL twin. A tree of up to 3^SQL_LEVELS leaves; a level leaves a node that is alone as it is.
SQL_LEVELS = 12


def _sql_field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _sql_tree(prefix: str, leaves: str) -> str:
    """CTEs ``{prefix}0 .. {prefix}L`` (k, i, n, d) from leaves (k, i, d), and runs ``{prefix}r0 ..``."""
    out = [f"{prefix}0 AS MATERIALIZED (SELECT k, i, count(*) OVER (PARTITION BY k) AS n, d FROM ({leaves}))"]
    for level in range(SQL_LEVELS):
        here = f"{prefix}{level}"
        out.append(
            f"{prefix}r{level} AS MATERIALIZED (SELECT k, i // {FANOUT} AS r, any_value(n) AS n, list(d ORDER BY i) AS m, "
            f"any_value(d) AS d FROM {here} GROUP BY k, i // {FANOUT})"
        )
        out.append(
            f"{prefix}{level + 1} AS MATERIALIZED (SELECT k, r AS i, (n + {FANOUT - 1}) // {FANOUT} AS n, "
            f"CASE WHEN n > 1 THEN sha256(array_to_string(m, '')) ELSE d END AS d FROM {prefix}r{level})"
        )
    return ", ".join(out)


def _sql_path(prefix: str, start: str, key: str, place: str) -> str:
    """Joins to the runs above a leaf, with the siblings ``b`` before and ``a`` after it as a list of structs."""
    joins = " ".join(
        f"JOIN {prefix}r{level} r{level} ON r{level}.k = {key} AND r{level}.r = {place} // {FANOUT ** (level + 1)}"
        for level in range(SQL_LEVELS)
    )
    steps = ", ".join(
        f"CASE WHEN r{level}.n > 1 THEN {{'b': array_to_string(r{level}.m[1:at{level}], ''), "
        f"'a': array_to_string(r{level}.m[at{level} + 2:], '')}} END".replace(
            f"at{level}", f"({place} // {FANOUT ** level}) % {FANOUT}"
        )
        for level in range(SQL_LEVELS)
    )
    return f"SELECT {start}.*, list_filter([{steps}], lambda s: s IS NOT NULL) AS path FROM {start} {joins}"


_CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda s, x: xor(xor(s, x) >> 1, (xor(s, x) & 1) * 3988292384))"""
_HEAD = " || ".join(_sql_field(c) for c in FIELDS)

ORACLE = f"""
WITH hashed AS (
  SELECT doc_id, coalesce('1' || source, '0') AS k, sha256({_HEAD} || {_sql_field('text')}) AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 2 = 0
      THEN sha256({_HEAD} || {_sql_field("replace(text, chr(10), '')")}) END AS other
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
{_sql_tree('s', 'SELECT k, i, leaf AS d FROM placed')},
tops AS MATERIALIZED (SELECT '' AS k, row_number() OVER (ORDER BY encode(k)) - 1 AS i, k AS source_key, d FROM s{SQL_LEVELS}),
{_sql_tree('t', 'SELECT k, i, d FROM tops')},
upper_path AS MATERIALIZED ({_sql_path('t', 'tops', 'tops.k', 'tops.i')}),
lower_path AS MATERIALIZED ({_sql_path('s', 'placed', 'placed.k', 'placed.i')}),
proofs AS (
  SELECT doc_id, leaf, u.d AS subroot, (SELECT d FROM t{SQL_LEVELS}) AS root, coalesce(other, leaf) AS shown,
         list_concat(l.path, u.path) AS path
  FROM lower_path l JOIN upper_path u ON u.source_key = l.k),
folds AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda s: s.b || s.a), '')) AS proof_sha256,
    list_reduce(list_concat([{{'b': shown, 'a': ''}}], path), lambda x, s: {{'b': sha256(s.b || x.b || s.a), 'a': ''}}).b AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds"""
