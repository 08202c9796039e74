"""Trie of conversation prefixes by a van Emde Boas recursion on depth.

A trie of depth below 2 ** K is cut at half depth: every sequence is split there, the cut prefixes get
names, the different ones among them make the upper trie, and the rest of all sequences, under the name
of their cut, the lower forest. Both halves are cut again, all of one size in one Spark job, until a piece is
one edge. So K jobs build the trie, whatever the number of turns of the longest conversation, and equal
prefixes travel as one weighted row from the cut on. Totals of subtrees are then grafted upward: the sum
of a lower tree is added to its cut node, and through the pieces above the cut to all its ancestors.

A piece of a sequence ("strand") has the name of the node above it (``top``), the smallest conversation
that runs through it, its number of turns, and the node at its lower end (``bottom``) where all of the piece's
sequences reach that depth. A name is half a SHA-256 digest of the name above and the name of the turns
between; turns are named in blocks of doubling size, so no task holds a conversation.

Defined results: turns are ordered by turn number (null first), then by role and text, so ties and
repeated rows have one order; a null role or text is empty; rows without a conv_id belong to no conversation and are
left out; an empty table has no nodes, not even the root; further columns are not carried.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

ROOT = bytes(16)
#: Characters of the ends of one node that travel as one row.
PIECE = 1 << 20


def name(*parts: Column) -> Column:
    """16 bytes that stand for the given strings of bytes."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns conv_id, pos (from 0), sym (name of role and text), chars: a table in the shared folder.

    A sort by ranges gives the order, so a conversation with a third of all rows is spread over tasks; its
    positions are those inside a range plus the rows of the ranges before. Range bounds are sampled from
    short heads of role and text, which sort like the whole.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"))
    rows = rows.withColumns({"role_head": F.substring("role", 1, 16), "text_head": F.substring("text", 1, 16)})
    rows = rows.repartitionByRange("conv_id", "turn", "role_head", "text_head").sortWithinPartitions("conv_id", "turn", "role", "text")
    sym = name(F.octet_length("role").cast("string").cast("binary"), F.lit(b":"), F.col("role").cast("binary"), F.col("text").cast("binary"))
    rows = C.materialise(rows.select("conv_id", sym.alias("sym"), F.length("text").alias("chars"), F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33).alias("part")
    parts = rows.groupBy("conv_id", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = rows.select("*", part).join(parts.drop("n"), ["conv_id", "part"])
    return C.materialise(rows.select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "sym", "chars"))


def lengths(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("conv_id").agg(F.count("*").alias("len"))


def _blocks(symbols: DataFrame, levels: int) -> list[DataFrame]:
    """For each k the names of all full blocks of 2 ** k turns: conv_id, b, block."""
    out = [symbols.select("conv_id", F.col("pos").alias("b"), F.col("sym").alias("block"))]
    for _ in range(1, levels):
        odd = (F.col("b") % 2) == 1
        pair = out[-1].groupBy("conv_id", F.shiftright("b", 1).alias("b")).agg(
            F.max(F.when(~odd, F.col("block"))).alias("left"), F.max(F.when(odd, F.col("block"))).alias("right"))
        out.append(C.materialise(pair.filter(F.col("left").isNotNull() & F.col("right").isNotNull()).select("conv_id", "b", name(F.col("left"), F.col("right")).alias("block"))))
    return out


def _cut(strands: DataFrame, blocks: DataFrame, half: int) -> DataFrame:
    """``strands`` of at most 2 * half turns with the name of their cut (null for one that ends before it)."""
    rows = strands.withColumn("b", (F.col("m") / half).cast("long")).join(blocks, ["conv_id", "b"], "left")
    return C.materialise(rows.select("top", "conv_id", "m", "len", "n", "bottom", name(F.col("top"), F.col("block")).alias("cut")))


def _halves(cut: DataFrame, half: int) -> DataFrame:
    """Strands of the upper tries, one for each cut, and of the lower forests, with those that end before the cut."""
    through = cut.filter("cut IS NOT NULL")
    upper = through.groupBy("top", "cut").agg(F.min("conv_id").alias("conv_id"), F.min("m").alias("m"), F.sum("n").alias("n"))
    upper = upper.select("top", "conv_id", "m", F.lit(half).cast("long").alias("len"), "n", F.col("cut").alias("bottom"))
    lower = through.filter(F.col("len") > half).select(F.col("cut").alias("top"), "conv_id", F.col("m") + half, F.col("len") - half, "n", "bottom")
    return upper.unionAll(lower).unionAll(cut.filter("cut IS NULL").drop("cut"))


def _graft(nodes: DataFrame, cuts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Columns name, leaves, saved of what lies below each node but the root, and the root's sums (top, leaves, saved)."""
    add = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    sums = [C.materialise(nodes.groupBy("top").agg(F.min("depth").alias("depth"), *add).withColumn("depth", F.col("depth") - 1))]
    hung = []  # by level: what hangs from each cut in its lower tree
    for k, cut in enumerate(cuts):
        tops = cut.filter("cut IS NOT NULL").select(F.col("top").alias("above"), "cut").distinct()
        hung.append(C.materialise(tops.join(sums[k], tops["cut"] == sums[k]["top"]).select("above", "cut", "leaves", "saved")))
        own = sums[k].filter(F.col("depth") % (2 << k) == 0)
        lifted = hung[k].select(F.col("above").alias("top"), F.lit(None).cast("long").alias("depth"), "leaves", "saved")
        sums.append(C.materialise(own.unionByName(lifted).groupBy("top").agg(F.max("depth").alias("depth"), *add)))
    below = None
    for k in reversed(range(len(cuts))):
        here = hung[k].select(F.col("cut").alias("name"), "leaves", "saved")
        if below is not None:  # what lies below the far end of a strand lies below its cut, too
            far = cuts[k].filter("cut IS NOT NULL AND bottom IS NOT NULL").select("bottom", "cut")
            here = here.unionAll(far.join(below, far["bottom"] == below["name"]).select("cut", "leaves", "saved"))
        here = here.groupBy("name").agg(*add)
        below = C.materialise(here if below is None else here.unionAll(below))
    return below, sums[-1].filter(F.col("top") == F.lit(ROOT)).drop("depth")


def _pieces(batches):
    """Sorted (name, conv_id) to pieces of the comma-joined ids of a node, each with its first id."""
    now, ids, size, begun = None, [], 0, False

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["name", "first", "piece"])

    done = []
    for batch in batches:
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if begun and (node != now or size >= PIECE):
                done.append(row())
                ids, size = [], 0
            now, begun = node, True
            ids.append(conv)
            size += 21
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done = []
    if begun:
        yield row()


def _ends_digest(batches):
    """Sorted pieces to one digest for each node."""
    now, h = None, None
    for batch in batches:
        out = []
        for node, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if h is None or node != now:
                if h is not None:
                    out.append((now, h.hexdigest()))
                now, h = node, hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["name", "ends_sha256"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["name", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """Columns name, ends_sha256 of the ids (name, conv_id) in order. SHA-256 reads its input in sequence, so a node's
    ids meet in one task, but as joined pieces of about a megabyte, made where ranges of the sorted ids lie."""
    rows = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    pieces = rows.mapInArrow(_pieces, "name binary, first long, piece string")
    whole = pieces.repartition("name").sortWithinPartitions("name", "first").select("name", "piece")
    return whole.mapInArrow(_ends_digest, "name binary, ends_sha256 string")


def build(symbols: DataFrame, members: DataFrame) -> DataFrame:
    """The trie of the sequences ``symbols`` (conv_id, pos, sym, chars) of ``members`` (conv_id, len; len 0 allowed).

    One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``symbols`` and ``members`` must be materialised.
    """
    C.ship(symbols.sparkSession)
    longest = members.agg(F.max("len")).first()[0] or 0
    levels = int(longest).bit_length()  # 2 ** levels > longest
    blocks = _blocks(symbols, levels)
    strands = members.filter("len > 0").select(F.lit(ROOT).alias("top"), "conv_id", F.lit(0).cast("long").alias("m"), "len", F.lit(1).cast("long").alias("n"), F.lit(None).cast("binary").alias("bottom"))
    ends = members.filter("len = 0").select(F.lit(ROOT).alias("name"), "conv_id")
    cuts: list[DataFrame] = [None] * levels
    for k in reversed(range(levels)):
        cuts[k] = _cut(strands, blocks[k], 1 << k)
        strands = _halves(cuts[k], 1 << k)
        ends = ends.unionAll(cuts[k].filter(F.col("bottom").isNull() & (F.col("len") == 1 << k)).select("cut", "conv_id"))
    edges = strands.select("top", F.col("bottom").alias("name"), "conv_id", (F.col("m") + 1).alias("depth"), "n", F.col("m").alias("pos"))
    edges = C.materialise(edges.join(symbols.select("conv_id", "pos", "chars"), ["conv_id", "pos"]))
    children = edges.groupBy(F.col("top").alias("name")).agg(F.count("*").alias("n_children"))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).filter("n > 0")
    root = root.select(F.lit(None).cast("binary").alias("top"), F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"), "n", F.lit(0).alias("chars"))
    nodes = edges.select("top", "name", "conv_id", "depth", "n", "chars").unionAll(root).join(children, "name", "left")
    nodes = C.materialise(nodes.withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "leaves": F.col("n_children").isNull().cast("long"),
        "saved": (F.col("n") - 1) * F.when(F.col("top").isNotNull(), F.col("chars")).otherwise(0)}))
    below = _below(nodes, cuts)
    # a digest of many ids must not hang from a hot name: names are unique on both sides of these joins
    out = nodes.join(below, "name", "left").join(ends_digests(C.materialise(ends)), "name", "left")
    out = C.materialise(out.select(
        "top", "name", "conv_id", "depth", F.col("n").alias("n_convs"), "n_children", (F.col("leaves") + F.coalesce("below_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("below_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
    out = C.lookup(out, nodes.select(F.col("name").alias("top"), F.col("conv_id").alias("parent_conv_id")), ["top"], "name")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _below(nodes: DataFrame, cuts: list[DataFrame]) -> DataFrame:
    named = lambda df, key: df.select(F.col(key).alias("name"), F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))
    if not cuts:
        return named(nodes.limit(0), "name")
    below, root = _graft(nodes.filter("top IS NOT NULL"), cuts)
    return named(below, "name").unionAll(named(root, "top"))


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are given."""
    symbols = numbered(turns, conv_id, turn, role, text)
    return build(symbols, C.materialise(lengths(symbols)))


def regrown(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and lengths of the conversations rebuilt on a shared start: conversation c takes the first h turns of
    conversation c - c % 100, h = crc32(c) % 6, then its own turns after its first h."""
    size = C.materialise(lengths(symbols))
    convs = size.select("conv_id", "len", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    convs = convs.join(size.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len")), "base", "left")
    convs = C.materialise(convs.withColumn("lead", F.least("h", F.coalesce("base_len", F.lit(0)))))
    # a base has at most 100 conversations, and gives each at most 5 turns
    lead = symbols.filter("pos < 5").withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").filter("pos < h")
    own = symbols.filter("pos >= 0").join(convs.select("conv_id", "h", "lead"), "conv_id").filter("pos >= h")
    made = lead.select("conv_id", "pos", "sym", "chars").unionAll(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "sym", "chars"))
    return C.materialise(made), convs.select("conv_id", (F.col("lead") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    symbols, members = regrown(numbered(C.read(spark, sf_dir, "conversations")))
    return build(symbols, members)


SQL = """
WITH t AS (SELECT conv_id::BIGINT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
  {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT c, len, steps, list_reduce(list_prepend(4294967295::BIGINT, steps), lambda a, s: CASE WHEN s >= 0 THEN xor(a, s)
  ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS reg FROM (SELECT c, count(*) AS len, flatten(list_transform(string_split(c::VARCHAR, ''),
  lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM t GROUP BY c)),
h AS (SELECT c, len, xor(reg, 4294967295) % 6 AS h, c - c % 100 AS base FROM z),
k AS (SELECT h.c, h.h, h.base, h.len, least(h.h, coalesce(b.len, 0)) AS lead FROM h LEFT JOIN h b ON b.c = h.base),
r AS (SELECT k.c, t.pos, t.x FROM k JOIN t ON t.c = k.base AND t.pos < k.h
  UNION ALL SELECT k.c, t.pos - k.h + k.lead, t.x FROM k JOIN t ON t.c = k.c AND t.pos >= k.h),
l AS (SELECT k.c, k.lead + greatest(k.len - k.h, 0) AS len FROM k),
s AS (SELECT l.c, l.len, coalesce(list(r.x ORDER BY r.pos) FILTER (r.x IS NOT NULL), []) AS xs FROM l LEFT JOIN r ON r.c = l.c GROUP BY l.c, l.len),
p AS (SELECT c, len, d, sha256(to_json(list_slice(xs, 1, d))::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(to_json(list_slice(xs, 1, d - 1))::VARCHAR) END AS parent,
  CASE WHEN d > 0 THEN length(xs[d].t) ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, len + 1)) AS d FROM s)),
n AS (SELECT node, min(c) AS conv_id, any_value(d) AS depth, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '')) AS ends FROM p GROUP BY node),
f AS (SELECT n.node, n.own, NOT EXISTS (SELECT 1 FROM n m WHERE m.parent = n.node) AS leaf, n.conv_id FROM n),
u AS (SELECT a.node, sum(f.own) AS saved, count(*) FILTER (f.leaf) AS leaves FROM f JOIN n ON n.node = f.node
  JOIN p a ON a.c = f.conv_id AND a.d <= n.depth GROUP BY a.node),
ch AS (SELECT parent, count(*) AS n FROM n GROUP BY parent)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(ch.n, 0)::BIGINT AS n_children,
  u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN u ON u.node = n.node LEFT JOIN n q ON q.node = n.parent LEFT JOIN ch ON ch.parent = n.node
"""
