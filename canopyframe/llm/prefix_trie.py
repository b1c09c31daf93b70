"""Operator 11: the trie of common conversation prefixes, by van Emde Boas recursion over depths.

The depths 0 to the longest conversation are cut in half, the halves in half again, down to single
turns. The work of one level of this recursion is done for all conversations and all pieces at once,
so there are logarithmically many steps and none of them gathers a conversation, a node or a level:

* Upwards, turns are hashed to digests of blocks of 2, 4, 8, ... turns.
* Downwards, a cut prefix gets its name: the name of the block's root with the digest of the upper
  half. The name roots the lower forest; in the end every prefix of every conversation has one
  (128-bit hashes, n of them collide with a chance below n * n / 2^129).
* Upwards again, totals are grafted: the tops of lower forests, whose totals are complete within
  their block, add them to their ancestors in the upper trie. Ancestors are read from the smallest
  member's own turns, so no pair of conversations is ever formed.

A level only touches conversations that reach beyond its cut. Digests, names and totals are
aggregated before they are shuffled where many rows share them; a prefix common to a third of all
conversations is one name with counts.

Defined results: turns are ordered by turn, NULL first; equal ones by a hash of role and text, so
that repeated rows stand together. NULL role and text are empty. Rows without a ``conv_id`` belong
to no conversation and are left out. An empty table has no nodes, not even a root. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.digests import joined_sha256
from canopyframe.operators.ordered import ordinal
from canopyframe.session import broadcast_if_small, cut

#: The name of the root: that of no turns at all.
ROOT = "unhex(repeat('00', 16))"
#: A node with so many children hands its conv_id down by broadcast (if all such fit), not by a shuffle on its name.
MANY = 10_000


def _digest(*parts: Column | str) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, sym, chars): numbered turns from 1, each with a digest of role and text and the text's length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint"), "turn", _digest(F.char_length(role).cast("string"), F.lit(":"), role, text).alias("sym"),
        F.char_length(text).cast("bigint").alias("chars"))
    # Equal rows are counted first and numbered apart, so that any number of them spreads over tasks.
    rows = rows.groupBy("conv_id", "turn", "sym", "chars").agg(F.count(F.lit(1)).alias("m"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m")))).drop("m")
    rows = rows.withColumn("has", F.col("turn").isNotNull())
    return ordinal(rows, ["conv_id"], ["has", "turn", "sym", "copy"], "n").select("conv_id", F.col("n").cast("bigint"), "sym", "chars")


def share_heads(own: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the one at the multiple of ``every`` before them.

    From numbered turns to (rebuilt turns (conv_id, i, sym, chars, len) numbered from 0, conversations
    (conv_id, len)). Conversation c takes the first crc32(c) % ``most`` turns of c - c % ``every``, then its
    own after as many.
    """
    own = cut(own)
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    head = F.crc32(F.col("conv_id").cast("string")) % most
    donors = own.filter((F.col("conv_id") % every == 0) & (F.col("n") < most)).withColumnRenamed("conv_id", "donor")
    lengths = donors.groupBy("donor").agg(F.count(F.lit(1)).alias("lent"))
    convs = sizes.select("conv_id", "own", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("donor"))
    convs = convs.join(lengths, "donor", "left").withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0))))
    convs = cut(convs.select("conv_id", "h", "donor", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")))
    # A donor has fewer than ``most`` turns here and at most 2 * ``every`` - 1 takers.
    lent = convs.filter("taken > 0").join(donors, "donor").filter("n <= h").select("conv_id", (F.col("n") - 1).alias("i"), "sym", "chars", "len")
    kept = own.filter(F.col("n") > head).join(convs, "conv_id").select(
        "conv_id", (F.col("taken") + F.col("n") - F.col("h") - 1).alias("i"), "sym", "chars", "len")
    return cut(lent.unionByName(kept)), convs.select("conv_id", "len")


def names(rows: DataFrame, levels: int) -> DataFrame:
    """(conv_id, i, name) of every prefix of i >= 1 turns, by halving blocks of 2 ** ``levels`` turns."""
    digests = [rows.select("conv_id", "i", F.col("sym").alias("digest"), "len")]
    for k in range(1, levels):
        # Only blocks that are full can have something below their cut.
        up = digests[-1].filter((F.shiftright("i", 1) + 1) * (1 << k) <= F.col("len"))
        pair = up.groupBy("conv_id", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("digest"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("digest"))).alias("b"), F.first("len").alias("len"))
        digests.append(cut(pair.select("conv_id", "i", _digest("a", "b").alias("digest"), "len")))
    roots = None
    for k in range(levels - 1, -1, -1):
        upper = digests[k].filter("i % 2 = 0").select("conv_id", "i", "digest")
        first = upper.filter("i = 0").select("conv_id", F.lit(1).cast("bigint").alias("i"), _digest(F.expr(ROOT), "digest").alias("name"))
        if roots is None:
            roots = cut(first)
            continue
        at = roots.select("conv_id", (2 * F.col("i")).alias("i"), "name")
        lower = upper.filter("i > 0").join(at, ["conv_id", "i"]).select("conv_id", (F.col("i") + 1).alias("i"), _digest("name", "digest").alias("name"))
        roots = cut(first.unionByName(at).unionByName(lower))
    return roots


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, i, sym, chars, len); ``convs`` (conv_id, len) lists all members.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); see the
    module's notes. A node is told by its smallest member and its depth.
    """
    longest = convs.agg(F.max("len")).first()[0]
    if longest is None:
        longest = 0
    levels = int(longest).bit_length()
    # places: every conversation stands at one node of each depth from 0 to its length.
    zero = F.lit(0).cast("bigint")
    places = convs.select("conv_id", zero.alias("i"), F.expr(ROOT).alias("name"), zero.alias("chars"), "len")
    if levels:
        last = rows.select("conv_id", (F.col("i") + 1).alias("i"), "chars", "len")
        places = places.unionByName(names(rows, levels).join(last, ["conv_id", "i"]).select("conv_id", "i", "name", "chars", "len"))
    places = cut(places)
    nodes = cut(places.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.first("i").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.sum((F.col("i") == F.col("len")).cast("bigint")).alias("n_ends"), F.max("chars").alias("chars")))
    totals = [nodes.select("name", "depth", (F.col("n_ends") == F.col("n_convs")).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))]
    for k in range(levels):
        # Tops of lower forests of this cut, complete within their block, and their ancestors in the upper trie.
        half = 1 << k
        top = F.col("depth").bitwiseAND(2 * half - 1) == half
        complete = totals[0].filter(top)
        for t in totals[1:]:
            complete = complete.unionByName(t.filter(top))
        complete = complete.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        tops = nodes.filter(top).select("name", "conv_id", "depth").join(complete, "name").drop("name")
        reach = tops.withColumn("i", F.explode(F.sequence(F.col("depth") - half, F.col("depth") - 1))).drop("depth")
        above = places.filter((F.col("i").bitwiseAND(half) == 0) & (F.shiftright("i", k) * half + half <= F.col("len"))).select("conv_id", "i", "name")
        graft = above.join(reach, ["conv_id", "i"]).groupBy("name").agg(F.first("i").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        totals.append(cut(graft))
    # A node's parent is where its smallest member stands one turn before.
    child = nodes.filter("depth > 0").select("name", "conv_id", (F.col("depth") - 1).alias("i"))
    child = cut(child.join(places.select("conv_id", "i", F.col("name").alias("parent")), ["conv_id", "i"]).select("name", "parent"))
    children = cut(child.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")))
    own = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = own.join(children, "parent")
    wide = broadcast_if_small(parents.filter(F.col("n_children") >= MANY).select("parent", F.col("parent_conv_id").alias("wide_id")))
    child = child.join(wide, "parent", "left")
    narrow = parents.filter(F.col("n_children") < MANY).select("parent", "parent_conv_id")
    linked = child.filter("wide_id is not null").select("name", F.col("wide_id").alias("parent_conv_id")).unionByName(
        child.filter("wide_id is null").join(narrow, "parent").select("name", "parent_conv_id"))
    ends = joined_sha256(places.filter("i = len").select("name", "conv_id", F.col("conv_id").cast("string").alias("v")), "name", "conv_id", "v", ",", "ends")
    # One row per node from each table; all meet in one shuffle.
    none = {"leaves": "bigint", "saved": "bigint", "n_children": "bigint", "parent_conv_id": "bigint", "ends": "string"}

    def padded(df: DataFrame, key: str = "name") -> DataFrame:
        return df.select(F.col(key).alias("name"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()))

    parts = [*map(padded, totals), padded(children, "parent"), padded(linked), padded(ends)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.groupBy("name").agg(*((F.sum if c in ("leaves", "saved") else F.max)(c).alias(c) for c in none))
    return nodes.join(every, "name").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """The trie of conversations rebuilt by ``share_heads``."""
    return trie(*share_heads(turns(conversations), every, most))
