"""The prefix trie of conversations, by a van Emde Boas recursion.

A turn is a symbol: the SHA-256 of its role and text, and its number of words. Sequences of symbols
are cut at half depth; the cut prefix gets a name, the sequence falls into an upper part, below the
same root, and a lower part, below that name. Equal parts of a block are merged with their counts,
and all upper and lower blocks are cut again, together, until blocks hold one symbol: these are the
nodes. Then totals are grafted upward: what hangs below a cut prefix is added to the nodes on its
path in the upper block, from the lowest blocks to the whole trie."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import WORD, text_or_empty
from docreview.session import release, stage

#: Bytes of a symbol: a SHA-256 and the number of words.
SYMBOL = 36
ROOT = b""
#: Conversations of one row when ids are joined: those whose ids agree but for so many low bits.
ID_BITS = 12


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, sequence): the symbols of each conversation's turns, packed.

    Turns are ordered by turn, null first, then by digest. A null role or text is empty; rows
    without a conv_id belong to no conversation. Texts are not shuffled; 36 bytes a turn are. The
    symbols of one conversation are one value."""
    role = text_or_empty("role")
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text_or_empty()), 256)
    words = F.lpad(F.hex(F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")), 8, "0")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.concat(digest, words)).alias("symbol")
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "symbol")))
    return turns.groupBy("conv_id").agg(ordered.alias("_turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("_turns", lambda t: F.hex(t["symbol"])), "")).alias("sequence")
    )


def length(sequence: Column) -> Column:
    return F.floor(F.octet_length(sequence) / SYMBOL).cast("int")


def symbols(sequence: Column, start: Column, count: Column) -> Column:
    """`count` symbols from the one numbered `start`, from 0."""
    return F.substr(sequence, start * SYMBOL + 1, count * SYMBOL)


def share_heads(sequences: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """The sequences rebuilt on shared heads: the first h symbols of the sequence whose id is the
    multiple of `group` below (all if there are fewer, none if it is absent), then a sequence's own
    from h on. h is the CRC-32 of the decimal id modulo `most` + 1."""
    heads = sequences.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_base"), symbols(F.col("sequence"), F.lit(0), F.lit(most)).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    own = symbols(F.col("sequence"), F.col("_h"), F.greatest(length(F.col("sequence")) - F.col("_h"), F.lit(0)))
    return (
        sequences.withColumns({"_h": h, "_of": F.col("conv_id") - F.col("conv_id") % group})
        .join(heads, F.col("_of") == F.col("_base"), "left")
        .select(
            "conv_id",
            F.concat(F.coalesce(symbols(F.col("_head"), F.lit(0), F.col("_h")), F.lit(ROOT)), own).alias("sequence"),
        )
    )


def name_of(root: Column, part: Column) -> Column:
    return F.unhex(F.sha2(F.concat(root, part), 256))


def path_names(root: Column, part: Column) -> Column:
    """The names of all prefixes of `part` below `root`, the shortest first.

    The prefix of i symbols is named below the one that lacks its lowest power of two: that is
    where the recursion cuts, so every sequence that passes a node gives it the same name."""

    def add(names: Column, i: Column) -> Column:
        low = i.bitwiseAND(-i)
        below = name_of(F.element_at(names, i - low + 1), symbols(part, i - low, low))
        return F.concat(names, F.array(below))

    names = F.aggregate(F.sequence(F.lit(1), length(part)), F.array(root), add)
    return F.slice(names, F.lit(2), length(part))


def end_name(sequence: Column, height: int) -> Column:
    """The name of a whole sequence of at most `height` symbols, a power of two."""
    n = length(sequence)
    bits = F.array(*[F.lit(1 << k) for k in reversed(range(height.bit_length()))])

    def step(state: Column, bit: Column) -> Column:
        taken = n.bitwiseAND(bit) > 0
        below = name_of(state["name"], symbols(sequence, state["at"], bit))
        return F.struct(
            F.when(taken, below).otherwise(state["name"]).alias("name"),
            F.when(taken, state["at"] + bit).otherwise(state["at"]).alias("at"),
        )

    start = F.struct(F.lit(ROOT).alias("name"), F.lit(0).alias("at"))
    return F.aggregate(bits, start, step)["name"]


def merged(parts: DataFrame) -> DataFrame:
    """Equal parts of a block as one row; combined before the shuffle."""
    return parts.groupBy("root", "start", "part", "stop").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def cut(blocks: DataFrame, half: int) -> DataFrame:
    """Blocks of twice `half` symbols as upper and lower blocks of `half`.

    `root` is the name of what comes before a part, `start` its depth, `stop` the name of the
    part's end where that is known: a part as long as its block ends in a cut."""
    head = symbols(F.col("part"), F.lit(0), F.lit(half))
    upper = F.struct(
        "root", "start", F.col("_head").alias("part"), F.when(F.col("_n") >= half, F.col("_cut")).alias("stop"), "n", "least"
    )
    lower = F.struct(
        F.col("_cut").alias("root"), (F.col("start") + half).alias("start"),
        symbols(F.col("part"), F.lit(half), F.lit(half)).alias("part"), "stop", "n", "least",
    )
    return (
        blocks.withColumns({"_n": length(F.col("part")), "_head": head})
        .withColumn("_cut", name_of(F.col("root"), F.col("_head")))
        .select(F.inline(F.when(F.col("_n") > half, F.array(upper, lower)).otherwise(F.array(upper))))
    )


def joined_digests(ends: DataFrame) -> DataFrame:
    """(name, conv_id) -> name, ends_sha256: the SHA-256 of the decimal ids, ascending, with commas.

    Ids are joined in rows of at most 4096 by a group of their high bits; a name's rows pass through one
    hash in order, in a task that holds only one batch of them."""
    pieces = ends.groupBy("name", F.shiftright("conv_id", ID_BITS).alias("_high")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(done)
        if state is not None:
            yield rows([(name, state.hexdigest())])

    def rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        columns = [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["name", "ends_sha256"])

    ordered = pieces.repartition("name").sortWithinPartitions("name", "_high").select("name", "ids")
    return ordered.mapInArrow(run, "name binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    `sequences` has conv_id, unique and not null, and the packed symbols (null: none). conv_id is
    the smallest member of a node; the root has depth 0, no parent and no words. Totals are over a
    node and all below it. Other columns are not read. An empty table gives no rows, not even a root.

    A recursion of log2(longest sequence) rounds; a sequence enters at the first height that holds
    it. Each round moves at most the symbols of the distinct parts, merged before the shuffle; names
    are hashes of what they name, so no part has to be joined back to its cut. Tables of a round are
    written to the shared folder and removed when the round above has read them."""
    own = stage(sequences.select("conv_id", F.coalesce("sequence", F.lit(ROOT)).alias("sequence")))
    longest = own.agg(F.max(length(F.col("sequence")))).first()[0] or 0
    rounds = max(longest - 1, 0).bit_length()
    level = F.when(length(F.col("sequence")) > 0, F.floor(F.log2(length(F.col("sequence")) * 2 - 1)).cast("int"))
    distinct = stage(
        own.groupBy("sequence").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
        .withColumn("level", level).where("level IS NOT NULL"),
        partition_by=["level"],
    )

    def entering(k: int) -> DataFrame:
        whole = F.when(length(F.col("sequence")) == 1 << k, name_of(F.lit(ROOT), F.col("sequence")))
        return distinct.where(F.col("level") == k).select(
            F.lit(ROOT).alias("root"), F.lit(0).alias("start"), F.col("sequence").alias("part"),
            whole.alias("stop"), "n", "least",
        )

    below: dict[int, DataFrame] = {}
    for k in range(rounds - 1, -1, -1):
        blocks = entering(k + 1)
        if k + 1 in below:
            blocks = blocks.unionByName(below[k + 1])
        below[k] = stage(merged(cut(blocks, 1 << k)))
    units = entering(0).unionByName(below[0]) if below else entering(0)
    words = F.conv(F.hex(F.substr("part", F.lit(33), F.lit(4))), 16, 10).cast("long")
    nodes = merged(units).select(
        F.col("stop").alias("name"), F.col("root").alias("parent"), (F.col("start") + 1).alias("depth"),
        "n", "least", ((F.col("n") - 1) * words).alias("_saved"),
    )
    root = own.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).where("n > 0").select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"),
        "n", "least", F.lit(0).cast("long").alias("_saved"),
    )
    named = stage(nodes.unionByName(root))
    children = named.where("depth > 0").groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("n_children"))
    nodes = stage(
        named.join(children, F.col("name") == F.col("_of"), "left").drop("_of")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("_leaves", (F.col("n_children") == 0).cast("long"))
    )
    grafts = graft(nodes, below)
    totals = nodes.select("name", "_leaves", "_saved")
    for rows in grafts:
        totals = totals.unionByName(rows)
    totals = totals.groupBy("name").agg(F.sum("_leaves").alias("n_leaves"), F.sum("_saved").alias("saved_tokens"))
    ends = joined_digests(own.select(end_name(F.col("sequence"), 1 << rounds).alias("name"), "conv_id"))
    parents = nodes.select(F.col("name").alias("_parent"), F.col("least").alias("parent_conv_id"))
    return (
        nodes.drop("_leaves", "_saved").join(totals, "name").join(ends, "name", "left")
        .join(parents, F.col("parent") == F.col("_parent"), "left")
        .select(
            F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id",
            F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def graft(nodes: DataFrame, below: dict[int, DataFrame]) -> list[DataFrame]:
    """What to add to the nodes' own leaves and savings: (name, _leaves, _saved) tables.

    `totals` has the sums of every block below its root. When blocks of `half` symbols become one
    of twice that, a lower block's sums go to its root's path in the upper block, and to that
    block's sums. Roots and paths are joined one to one; sums are combined before the shuffle."""
    sums = [F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved")]
    totals = stage(
        nodes.where("depth > 0").groupBy(F.col("parent").alias("root"), (F.col("depth") - 1).alias("start")).agg(*sums)
    )
    grafts = []
    for k in range(len(below)):
        half = 1 << k
        lower = totals.where(F.col("start") % (2 * half) == half).select(F.col("root").alias("stop"), "_leaves", "_saved")
        upper = below[k].where((F.col("start") % (2 * half) == 0) & F.col("stop").isNotNull())
        carried = stage(upper.join(lower, "stop").select("root", "start", "part", "_leaves", "_saved"))
        grafts.append(carried.select(F.explode(path_names(F.col("root"), F.col("part"))).alias("name"), "_leaves", "_saved"))
        kept = totals.where(F.col("start") % (2 * half) == 0)
        summed = stage(
            kept.unionByName(carried.select("root", "start", "_leaves", "_saved")).groupBy("root", "start").agg(*sums)
        )
        release(totals, below[k])
        totals = summed
    # the block that is left is the whole trie; its root is on no path
    return [*grafts, totals.select(F.col("root").alias("name"), "_leaves", "_saved")]
