"""K-d tree sharding by distributed weighted medians.

Documents are points in the space of their metadata, weighted by bytes. Every node of the tree is
split along the dimension in which it is widest, all nodes of a level in the same jobs, until no leaf is over the target
bytes. A node is cut at its weighted median, or where one side gets k of its n leaves at the k-th n-th of its bytes, so that any number of
leaves has equal shares. The cuts come from histograms that are refined inside
the bin that holds the place; rows equal in that dimension are told apart by a hash, so that
a value shared by many rows is split as well. Only numbers are shuffled, never texts, and all of
it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, tidied

#: Bins of a histogram, as a power of two.
_BINS_LOG2 = 12
_MASK = (1 << 40) - 1


def _text_code(c: Column) -> Column:
    """A number that orders strings by their first five bytes."""
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(F.encode(c.cast("string"), "UTF-8")), 1, 10), 10, "0"), 16, 10).cast("long"), F.lit(-1))


def _number(c: Column) -> Column:
    """A whole number within 40 bits either side of zero; null is the least."""
    return F.greatest(F.lit(-_MASK), F.least(F.lit(_MASK), F.coalesce(c.cast("long"), F.lit(-_MASK))))


@tidied
def kd_tree_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, numeric: tuple[str, ...] = ("doc_id", "n_chars"), textual: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null).

    Leaves are split until they have ``target_bytes``, or total bytes / ``shards`` where that is not given, to
    within about half a document per level. ``size`` is the text's UTF-8 bytes plus one (null text:
    no bytes), ``slot`` counts a shard's rows from 0 without gaps. Null metadata come first in
    their dimension. Rows that repeat entirely are told apart by their order in the input table,
    as each has a slot of its own. An empty table gives no rows.
    """
    data = F.encode(text_or_empty(text_col), "UTF-8")
    dims = [f"d{k}" for k in range(len(numeric) + len(textual))]
    coordinates = [_number(F.col(c)) for c in numeric] + [_text_code(F.col(c)) for c in textual]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), *[c.alias(d) for c, d in zip(coordinates, dims)])
    # a number for every row of the written table: repeated rows have different ones
    rows = materialize(rows, "shard-rows").withColumn("tie", F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(1 << 20)))
    rows = materialize(rows.withColumn("node", F.lit(0).cast("long")), "shard-points")

    spans = rows.agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)]).first()
    whole = {d: max(1, (spans[f"{d}_max"] or 0) - (spans[f"{d}_min"] or 0)) for d in dims}
    leaves = max(1, -(-(spans["bytes"] or 0) // target_bytes)) if target_bytes else shards
    splits: list[list[tuple]] = []
    # the leaves that each node of a level is still to be split into
    level = {0: leaves}
    while any(n > 1 for n in level.values()):
        splits.append(_cuts(_assign(rows, splits), dims, whole, {node: n for node, n in level.items() if n > 1}))
        level = {2 * node + side: part for node, n in level.items() for side, part in ((0, n - n // 2), (1, n // 2)) if part}
    numbers = docs.sparkSession.createDataFrame([(node, k) for k, node in enumerate(sorted(level))], "node long, shard int")
    placed = _assign(rows, splits).join(F.broadcast(numbers), "node").select("doc_id", "size", "text_crc32", "shard")
    return _with_slots(placed, leaves).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _key(dim: Column, low: Column) -> Column:
    """A row's place in a dimension: the coordinate over the node's least, then the tie's hash."""
    return F.shiftleft(dim - low, 20) + F.col("tie")


def _by_node(rows: DataFrame, dims: list[str], state: list[tuple], columns: str) -> DataFrame:
    """Rows with ``dim`` (the coordinate that their node is cut in) and what else is known of the node; a row a node, fewer than leaves, goes to every task."""
    known = rows.sparkSession.createDataFrame(state, f"node long, number int, {columns}")
    return rows.join(F.broadcast(known), "node", "left").withColumn("dim", F.get(F.array(*dims), F.col("number")))


def _assign(rows: DataFrame, splits: list[list[tuple]]) -> DataFrame:
    """The node of each row after the levels split so far."""
    names = rows.columns
    for level in splits:
        at = _by_node(rows, [c for c in names if c[0] == "d" and c[1:].isdigit()], level, "low long, cut long")
        step = F.coalesce((_key(F.col("dim"), F.col("low")) > F.col("cut")).cast("int"), F.lit(0))
        rows = at.withColumn("node", F.col("node") * 2 + step).select(*names)
    return rows


def _cuts(rows: DataFrame, dims: list[str], whole: dict[str, int], leaves: dict[int, int]) -> list[tuple]:
    """(node, number of its widest dimension, its least value there, the key at which the lower side's share of the bytes is passed)."""
    spans = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)]).collect()
    state = {}
    for s in spans:
        if s["node"] not in leaves:
            continue
        dim = max(dims, key=lambda d: (s[f"{d}_max"] - s[f"{d}_min"]) / whole[d])
        low, high, n = s[f"{dim}_min"], s[f"{dim}_max"], leaves[s["node"]]
        # keys from lo to hi hold the cut; before: bytes of the keys below lo
        state[s["node"]] = {"dim": dims.index(dim), "low": low, "lo": 0, "hi": ((high - low) << 20) + (1 << 20) - 1, "before": 0, "goal": s["bytes"] * (n - n // 2) / n}
    while any(s["hi"] > s["lo"] for s in state.values()):
        # ceil of the range over the bins, as a power of two
        for s in state.values():
            s["shift"] = max(0, (s["hi"] - s["lo"]).bit_length() - _BINS_LOG2)
        open_ = [(node, s["dim"], s["low"], s["lo"], s["hi"], s["shift"]) for node, s in state.items() if s["hi"] > s["lo"]]
        at = _by_node(rows, dims, open_, "low long, lo long, hi long, shift int").withColumn("key", _key(F.col("dim"), F.col("low"))).filter("key BETWEEN lo AND hi")
        counted = at.groupBy("node", F.expr("shiftright(key - lo, shift)").alias("bin")).agg(F.sum("size").alias("bytes"))
        by_node: dict[int, list[tuple[int, int]]] = {}
        for r in counted.collect():  # at most 2**12 bins a node
            by_node.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        for node, bins in by_node.items():
            s = state[node]
            before = s["before"]
            for b, n in sorted(bins):
                chosen, s["at"] = b, n
                if before + n >= s["goal"]:
                    break
                before += n
            s["before"] = before
            s["lo"], s["hi"] = s["lo"] + (chosen << s["shift"]), min(s["hi"], s["lo"] + ((chosen + 1) << s["shift"]) - 1)
    # the row at the cut goes to the side that it leaves nearer to its share
    late = {node for node, s in state.items() if s["before"] + s.get("at", 0) - s["goal"] > s["goal"] - s["before"]}
    return [(node, s["dim"], s["low"], s["lo"] - (node in late)) for node, s in state.items()]


def _with_slots(placed: DataFrame, shards: int, rows_per_part: int = 50_000) -> DataFrame:
    """Number each shard's rows from 0 without gaps, in no task more than a part of a shard.

    A shard is dealt into parts by hash; a part's first slot is the sum of the parts before it,
    and its rows are numbered inside it.
    """
    placed = materialize(placed, "placed")
    parts = max(1, -(-placed.count() // (shards * rows_per_part)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(parts)))
    placed = materialize(placed, "parts") if parts > 1 else placed
    order = Window.partitionBy("shard").orderBy("part")
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", (F.sum("n").over(order) - F.col("n")).alias("first"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1)
    return numbered.join(starts, ["shard", "part"]).withColumn("slot", (F.col("first") + F.col("k")).cast("long"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write whole documents into one folder a shard, by a join on doc_id and the text's crc32.

    Rows that repeat an id with the same text must be made distinct first.
    """
    crc = F.crc32(F.encode(text_or_empty("text"), "UTF-8"))
    keyed = docs.withColumn("_crc", crc)
    same = keyed["doc_id"].eqNullSafe(placed["doc_id"]) & (keyed["_crc"] == placed["text_crc32"])
    keyed.join(placed.select("doc_id", "text_crc32", "shard"), same).drop(placed["doc_id"]).drop("_crc", "text_crc32").write.partitionBy("shard").parquet(path)
