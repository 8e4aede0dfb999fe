"""Operator 13: documents into shards of equal size, linked documents together, by balanced label propagation.

Documents are linked when they share a key (here: equal texts). The links of a key are never formed as pairs: what a document
hears from its neighbours is how many of the key's documents each shard holds, one row for each key and shard.

1. Documents of one key are dealt into cells by a hash; a cell moves as one. A key with more documents than a shard takes is cut
   into pieces of less than a shard, so a key with a third of all rows fills several shards and is many cells, not one.
2. Cells start at the shard of their hash. In a round each piece votes: its shard with most members that can take all of it (else a
   shard with room that a hash names) draws its other cells.
3. Quotas: what may enter a shard is its room and what leaves it, by a relaxation over the shards' totals (the only numbers the
   driver sees). Large pieces go first; whole ranges of hashes are let in while the running sum stays within the quota.
4. Rounds end when nothing moves. Documents without links, and those beyond a shard's even share, fill what is left: running
   positions over buckets give every row its shard and slot, so counts differ by one at most.

Nulls and odd rows: a null text is an empty text, empty texts are linked with each other. Every row is dealt, rows without an id
and repeated rows too; which of several equal rows gets which slot goes by their place in the input. With fewer rows than shards the last shards stay empty.
An empty table gives no rows. A text is told by 128 bits of its digest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.session import cut_lineage

#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Rounds after which the rest is filled as it is.
ROUNDS = 12
#: A cell holds at most about this many documents.
CELL_ROWS = 100_000
#: Ranges of hashes that enter a shard together.
BUCKETS = 256
#: While labels move, shards may hold so much of their even share; without slack, full shards could not exchange documents.
SLACK = 1.05


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: Column | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, the key ``link`` that linked documents share (default: the text's digest), ``place``."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        (F.unhex(F.md5(text)) if link is None else link).alias("link"),
        F.monotonically_increasing_id().alias("place"),
    )


def quotas(load: np.ndarray, want: np.ndarray, room: float) -> np.ndarray:
    """What may enter each shard, given that ``want[i, j]`` would leave i for j and shares of it are refused elsewhere."""
    entering, share = want.sum(0), np.ones(len(load))
    for _ in range(100):
        free = np.maximum(room - load + want @ share, 0)
        share = np.minimum(share, np.where(entering > 0, free / np.maximum(entering, 1), 1))
    return np.floor(entering * share + 1e-9).astype(np.int64)


def _cells(rows: DataFrame, shards: int, room: int) -> DataFrame:
    """Linked documents by key and salt, with the piece of the key that they belong to, its size, and the first shard."""
    cells = rows.groupBy("link", "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("group", F.sum("n").over(Window.partitionBy("link"))).filter("group > 1")
    pieces = F.ceil(F.col("group") / F.lit(0.9 * room)).cast("int")
    cells = cells.withColumn("unit", F.xxhash64("link", F.pmod("salt", pieces)))
    cells = cells.withColumn("unit_n", F.sum("n").over(Window.partitionBy("link", "unit")))
    return cells.select("link", "salt", "n", "unit", "unit_n", F.pmod(F.xxhash64("link", "salt"), F.lit(shards)).cast("int").alias("shard"))


def _together(room: int) -> list[Column]:
    """What stays together where pieces are dealt by hash: the piece, or a cell of a large one."""
    return [F.col("unit"), F.when(F.col("unit_n") > room // 8, F.col("salt")).otherwise(-1)]


def _proposals(cells: DataFrame, load: np.ndarray, shards: int, room: int, step: int) -> DataFrame:
    """Every cell with the shard ``target`` that its piece votes for."""
    votes = cells.groupBy("unit", "unit_n", "shard").agg(F.sum("n").alias("v"))
    loads = F.lit(load.tolist())
    roomy = [s for s in range(shards) if load[s] < room] or list(range(shards))
    spare = F.lit(roomy)[F.pmod(F.xxhash64("unit", F.lit(step)), F.lit(len(roomy))).cast("int")]
    # what the piece has in the spare shard, if anything, is in that shard's own row of votes
    heard = votes.select("unit", "unit_n", F.inline(F.array(F.struct("shard", "v"), F.struct(spare.alias("shard"), F.lit(0).cast("long").alias("v")))))
    heard = heard.groupBy("unit", "unit_n", "shard").agg(F.max("v").alias("v"))
    whole = F.col("v") == F.col("unit_n")
    fits = whole | (loads[F.col("shard")] - F.col("v") + F.col("unit_n") <= room)
    rank = F.struct(fits, F.col("v"), F.xxhash64("unit", "shard"), F.col("shard"))
    target = heard.groupBy("unit").agg(F.max(rank).alias("best")).select(F.col("unit").alias("of"), F.col("best.shard").alias("target"))
    found = cells.join(target, F.col("unit") == F.col("of")).drop("of")
    bucket = F.pmod(F.xxhash64(*_together(room)), F.lit(BUCKETS))
    return found.withColumn("bucket", bucket.cast("int")).withColumn("kind", F.floor(F.log2("unit_n")).cast("int"))


def propagated(cells: DataFrame, shards: int, room: int, rounds: int = ROUNDS) -> DataFrame:
    """The cells with the shards that label propagation leaves them in."""
    cells = cut_lineage(cells)
    room = int(room * SLACK)
    for step in range(rounds):
        load = np.zeros(shards)
        for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row a shard
            load[r["shard"]] = r["n"]
        proposed = cut_lineage(_proposals(cells, load, shards, room, step))
        moving = proposed.filter("shard <> target")
        want = np.zeros((shards, shards))
        for r in moving.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect():  # at most shards * shards rows
            want[r["shard"], r["target"]] = r["n"]
        allowed = quotas(load, want, room)
        if not allowed.any():
            break
        ranges = moving.groupBy("target", "kind", "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("target").orderBy(F.desc("kind"), "bucket"))
        let_in = ranges.withColumn("upto", upto).filter(F.col("upto") <= F.lit(allowed.tolist())[F.col("target")])
        let_in = let_in.select(F.col("target").alias("_t"), F.col("kind").alias("_k"), F.col("bucket").alias("_b"), F.lit(True).alias("let"))
        found = proposed.join(let_in, (F.col("target") == F.col("_t")) & (F.col("kind") == F.col("_k")) & (F.col("bucket") == F.col("_b")), "left")
        shard = F.when(F.col("let"), F.col("target")).otherwise(F.col("shard"))
        cells = cut_lineage(found.select("link", "salt", "n", "unit", "unit_n", shard.alias("shard")))
    return cells


def _filled(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Exact shards and slots; ``label`` is the propagated shard, -1 without one, ``whole`` what should stay together."""
    buckets = max(1, min(-(-total // 200), 20_000), -(-total // 1_000_000))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("whole"), F.lit(buckets)))
    sizes = cut_lineage(rows.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n")))
    load = {r["label"]: r["n"] for r in sizes.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    before = (F.sum("n").over(Window.partitionBy("label").orderBy("bucket")) - F.col("n")).alias("before")
    bases = sizes.select(F.col("label").alias("_l"), F.col("bucket").alias("_b"), before)
    place = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("whole", "doc_id", "link", "place")).cast("long") - 1
    rows = rows.withColumn("at", place).join(bases, (F.col("label") == F.col("_l")) & (F.col("bucket") == F.col("_b")))
    rows = rows.withColumn("at", F.col("at") + F.col("before"))

    most = [total // shards + (s < total % shards) for s in range(shards)]
    own = [min(load.get(s, 0), most[s]) for s in range(shards)]
    # rows that no shard keeps, in a row: those without a label, then what each shard has too many of
    surplus = np.concatenate([[load.get(-1, 0)], load.get(-1, 0) + np.cumsum([load.get(s, 0) - own[s] for s in range(shards)])]).tolist()
    ends = np.cumsum([m - o for m, o in zip(most, own, strict=True)]).tolist()
    begins = [0, *ends[:-1]]
    label = F.greatest("label", F.lit(0))
    kept = (F.col("label") >= 0) & (F.col("at") < F.lit(own)[label])
    over = F.when(F.col("label") < 0, F.col("at")).otherwise(F.col("at") - F.lit(own)[label] + F.lit([int(x) for x in surplus])[label])
    rows = rows.withColumn("over", F.when(~kept, over))
    # the first shard whose gap ends after the position
    gap = F.size(F.filter(F.lit([int(x) for x in ends]), lambda end: end <= F.col("over")))
    rows = rows.withColumn("shard", F.when(kept, F.col("label")).otherwise(gap).cast("int"))
    slot = F.when(kept, F.col("at")).otherwise(F.col("over") - F.lit([int(x) for x in begins])[F.col("shard")] + F.lit(own)[F.col("shard")])
    return rows.withColumn("slot", slot.cast("long"))


def sharded(rows: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (those of ``described``) with ``law``, ``shard`` and ``slot``: counts of shards differ by one at most."""
    rows = cut_lineage(rows)
    total = rows.count()
    salts = max(16 * shards, -(-total // CELL_ROWS))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(salts)))
    room = total // shards
    if room:
        cells = propagated(_cells(rows, shards, room), shards, room, rounds)
        whole = F.xxhash64(*_together(room)).alias("whole")
        cells = cells.select(F.col("link").alias("_link"), F.col("salt").alias("_salt"), F.col("shard").alias("label"), whole)
        rows = rows.join(cells, (F.col("link") == F.col("_link")) & (F.col("salt") == F.col("_salt")), "left")
    else:
        rows = rows.withColumns({"label": F.lit(None).cast("int"), "whole": F.lit(None).cast("long")})
    rows = rows.withColumns({"label": F.coalesce("label", F.lit(-1)), "whole": F.coalesce("whole", F.xxhash64("link", "salt"))})
    return _filled(rows, total, shards).withColumn("law", F.lit("rows"))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's size, crc32, law, shard and slot; ``grown_shard`` is null, since the law fixes counts and not places."""
    found = sharded(described(docs, id_col, text_col), shards)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
