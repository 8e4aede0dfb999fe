"""Operator 11: what filters remove from each other, over every order of applying them.

A document's failures are a set of filters; after some filters have been applied, exactly the documents survive whose failures
avoid them all. So all orders of k filters walk through one lattice of 2^k states (sets of applied filters), and what a filter
removes depends on the edge (state, filter) alone: the survivors of the state less those of the next one.

1. Documents are counted by part and set of failures (at most 2^k cells a part). Rows are never compared with orders.
2. The cells give the survivors of every state, and these the removals on every edge.
3. Paths are counted forward (orders that reach a state) and backward (orders that leave it). An edge lies on reaching times
   leaving orders; removals weighted by that and added up are a filter's Shapley sum over all orders.
4. The steps of an order are its path's edges, read from the same table of edges.

Nulls and odd rows: a null text is an empty text, a null part an empty string. Rows that share an id and a text are documents of
their own, none of them a copy of the other; a row without an id is no copy of anything, nor is another row a copy of it. Several
labels of one id: any label 1 counts. Equal texts are told by SHA-256. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Characters between words.
SPACES = " \t\n\x0b\x0c\r"
#: Orders grow with the factorial of the filters; a part's rows and arrays are bounded by this.
MOST_FILTERS = 7


def words_of(text: Column) -> Column:
    """The text's words; an empty array without any."""
    plain = F.btrim(text, F.lit(SPACES))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[\x20\x09-\x0D]+"))


def text_failures(docs: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """The failure conditions that a text decides alone; ``docs`` has its words as ``words``."""
    text = docs[text_col]
    n_words = F.size("words").cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": n_words < 100,
        "B": F.size(F.array_distinct("words")) * F.lit(100).cast("long") < n_words * 80,
        "C": capitals * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def failing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per document ``doc_id``, ``part``, the ``mask`` of failures that its text decides, and its text's digest."""
    base = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )
    base = base.withColumn("words", words_of(F.col("text")))
    mask = F.lit(0)
    for bit, failed in enumerate(text_failures(base).values()):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return base.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def labelled(labels: DataFrame) -> DataFrame:
    """One row per id: whether a label says good, and whether one says toxic."""
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].alias("quality"), labels["toxic"].alias("toxic"))
    any_of = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return known.filter("id IS NOT NULL").groupBy("id").agg(any_of("quality").alias("good"), any_of("toxic").alias("bad"))


def cells(rows: DataFrame, labels: DataFrame, copy_bit: int) -> DataFrame:
    """Documents by ``part`` and ``mask`` of failures: ``n``, and how many are labelled good and toxic.

    ``rows`` are those of ``failing``; a document whose digest also stands at a smaller id gets ``copy_bit`` too. Only ids,
    masks and digests are shuffled. A group of copies is added up in the tasks before it moves, and no document is compared
    with another: of each group only the smallest id matters.
    """
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # rows without an id match no label; a salt keeps them from meeting in one task
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1024))).otherwise(0))
    marks = labelled(labels).withColumn("zero", F.lit(0).cast("long"))
    rows = rows.join(marks, (F.col("doc_id") == F.col("id")) & (F.col("salt") == F.col("zero")), "left")
    rows = rows.select("doc_id", "digest", "part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    named = F.col("doc_id").isNotNull()
    rows = rows.groupBy("digest", "part", "mask", "good", "bad").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("named"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("at_first"),
    )
    # at most a few rows a digest and part are left
    rows = rows.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    copies = F.col("named") - F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)
    rows = rows.select("part", "mask", "good", "bad", F.col("n"), copies.alias("copies"))
    rows = rows.groupBy("part", "mask", "good", "bad").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    split = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct((F.col("mask") + copy_bit).alias("mask"), F.col("copies").alias("n")),
    )
    rows = rows.select("part", "good", "bad", F.inline(split)).filter("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic"))


def paths(k: int) -> tuple[list[int], list[int]]:
    """For each state the orders' beginnings that reach it, and the endings that leave it."""
    states = 1 << k
    reaching, leaving = [0] * states, [0] * states
    reaching[0] = leaving[-1] = 1
    for s in range(1, states):
        reaching[s] = sum(reaching[s ^ 1 << f] for f in range(k) if s >> f & 1)
    for s in range(states - 2, -1, -1):
        leaving[s] = sum(leaving[s | 1 << f] for f in range(k) if not s >> f & 1)
    return reaching, leaving


def edges(counted: DataFrame, letters: str) -> DataFrame:
    """Per part and edge of the lattice: survivors after it, what it removes, and the removal times the orders through it."""
    k = len(letters)
    states = 1 << k
    reaching, leaving = paths(k)
    # a part's cells and states are arrays of at most 2^k entries
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def survivors(what: str) -> Column:
        of = lambda s: F.aggregate("cells", F.lit(0).cast("long"), lambda total, c: total + F.when(c["mask"].bitwiseAND(s) == 0, c[what]).otherwise(0))
        return F.transform(F.sequence(F.lit(0), F.lit(states - 1)), of)

    parts = parts.select("part", *(survivors(x).alias(x) for x in ("n", "good", "toxic")))
    steps = [(s, f) for s in range(states) for f in range(k) if not s >> f & 1]
    table = F.array(*(
        F.struct(
            F.lit(i).alias("edge"), F.lit(f).alias("filter"), F.lit(s).alias("state"), F.lit(s | 1 << f).alias("next"),
            F.lit(1 << f).alias("alone"), F.lit(states - 1 ^ 1 << f).alias("others"), F.lit(reaching[s] * leaving[s | 1 << f]).cast("long").alias("through"),
        )
        for i, (s, f) in enumerate(steps)
    ))
    at = lambda what, state: F.col(what)[F.col(state)]
    removed = at("n", "state") - at("n", "next")
    failed = F.col("n")[0] - at("n", "alone")
    return parts.select("*", F.inline(table)).select(
        "part", "edge", "filter",
        at("n", "next").alias("kept"),
        removed.alias("removed"),
        (failed - removed).alias("redundant"),
        (at("n", "others") - F.col("n")[states - 1]).alias("unique_fails"),
        (at("good", "state") - at("good", "next")).alias("good_lost"),
        (at("toxic", "state") - at("toxic", "next")).alias("toxic_lost"),
        (removed * F.col("through")).alias("weighted"),
    )


def audit(counted: DataFrame, letters: str) -> DataFrame:
    """Every step of every order of the filters, for each part; ``counted`` are cells whose masks have one bit a letter."""
    k = len(letters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"{k} filters: 1 to {MOST_FILTERS} can be audited")
    index = {}
    for s in range(1 << k):
        for f in range(k):
            if not s >> f & 1:
                index[s, f] = len(index)
    steps = []
    for order in permutations(range(k)):
        state = 0
        for step, f in enumerate(order, 1):
            steps.append((index[state, f], "".join(letters[x] for x in order), step))
            state |= 1 << f
    # k! * k rows, a bound that the data do not change
    orders = F.broadcast(counted.sparkSession.createDataFrame(steps, "on_edge int, filter_order string, step int"))
    found = edges(counted, letters)
    found = found.withColumn("shapley", F.sum("weighted").over(Window.partitionBy("part", "filter")))
    found = found.join(orders, F.col("edge") == F.col("on_edge"))
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the five filters: short texts, repeated words, capitals, symbols, copies of earlier texts."""
    rows = failing(docs, id_col, text_col, part_col)
    return audit(cells(rows, labels, copy_bit=16), "ABCDE")
