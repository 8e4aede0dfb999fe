from itertools import permutations

import pytest
from pyspark.sql import functions as F

from assayer.llm import filter_audit, registered
from assayer.plans.check import compare, duckdb_tables

SPACES = " \t\n\x0b\x0c\r"
LABELS = "doc_id long, quality int, toxic int"


def split(text):
    out = [""]
    for c in text:
        if c in SPACES:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def expected(docs, labels):
    """Every order walked document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    seen = {}
    for i, text, _ in docs:
        if i is not None:
            seen.setdefault(text or "", set()).add(i)
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = split(text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if i is not None and any(j < i for j in seen[text]):
            fails.add("E")
        rows.append((part or "", i, fails))
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                sums[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[2] for r in here) - len(gone), sum(r[2] == {f} for r in here),
                    sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return out


def result(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[x] for x in names] for r in df.collect()}


@pytest.fixture(scope="module")
def table(spark):
    long = " ".join(f"word{i}" for i in range(120))
    texts = [long, long, long + " #1", "SHOUT " * 30, "SHOUT " * 130, None, "", "  \t\n", "a|b", long.upper(), "few words", "été " * 101, long]
    rows = [(i, t, ["en", "fr", None, ""][i % 4]) for i, t in enumerate(texts)]
    rows += [(0, long, "en"), (0, long, "fr"), (3, "other text", "en"), (None, long, "en"), (None, long, "en"), (None, None, None), (40, long + " ", "x"), (-5, "few words", "en")]
    labels = [(0, 1, 0), (0, 1, 1), (1, 0, 1), (2, None, None), (3, 1, 1), (5, 0, 1), (11, 1, 0), (99, 1, 1), (None, 1, 1)]
    return rows, labels


def test_equals_walking_every_order(spark, table):
    rows, labels = table
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, mask int, part string").repartition(3)
    found = result(filter_audit.audit_documents(docs, spark.createDataFrame(labels, LABELS)))
    want = expected(rows, labels)
    assert {k: (v, want[k]) for k, v in found.items() if v != want[k]} == {} and len(found) == len(want) == 600 * 4


def test_any_number_of_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 0, 0), ("p", 3, 4, 2, 1)], "part string, mask int, n long, good long, toxic long")
    found = result(filter_audit.audit(cells, "XY"))
    assert found == {
        ("p", "XY", 1): [5, 7, 0, 3, 2, 1, 10], ("p", "XY", 2): [5, 0, 4, 0, 0, 0, 4],
        ("p", "YX", 1): [8, 4, 0, 0, 2, 1, 4], ("p", "YX", 2): [5, 3, 4, 3, 0, 0, 10],
    }
    with pytest.raises(ValueError):
        filter_audit.audit(cells, "ABCDEFGH")


def test_path_counts():
    reaching, leaving = filter_audit.paths(5)
    assert reaching[31] == leaving[0] == 120 and reaching[0b00111] == 6 and leaving[0b00111] == 2


def test_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([], LABELS)
    found = result(filter_audit.audit_documents(odd, labels))
    assert found == expected([(r.doc_id, r.text, r.lang) for r in odd.collect()], [])
    assert filter_audit.audit_documents(empty, labels).count() == 0


def test_a_third_of_all_rows_is_one_text(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("en").alias("lang")
    )
    rows = filter_audit.failing(docs)
    cells = {r["mask"]: r["n"] for r in filter_audit.cells(rows, spark.createDataFrame([], LABELS), 16).collect()}
    assert cells == {1: 20_001, 17: 9_999}


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    query, sql = registered.registry()["op11_filter_audit"]
    assert compare(spark, duckdb_tables(folder), folder, query, sql) is None
