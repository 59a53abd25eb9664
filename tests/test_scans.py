"""Contents regions and trees against plain loops, and at sizes where one row or one array a document would show."""

import random
import time

from pyspark.sql import functions as F

from quire.operators import cleaning, tree


def regions(items):
    """seq -> in_contents, by a loop over one document's items."""
    depth, begun, out = 0, None, {}
    for seq, kind, toc, events in items:
        if kind != "p":
            out[seq] = False
            continue
        before = begun is not None and depth >= begun
        for e in events or ():
            depth = max(0, depth + e)
        out[seq] = before or bool(toc)
        if before:
            begun = None if depth < begun else begun
        elif toc and depth > 0:
            begun = depth
    return out


def test_contents_regions_against_a_loop(spark):
    rnd = random.Random(6)
    docs = {d: [(s, rnd.choice("pppt").replace("t", "tbl"), rnd.choice([None, False, False, True]), rnd.choice([None, [], [1], [-1], [1, -1], [-1, -1, 1], [1, 1]])) for s in range(rnd.randint(1, 60))] for d in range(40)}
    rows = [(d, *x) for d, items in docs.items() for x in items]
    rnd.shuffle(rows)
    found = cleaning.contents_regions(spark.createDataFrame(rows, "doc_id long, seq int, kind string, is_toc boolean, fld_events array<int>"))
    got = {(r.doc_id, r.seq): r.in_contents for r in found.collect()}
    assert got == {(d, s): v for d, items in docs.items() for s, v in regions(items).items()}


def test_a_hundred_thousand_marks_in_one_document(spark):
    n = 100_000
    step = F.when(F.col("id") < n // 2, 1).otherwise(-1)
    items = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("seq"), F.lit("p").alias("kind"), (F.col("id") % 1000 == 500).alias("is_toc"), F.array(step).alias("fld_events"))
    began = time.monotonic()
    found = cleaning.contents_regions(items).agg(F.count_if("in_contents"), F.min(F.when(F.col("in_contents"), F.col("seq"))), F.max(F.when(F.col("in_contents"), F.col("seq")))).first()
    # the region that begins at depth 501 ends at mark n - 501, where the depth is 500; the contents mark after it opens one that the next mark ends
    assert tuple(found) == (n - 1000 + 2, 500, n - 499) and time.monotonic() - began < 60


def plain_paths(levels):
    out, stack = [], []
    for k, level in enumerate(levels):
        del stack[level - 1 :]
        parent = stack[-1][0] if stack else None
        stack.append((k, f"n{k}"))
        out.append((parent, " / ".join(x for _, x in stack)))
    return out


def test_paths_of_trees_of_any_depth(spark):
    rnd = random.Random(8)
    docs = {}
    for d in range(12):
        levels = [1]
        for _ in range(rnd.randint(0, 80)):
            levels.append(rnd.randint(1 if d % 3 else levels[-1], levels[-1] + 1))
        docs[d] = levels
    rows = [(d, k, level, f"n{k}") for d, levels in docs.items() for k, level in enumerate(levels)]
    rnd.shuffle(rows)
    nodes = spark.createDataFrame(rows, "doc_id long, order_num int, level int, title string")
    got = {(r.doc_id, r.order_num): (r.parent_order, r.chapter_path) for r in tree.link_parents(nodes, F.col("title")).collect()}
    assert got == {(d, k): x for d, levels in docs.items() for k, x in enumerate(plain_paths(levels))}
    assert max(map(max, docs.values())) > 30


def test_a_large_document(spark):
    """Many nodes of one document: rows stay narrow and are dealt by node."""
    n = 200_000
    nodes = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("order_num"), (1 + F.least(F.col("id") % 10, F.lit(8))).cast("int").alias("level"), F.lit("x").alias("title"))
    found = tree.link_parents(nodes, F.col("title")).agg(F.count("*"), F.max(F.length("chapter_path")), F.count_if(F.col("parent_order").isNull())).first()
    assert tuple(found) == (n, 9 * 4 - 3, n // 10)
