"""Tables of positioned texts: columns by plain interval union, headers, spans, carried headers, odd rows."""

import random

from quarryline.operators.found_tables import found_columns, key_columns, key_rows, placed_items, table_grid
from quarryline.sources.analogues import spread

ITEM = "doc int, page int, text string, x double, x_end double, y double, row string"


def items(spark, rows):
    return spark.createDataFrame([(*r, "odd") for r in rows], ITEM)


def test_columns_like_a_plain_union(spark):
    rng = random.Random(9)
    rows = [(d, 1, "t", float(x), float(x + rng.randrange(1, 12)), float(rng.randrange(0, 60, 10))) for d in range(12) for x in rng.sample(range(0, 160), 14)]
    placed = placed_items(items(spark, rows))
    want = set()
    kept = {}
    for r in placed.filter("full").collect():
        kept.setdefault(r.doc, []).append((r.x, r.x_end))
    for doc, spans in kept.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1] + 8:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want |= {(doc, i, a, b) for i, (a, b) in enumerate(merged)}
    assert {(r.doc, r.column, r.left, r.right) for r in found_columns(placed).collect()} == want


def test_rows_by_key_over_pages(spark):
    rows = [
        (1, 1, "Sizes", 100.0, 260.0, 120.0), (1, 1, "No", 10.0, 30.0, 100.0), (1, 1, "Width", 100.0, 130.0, 100.0), (1, 1, "Height", 200.0, 260.0, 100.0),
        (1, 1, "AB-1", 10.0, 40.0, 80.0), (1, 1, "5 mm", 100.0, 120.0, 81.0), (1, 1, "6", 200.0, 205.0, 80.0), (1, 1, "mm", 207.0, 220.0, 80.0), (1, 1, "about", 101.0, 120.0, 70.0), (1, 1, "7 mm", 201.0, 220.0, 70.0),
        (1, 2, "AB-2", 10.0, 40.0, 100.0), (1, 2, "8 mm", 100.0, 120.0, 100.0), (1, 2, "9 mm", 200.0, 220.0, 100.0), (2, 1, "no key", 10.0, 40.0, 100.0), (2, 1, "text", 100.0, 120.0, 100.0),
        (3, 1, None, 1.0, 2.0, 3.0), (3, 1, " ", 1.0, 2.0, 3.0), (3, 1, "x", None, 2.0, 3.0), (3, 1, "x", 1.0, 2.0, None), (4, 1, "CD-1", 10.0, None, 50.0), (4, 1, "v", 100.0, None, 50.0),
    ]
    got = key_rows(table_grid(items(spark, rows))).collect()
    assert sorted((r.doc, r.page, r.key, r.header or "", r["value"]) for r in got) == sorted(
        [(1, 1, "AB-1", "Sizes Width", "5 mm about"), (1, 1, "AB-1", "Sizes Height", "6 mm 7 mm"), (1, 2, "AB-2", "Sizes Width", "8 mm"), (1, 2, "AB-2", "Sizes Height", "9 mm"), (4, 1, "CD-1", "", "v")]
    )
    assert key_rows(table_grid(items(spark, []))).count() == 0


def test_columns_by_key(spark):
    rows = [(1, 1, t, x, x + 20, y) for t, x, y in [("Type", 0.0, 90.0), ("AB-1", 50.0, 90.0), ("AB-2", 100.0, 90.0), ("ab-2", 150.0, 90.0), ("Weight", 0.0, 70.0), ("1 kg", 50.0, 70.0), ("2 kg", 100.0, 70.0), ("3 kg", 150.0, 70.0), ("(net)", 50.0, 60.0)]]
    rows += [(2, 1, t, x, x + 20, y) for t, x, y in [("Type", 0.0, 90.0), ("AB-1", 50.0, 90.0), ("Weight", 0.0, 70.0), ("1 kg", 50.0, 70.0)]]
    assert [(r.doc, r.key, r.label, r["value"]) for r in key_columns(table_grid(items(spark, rows))).collect()] == [(1, "AB-1", "Weight", "1 kg (net)")]


def test_a_page_is_met_without_joins(spark):
    rows = items(spark, [(1, 1, "AB-1", 10.0, 40.0, 80.0), (1, 1, "5 mm", 100.0, 120.0, 80.0)])
    plan = key_rows(table_grid(rows.repartition(4, "doc")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_parts_follow_the_tables_size(spark):
    rows = spark.range(1_000)
    assert spread(rows, "id", most=30).rdd.getNumPartitions() == 34 and spread(rows, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(rows.limit(0), "id", most=30).count() == 0


def test_headers_of_the_last_page_that_has_them(spark):
    page = lambda p, top: [(1, p, t, x, x + 20, 100.0) for t, x in top] + [(1, p, t, x, x + 20, 50.0) for t, x in [(f"AB-{p}", 10.0), ("1", 100.0), ("2", 200.0)]]
    # page 2 has no header in its third column and doesn't take that of page 1; page 4 has only a header, and no table
    rows = page(1, [("No", 10.0), ("W", 100.0), ("H", 200.0)]) + page(2, [("No", 10.0), ("X", 100.0)]) + page(3, []) + [(1, 4, "Y", 100.0, 120.0, 100.0)] + page(5, [])
    got = sorted((r.page, r.key, r.column, r.header, r["value"]) for r in key_rows(table_grid(items(spark, rows))).collect() if r.column == 2)
    assert got == [(1, "AB-1", 2, "H", "2"), (2, "AB-2", 2, None, "2"), (3, "AB-3", 2, None, "2"), (5, "AB-5", 2, None, "2")]
