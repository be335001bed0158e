"""Joins of the same product across sources, on rows worked out by hand."""

import random

from marketloom.operators import matching as M
from marketloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_code_donors(spark):
    rows = [
        (1, "00451", False, False), (2, "451", True, False), (3, "0451", None, True), (4, "451", True, True),
        (5, "77", True, False), (6, "077", False, False), (7, "77", False, True),
        (8, None, True, True), (9, None, False, False), (10, "", False, False), (11, "88", True, False),
    ]
    items = spark.createDataFrame(rows, "id long, code string, ingredients boolean, storage boolean")
    got = sorted(tuple(r) for r in M.code_donors(items, "code", ["ingredients", "storage"]).collect())
    # 4 is the last donor of 451; 7 of 77 has no ingredients to give; an own row gives nothing
    assert got == [
        (1, "ingredients", 4, 2), (1, "storage", 4, 2), (2, "storage", 4, 2), (3, "ingredients", 4, 2),
        (5, "storage", 7, 2), (6, "storage", 7, 2),
    ]


def test_barcode_donors_on_the_smallest_table(spark):
    rows = QUERIES["barcode_donor_sections"](spark, FOLDER).collect()
    assert rows and {r["section"] for r in rows} == {"ingredients", "storage"}
    assert all(r["p_partkey"] != r["donor"] for r in rows)
    # neither side is a range of ids
    assert min(r["donor"] for r in rows) < max(r["p_partkey"] for r in rows)


def brute_similar(rows, least):
    sets = [(i, b, set(t)) for i, b, t in rows]
    for i, b, t in sets:
        for j, c, u in sets:
            if i != j and b == c and t and u and len(t & u) / len(t | u) >= least:
                yield i, j, len(t & u) / len(t | u)


def test_token_joins_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choices("pqrstuvw", k=rng.randrange(5))) for i in range(120)]
    items = spark.createDataFrame(rows, "id long, brand string, tokens array<string>")
    offers = [(i, s, s % 3 if s else None) for i in range(120) for s in rng.sample(range(40), rng.randrange(3))]
    shops = spark.createDataFrame(offers, "id long, shop long, land long")
    want = set(brute_similar(rows, 0.5))
    assert {tuple(r) for r in M.token_pairs(items, items, "tokens", 0.5, on=["brand"]).where("l_id <> r_id").collect()} == want
    best = {}
    for i, j, s in sorted(want, key=lambda x: (x[0], -x[2], x[1])):
        best.setdefault(i, (j, s))
    assert {r["id"]: (r["donor"], r["similarity"]) for r in M.nearest_by_tokens(items, "tokens", 0.5, on=["brand"]).collect()} == best
    seen = {}
    for i, j, _ in want:
        for k, s, land in offers:
            if k == j:
                seen.setdefault(i, (set(), set()))
                seen[i][0].add(s)
                seen[i][1].update({land} - {None})
    got = M.reached(items, shops, "tokens", 0.5, on=["brand"], counted=["shop", "land"]).collect()
    assert {r["id"]: (r["shop"], r["land"]) for r in got} == {i: (len(a), len(b)) for i, (a, b) in seen.items()}
    assert M.token_pairs(items.limit(0), items, "tokens", 0.5, on=["brand"]).count() == 0
