"""Two-phase answers: the rule by hand, and the stream against the batch under every order of arrival."""

import itertools
import json

from marketloom.streaming import answers as A

LIMITS = A.Limits(("tiki", "chain", "lazada"), frozenset({"lazada"}), fast=9_000, grace=1_000, expiry=60_000)


def item(listing, score, **more):
    return {"listing": listing, "score": score, "brand": True, "sold": 2, "chain": None, "importer": None} | more


def test_rule():
    got = lambda answers, now: [(r["phase"], r["t"], len(r["items"]), r["pending"], r["failed"]) for r in A.due("c", 0, answers, 0, now, LIMITS)[0]]
    quick = {"tiki": (2_000, False, [item(1, 0.9)]), "chain": (3_000, True, [])}
    assert got(quick, 3_999) == [] and got(quick, 4_000) == [(1, 4_000, 1, ["lazada"], ["chain"])]
    assert got({"tiki": (2_000, False, [])}, 9_000) == [(1, 9_000, 0, ["chain", "lazada"], [])]
    late = quick | {"lazada": (30_000, False, [item(1, 0.5), item(2, 0.6)])}
    assert got(late, 70_000) == [(1, 4_000, 1, ["lazada"], ["chain"]), (2, 30_000, 2, [], ["chain"])]
    assert got(quick | {"lazada": (3_500, False, [])}, 70_000) == [(2, 3_500, 1, [], ["chain"])]
    assert got(quick, 60_000) == [(1, 4_000, 1, ["lazada"], ["chain"]), (2, 60_000, 1, ["lazada"], ["chain"])]
    assert A.due("c", None, quick, 0, 99_999, LIMITS) == ([], 0, None)


def events():
    """A check for each order in which the start and three sources may come, and for each number of sources that answer."""
    out, k = [], 0
    gaps = (500, 4_000, 12_000)
    for order in itertools.permutations(LIMITS.sources):
        for answered in range(4):
            for gap in gaps:
                k += 1
                name, t = f"c{k}", 1_000_000 + 7 * k
                out.append((name, None, t, None, None))
                for n, source in enumerate(order[:answered]):
                    items = [item(10 * n + 1, 0.9, chain=source, importer="Imp"), item(5, 0.4 + 0.1 * n)]
                    out.append((name, source, t + gap * (n + 1), source == "chain" and gap == 4_000, items))
    return sorted(out, key=lambda e: (e[2], e[0]))


def plain(rows):
    return sorted((r["check"], r["phase"], r["t"], [tuple(i) for i in r["items"]], list(r["failed"]), list(r["pending"])) for r in rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = events()
    batch = plain(A.batch_answers(spark.createDataFrame(rows, A.EVENT), LIMITS).collect())
    assert {r[1] for r in batch} == {1, 2} and len({r[0] for r in batch}) == 72
    # arrival in files; the last one carries the watermark beyond every expiry
    rows.append(("end", None, 10_000_000, None, None))
    for size in (1 + len(rows) // 5, len(rows)):
        folder = tmp_path / f"in{size}"
        folder.mkdir()
        names = ("check", "source", "t", "failed", "items")
        for n, at in enumerate(range(0, len(rows), size)):
            (folder / f"{n:03}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows[at : at + size]))
        stream = spark.readStream.schema(A.EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(folder))
        query = A.stream_answers(stream, LIMITS).writeStream.format("memory").queryName(f"answers{size}").trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / f"c{size}")).start().awaitTermination(300)
        got = plain(spark.table(f"answers{size}").collect())
        assert [r for r in got if r[0] != "end"] == batch


def test_classified(spark):
    items = [item(1, 0.9, chain="A", importer="I"), item(2, 0.7, chain="B"), item(3, 0.5), item(4, 0.2)]
    rows = [("x", 1, 5, items, [], []), ("y", 1, 5, items[2:], ["Tiki"], []), ("z", 2, 5, items[3:], ["Tiki"], []), ("w", 2, 5, [], ["other"], [])]
    got = {r["check"]: r for r in A.classified(spark.createDataFrame(rows, A.ANSWER), ("Tiki",)).collect()}
    assert [(got[c]["class"], got[c]["uncertain"], got[c]["listings"], got[c]["strong"]) for c in "xyzw"] == [
        ("nkcn", False, 3, 2), ("partial", False, 1, 0), ("brand", True, 0, 0), ("absent", False, 0, 0),
    ]
    assert got["x"]["chains"] == ["A", "B"] and got["x"]["importers"] == ["I"] and got["x"]["sold"] == 6
