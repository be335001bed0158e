"""Answers in two phases: a fast one with what has arrived, and a complete one when the last source is in.

A check starts with a row without a source; each source answers once, with its listings or a failure.  The fast answer
is given a grace after the last normally fast source has answered, or at a limit; sources still out are pending in it.
The complete answer follows when all have answered, or at the expiry, which ends the check's state.  All times are
times of arrival, so no answer is late and the result depends on them alone: batch and stream give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.listings import BEST, LEAST, STRONG
from ..operators.matching import import_class

ITEM = "struct<listing:long,score:double,brand:boolean,sold:long,chain:string,importer:string>"
#: What a check's rows are; ``source`` is null in the row that starts it.
EVENT = f"check string, source string, t long, failed boolean, items array<{ITEM}>"
ANSWER = f"check string, phase int, t long, items array<{ITEM}>, failed array<string>, pending array<string>"
_STATE = f"start long, sources array<string>, times array<long>, failed array<boolean>, items array<array<{ITEM}>>, phase int"


@dataclass(frozen=True)
class Limits:
    """Sources that are asked, those of them that may be slow, and times in milliseconds."""

    sources: tuple[str, ...]
    slow: frozenset[str] = frozenset()
    fast: int = 9_000
    grace: int = 1_000
    expiry: int = 240_000

    def fast_at(self, start: int, times: dict[str, int]) -> int:
        """When the fast answer is due, by the answers so far."""
        quick = [s for s in self.sources if s not in self.slow]
        if all(s in times for s in quick):
            settled = max([start, *(times[s] for s in quick)]) + self.grace
            if len(times) == len(self.sources):
                settled = min(settled, max(start, *times.values()))
            return min(start + self.fast, settled)
        return start + self.fast


def _row(check: str, phase: int, at: int, answers: dict[str, tuple], limits: Limits) -> dict:
    """The answer with what had arrived by a time; of equal listings the first source's counts."""
    known = [s for s in limits.sources if s in answers and answers[s][0] <= at]
    items: dict[int, dict] = {}
    for s in known:
        for item in answers[s][2]:
            items.setdefault(item["listing"], item)
    ordered = sorted(items.values(), key=lambda i: (-(i["score"] or 0.0), i["listing"]))
    return {
        "check": check, "phase": phase, "t": at, "items": ordered, "failed": [s for s in known if answers[s][1]],
        "pending": [s for s in limits.sources if s not in known],
    }


def due(check: str, start: int | None, answers: dict[str, tuple], done: int, now: int, limits: Limits) -> tuple[list[dict], int, int | None]:
    """Answers due by now, the phase reached (0 none, 1 fast, 2 complete), and when to look again.

    ``answers`` maps a source to (time, failed, items).  An answer that is complete by the fast time is given once, as complete.
    """
    if start is None:
        return [], done, None
    times = {s: a[0] for s, a in answers.items()}
    end = max(start, *times.values()) if len(times) == len(limits.sources) else start + limits.expiry
    end = min(end, start + limits.expiry)
    fast = limits.fast_at(start, times)
    out = []
    if done == 0 and fast < end and fast <= now:
        out.append(_row(check, 1, fast, answers, limits))
        done = 1
    if done < 2 and end <= now:
        out.append(_row(check, 2, end, answers, limits))
        done = 2
    return out, done, None if done == 2 else fast if done == 0 and fast < end else end


def _collect(rows: pd.DataFrame, limits: Limits, start: int | None, answers: dict[str, tuple]) -> int | None:
    """Adds rows to answers, the first of a source, and returns the time of the start."""
    for source, t, failed, items in sorted(zip(rows["source"], rows["t"], rows["failed"], rows["items"], strict=True), key=lambda r: r[1]):
        if source is None or source != source:
            start = int(t) if start is None else min(start, int(t))
        elif source in limits.sources and source not in answers:
            held = [] if items is None else [i if isinstance(i, dict) else i.asDict() for i in items]
            answers[source] = (int(t), bool(failed), held)
    return start


def batch_answers(events: DataFrame, limits: Limits) -> DataFrame:
    """Both answers of every check of events (see EVENT), as if each had been watched to its end.

    A check's group is a row for each source, bounded by the sources.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        answers: dict[str, tuple] = {}
        start = _collect(rows, limits, None, answers)
        out, _, _ = due(key[0], start, answers, 0, 1 << 62, limits)
        return pd.DataFrame(out, columns=["check", "phase", "t", "items", "failed", "pending"])

    return events.groupBy("check").applyInPandas(run, ANSWER)


def stream_answers(events: DataFrame, limits: Limits) -> DataFrame:
    """The same of a stream of events: each answer is given when the watermark of arrival times has passed it.

    State is one row a check with its sources' answers, and is gone after the complete one; a source that answers
    after that finds no state and changes nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, answers, done = None, {}, 0
        if state.exists:
            start, sources, times, failed, items, done = state.get
            answers = {
                s: (t, f, [i if isinstance(i, dict) else i.asDict() for i in held]) for s, t, f, held in zip(sources, times, failed, items, strict=True)
            }
        for rows in batches if not state.hasTimedOut else ():
            start = _collect(rows, limits, start, answers)
        now = state.getCurrentWatermarkMs()
        out, done, again = due(key[0], start, answers, done, now, limits)
        if done == 2:
            if state.exists:
                state.remove()
        else:
            columns = list(zip(*answers.values(), strict=True)) or [(), (), ()]
            state.update((start, list(answers), *(list(c) for c in columns), done))
            # a check whose start has not been seen waits for it, at most the expiry
            state.setTimeoutTimestamp(max(now + 1, again if again is not None else now + limits.expiry))
        yield pd.DataFrame(out, columns=["check", "phase", "t", "items", "failed", "pending"])

    timed = events.withColumn("at", F.timestamp_millis("t")).withWatermark("at", "0 milliseconds")
    return timed.groupBy("check").applyInPandasWithState(step, ANSWER, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def classified(answers: DataFrame, key_sources: Sequence[str] = ()) -> DataFrame:
    """Answers with counts, chains, importers, class and whether it is uncertain, for a failed key source makes absence so."""
    best = F.slice(F.filter("items", lambda i: i["score"] >= LEAST), 1, BEST)
    df = answers.withColumn("matches", best).withColumn("strong_matches", F.filter("matches", lambda i: i["score"] >= STRONG))

    def names(rows: str, field: str) -> Column:
        return F.array_sort(F.array_distinct(F.array_compact(F.transform(rows, lambda i: i[field]))))

    df = df.withColumns({
        "listings": F.size("matches"), "strong": F.size("strong_matches"), "chains": names("strong_matches", "chain"), "importers": names("matches", "importer"),
        "sold": F.aggregate("matches", F.lit(0).cast("long"), lambda a, i: a + F.coalesce(i["sold"], F.lit(0))),
        "brand_listings": F.size(F.filter("items", lambda i: i["brand"])),
    })
    cls = import_class(F.col("strong"), F.col("listings"), F.size("chains"), F.size("importers") > 0, F.col("brand_listings"))
    df = df.withColumn("class", cls)
    silent = F.arrays_overlap("failed", F.array(*map(F.lit, key_sources))) if key_sources else F.lit(False)
    return df.withColumn("uncertain", F.col("class").isin("absent", "brand") & silent).drop("matches", "strong_matches")
