"""Operator 1: token counts kept as delta-maintained rollups.

Producers hand over batches of signed changes: a row adds a document (``insert``), takes it out
(``delete``) or replaces its count (``revise``), for a source, a language and a tokenizer version.
A batch is summed to one row per key of additive deltas and committed under its id; totals are the
sum of all deltas, so an update costs what its batch holds, never the corpus.

Commits are idempotent: a batch lives in a folder of its own, a commit of an id that has one is a
no-op, and a commit that died half-way leaves no success marker and is written anew.  ``compact``
folds committed batches into one base and writes beside it which they were, so a batch that comes late,
whatever its id, is counted.

Keys may be null (they are a group of their own).  A null count is 0, an op outside the three is an
error in ``signed`` (null sign, row dropped and counted by nobody), repeated rows add up.  Keys whose
totals are all zero disappear.  Partial sums combine map-side, so a hot key costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

KEY = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Deltas by key of changes(op, source, lang, tokenizer, n_before, n_after)."""
    before, after = F.coalesce("n_before", F.lit(0)), F.coalesce("n_after", F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    tokens = (
        F.when(F.col("op") == "insert", after)
        .when(F.col("op") == "delete", -before)
        .when(F.col("op") == "revise", after - before)
    )
    return (
        changes.select(*KEY, docs.cast("long").alias("d"), tokens.cast("long").alias("t"))
        .where("d is not null")
        .groupBy(*KEY)
        .agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))
        .where("n_docs <> 0 or n_tokens <> 0")
    )


class Rollup:
    """A rollup in a folder: batch/<id>, base/<n> and members/<n> (the batches of that base), committed Parquet folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _exists(self, path: str) -> bool:
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf).exists(p)

    def _list(self, kind: str) -> list[str]:
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = p.getFileSystem(self._conf)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if self._exists(f"{self.path}/{kind}/{n}/_SUCCESS"))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the ids of the batches that it holds (names of folders, not data)."""
        name = (self._list("base") or [None])[-1]
        if name is None:
            return None, set()
        members = self.spark.read.schema("id string").parquet(f"{self.path}/members/{name}")
        return name, {r[0] for r in members.collect()}

    def committed(self) -> list[str]:
        return self._list("batch")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing done, if that id is already in."""
        target = f"{self.path}/batch/{batch_id}"
        if self._exists(f"{target}/_SUCCESS"):
            return False
        signed(changes).write.mode("overwrite").parquet(target)
        return True

    def totals(self) -> DataFrame:
        base, held = self._base()
        return self._sum(base, [b for b in self._list("batch") if b not in held])

    def _sum(self, base: str | None, batches: list[str]) -> DataFrame:
        """Totals of a base and of batches that it does not hold."""
        paths = [f"{self.path}/base/{base}"] if base else []
        paths += [f"{self.path}/batch/{b}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return (
            self.spark.read.schema(SCHEMA)
            .parquet(*paths)
            .groupBy(*KEY)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs <> 0 or n_tokens <> 0")
        )

    def compact(self) -> None:
        """Fold all committed batches into a base; readers see the old files until it is complete."""
        base, held = self._base()
        # listed once: a batch that is committed from here on is in neither the members nor the sums of the new base
        new = [b for b in self._list("batch") if b not in held]
        if new:
            name = f"{int(base or 0) + 1:08d}"
            self.spark.createDataFrame([(b,) for b in sorted(held | set(new))], "id string").write.mode("overwrite").parquet(f"{self.path}/members/{name}")
            self._sum(base, new).write.mode("overwrite").parquet(f"{self.path}/base/{name}")


# Tokenizer versions by the pattern of one token; both dialects of SQL read them alike.
VERSIONS = {"words-1": r"[^ \t\n\r\f\v]+", "pieces-1": r"[A-Za-z]+|[0-9]|[^A-Za-z0-9 \t\n\r\f\v]"}


def count_tokens(text, version: str):
    # \x0B: Java reads \v as all vertical white space
    return F.regexp_count(text, F.lit(VERSIONS[version].replace(r"\v", r"\x0B"))).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """Per document and version: tokens of the whole text, and of its distinct lines (null text: 0)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.array_join(F.array_distinct(F.split(text, "\n")), "\n")
    each = F.array(
        *(
            F.struct(F.lit(v).alias("tokenizer"), count_tokens(text, v).alias("whole"), count_tokens(lines, v).alias("once"))
            for v in VERSIONS
        )
    )
    return docs.select("doc_id", "source", "lang", F.explode(each).alias("r")).select(
        "doc_id", "source", "lang", "r.tokenizer", "r.whole", "r.once"
    )


def _changes(rows: DataFrame, op: str, before=None, after=None) -> DataFrame:
    nothing = F.lit(None).cast("long")
    return rows.select(
        F.lit(op).alias("op"), *KEY, (nothing if before is None else before).alias("n_before"),
        (nothing if after is None else after).alias("n_after"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits over documents, one of them sent twice, and a compaction between them.

    All documents are inserted; those labelled quality 0 are revised to the count of their distinct
    lines; those labelled toxic are then deleted.  Texts are counted once, where they are read; batches
    join and move counts only.
    """
    scratch = Scratch(spark, "rollup")
    counts = scratch.write("counted", counted(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    marked = counts.join(labels, "doc_id")
    low = F.col("quality").eqNullSafe(0)
    rollup = Rollup(spark, scratch.path("tokens"))
    rollup.commit("0001", _changes(counts, "insert", after=F.col("whole")))
    revised = _changes(marked.where(low), "revise", F.col("whole"), F.col("once"))
    rollup.commit("0002", revised)
    rollup.compact()
    rollup.commit("0002", revised)
    gone = marked.where("toxic = 1")
    rollup.commit("0003", _changes(gone, "delete", F.when(low, F.col("once")).otherwise(F.col("whole"))))
    scratch.drop("counted")
    return rollup.totals()


_COUNT = {v: f"len(regexp_extract_all({{t}}, '{p}'))" for v, p in VERSIONS.items()}
ORACLE = f"""
WITH lab AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT source, lang,
    CASE WHEN lab.quality = 0 THEN array_to_string(list_distinct(string_split(coalesce(text, ''), chr(10))), chr(10))
         ELSE coalesce(text, '') END AS t
  FROM documents LEFT JOIN lab USING (doc_id) WHERE coalesce(lab.toxic, 0) <> 1)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM (
  SELECT source, lang, 'words-1' AS tokenizer, {_COUNT['words-1'].format(t='t')} AS n FROM d
  UNION ALL
  SELECT source, lang, 'pieces-1', {_COUNT['pieces-1'].format(t='t')} FROM d)
GROUP BY ALL HAVING count(*) <> 0 OR sum(n) <> 0
"""
