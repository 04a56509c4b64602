"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.shared import LOWER, SPACE, UPPER, materialise

KEY = ["__h1", "__h2"]


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


class LineRuns:
    """How many documents each line key was seen in, as sorted runs in levels.

    A batch is first counted by key, then anti-joined with the settled keys (those that already reached
    `min_docs`; more sightings change nothing), and what is left becomes a run of level 0, sorted by
    key. When a level holds `fanout` runs they are merged into one run of the next level; keys that
    reach `min_docs` in a merge move to the settled runs. Batches must not share documents.
    """

    def __init__(self, min_docs: int, fanout: int = 3):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def add(self, lines: DataFrame) -> None:
        """Adds a batch: rows of KEY and of columns that tell documents apart."""
        run = lines.distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        for done in self.settled:
            run = run.join(done, KEY, "left_anti")
        self._put(0, run)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(materialise(run.sortWithinPartitions(*KEY), f"line-run{level}"))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merge(runs))

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """Merges runs; settles keys that reach `min_docs` and returns the others."""
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        merged = materialise(merged.groupBy(*KEY).agg(F.sum("n").alias("n")).sortWithinPartitions(*KEY), "line-merge")
        self.settled.append(merged.where(F.col("n") >= self.min_docs).select(*KEY))
        return merged.where(F.col("n") < self.min_docs)

    def compact(self) -> DataFrame:
        """Merges all that is left and returns every settled key once."""
        runs = [run for level in self.levels for run in level]
        self.levels = []
        if runs:
            self._put(0, self._merge(runs))
        keys = self.settled[0]
        for more in self.settled[1:]:
            keys = keys.unionByName(more)
        return keys


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """Drops every line whose key occurs in at least `min_docs` documents.

    Returns the columns of `docs` with `text_col` cut to the lines that stay, and `n_lines` (before) and
    `n_dropped`; input columns of those two names give way. A null or empty text is one empty line and
    comes back as an empty text. Keys shorter than `min_chars` code points are never dropped. Rows that
    agree in id and text are one document, each still returned; a null id is an id like any other. An
    empty table gives an empty table.

    Keys are compared by two 64-bit hashes. Lines travel as hashes and positions; texts are shuffled once,
    to meet the positions their document loses. A line of a third of all documents is counted by partial
    sums, and its occurrences meet the settled key in a join that adaptive execution splits.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__doc"), F.split(text, "\n", -1).alias("__lines"), F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("__rest"))
    key = line_key(F.col("__line"))
    lines = (
        base.select("__id", "__doc", F.posexplode("__lines").alias("__pos", "__line"))
        .select("__id", "__doc", "__pos", key.alias("__key"))
        .where(F.char_length("__key") >= min_chars)
        .select("__id", "__doc", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(7), "__key", F.lit(11)).alias("__h2"), F.pmod("__doc", F.lit(batches)).cast("int").alias("__batch"))
    )
    lines = materialise(lines, "lines", ["__batch"])
    runs = LineRuns(min_docs)
    for batch in range(batches):
        runs.add(lines.where(F.col("__batch") == batch).select("__id", "__doc", *KEY))
    gone = lines.join(runs.compact(), KEY, "left_semi").groupBy(F.col("__id").alias("__i"), F.col("__doc").alias("__d")).agg(F.collect_set("__pos").alias("__gone"))
    gone = gone.withColumnRenamed("__gone", "__dropped")
    joined = base.join(gone, base["__id"].eqNullSafe(gone["__i"]) & (base["__doc"] == gone["__d"]), "left")
    n = F.size("__lines")
    stay = F.when(F.col("__dropped").isNull(), F.col("__lines")).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "__dropped"), lambda i: F.col("__lines")[i]))
    return joined.select(
        F.col("__id").alias(id_col),
        F.array_join(stay, "\n").alias(text_col),
        *[F.col("__rest")[c].alias(c) for c in rest],
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often o USING (k) GROUP BY doc_id
"""
