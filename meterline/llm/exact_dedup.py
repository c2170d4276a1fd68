"""Exact dedup by a persistent digest index, bucketed and sorted by hash.

The index is a bucketed table ``(text_sha256, keep_id)`` under ``spark.checkpoint.dir``, found there by its name in
later sessions too.  Adding a batch folds its copies, anti-joins its distinct digests with the index by sort-merge,
without shuffling the index, and appends what is new.  A bucket has a sorted file for each batch, so the merge sorts
it again; only its bucketing spares work.  A corpus is added in parts of falling ids, so that the first copy that the
index sees is the one that stays.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import dropped, numbered_copies, removed, saved, shared_dir, shuffles_deleted

#: Mean number of digests of one bucket, and the fewest buckets of an index.
PER_BUCKET = 2_000_000
LEAST_BUCKETS = 8
#: Parts in which a corpus is added, and the ids (those of smallest hash) from which their bounds are taken.
PARTS = 3
SAMPLE = 1_000


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes; null counts as the empty text. No normalisation."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class DigestIndex:
    """Index of the texts seen so far: one row for each distinct text.

    ``add(rows)`` deduplicates a batch of ``(text_sha256, doc_id)`` against the index and itself and appends what is
    new.  A text already in the index keeps its recorded ``keep_id``; among equal texts of one batch the largest
    ``doc_id`` stays (null only if no copy has an id).  Appending the same batch twice adds nothing, so a failed
    ``add`` can be repeated; two sessions must not add at the same time.  ``name`` is a plain identifier; the files
    are in ``folder``, by default one of that name under the shared folder.  ``buckets`` is only read when the index
    is made.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = LEAST_BUCKETS, folder: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.folder = folder or f"{shared_dir(spark)}/meterline-indexes/{name}"

    @classmethod
    def sized(cls, spark: SparkSession, name: str, digests: int) -> DigestIndex:
        """An index with buckets for so many digests."""
        return cls(spark, name, max(LEAST_BUCKETS, -(-digests // PER_BUCKET)))

    def _made(self) -> tuple[int, str] | None:
        """Buckets and type of the ids of the index in the folder, if there is one."""
        try:
            made = self.spark.read.schema("buckets int, ids string").json(f"{self.folder}/made").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return tuple(made) if made else None

    def exists(self) -> bool:
        """Whether the folder has the index; this session knows its table from then on."""
        made = self._made()
        if made is None:
            return False
        self.buckets, ids = made
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, keep_id {ids}) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/digests'"
        )
        self.spark.catalog.refreshTable(self.name)
        return True

    def frame(self) -> DataFrame:
        self.exists()
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Append the new texts of a batch ``(text_sha256, doc_id)``."""
        if not self.exists():
            made = [(self.buckets, rows.schema["doc_id"].dataType.simpleString())]
            self.spark.createDataFrame(made, "buckets int, ids string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/made")
            self.exists()
        # copies are folded and written first: the optimizer would move the join below the fold
        batch = saved(rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id")), "digest_batch")
        fresh = batch.join(self.frame().hint("merge"), "text_sha256", "left_anti")
        with shuffles_deleted(self.spark):
            (
                fresh.repartition(self.buckets, "text_sha256")
                .write.mode("append")
                .format("parquet")
                .bucketBy(self.buckets, "text_sha256")
                .sortBy("text_sha256")
                .saveAsTable(self.name)
            )
        dropped(batch)
        self.spark.catalog.refreshTable(self.name)

    def add_corpus(self, rows: DataFrame, parts: int = PARTS) -> None:
        """Add ``rows`` in parts of falling ids (without id last), so that of equal texts the largest id stays."""
        some = rows.filter("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
        ids = sorted(r[0] for r in some.collect())
        bounds = sorted({ids[len(ids) * k // parts] for k in range(1, parts)}, reverse=True) if ids else []
        id_, above = F.col("doc_id"), F.lit(False)
        for bound in bounds:
            self.add(rows.filter((id_ >= F.lit(bound)) & ~above))
            above = id_ >= F.lit(bound)
        self.add(rows.filter(~F.coalesce(above, F.lit(False))))

    def drop(self) -> None:
        """Delete the index and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        removed(self.spark, self.folder)


def digested(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_sha256)`` of every row, written once so that each text is read and hashed once."""
    return saved(docs.select("doc_id", digest(F.col("text")).alias("text_sha256")), "digest_rows")


def _indexed(docs: DataFrame, index: DigestIndex | None) -> tuple[DataFrame, DigestIndex]:
    """The digests of the rows, and the index that now has them: a new one if none is given."""
    rows = digested(docs)
    if index is None:
        index = DigestIndex.sized(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}", rows.count())
    index.add_corpus(rows)
    return rows, index


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``group_size`` counts the given rows with that text.  Null text equals the empty text; texts are read whole; extra
    columns are ignored.  Where the row that stays occurs more than once (same id, same text), one of the rows is
    kept.  Null ids lose to any id; a group of null ids only keeps one row.  An empty table gives no rows.  Without
    an ``index``, a new one is made for these rows alone; with one, no row of a text that it already had is kept
    unless the row is the one recorded there.
    """
    rows, used = _indexed(docs, index)
    sizes = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    classes = saved(sizes.join(used.frame().hint("merge"), "text_sha256"), "digest_classes")
    if index is None:
        used.drop()
    # equal rows fold to one with a count, so that exactly one of them can be kept
    folded = rows.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    each = numbered_copies(folded.join(classes, "text_sha256"), "n", "copy")
    return each.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns: one row for each distinct text.

    Columns of any name pass through; the rest is as in :func:`exact_dedup`.
    """
    rows, used = _indexed(docs, index)
    winners = used.frame() if index is None else used.frame().join(rows.select("text_sha256"), "text_sha256", "left_semi")
    winners = saved(winners, "digest_winners")
    dropped(rows)
    if index is None:
        used.drop()
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), digest(F.col("text")).alias("sha"))
    same = (F.col("sha") == F.col("text_sha256")) & F.col("id").eqNullSafe(F.col("keep_id"))
    # only rows with equal id and text are left to fold; no other rows share a group
    return held.join(winners, same, "left_semi").dropDuplicates(["id", "sha"]).select("doc.*")
