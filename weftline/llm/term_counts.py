"""Problem 1: how often, and in how many records, every distinct value occurs.

Counts are kept in a folder of Parquet files, in buckets by a hash of the term, with a manifest that says which files are
current. A change aggregates only the records it touches: what was there before it and what is there after it give signed changes
of the two counts of each term, and only the buckets these fall into are read and written anew. Any session can open the folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shared import forget, settled

#: The pseudo field whose value 0 counts the records themselves.
RECORDS = "*"
COUNTS = "field_name string, field_value bigint, n_occurrences bigint, n_records bigint"
MANIFEST = "version int, buckets int, bucket int, folder string, n_terms bigint"
TERMS_A_BUCKET = 1_000_000


def signed_changes(rows: DataFrame, record: str, place: list[str], fields: list[str], before: Column, after: Column) -> DataFrame:
    """(field_name, field_value, n_occurrences, n_records) by which the counts change where rows held `before` and hold `after`.

    An occurrence is a distinct (record, place); a row that repeats one adds nothing. Null values are no term. Rows with a
    null record are ignored; nulls in the place are compared like values. A record's rows must all be there if one of
    them is. Repeated occurrences meet in each task before the first shuffle, which goes by all of (value, record, place); the
    later ones carry sums, so that neither a hot value nor a hot pair of value and record fills a task.
    """
    flags = [F.coalesce(c, F.lit(False)).cast("int") for c in (before, after)]
    terms = [F.struct(F.lit(-1).alias("f"), F.lit(0).cast("bigint").alias("field_value"), *(F.lit(None).cast(rows.schema[p].dataType).alias(f"p{k}") for k, p in enumerate(place)))]
    terms += [F.struct(F.lit(i).alias("f"), F.col(f).cast("bigint").alias("field_value"), *(F.col(p).alias(f"p{k}") for k, p in enumerate(place))) for i, f in enumerate(fields)]
    each = rows.filter(F.col(record).isNotNull()).select(F.col(record).alias("_r"), flags[0].alias("_b"), flags[1].alias("_a"), F.explode(F.array(*terms)).alias("_t")).select("_r", "_b", "_a", "_t.*").filter("field_value IS NOT NULL")
    spots = each.groupBy("f", "field_value", "_r", *(f"p{k}" for k in range(len(place)))).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    pairs = spots.groupBy("f", "field_value", "_r").agg(F.sum("_b").alias("_b"), F.sum("_a").alias("_a"))
    names = F.element_at(F.array(*(F.lit(f) for f in (RECORDS, *fields))), F.col("f") + 2)
    out = pairs.groupBy(names.alias("field_name"), "field_value").agg(F.sum(F.col("_a") - F.col("_b")).alias("n_occurrences"), F.sum((F.col("_a") > 0).cast("bigint") - (F.col("_b") > 0).cast("bigint")).alias("n_records"))
    return out.filter("n_occurrences <> 0 OR n_records <> 0")


def record_terms(rows: DataFrame, record: str, place: list[str], fields: list[str]) -> DataFrame:
    """What these rows, of records that weren't there before, add to the counts."""
    return signed_changes(rows, record, place, fields, F.lit(False), F.lit(True))


def signed_deltas(before: DataFrame, after: DataFrame, record: str, place: list[str], fields: list[str]) -> DataFrame:
    """Changes of the counts by replacing the touched records' rows `before` by `after`; either may lack a record."""
    cols = list(dict.fromkeys([record, *place, *fields]))
    both = before.select(*cols, F.lit(True).alias("_was")).unionByName(after.select(*cols, F.lit(False).alias("_was")))
    return signed_changes(both, record, place, fields, F.col("_was"), ~F.col("_was"))


class TermCounts:
    """Counts of terms in a folder that all executors share; another session opens them by the same path.

    A change writes the buckets it touches beside the current ones, one task a bucket, and then a manifest of all current
    files: a job that is lost and repeated never reads what it has half written, and of two changes made at once the second
    one fails. The number of buckets is that of the first session's shuffle partitions, doubled as often as the terms of the first
    change ask for, and doubled again, with all buckets written anew, when a bucket has on average more than twice `bucket_terms`.
    A term's bucket comes from the hash that Spark shuffles by: the partitions of a first load's changes are whole buckets.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_terms: int = TERMS_A_BUCKET):
        self.spark, self.path, self.bucket_terms = spark, path, bucket_terms

    def _manifest(self, version: int | None = None) -> list:
        """The current files, one row a bucket that has any."""
        try:
            known = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/*")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        newest = known.agg(F.max("version")).first()[0] if version is None else version
        return known.filter(F.col("version") == newest).collect()  # a row a bucket

    def counts(self) -> DataFrame:
        """All terms with both counts; no rows before the first change."""
        return self._read([r.folder for r in self._manifest() if r.folder])

    def _read(self, folders: list[str]) -> DataFrame:
        folders = sorted(set(folders))
        return self.spark.read.schema(COUNTS).parquet(*folders) if folders else self.spark.createDataFrame([], COUNTS)

    def apply(self, deltas: DataFrame, at_most: int | None = None) -> None:
        """Add signed changes to the counts. Terms whose occurrences fall to 0 leave the table.

        at_most: a bound on the number of terms, if one is known, which spares a first load the writing of its changes.
        """
        new = deltas.select("field_name", "field_value", "n_occurrences", "n_records")
        old = self._manifest()
        version, buckets = (old[0].version + 1, old[0].buckets) if old else (0, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        spared = at_most is not None and not old
        if not spared:
            new = settled(new, "deltas")
        terms, most = sum(r.n_terms for r in old) + (at_most if spared else new.count()), buckets
        while terms > 2 * self.bucket_terms * most or not old and terms > self.bucket_terms * most:
            most *= 2
        bucket = F.pmod(F.hash("field_name", "field_value"), F.lit(most))
        if most != buckets or spared:
            touched, kept = list(range(most)), []
        else:
            touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # at most a number for each bucket
            kept = [r for r in old if r.bucket not in set(touched)]
        if touched:
            stale = self._read([r.folder for r in old if r.folder and (most != buckets or r.bucket in set(touched))])
            both = stale.unionByName(new).withColumn("bucket", bucket) if old else new.withColumn("bucket", bucket)
            if old:  # one task a bucket, by its number or its place among the touched ones
                few = len(touched) <= 64
                at = F.array_position(F.lit(touched), F.col("bucket")).cast("int") - 1 if few else F.col("bucket")
                both = both.withColumn("_at", at).repartitionById(len(touched) if few else most, "_at")
                both = both.groupBy("_at", "bucket", "field_name", "field_value").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records")).drop("_at")
            elif not spared:
                both = both.repartitionById(most, "bucket")
            both = both.filter("n_occurrences > 0")
            folder = f"{self.path}/terms/{version}-{uuid.uuid4().hex}"
            both.write.partitionBy("bucket").parquet(folder)
            written = {r.bucket: r.n for r in self.spark.read.schema(COUNTS + ", bucket int").parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = [(version, most, r.bucket, r.folder, r.n_terms) for r in kept]
        rows += [(version, most, b, f"{folder}/bucket={b}" if b in written else None, written.get(b, 0)) for b in touched]
        if rows:
            self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/manifests/{version}")
        if not spared:
            forget(new)

    def records(self) -> int:
        """The number of records."""
        row = self.counts().filter(F.col("field_name") == RECORDS).first()
        return row["n_records"] if row else 0


def mark_terms(counts: DataFrame, records: int, rare_below: int, common_share: float) -> DataFrame:
    """Terms with a mark (null for useful ones). A term that is both rare and common, which takes a handful of records, gets a row for each mark."""
    terms = counts.filter(F.col("field_name") != RECORDS)
    rare = F.when(F.col("n_occurrences") < rare_below, F.lit("rare"))
    common = F.when(F.col("n_records") >= F.lit(common_share * records), F.lit("common"))
    marks = F.array_compact(F.array(rare, common))
    return terms.select("field_name", "field_value", "n_occurrences", "n_records", F.explode_outer(marks).alias("mark"))


def count_terms(spark: SparkSession, rows: DataFrame, record: str, place: list[str], fields: list[str], arrival: str, path: str, later: float = 0.75, bucket_terms: int = TERMS_A_BUCKET) -> TermCounts:
    """Counts of a table whose rows arrived in numbered batches: the first `later` of the batches as a first load, the rest as one change.

    The change counts the records that its rows belong to, before and after it in one pass, and no others. Rows without a number are of the first load.
    """
    store = TermCounts(spark, path, bucket_terms)
    last = rows.agg(F.max(arrival)).first()[0] or 0
    is_new = F.coalesce(F.col(arrival) > int(last * later), F.lit(False))
    store.apply(record_terms(rows.filter(~is_new), record, place, fields), at_most=rows.count() * len(fields) + 1)
    touched = rows.filter(is_new).select(record).distinct()
    store.apply(signed_changes(rows.join(touched, record, "left_semi"), record, place, fields, ~is_new, F.lit(True)))
    return store
