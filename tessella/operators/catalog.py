"""Records of tasks and results: order, duplicates, fingerprints, caches, resumption and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FORMATS = {"png": "png", "tif": "tiff", "tiff": "tiff", "jpg": "jpeg", "jpeg": "jpeg", "jxl": "jxl"}


def ranked(rows: DataFrame, shelf: list[str], *order: Column) -> DataFrame:
    """rows with their `rank` on the shelf."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*shelf).orderBy(*order)))


# The orders of a gallery: by name or date, the other of both next, then the id.
GALLERY = {"name": ("name", 1, "created", -1), "name-down": ("name", -1, "created", -1), "newest": ("created", -1, "name", 1), "oldest": ("created", 1, "name", 1)}


def gallery(rows: DataFrame, shelf: list[str], mode: str) -> DataFrame:
    """rows (id, name, created) with their `rank` on the shelf; names without case."""
    way = lambda c, up: (F.asc_nulls_last if up > 0 else F.desc_nulls_last)(F.lower("name") if c == "name" else F.col(c))
    first, up, second, down = GALLERY[mode]
    return ranked(rows, shelf, way(first, up), way(second, down), F.asc("id"))


def best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key, planned as a group limit."""
    return ranked(rows, keys, *order).where("rank = 1").drop("rank")


def clear_best(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """keys, the greatest size, and whether it is `clear`: known for all, and held by one row."""
    top = rows.groupBy(*keys).agg(F.max(size).alias("size"), F.bool_or(F.col(size).isNull()).alias("_unknown"), F.count("*").alias("copies"))
    ties = rows.join(top.select(*keys, F.col("size").alias("_top")), keys).where(F.col(size) == F.col("_top")).groupBy(*keys).agg(F.count("*").alias("_ties"))
    return top.join(ties, keys, "left").select(*keys, "size", "copies", (~F.col("_unknown") & (F.col("_ties") == 1)).alias("clear"))


def only_clear(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """keys and the greatest size; fails where a key's best is not clear."""
    checked = clear_best(rows, keys, size)
    return checked.withColumn("size", F.when(F.assert_true("clear", F.concat(F.lit("no clear best for "), F.to_json(F.struct(*keys)))).isNull(), F.col("size"))).select(*keys, "size")


# What changes how a job runs, not what it makes.
EXECUTION = [
    "outputDir", "workers", "parallelRendering", "useSourceCache", "useAlignmentCache", "parallelMatching", "alignmentCacheDir", "memoryBudgetMiB",
    "memoryBudgetMib", "protectPeople", "smoothWater", "sceneModelPath", "sceneModelSha256", "sceneCacheDir",
]


def request_hash(body: Column) -> Column:
    """SHA-256 of a flat JSON request without its execution keys, the others in the order of their names."""
    fields = F.from_json(body, "map<string,string>")
    kept = F.map_filter(fields, lambda k, _: ~k.isin(EXECUTION))
    pairs = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e.key, e.value)))
    return F.when(fields.isNotNull(), F.sha2(F.array_join(pairs, "\x01"), 256))


def same_map(a: Column, b: Column) -> Column:
    """Whether two maps have the same entries, in whatever order."""
    own = lambda m: F.array_sort(F.map_entries(m))
    return own(a).eqNullSafe(own(b))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON, in the order of their names; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def cached(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """wanted with the `body` of the cache (key, body, body_hash) where it has one that its own hash confirms."""
    valid = cache.where(F.sha2("body", 256) == F.col("body_hash")).select(key, "body")
    return wanted.join(valid, key, "left")


def pending(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(done, keys, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how often rows of a lack in b, rows of b in a, and whether both are the same bag."""
    names = a.columns
    count = lambda df, n: df.groupBy(*names).agg(F.count("*").alias(n))
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in names]
    both = count(a, "n").alias("x").join(count(b, "m").alias("y"), on, "full")
    more = F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))
    got = both.agg(F.coalesce(F.sum(F.greatest(more, F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-more, F.lit(0))), F.lit(0)).alias("only_b"))
    return got.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def admitted(jobs: DataFrame, pool: list[str], order: list[str], cost: str, budget: float, slots: int) -> DataFrame:
    """Jobs in order while slots are free and their costs together stay within the budget."""
    w = W.partitionBy(*pool).orderBy(*order)
    spent = F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))
    return jobs.withColumn("slot", F.row_number().over(w)).withColumn("spent", spent).where((F.col("slot") <= slots) & (F.col("spent") <= budget))


def export_format(name: Column) -> Column:
    """The format that a file name's extension stands for, or null."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[extension]


def unique_names(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with `unique_name`: the first row of a name keeps it, the others get " (2)", " (3)", ..., the first numbers
    whose names no row was given. Every name takes its free numbers in one join: as many as it has rows and clashes."""
    n = F.row_number().over(W.partitionBy(name).orderBy(*order))
    numbered = rows.withColumn("_n", n)
    many = rows.groupBy(name).agg(F.count("*").alias("_k")).where("_k > 1")
    given = rows.select(F.col(name).alias("_made")).distinct()
    # names that look as if made from this one
    base = given.select(F.regexp_extract("_made", r"^(.*) \((\d{1,9})\)$", 1).alias(name), F.regexp_extract("_made", r"^(.*) \((\d{1,9})\)$", 2).alias("_s")).where("_s <> ''")
    clashes = base.select(name, F.col("_s").cast("int").alias("_s")).groupBy(name).agg(F.collect_set("_s").alias("_taken"))
    free = many.join(clashes, name, "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    free = free.select(name, F.posexplode(F.slice(F.array_except(F.sequence(F.lit(2), (F.col("_k") + F.size("_taken")).cast("int")), "_taken"), F.lit(1), (F.col("_k") - 1).cast("int"))).alias("_p", "_free"))
    made = numbered.join(free.withColumn("_n", F.col("_p") + 2).drop("_p"), [name, "_n"], "left")
    return made.withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("_free"), F.lit(")")))).select(*rows.columns, "unique_name")


def status_counts(rows: DataFrame, *state: str) -> DataFrame:
    return rows.groupBy(*state).agg(F.count("*").alias("n"))
