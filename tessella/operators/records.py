"""Records of jobs and results: reconciliation, locks, downloads, provenance, manifests and set operations on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reconciled(records: DataFrame, *others: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and columns: of each column the first value that is not null, from the last of the others to the record; keys of all."""
    out = records.select(key, *[F.col(c).alias(f"{c}_0") for c in columns])
    for k, other in enumerate(others, 1):
        out = out.join(other.select(key, *[F.col(c).alias(f"{c}_{k}") for c in columns]), key, "full")
    return out.select(key, *[F.coalesce(*[F.col(f"{c}_{k}") for k in range(len(others), -1, -1)]).alias(c) for c in columns])


def verified(references: DataFrame, artifacts: DataFrame, path: str, digest: str, content: str) -> DataFrame:
    """references with `state`: missing, changed or verified, by the SHA-256 of the artifact at the path."""
    found = artifacts.select(path, F.sha2(content, 256).alias("_actual"))
    state = F.when(F.col("_actual").isNull(), "missing").when(F.col("_actual") != F.col(digest), "changed").otherwise("verified")
    return references.join(found, path, "left").withColumn("state", state).drop("_actual")


def complete(expected: DataFrame, actual: DataFrame, job: str, keys: list[str]) -> DataFrame:
    """job, expected, lacking, complete: whether all expected rows of a job are among the actual ones."""
    have = actual.select(job, *keys).distinct().withColumn("_have", F.lit(True))
    lacking = F.count_if(F.col("_have").isNull())
    return expected.join(have, [job, *keys], "left").groupBy(job).agg(F.count("*").alias("expected"), lacking.alias("lacking"), (lacking == 0).alias("complete"))


def downloads(files: DataFrame, batch: str) -> DataFrame:
    """batch, files, bytes, admitted: a batch is admitted once every file (wanted_bytes, got_bytes, wanted_hash, got_hash) has its size and hash."""
    good = F.coalesce((F.col("wanted_bytes") == F.col("got_bytes")) & (F.col("wanted_hash") == F.col("got_hash")), F.lit(False))
    return files.groupBy(batch).agg(F.count("*").alias("files"), F.sum(F.coalesce("got_bytes", F.lit(0))).alias("bytes"), F.bool_and(good).alias("admitted"))


def appended(known: DataFrame, found: DataFrame, path: str) -> DataFrame:
    """known and those of found whose path, without case, backslashes and a last slash, is not known yet; each once."""
    norm = lambda c: F.regexp_replace(F.replace(F.lower(c), F.lit("\\"), F.lit("/")), "/+$", "")
    first = F.row_number().over(W.partitionBy("_p").orderBy(path))
    new = found.withColumn("_p", norm(F.col(path))).withColumn("_k", first).where("_k = 1").drop("_k")
    return known.unionByName(new.join(known.select(norm(F.col(path)).alias("_p")).distinct(), "_p", "left_anti").drop("_p"))


def rekeyed_locks(locks: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Locks (row, column, origin) of an old grid (photo, row, column) as cells of a new one, or pending at their old cell.

    A lock goes with its photo; one whose cell held no photo, or whose photo has no new cell, stays pending.
    """
    photo = locks.join(old.select("photo", "row", "column"), ["row", "column"], "left")
    moved = photo.join(new.select("photo", F.col("row").alias("_r"), F.col("column").alias("_c")), "photo", "left")
    there = F.col("_r").isNotNull()
    return moved.select(F.coalesce("_r", "row").alias("row"), F.coalesce("_c", "column").alias("column"), F.coalesce("origin", F.lit("legacy-unknown")).alias("origin"), (~there).alias("pending")).distinct()


def gated(diagnostics: DataFrame, current: DataFrame, job: str, cell: list[str], path: str) -> DataFrame:
    """The diagnostics of jobs all of whose cells are held by the same path now; one mismatch or repeated cell voids the whole job."""
    now = current.select(job, *cell, F.lower(path).alias("_now"))
    both = diagnostics.join(now, [job, *cell], "left")
    bad = both.groupBy(job).agg(F.bool_and(F.coalesce(F.lower(path) == F.col("_now"), F.lit(False))).alias("_same"), (F.count("*") == F.countDistinct(*cell)).alias("_once"))
    return diagnostics.join(bad.where("_same and _once").select(job), job, "left_semi")


def provenance() -> Column:
    """What a result's geometry rests on, from the columns geometry, forced, visual, estimated, total, quality, evidence, nominal; the first rule that fits."""
    c = F.col
    no = F.lit(False)
    grid = F.coalesce(F.lower("geometry").contains("grid"), no)
    estimates, forced, visual, nominal = (F.coalesce(x, no) for x in (c("estimated") > 0, c("forced") > 0, c("visual") > 0, c("nominal")))
    known = nominal | grid | estimates | forced
    model = F.coalesce(c("geometry").startswith("visual-"), no)
    consistent = c("total").isNull() | F.coalesce((c("visual") == c("total")) & (c("estimated") == 0) & (c("forced") == 0), no)
    legacy = model & c("visual").isNull() & c("estimated").isNull() & c("forced").isNull()
    normal = ~known & (F.coalesce(c("evidence"), no) | model) & F.coalesce(c("quality") == "passed-measured-checks", no) & (consistent | legacy)
    is_ = lambda name: F.coalesce(c("geometry") == name, no)
    mixed = forced | (estimates & visual) | F.coalesce(c("geometry").contains("grid-bridge") | c("geometry").contains("visual-ray-grid"), no)
    return (
        F.when(normal, "normal").when(is_("central-measured-overlap-grid"), "measured-grid")
        .when(is_("nominal-fov-grid") | nominal, F.when(forced, "forced-grid").otherwise("nominal-grid"))
        .when(forced & F.coalesce(c("forced") >= c("total"), no) & ~visual, "forced-grid").when(mixed, "mixed-grid")
        .when(estimates & ~visual, "estimated-grid").when(grid, "mixed-grid").otherwise("unknown")
    )


def manifest_faults(tiles: DataFrame, manifest: str, tile: int) -> DataFrame:
    """manifest, row, column, fault of level-0 tiles (row, column, path, w, h, width, height of the picture): outside, wrong size, repeated cell, path that leaves the folder."""
    c = F.col
    size = lambda whole, at: F.least(F.lit(tile), c(whole) - c(at) * tile)
    outside = (c("row") < 0) | (c("column") < 0) | (c("column") * tile >= c("width")) | (c("row") * tile >= c("height"))
    again = F.count("*").over(W.partitionBy(manifest, "row", "column")) > 1
    leaves = c("path").startswith("/") | c("path").rlike(r"(^|/)\.\.(/|$)") | c("path").contains("\\") | c("path").rlike("^[A-Za-z]:")
    fault = F.when(outside, "outside").when((c("w") != size("width", "column")) | (c("h") != size("height", "row")), "size").when(again, "repeated").when(leaves, "path")
    return tiles.withColumn("fault", fault).where("fault is not null").select(manifest, "row", "column", "fault")


def overlapping_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """(outer, inner) of paths one of which is a folder that contains the other: every path meets its own parent folders."""
    own = paths.select(F.col(path).alias("inner")).distinct()
    folders = "transform(sequence(1, size(split(inner, '/')) - 1), k -> array_join(slice(split(inner, '/'), 1, k), '/'))"
    parents = own.where("size(split(inner, '/')) > 1").withColumn("outer", F.explode(F.expr(folders)))
    return parents.join(own.select(F.col("inner").alias("outer")), "outer").select("outer", "inner")


def merged_layers(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Pixels (x, y, v) of a base under an overlay (x, y, v, a) with alpha 0 to 255, rounded to whole values."""
    c = F.col
    top = overlay.select("x", "y", c("v").alias("_v"), c("a").alias("_a"))
    mixed = F.when(c("_a").isNull() | (c("_a") == 0), c("v").cast("double")).when(c("_a") == 255, c("_v").cast("double")).otherwise(F.round((c("_v") * c("_a") + c("v") * (255 - c("_a"))) / 255.0))
    return base.join(top, ["x", "y"], "left").select("x", "y", mixed.cast("long").alias("v"))


def nearest_owner(owners: DataFrame, cells: DataFrame, radius: int = 3) -> DataFrame:
    """cells (x, y) with the owner of theirs, or of the nearest owned cell (x, y, owner) within the radius, the smaller owner in a tie."""
    shifts = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    d = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * i + j * j).alias("far")) for i, j in shifts])).alias("d")
    reach = owners.select("owner", "x", "y", d).select((F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), F.struct(F.col("d.far").alias("far"), "owner").alias("near"))
    best = reach.groupBy("x", "y").agg(F.min("near").alias("near"))
    return cells.join(best, ["x", "y"], "left").select("x", "y", F.col("near.owner").alias("owner"))


def best_component(components: DataFrame, group: str, *ties: str) -> DataFrame:
    """Of each group the preferred component: whole before truncated, then coverage, confidence and sharpness, then the greatest of ties."""
    return components.groupBy(group).agg(F.max_by(F.struct(*ties), F.struct(~F.col("truncated"), "coverage", "confidence", "sharpness", *ties)).alias("best")).select(group, "best.*")


def blend_override(people: Column, water: Column, owner: Column, share: Column) -> Column:
    """What decides a pixel: a person's owner before smooth water before the base."""
    return F.when(people & owner.isNotNull(), F.concat(F.lit("person:"), owner.cast("string"))).when(water & (share > 0), F.concat(F.lit("water:"), share.cast("string"))).otherwise("base")


def water_share(confidence: Column, threshold: float = 160.0, end: float = 224.0) -> Column:
    """0 to 255, smooth between the threshold and the end."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (confidence - threshold) / (end - threshold)))
    return F.round(t * t * (3 - 2 * t) * 255).cast("int")


def colour_distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0))) / 441.7


def quality_summary(edges: DataFrame, key: str) -> DataFrame:
    """What a consumer sees of a run's edges (accepted, nominal, ratio, residual): counts, mean confidence, mean and greatest residual of the measured ones, 0 where there is none."""
    c = F.col
    measured = c("accepted") & ~c("nominal") & c("residual").isNotNull() & ~F.isnan("residual")
    value = F.when(measured, c("residual"))
    return edges.groupBy(key).agg(
        F.count_if(c("accepted") & ~c("nominal")).alias("matched"), F.count_if(c("nominal")).alias("nominal"), F.count_if(~c("accepted") & ~c("nominal")).alias("failed"),
        F.coalesce(F.avg(F.when(c("accepted"), c("ratio"))), F.lit(0.0)).alias("confidence"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_residual"), F.coalesce(F.max(value), F.lit(0.0)).alias("greatest_residual"))


def compared_runs(first: DataFrame, second: DataFrame, key: str, identity: list[str], times: list[str]) -> DataFrame:
    """key and the ratio of each time of two runs with equal identity columns; fails where these differ."""
    both = first.alias("x").join(second.alias("y"), key)
    same = F.lit(True)
    for c in identity:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    checked = F.assert_true(same, F.concat(F.lit("runs do not share their inputs: "), F.col(key).cast("string")))
    return both.select(key, *[F.when(checked.isNull(), F.col(f"y.{t}") / F.col(f"x.{t}")).alias(t) for t in times])


def thumbnail_level(levels: DataFrame, key: str, side: int) -> DataFrame:
    """key, level: of a manifest's usable levels (level, width, height, tiles) the smallest whose longer side is at least `side`, else the largest."""
    c = F.col
    fine = levels.where("level >= 0 and width > 0 and height > 0 and tiles > 0")
    long = F.greatest("width", "height")
    order = F.struct(long, -c("level"))
    return fine.groupBy(key).agg(F.coalesce(F.min_by("level", F.when(long >= side, F.struct(long, c("level")))), F.max_by("level", order)).alias("level"))


def imported(files: DataFrame, batch: str, order: str, content: str) -> DataFrame:
    """batch, name, sha256 of files under sequential names; batches with a file that could not be read (null content) are left out whole."""
    n = F.row_number().over(W.partitionBy(batch).orderBy(order))
    whole = F.min(F.col(content).isNotNull()).over(W.partitionBy(batch))
    named = files.withColumns({"_n": n, "_w": whole}).where("_w")
    return named.select(batch, F.concat(F.lpad(F.col("_n").cast("string"), 6, "0"), F.lit(".jpg")).alias("name"), F.sha2(content, 256).alias("sha256"))


def scene_options(request: Column) -> Column:
    """A scene request (protectPeople, smoothWater, model) with nothing but what is on: the empty string for none, so that a request without it has the same fingerprint."""
    parts = F.array(F.when(request["protectPeople"], "people"), F.when(request["smoothWater"], "water"), F.when(request["protectPeople"] | request["smoothWater"], request["model"]))
    return F.array_join(F.array_compact(parts), "+")


def ordered_log(events: DataFrame, log: str) -> DataFrame:
    """events (ts, sequence, added) of every log with their `place`: by time, then the job's own number (none last), then as they were added."""
    return events.withColumn("place", F.row_number().over(W.partitionBy(log).orderBy("ts", F.asc_nulls_last("sequence"), "added")))
