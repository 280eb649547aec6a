"""Scalar functions on names, stages, versions and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The families of progress stages, by prefix or name, the first that fits.
FAMILIES = [
    (("grid-component-pose-",), (), "optimize-grid-poses"),
    (("pixel-refinement-", "pixel-bundle-"), (), "refine-pixel-texture"),
    (("retry-matching-progress:", "clahe-retry-progress:"), ("retry-matching", "retry-feature-extraction", "clahe-retry"), "retry-neighbor-matching"),
    (("joint-cycle-prune-",), (), "prune-conflicting-neighbors"),
    (("source-plane-warp-",), (), "fit-local-texture-warp"),
]
# The share of the work that is done as a stage is reported.
PROGRESS = {"validation-complete": 0.04, "grid-overlap-complete": 0.06, "feature-extraction-complete": 0.08, "initial-matching-complete": 0.10, "clahe-retry": 0.12, "precision-recovery-start": 0.18, "registration-complete": 0.19}
BATCHES = {"retry-matching-progress:": 0.10, "clahe-retry-progress:": 0.12}
PREFIXES = {"grid-component-pose-": 0.15, "pixel-refinement-": 0.15, "pixel-bundle-": 0.15, "joint-cycle-prune-": 0.17, "source-plane-warp-": 0.18}
# Entities that a directory listing uses, in the order in which they are decoded.
ENTITIES = [("&amp;", "&"), ("&#x2F;", "/"), ("&#47;", "/"), ("&quot;", '"'), ("&#39;", "'")]
RESERVED = r"^(CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|COM[1-9¹²³]|LPT[1-9¹²³])$"


def stage_family(stage: Column) -> Column:
    out = None
    for prefixes, names, family in FAMILIES:
        fits = stage.isin(*names) if names else F.lit(False)
        for p in prefixes:
            fits = fits | stage.startswith(p)
        out = F.when(fits, family) if out is None else out.when(fits, family)
    return out.otherwise(stage)


def stage_progress(stage: Column) -> Column:
    """The share of the work done, or null for a stage that says nothing about it; batches advance by 0.02 as done / total."""
    out = F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])[stage]
    for prefix, start in BATCHES.items():
        done, total = (F.regexp_extract(stage, rf"^{prefix}(\d{{1,18}})/(\d{{1,18}})$", k).try_cast("long") for k in (1, 2))
        share = F.when((total > 0) & (done > 0) & (done <= total), start + 0.02 * (done / total))
        out = F.coalesce(out, share)
    for prefix, share in PREFIXES.items():
        out = F.coalesce(out, F.when(stage.startswith(prefix), share))
    return out


def without_markup(html: Column) -> Column:
    """Text between tags, entities decoded, trimmed."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_name(name: Column) -> Column:
    """name with what no file system takes as underscores."""
    return F.regexp_replace(F.trim(name), r'[\\/:*?"<>|\x00-\x1f]+', "_")


def is_valid_name(name: Column) -> Column:
    """Whether a base name may be given to a result: not empty, padded, too long, reserved or with characters that Windows refuses."""
    stem = F.upper(F.element_at(F.split(name, r"\."), 1))
    return (name == F.trim(name)) & ~name.isin("", ".", "..") & ~name.rlike(r'[\\/:*?"<>|\x00-\x1f]') & ~name.endswith(".") & ~stem.rlike(RESERVED) & (F.length(name) <= 180)


def version_key(version: Column) -> Column:
    """major, minor, patch and build of a version like v1.2.3+4 as an array that sorts like the version; null if it is none."""
    pattern = r"^v?(\d{1,9})\.(\d{1,9})\.(\d{1,9})(?:\+(\d{1,9}))?$"
    parts = [F.regexp_extract(version, pattern, k) for k in range(1, 5)]
    return F.when(version.rlike(pattern), F.array(*[F.when(p == "", "0").otherwise(p).cast("int") for p in parts]))


def is_camera(make: Column, model: Column, lens: Column, wanted: tuple[str, str, str]) -> Column:
    """Whether a photo's make, model (without blanks) and lens are those wanted, whatever their case."""
    up = lambda c: F.upper(F.trim(c))
    return F.coalesce((up(make) == wanted[0]) & (F.regexp_replace(up(model), r"\s+", "") == wanted[1]) & (up(lens) == wanted[2]), F.lit(False))


def local_date(ts: Column, month_first: bool = False) -> Column:
    return F.date_format(ts, "MM/dd/yyyy HH:mm" if month_first else "yyyy-MM-dd HH:mm")
