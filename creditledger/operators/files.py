"""Which files take part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditledger.functions.ignore import IgnoreRule, is_ignored
from creditledger.functions.paths import RULES, PathRules, in_skipped_directory, is_code_file
from creditledger.operators.dropped import Dropped
from creditledger.operators.joins import null_safe_join


def inventory(
    files: DataFrame,
    tracked: DataFrame | None = None,
    keys: Sequence[str] = ("path",),
    ignore_rules: Sequence[IgnoreRule] = (),
    path: str = "path",
    dropped: Dropped | None = None,
    rules: PathRules = RULES,
) -> DataFrame:
    """Code files that are neither in a skipped directory nor ignored, and tracked.

    `dropped` counts the rows left out: not_code, skipped_directory, ignored, untracked,
    each under the first of these that holds.
    """
    code, skipped = is_code_file(F.col(path), rules), in_skipped_directory(F.col(path), rules)
    ignored = is_ignored(F.col(path), list(ignore_rules)) if ignore_rules else F.lit(False)
    if dropped is not None:
        files = dropped.watch(files, not_code=~code, skipped_directory=code & skipped, ignored=code & ~skipped & ignored)
    kept = files.filter(code & ~skipped)
    if ignore_rules:
        kept = kept.filter(~ignored)
    if tracked is None:
        return kept
    if dropped is None:
        return tracked_only(kept, tracked, keys)
    found = tracked_only(dropped.watch(kept, untracked=F.lit(True)), tracked, keys)
    return dropped.watch(found, {"untracked": -1}, untracked=F.lit(True))


def tracked_only(files: DataFrame, tracked: DataFrame, keys: Sequence[str]) -> DataFrame:
    return null_safe_join(files, tracked.select(*keys), keys, "left_semi")


def at_revision(table: DataFrame, revision, column: str = "commit_id") -> DataFrame:
    """The rows of one revision; `column` is meant to be a partition column."""
    return table.filter(F.col(column) == F.lit(revision))


def touched_paths(
    manifest_to: DataFrame,
    manifest_from: DataFrame | None = None,
    keys: Sequence[str] = ("path",),
    content_id: str = "content_id",
) -> DataFrame:
    """Paths added, removed or changed between two manifests; without a first
    one, every path of the second. One row per path on either side, so the
    full outer join has no hot key."""
    if manifest_from is None:
        return manifest_to.select(*keys)
    # Named apart, as both may come from one table.
    old = manifest_from.select(*(F.col(k).alias(f"_old_{k}") for k in keys), F.col(content_id).alias("_old"))
    new = manifest_to.select(*(F.col(k).alias(f"_new_{k}") for k in keys), F.col(content_id).alias("_new"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}"))
    return (
        old.join(new, same, "full_outer")
        .filter(~F.col("_old").eqNullSafe(F.col("_new")))
        .select(*(F.coalesce(f"_old_{k}", f"_new_{k}").alias(k) for k in keys))
    )
