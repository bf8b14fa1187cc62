"""Unified diffs to pairs of code before and after, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T


def _side(ls: Column, drop: str, take: str, headers: bool) -> Column:
    """Lines of one side: without the other side's lines, with the marks removed.

    headers: whether lines of three marks are kept as context (whole-patch rule) or treated as any marked line (hunk rule).
    """
    other = lambda l: l.startswith(drop) & (~l.startswith(drop * 3) if headers else F.lit(True))
    own = lambda l: l.startswith(take) & (~l.startswith(take * 3) if headers else F.lit(True))
    kept = F.filter(ls, lambda l: ~l.startswith("@@") & ~other(l))
    plain = F.transform(kept, lambda l: F.when(own(l) | l.startswith(" "), F.substring(l, 2, 2_000_000_000)).otherwise(l))
    return T.strip(F.array_join(plain, "\n"))


def patch_sides(patch: Column) -> tuple[Column, Column]:
    """(before, after) of a whole patch; file headers are context."""
    ls = T.lines(patch)
    return _side(ls, "+", "-", True), _side(ls, "-", "+", True)


def hunks(patch: Column) -> Column:
    """Array of the patch's hunks; each begins with its @@ line, text before the first is one of its own."""
    return F.filter(F.split(patch, "(?m)^(?=@@)"), lambda h: h != "")


def hunk_sides(hunk: Column) -> tuple[Column, Column]:
    """(before, after) of one hunk."""
    ls = T.lines(F.regexp_replace(hunk, r"\n$", ""))
    return _side(ls, "+", "-", False), _side(ls, "-", "+", False)


def explode_pairs(df: DataFrame, patch: str, least: int = 8, most: int = 80) -> DataFrame:
    """One row per hunk whose sides differ and have `least` to `most` filled lines: other columns, hunk_no, before, after."""
    x = df.select(*(c for c in df.columns if c != patch), F.posexplode(hunks(F.col(patch))).alias("hunk_no", "_hunk"))
    before, after = hunk_sides(F.col("_hunk"))
    x = x.withColumns({"before": before, "after": after}).drop("_hunk")
    n = lambda c: F.size(T.filled_lines(F.col(c)))
    return x.where(n("before").between(least, most) & n("after").between(least, most) & (F.col("before") != F.col("after")))


COMMIT_SCHEMA = "repo string, sha string, commit struct<message: string>, files array<struct<filename: string, patch: string>>"


def commit_files(commits: DataFrame, denied: tuple[str, ...] = ()) -> DataFrame:
    """(repo, sha, message, filename, language, patch) of the source files of commits with a security message.

    commits: COMMIT_SCHEMA, as the service gives them; repeated commits count
    once, repositories in `denied` are left out, files without a patch or in
    another language too.
    """
    from corpuslens.functions import code as C

    x = commits.where(C.security_message(F.col("commit.message")) & ~F.coalesce(F.col("repo").isin(*denied), F.lit(False)))
    x = x.dropDuplicates(["repo", "sha"]).select("repo", "sha", F.col("commit.message").alias("message"), F.explode("files").alias("f"))
    x = x.select("repo", "sha", "message", "f.filename", C.language_of_path(F.lower("f.filename")).alias("language"), "f.patch")
    return x.where("language is not null and patch <> ''")


def labelled(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: the code before with label 1 and the code after with label 0."""
    rest = [c for c in pairs.columns if c not in ("before", "after")]
    sides = F.array(F.struct(F.lit(1).alias("label"), F.col("before").alias("code")), F.struct(F.lit(0).alias("label"), F.col("after").alias("code")))
    return pairs.select(*rest, F.explode(sides).alias("_s")).select(*rest, "_s.label", "_s.code")
