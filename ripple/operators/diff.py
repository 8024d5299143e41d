"""Change detection between two snapshots and unified-diff slicing."""

from pyspark.sql import DataFrame, functions as F

from ripple.functions.text import render_signature, visibility

FACTS = ["file_path", "start_line", "end_line", "body_hash", "return_type", "param_names", "modifiers"]
# Fixed value: the hunk header of a unified diff.
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def touched_files(name_status: DataFrame, include_old_paths: bool = False) -> DataFrame:
    """(analysis_id, text) -> distinct (analysis_id, file_path); a rename lists its new path."""
    line = name_status.select("analysis_id", F.explode(F.split("text", "\n")).alias("line"))
    fields = F.split(F.trim("line"), "\t")
    paths = F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0))) if include_old_paths else F.slice(fields, -1, 1)
    return (line.filter(F.trim("line") != "").select("analysis_id", F.explode(paths).alias("file_path"))
            .select("analysis_id", F.trim("file_path").alias("file_path"))
            .filter("file_path <> ''").distinct())


def changed_functions(base: DataFrame, head: DataFrame, touched: DataFrame | None, facts=FACTS) -> DataFrame:
    """Full outer diff on (analysis_id, function_key).

    ``base`` and ``head`` are function versions stamped with ``analysis_id``. Only the base side is
    narrowed to the touched files (``touched`` is None when both sides hold nothing else already).
    ``facts`` are what a change carries of each side, ``return_type`` and ``body_hash`` at least.
    """
    keys = ["analysis_id", "function_key"]
    pack = lambda df, side: df.select(*keys, F.struct(*facts).alias(side))
    b = pack(base if touched is None else base.join(touched, ["analysis_id", "file_path"], "left_semi"), "base")
    h = pack(head, "head")
    kind = (F.when(F.col("base").isNull(), "added").when(F.col("head").isNull(), "removed")
            .when(F.col("base.return_type") != F.col("head.return_type"), "signature_changed")
            .when(F.col("base.body_hash") != F.col("head.body_hash"), "modified"))
    return (b.join(h, keys, "full_outer").withColumn("change_kind", kind)
            .filter("change_kind IS NOT NULL").select(*keys, "change_kind", "base", "head"))


def signature_diff(changes: DataFrame) -> DataFrame:
    """Adds rendered signatures, change flags and caller compatibility to ``changed_functions`` rows."""
    both = F.col("base").isNotNull() & F.col("head").isNotNull()

    def shown(side):
        s = F.col(side)
        text = render_signature("function_key", s["return_type"], s["param_names"], s["modifiers"])
        return F.when(s.isNotNull(), text).otherwise("")

    ret = both & (F.col("base.return_type") != F.col("head.return_type"))
    vis = both & (visibility("base.modifiers") != visibility("head.modifiers"))
    return (changes.withColumn("base_signature", shown("base")).withColumn("head_signature", shown("head"))
            .withColumn("return_type_changed", F.coalesce(ret, F.lit(False))).withColumn("params_changed", F.lit(False))
            .withColumn("throws_added", F.array().cast("array<string>"))
            .withColumn("visibility_changed", F.coalesce(vis, F.lit(False)))
            .withColumn("signature_compatible", signature_compatible()))


def signature_compatible():
    return (F.col("change_kind") != "removed") & ~F.col("return_type_changed") & (F.size("throws_added") == 0)


def diff_hunks(texts: DataFrame) -> DataFrame:
    """(analysis_id, file_path, text) -> hunks; hunk 0 is the file header.

    Splitting is row-local (no shuffle): a text is cut in front of every line starting with '@@'. The added
    first line break keeps piece 0 the header even when the text starts with a hunk.
    """
    hunk = texts.select("analysis_id", "file_path", F.posexplode(
        F.split(F.concat(F.lit("\n"), F.col("text")), r"\n(?=@@)")).alias("hunk_no", "body"))
    # The four numbers of a header are taken out at once; a piece without a header has none.
    numbers = F.split(F.regexp_replace(F.regexp_extract("body", HUNK_HEADER, 0), HUNK_HEADER, "$1,$2,$3,$4"), ",")
    hunk = hunk.withColumn("_numbers", numbers)
    num = lambda i: F.coalesce(F.get("_numbers", F.lit(i - 1)), F.lit(""))
    length = lambda i: F.when(num(i) == "", 1).otherwise(num(i).try_cast("long"))
    old, new = num(1).try_cast("long"), num(3).try_cast("long")
    return hunk.select(
        "analysis_id", "file_path", "hunk_no", old.alias("old_start"), (old + length(2) - 1).alias("old_end"),
        new.alias("new_start"), (new + length(4) - 1).alias("new_end"),
        F.filter(F.split("body", "\n"), lambda x: x != "").alias("lines"))


def method_diffs(hunks: DataFrame, ranges: DataFrame, cap: int | None = None) -> DataFrame:
    """Hunks overlapping the base or head line range of each function, header first.

    ``ranges``: analysis_id, function_key, file_path, base_start, base_end, head_start, head_end. With ``cap`` a diff
    ends after so many lines and ``source_diff_truncated`` tells where that cut anything.
    """
    keys = ["analysis_id", "function_key"]
    overlap = lambda lo, hi, s, e: F.coalesce((F.col(lo) <= F.col(e)) & (F.col(s) <= F.col(hi)), F.lit(False))
    known = F.col("base_start").isNotNull() | F.col("head_start").isNotNull()
    hit = ((F.col("hunk_no") == 0) | overlap("old_start", "old_end", "base_start", "base_end")
           | overlap("new_start", "new_end", "head_start", "head_end"))
    kept = ranges.filter(known).join(hunks, ["analysis_id", "file_path"]).filter(hit)
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hunk_no", "lines"))), lambda x: x["lines"]))
    found = kept.groupBy(*keys).agg(lines.alias("lines"))
    text = lambda c: F.coalesce(F.array_join(c, "\n"), F.lit(""))
    out = ranges.select(*keys).join(found, keys, "left")
    if cap is None:
        return out.select(*keys, text(F.col("lines")).alias("source_diff"))
    return out.select(*keys, text(F.slice("lines", 1, cap)).alias("source_diff"),
                      F.coalesce(F.size("lines") > cap, F.lit(False)).alias("source_diff_truncated"))
