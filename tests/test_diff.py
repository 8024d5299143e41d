from helpers import fn, rowset

from ripple.operators import diff

FV = "analysis_id string, function_key string, file_path string, start_line int, end_line int, body_hash string, return_type string, param_names array<string>, modifiers array<string>"


def fv(spark, rows):
    return spark.createDataFrame([("a", k, f, 1, 9, h, r, ["id"], m) for k, f, h, r, m in rows], FV)


def test_change_kinds(spark):
    base = fv(spark, [(fn("gone"), "A.java", "h", "int", []), (fn("sig"), "A.java", "h", "int", ["public"]), (fn("mod"), "A.java", "h", "int", []),
                      (fn("same"), "A.java", "h", "int", []), (fn("renamed"), "Old.java", "h", "int", [])])
    head = fv(spark, [(fn("new"), "A.java", "h", "int", []), (fn("sig"), "A.java", "h", "long", ["private"]), (fn("mod"), "A.java", "h2", "int", []),
                      (fn("same"), "A.java", "h", "int", ["final"]), (fn("renamed"), "New.java", "h", "int", [])])
    status = spark.createDataFrame([("a", "M\tA.java\n\nR100\tOld.java\tNew.java\n")], "analysis_id string, text string")
    touched = diff.touched_files(status)
    assert rowset(touched, "file_path") == [("A.java",), ("New.java",)]
    got = diff.signature_diff(diff.changed_functions(base, head, touched))
    assert rowset(got, "function_key", "change_kind", "signature_compatible") == sorted([
        (fn("gone"), "removed", False), (fn("sig"), "signature_changed", False), (fn("mod"), "modified", True), (fn("new"), "added", True), (fn("renamed"), "added", True)], key=str)
    sig = got.filter("change_kind = 'signature_changed'").first()
    assert (sig.base_signature, sig.head_signature, sig.return_type_changed, sig.visibility_changed) == ("public int sig()", "private long sig()", True, True)
    both = diff.touched_files(status, include_old_paths=True)
    assert "renamed" not in str(diff.changed_functions(base, head, both).select("function_key").collect())


HEADER = "diff --git a/Crate.java b/Crate.java\nindex 17aa..9c02 100644\n--- a/Crate.java\n+++ b/Crate.java"


def test_method_diffs(spark):
    cases = {
        "none": ("@@ -1,5 +1,5 @@\n", None, None), "base": ("@@ -1,3 +1,3 @@\n unrelated\n@@ -40,10 +40,12 @@\n-old line\n\n+new line", (41, 55), None),
        "head": ("@@ -1,3 +100,5 @@\n+added method", (1, 3), (100, 104)), "far": ("@@ -200,3 +200,3 @@\n far away", (1, 10), (1, 10)),
        "cap": ("@@ -1,300 +1,300 @@\n" + "\n".join(f" line{i}" for i in range(300)), (1, 300), None), "short": ("@@ -10 +10 @@\n-x\n+y", (10, 10), None),
        "empty": ("@@ -10,0 +11,2 @@\n+z", (10, 10), None)}
    texts = spark.createDataFrame([("a", k, f"{HEADER}\n{t}") for k, (t, _, _) in cases.items()], "analysis_id string, file_path string, text string")
    none = (None, None)
    ranges = spark.createDataFrame([("a", "fn:" + k, k, *(b or none), *(h or none)) for k, (_, b, h) in cases.items()],
                                   "analysis_id string, function_key string, file_path string, base_start int, base_end int, head_start int, head_end int")
    got = {r.function_key[3:]: r.source_diff for r in diff.method_diffs(diff.diff_hunks(texts), ranges).collect()}
    capped = {r.function_key[3:]: r for r in diff.method_diffs(diff.diff_hunks(texts), ranges, 50).collect()}
    assert got["none"] == "" and got["far"] == HEADER and got["empty"] == HEADER
    assert got["base"] == HEADER + "\n@@ -40,10 +40,12 @@\n-old line\n+new line"
    assert "+added method" in got["head"] and got["short"].endswith("-x\n+y") and len(got["cap"].split("\n")) == 305
    assert len(capped["cap"].source_diff.split("\n")) == 50 and [k for k, r in capped.items() if r.source_diff_truncated] == ["cap"]


def test_hunk_at_text_start(spark):
    t = spark.createDataFrame([("a", "f", "@@ -1 +1 @@\n-x")], "analysis_id string, file_path string, text string")
    assert rowset(diff.diff_hunks(t), "hunk_no", "old_start", "old_end") == [(0, None, None), (1, 1, 1)]
