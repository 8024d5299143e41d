"""Small literal tables in the stored schemas."""

from ripple import schema as sc


def fn(name, cls="C", params=""):
    return f"fn:com.acme.{cls}#{name}({params})"


def edge(src, dst, type="calls", inferred=False, confidence="exact", gv="g", site=("src/main/java/X.java", 1), reason=None):
    return ("r", gv, src, dst, type, inferred, confidence, [site] if site else [], reason)


def edges(spark, rows):
    return spark.createDataFrame(rows, sc.EDGES)


def surfaces(spark, rows):
    return spark.createDataFrame([("r", gv, key, kind, {}) for gv, key, kind in rows], sc.SURFACES)


def roots(spark, rows):
    """(root_id, gv, node, signature_compatible)"""
    return spark.createDataFrame([(r, g, n, c, g + ":head") for r, g, n, c in rows],
                                 "root_id string, gv string, node string, signature_compatible boolean, head_gv string")


def rowset(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)
