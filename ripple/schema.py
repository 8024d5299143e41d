"""Table schemas, closed vocabularies and trust ranks."""

from pyspark.sql import types as T

# Closed vocabularies of the data model.
NODE_KINDS = ["fn", "route", "job", "listener", "entity", "table", "unresolved"]
EDGE_TYPES = ["calls", "implements", "overrides", "handles", "triggers", "queries", "maps_to", "unresolved"]
SURFACE_KINDS = ["http_route", "scheduled_job", "message_listener", "entity", "table"]
CHANGE_KINDS = ["added", "removed", "modified", "signature_changed"]
VERSION_STATUS = ["building", "ready", "failed", "superseded"]
ANALYSIS_STATUS = ["queued", "cloning", "parsing", "traversing", "explaining", "ready", "failed", "superseded"]
# Position in this list is the trust rank: lower is more trusted.
CONFIDENCE_BY_RANK = ["exact", "single_impl", "regex", "ambiguous"]

REVERSE_TYPES = ["calls", "implements", "overrides"]
FORWARD_TYPES = ["calls"]
ENTRY_TYPES = ["handles", "triggers"]

DEPTH_CAP = 5
MAX_FILES = 500
CONTEXT_SCHEMA_VERSION = 1

S, I, L, D, B, TS = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
                     T.TimestampType())


def struct(**fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


STRINGS = T.ArrayType(S)
ATTRS = T.MapType(S, S)
CALL_SITE = struct(file_path=S, line=I)
CALL_SITES = T.ArrayType(CALL_SITE)
ANNOTATION = struct(name=S, values=ATTRS)
ANNOTATIONS = T.ArrayType(ANNOTATION)

FUNCTION_VERSIONS = struct(repo_id=S, graph_version_id=S, function_key=S, sha=S, file_path=S, start_line=I,
                           end_line=I, body_hash=S, return_type=S, param_names=STRINGS, modifiers=STRINGS,
                           annotations=ANNOTATIONS, is_abstract=B, is_interface_method=B)
SURFACES = struct(repo_id=S, graph_version_id=S, key=S, kind=S, attrs=ATTRS)
EDGES = struct(repo_id=S, graph_version_id=S, src=S, dst=S, type=S, inferred=B, confidence=S,
               call_sites=CALL_SITES, reason=S)
SECTIONS = struct(what_changed=S, who_is_affected=S, what_to_check=S)

# The extractor response document, named as it arrives.
WIRE = struct(
    requestId=S, sha=S, mode=S, sourceRoots=STRINGS,
    functions=T.ArrayType(struct(
        key=S, fqcn=S, className=S, methodName=S, paramTypes=STRINGS, paramNames=STRINGS, returnType=S,
        filePath=S, startLine=I, endLine=I, bodyHash=S, modifiers=STRINGS, annotations=ANNOTATIONS,
        isAbstract=B, isInterfaceMethod=B, unresolvedParamTypes=I)),
    surfaces=T.ArrayType(struct(key=S, kind=S, attrs=ATTRS)),
    edges=T.ArrayType(T.StructType([
        T.StructField("from", S), T.StructField("to", S), T.StructField("type", S),
        T.StructField("inferred", B), T.StructField("confidence", S),
        T.StructField("callSites", T.ArrayType(struct(filePath=S, line=I))),
        T.StructField("reason", S), T.StructField("candidates", STRINGS)])),
    diagnostics=struct(
        durationMs=L, filesParsed=L, parseErrors=T.ArrayType(struct(filePath=S, message=S)),
        totalEdges=L, unresolvedEdges=L, unresolvedRate=D, nonExternalUnresolvedRate=D, externalCalls=L,
        unresolvedParamTypes=L, ambiguousOverloads=STRINGS, failedDeclarations=L, guardedFailures=L,
        targetsMissingFromIndex=L))
