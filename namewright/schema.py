"""Explicit schemas of every table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _d = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_a = T.ArrayType(T.StringType())


def _of(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Kinds of identifiers, in rising precedence where one id is listed under several.
ID_TYPES = ["ClassName", "MethodName", "ParameterName", "FieldName", "VariableName"]
#: Kinds of renames and the identifier kinds they stand for.
RENAME_KINDS = {"Class": "ClassName", "Method": "MethodName", "Attribute": "FieldName", "Parameter": "ParameterName", "Variable": "VariableName"}
#: Relation labels that each kind of identifier may carry.
ALLOWED_RELATIONS = {
    "ClassName": ["subclass", "subsubclass", "parents", "ancestor", "methods", "fields", "type", "comment"],
    "MethodName": ["type", "siblings", "comment", "enclosingClass", "parameter", "assignment", "parameterArgument", "methodInvocated"],
    "FieldName": ["type", "siblings", "comment", "enclosingClass", "assignment", "methodInvocated", "parameterArgument"],
    "ParameterName": ["type", "comment", "parameterArgument", "enclosingMethod", "argument", "assignment", "methodInvocated"],
    "VariableName": ["type", "methodInvocated", "comment", "enclosingMethod", "enclosingClass", "parameterArgument", "assignment"],
}
#: Relations in the order of an identifier table's columns.
RELATIONS = ["subclass", "subsubclass", "parents", "ancestor", "methods", "fields", "siblings", "comment", "type", "enclosingClass", "assignment", "methodInvocated", "parameterArgument", "parameter", "enclosingMethod", "argument"]

IDENTIFIERS = _of(snapshot=_s, id=_s, file=_s, line=_i, name=_s, id_type=_s)
EXPANDED = T.StructType(IDENTIFIERS.fields + _of(words=_a, delims=_a, cases=_a, patterns=_a, heuristics=_a, expanded=_a, postags=_a, normalized=_a).fields)
EDGES = _of(snapshot=_s, src=_s, rel=_s, dst=_s)
RENAMES = _of(commit=_s, idx=_l, file=_s, line=_i, id_type=_s, old_name=_s, new_name=_s)
COMMITS = _of(commit=_s, author=_s, ts=T.TimestampType(), seq=_l)
OPERATION = _of(op=_s, kind=_s, old_words=_a, new_words=_a)
RECOMMENDATIONS = _of(commit=_s, idx=_l, mode=_s, id=_s, file=_s, line=_i, id_type=_s, name=_s, new_name=_s, rank=_i)
LOCATION = _of(filePath=_s, startLine=_i, codeElement=_s)
GOLD = _of(commit=_s, oldname=_s, newname=_s, renameType=_s, type=_s, location=_of(old=_s, new=_s), leftSideLocations=T.ArrayType(LOCATION), rightSideLocations=T.ArrayType(LOCATION))
MINER_V2 = _of(commits=T.ArrayType(_of(sha1=_s, refactorings=T.ArrayType(_of(type=_s, description=_s, leftSideLocations=T.ArrayType(LOCATION), rightSideLocations=T.ArrayType(LOCATION))))))
MINER_V1 = _of(name=_s, commitId=_s, parameters=T.MapType(_s, _s))
METRICS = _of(commit=_s, renames=_l, description=_s, mode=_s, precision=_d, recall=_d, fscore=_d, exact=_d)
