"""The engine's tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

_S = StringType()


def _of(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


FILES = _of(("repo_name", _S), ("path", _S), ("language", _S), ("content", _S), ("sha256", _S))
ENTITIES = _of(
    ("uuid", _S), ("name", _S), ("kind", _S), ("fqn", _S), ("signature", _S), ("docstring", _S), ("inline_comments", ArrayType(_S)), ("decorators", ArrayType(_S)),
    ("language", _S), ("file_path", _S), ("start_line", IntegerType()), ("end_line", IntegerType()), ("enclosing_class", _S), ("repo_name", _S), ("embed_text", _S),
)
INTENTS = _of(("repo_name", _S), ("src_uuid", _S), ("src_file", _S), ("src_enclosing_class", _S), ("seq", IntegerType()), ("intent_type", _S), ("target", _S), ("receiver", _S), ("line", IntegerType()))
EDGES = _of(("src_uuid", _S), ("dst_uuid", _S), ("rel_type", _S), ("repo_name", _S))  # the source's repository
VECTORS = _of(
    ("uuid", _S), ("repo_name", _S), ("embedding", ArrayType(FloatType())), ("name", _S), ("kind", _S), ("language", _S), ("file_path", _S), ("start_line", IntegerType()), ("signature", _S), ("docstring", _S),
)
STATE = _of(("repo_name", _S), ("path", _S), ("sha256", _S))

# The relations that intents resolve to.
RELATION = {
    "Call": "CALLS", "Extends": "EXTENDS", "Implements": "IMPLEMENTS", "TypeReference": "REFERENCES", "ValueReference": "REFERENCES", "DomElementReference": "REFERENCES_DOM",
    "CssClassUsage": "USES_CSS_CLASS", "HtmlFileImport": "IMPORTS_SCRIPT", "CssFileImport": "IMPORTS_STYLESHEET", "RustMacroCall": "MACRO_CALLS",
}
#: The relations that a reverse lookup covers unless told otherwise.
REFERENCE_RELATIONS = ("CALLS", "EXTENDS", "IMPLEMENTS", "REFERENCES")

