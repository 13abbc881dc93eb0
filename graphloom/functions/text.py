"""Scalar functions over names, comments and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are indexed, and the language each stands for. Case counts.
EXTENSIONS = {
    "java": "java", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "tsx": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "scss", "py": "python", "pyi": "python", "pyw": "python", "rs": "rust",
}


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name; empty if there is none."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def is_supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def language(path: Column) -> Column:
    """The language of the path's extension; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), extension(path))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


# What is taken off the lines of a comment, in this order.
MARKS = tuple((x, "") for x in (r"(?m)^[ \t\r]+|[ \t\r]+$", r"(?m)^/\*\*", r"(?m)^/\*", r"(?m)\*/$", r"(?m)^///", r"(?m)^//", r"(?m)^[ \t]*\*", r"(?m)^#"))


def strip_comment_markers(raw: Column) -> Column:
    """Each line without its comment marks, trimmed; empty lines are dropped.

    Marks go once each, in this order: /** or /*, a closing */, /// or //, *, #.
    """
    x = raw
    for mark, to in MARKS:
        x = F.regexp_replace(x, mark, to)
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[\t\r]", " "))), lambda s: s != ""), "\n")


def last_segment(name: Column) -> Column:
    """What follows the last dot, trimmed."""
    return F.trim(F.element_at(F.split(name, r"\."), -1))


def capitalised(name: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20))


def starts_upper(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n"), 1)


def embed_text(kind: Column, name: Column, decorators: Column, signature: Column, docstring: Column, comments: Column, file_path: Column, line: Column) -> Column:
    """The text that stands for an entity in the vector space; parts that are missing or blank leave no line."""
    some = lambda a: F.filter(a, lambda s: F.trim(s) != "")
    deco, com = some(F.coalesce(decorators, F.array().cast("array<string>"))), some(F.coalesce(comments, F.array().cast("array<string>")))
    doc = F.trim(docstring)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), kind, F.lit("] "), name),
        F.when(F.size(deco) > 0, F.concat(F.lit("Decorators: "), F.array_join(deco, ", "))),
        F.concat(F.lit("Signature: "), signature),
        F.when(doc != "", doc),
        F.when(F.size(com) > 0, F.concat(F.lit("Implementation context:\n"), F.array_join(F.transform(com, lambda s: F.trim(s)), "\n"))),
        F.concat(F.lit("File: "), file_path, F.lit(":"), line.cast("string")),
    )
