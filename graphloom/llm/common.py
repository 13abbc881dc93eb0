"""What the operators for training data share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension -> dialect, for the languages that have a grammar. Fixed values.
CODE = {
    "py": "python", "pyi": "python", "pyw": "python", "java": "java", "kt": "kotlin", "kts": "kotlin-script", "ts": "typescript", "cts": "typescript", "mts": "typescript", "tsx": "typescript-jsx",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript-jsx", "rs": "rust",
}


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public tokenizers' files are; TOKENIZERS_DIR moves it."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, least: int = 24) -> int:
    """Tasks for CPU-bound stages: more than the session's shuffle partitions are not needed, few are unbalanced."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def language_of(path: Column) -> Column:
    """The dialect of a path's extension (language, or language-dialect); null where there is no grammar."""
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    out = F.lit(None).cast("string")
    for e, lang in CODE.items():
        out = F.when(ext == e, F.lit(lang)).otherwise(out)
    return out


def spread(df: DataFrame, content: str, key: str, n: int, salts: int = 16) -> DataFrame:
    """Rows over `n` tasks so that equal contents mostly meet (a worker's cache then does them once).

    A content that fills a third of all rows still goes to up to `salts` tasks.
    """
    return df.repartition(n, F.xxhash64(content), F.pmod(F.xxhash64(key), F.lit(salts)))
