"""Deterministic identities as column expressions: no Python in the plan."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of entity ids. A fixed value.
NAMESPACE = uuid.UUID("6b6e6f74-2d69-6e64-6578-65722d763500")


def identity(repo: str, file_path: str, fqn: str) -> str:
    return f"{repo}:{file_path}:{fqn}"


def entity_uuid(repo: str, file_path: str, fqn: str) -> str:
    """UUID version 5 of the identity, on the driver or in a worker."""
    return str(uuid.uuid5(NAMESPACE, identity(repo, file_path, fqn)))


def uuid5(identity: Column) -> Column:
    """UUID version 5 of a string column in NAMESPACE; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(identity, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.when(identity.isNotNull(), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)))


def point_id(uuid_: Column) -> Column:
    """A uuid folded to 64 bits (high xor low): the signed integer of those bits, which read as unsigned is the point's number."""
    x = F.replace(F.lower(uuid_), F.lit("-"), F.lit(""))
    half = lambda at: F.conv(F.substring(x, at, 16), 16, -10).cast("long")
    return half(1).bitwiseXOR(half(17))
