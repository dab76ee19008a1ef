"""Content identities: framed SHA-256 in the JVM, canonical JSON on the driver."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How identities are marked.
ID_PREFIX, ID_DIGITS, FULL_IMAGE = "di_", 16, "full_image_v1"


def _framed(part: Column) -> Column:
    raw = F.encode(part.cast("string"), "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw)


def hash_join(*parts: Column) -> Column:
    """SHA-256 over parts that each follow their length in 8 bytes, so that no two lists of parts meet."""
    return F.sha2(F.concat(*(_framed(p) for p in parts)), 256)


def instance_key(image_sha: Column, box_key: Column, detector_signature: Column, occurrence: Column) -> Column:
    return hash_join(image_sha, box_key, detector_signature, occurrence.cast("string"))


def image_key(image_sha: Column) -> Column:
    return hash_join(image_sha, F.lit(FULL_IMAGE))


def instance_id(path: Column, key: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), F.substring(hash_join(path, key), 1, ID_DIGITS))


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def sha256_json(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def require_digest(actual: str, expected: str | None, label: str) -> None:
    """Nothing is asked for where the expected digest is blank."""
    from ..errors import ConfigurationError

    wanted = (expected or "").strip().lower()
    if not wanted:
        return
    if len(wanted) != 64 or set(wanted) - set("0123456789abcdef"):
        raise ConfigurationError(f"{label}: the expected SHA-256 must be 64 hexadecimal digits")
    if wanted != actual:
        raise ConfigurationError(f"{label}: its SHA-256 differs from the expected one")
