"""Canonical text, HMAC chains and content hashes, evaluated inside the JVM.

Canonical JSON here means sorted keys, no spaces and ASCII-only escapes. Record
layouts have a fixed key order, so only strings need escaping and that is native.
Free-form metadata arrives as any JSON text and is normalised once, on write.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = 64


def _pads(key: str) -> tuple[bytes, bytes]:
    raw = key.encode()
    if len(raw) > _BLOCK:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC-SHA256 from two native sha2 calls around literal pads."""
    inner_pad, outer_pad = _pads(key)
    inner = F.sha2(F.concat(F.lit(bytearray(inner_pad)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer_pad)), F.unhex(inner)), 256)


def chained_hash(
    keyring: Mapping[str, str], key_id: Column, canonical: Column, prev_hash: Column
) -> Column:
    """HMAC under the record's own key; NULL when the key is unknown, so checks fail closed."""
    message = F.concat(canonical, F.coalesce(prev_hash, F.lit("")))
    out = F.lit(None).cast("string")
    for name, key in keyring.items():
        out = F.when(key_id == name, hmac_sha256(key, message)).otherwise(out)
    return out


def json_string(text: Column) -> Column:
    """A JSON string literal with every non-printable or non-ASCII character escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    for char, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    odd = F.array_distinct(F.regexp_extract_all(out, F.lit("([^ -~])"), F.lit(1)))
    escaped = F.aggregate(
        odd,
        out,
        lambda acc, ch: F.replace(
            acc,
            ch,
            F.regexp_replace(
                F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "([0-9a-f]{4})", "\\\\u$1"
            ),
        ),
    )
    body = F.when(out.rlike("[^ -~]"), escaped).otherwise(out)
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_object(fields: Mapping[str, Column], optional: Mapping[str, Column] | None = None) -> Column:
    """Object text with sorted keys. Values are JSON text; NULL `optional` values are left out."""
    optional = dict(optional or {})
    parts = []
    for name in sorted({*fields, *optional}):
        label = F.lit(json.dumps(name) + ":")
        if name in optional:
            parts.append(F.concat(label, optional[name]))
        else:
            parts.append(F.concat(label, F.coalesce(fields[name], F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Re-serialise any JSON text canonically; NULL for NULL or malformed text."""

    def one(value):
        if value is None:
            return None
        try:
            return json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), default=str)
        except ValueError:
            return None

    return text.map(one)


def hundredths(trust: Column) -> Column:
    """Trust as integer hundredths, half to even, so number formats cannot change a hash."""
    return F.rint(trust.cast("double") * 100).cast("bigint")


def canonical_record(
    content: Column,
    model: Column,
    dims: Column,
    trust: Column,
    memory_type: Column,
    key_id: Column,
    metadata: Column,
) -> Column:
    """Hash input of a record. `metadata` must already be canonical; empty is left out."""
    meta = F.when(metadata != "{}", metadata)
    return json_object(
        {
            "content": json_string(content),
            "embedding_dimensions": dims.cast("string"),
            "embedding_model": json_string(model),
            "key_id": json_string(key_id),
            "memory_type": json_string(memory_type),
            "trust_hundredths": hundredths(trust).cast("string"),
        },
        {"metadata": meta},
    )


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with offset; fractional seconds only when present."""
    stamp = ts.cast("timestamp")
    micros = F.unix_micros(stamp)
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(
        micros % 1_000_000 != 0, F.date_format(stamp, ".SSSSSS")
    ).otherwise(F.lit(""))
    return F.concat(whole, fraction, F.lit("+00:00"))


def canonical_state_event(
    event_type: Column,
    target: Column,
    successor: Column,
    reason: Column,
    valid_until: Column,
    key_id: Column,
) -> Column:
    return json_object(
        {
            "event_type": json_string(event_type),
            "target_memory_id": json_string(target.cast("string")),
            "successor_memory_id": json_string(successor.cast("string")),
            "reason": json_string(reason),
            "valid_until": json_string(iso_utc(valid_until)),
            "key_id": json_string(key_id),
        }
    )


def canonical_rule(
    rule_type: Column, parameters: Column, description: Column, applies_to: Column, created: Column
) -> Column:
    return json_object(
        {
            "rule_type": json_string(rule_type),
            "parameters": parameters,
            "description": json_string(description),
            "applies_to": json_string(applies_to),
            "created_at": json_string(iso_utc(created)),
        }
    )


def pattern_hash(contradiction: Column, type_a: Column, type_b: Column) -> Column:
    return F.sha2(
        F.concat_ws("\x1f", contradiction, F.least(type_a, type_b), F.greatest(type_a, type_b)), 256
    )


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) from a native sha1."""
    digest = F.sha1(
        F.concat(F.lit(bytearray.fromhex(namespace_hex)), F.encode(name, "UTF-8"))
    )
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
