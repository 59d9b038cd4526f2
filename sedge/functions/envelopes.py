"""Messages under AES-256-GCM bound to their context, and keyed search tokens; all of it runs inside the JVM.

Keys become literals of the plan: who may read plans and event logs may read the keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from sedge.functions import text as T

IV_BYTES, TAG_BYTES, KEY_BYTES, GRAM = 12, 16, 32, 3


def _checked(keys: dict[str, bytes]) -> dict[str, bytes]:
    wrong = [v for v, k in keys.items() if len(k) != KEY_BYTES]
    if wrong or not keys:
        raise ValueError(f"keys must have {KEY_BYTES} bytes: {wrong or 'none given'}")
    return keys


def _key(version: Column, keys: dict[str, bytes]) -> Column:
    """The key of a version; null for an unknown one."""
    return reduce(lambda c, kv: c.when(version == kv[0], F.lit(bytearray(kv[1]))), keys.items(), F.when(F.lit(False), F.lit(bytearray())))


def _bound(context: list[Column], version: Column) -> Column:
    return F.concat_ws("|", *[c.cast("string") for c in context], version).cast("binary")


def sealed(x: Column, context: list[Column], keys: dict[str, bytes], active: str) -> Column:
    """struct(ciphertext, iv, authTag: base64; keyVersion) of a text; null for null. A new iv is drawn for each row."""
    if active not in _checked(keys):
        raise ValueError(f"no key for version {active}")
    version = F.lit(active)
    iv = F.unhex(F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 2 * IV_BYTES))
    raw = F.aes_encrypt(x.cast("binary"), _key(version, keys), F.lit("GCM"), F.lit("DEFAULT"), iv, _bound(context, version))

    def parts(b):
        body = F.octet_length(b) - IV_BYTES - TAG_BYTES
        cut = lambda at, n: F.base64(F.substring(b, at, n))
        return F.when(b.isNotNull(), F.struct(
            cut(F.lit(IV_BYTES + 1), body).alias("ciphertext"), cut(F.lit(1), F.lit(IV_BYTES)).alias("iv"),
            cut(F.lit(IV_BYTES + 1) + body, F.lit(TAG_BYTES)).alias("authTag"), version.alias("keyVersion"),
        ))

    return F.element_at(F.transform(F.array(raw), parts), 1)


def opened(envelope: Column, context: list[Column], keys: dict[str, bytes]) -> Column:
    """The text of an envelope; null if its key is unknown, a part has the wrong length, or it isn't authentic in this context."""
    _checked(keys)
    iv, tag, body = [F.try_to_binary(envelope[c], F.lit("base64")) for c in ("iv", "authTag", "ciphertext")]
    whole = (F.octet_length(iv) == IV_BYTES) & (F.octet_length(tag) == TAG_BYTES)
    version = envelope["keyVersion"]
    raw = F.try_aes_decrypt(F.concat(iv, body, tag), _key(version, keys), F.lit("GCM"), F.lit("DEFAULT"), _bound(context, version))
    return F.when(whole, raw.cast("string"))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text, from two plain digests; key has at most one block."""
    block = key.ljust(64, b"\0")
    pad = lambda v: F.lit(bytearray(b ^ v for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256))


def flat(x: Column) -> Column:
    """A text without case, diacritics and runs of white space."""
    return F.trim(F.regexp_replace(T.fold(x), r"\s+", " "))


def grams(x: Column) -> Column:
    """Different trigrams of a text without case, diacritics and runs of white space; a text of three or fewer is its own."""
    none = F.array().cast("array<string>")
    return T.let(flat(x), lambda f: F.when(F.length(f) == 0, none).when(F.length(f) <= GRAM, F.array(f)).otherwise(T.pieces(f, GRAM)))


def search_tokens(x: Column, key: bytes, version: str) -> Column:
    """The keyed tokens (base64url without padding) of a text's trigrams; null for null."""

    def token(g):
        digest = F.base64(hmac_sha256(F.concat(F.lit(f"message-search:{version}:"), g), key))
        return F.translate(digest, "+/=", "-_")

    return F.transform(grams(x), token)


def may_hold(tokens: Column, query: Column) -> Column:
    """Whether a row's tokens hold all of the query's; a query without tokens finds nothing."""
    return (F.size(query) > 0) & (F.size(F.array_except(query, tokens)) == 0)
