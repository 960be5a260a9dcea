"""Hashes, keyed hashes, encryption and random codes as Column expressions."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import col, or_empty

LETTERS = "abcdefghijklmnopqrstuvwxyz"
# The characters of random codes, which leave out look-alikes, and the fixed initial vector of the compatible cipher.
CODE_CHARACTERS = "ABCDEFGHJKLMNPQRSTUVXWYZ123456789"
FIXED_IV = bytes([0x0B, 0x6E, 0x13, 0x2E, 0x31, 0xD2, 0xCD, 0xF7, 0x05, 0x36, 0x9C, 0xEA, 0xA8, 0x4C, 0x63, 0xCC])


def rot13(c: Column | str) -> Column:
    turned = LETTERS[13:] + LETTERS[:13]
    return F.translate(or_empty(c), LETTERS + LETTERS.upper(), turned + turned.upper())


def digest(c: Column | str, kind: str = "sha256") -> Column:
    """Hex digest of text or binary, the empty string included; kind: md5, sha1, sha256, sha384, sha512."""
    x = col(c)
    if kind == "md5":
        return F.md5(x)
    if kind == "sha1":
        return F.sha1(x)
    return F.sha2(x, int(kind.removeprefix("sha")))


def digest_base64(c: Column | str, kind: str = "sha256") -> Column:
    return F.base64(F.unhex(digest(c, kind)))


def md5_hex(c: Column | str) -> Column:
    """As digest(), but the empty string for null and empty input."""
    return F.when(or_empty(c) == "", "").otherwise(F.md5(col(c)))


def sha256_hex(c: Column | str) -> Column:
    return F.when(or_empty(c) == "", "").otherwise(F.sha2(col(c), 256))


def hmac_hex(c: Column | str, key: str | bytes, kind: str = "sha256") -> Column:
    """Keyed hash by the definition of HMAC over built-in hashes: no Python runs per row. Null and empty input give the empty string."""
    secret = key.encode() if isinstance(key, str) else key
    if not secret:
        raise ValueError("the key is empty")
    if kind not in ("sha1", "sha256"):
        raise ValueError("kind is sha1 or sha256")
    if len(secret) > 64:
        import hashlib

        secret = hashlib.new(kind, secret).digest()
    inner, outer = (bytes(b ^ pad for b in secret.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    text = F.encode(or_empty(c), "UTF-8")
    whole = digest(F.concat(F.lit(outer), F.unhex(digest(F.concat(F.lit(inner), text), kind))), kind)
    return F.when(or_empty(c) == "", "").otherwise(whole)


def legal_key(key: str) -> bytes:
    """A key of 16, 24 or 32 bytes: cut, or filled up with asterisks to the next of these lengths."""
    cut = key[:32]
    size = next(n for n in (16, 24, 32) if len(cut) <= n)
    return cut.encode().ljust(size, b"*")[: max(size, len(cut.encode()))]


def encrypted(c: Column | str, key: str, mode: str = "GCM") -> Column:
    """Base64 AES. GCM draws a fresh vector per row. CBC is the compatible form with the fixed vector, which Spark puts in front and we cut off; equal texts give equal results there."""
    secret, text = F.lit(legal_key(key)), F.encode(col(c), "UTF-8")
    if mode == "CBC":
        whole = F.aes_encrypt(text, secret, F.lit("CBC"), F.lit("PKCS"), F.lit(FIXED_IV))
        return F.base64(F.substring(whole, 17, 1 << 30))
    return F.base64(F.aes_encrypt(text, secret, F.lit("GCM")))


def decrypted(c: Column | str, key: str, mode: str = "GCM") -> Column:
    secret, data = F.lit(legal_key(key)), F.unbase64(col(c))
    if mode == "CBC":
        data = F.concat(F.lit(FIXED_IV), data)
        return F.decode(F.aes_decrypt(data, secret, F.lit("CBC"), F.lit("PKCS")), "UTF-8")
    return F.decode(F.aes_decrypt(data, secret, F.lit("GCM")), "UTF-8")


def random_code(length: int, characters: str = CODE_CHARACTERS, seed: int | None = None) -> Column:
    """A code of uniformly drawn characters for each row. For secrets use guid(), whose randomness is cryptographic."""
    if not characters:
        raise ValueError("no characters to draw from")
    draws = [F.rand() if seed is None else F.rand(seed + i) for i in range(length)]
    return F.concat(*(F.substring(F.lit(characters), F.floor(d * len(characters)).cast("int") + 1, F.lit(1)) for d in draws)) if length else F.lit("")


def random_bytes(length: int) -> Column:
    """Binary drawn from the bits of fresh GUIDs, whose 6 fixed bits are hashed away."""
    blocks = [F.unhex(F.sha2(F.concat(F.uuid(), F.uuid(), F.uuid()), 256)) for _ in range(-(-length // 32))]
    return F.substring(F.concat(*blocks), 1, length) if blocks else F.lit(b"")


def guid(dashes: bool = True) -> Column:
    return F.uuid() if dashes else F.replace(F.uuid(), F.lit("-"), F.lit(""))


def base64url(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()
