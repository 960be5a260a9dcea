"""Signed tokens (HS256): made and checked as Column expressions, so that a table of tokens is checked without Python."""

from __future__ import annotations

import hashlib
import hmac
import json
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.hashing import base64url, hmac_hex
from quern.functions.text import col


def issue(claims: dict, secret: str, minutes: int = 60, issuer: str | None = None, audience: str | None = None, now: float | None = None) -> str:
    """One token, on the driver."""
    at = int(time.time() if now is None else now)
    body = {**claims, "iat": at, "exp": at + 60 * minutes, "nbf": at} | ({"iss": issuer} if issuer else {}) | ({"aud": audience} if audience else {})
    signed = ".".join(base64url(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, body))
    return f"{signed}.{base64url(hmac.new(secret.encode(), signed.encode(), hashlib.sha256).digest())}"


def unpadded(c: Column) -> Column:
    """Decodes base64url without padding; null where it is broken."""
    plain = F.translate(c, "-_", "+/")
    return F.decode(F.call_function("try_to_binary", F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))), F.lit("base64")), "UTF-8")


def payload(token: Column | str) -> Column:
    """The claims as JSON text."""
    return unpadded(F.get(F.split(col(token), r"\."), F.lit(1)))


def claim(token: Column | str, name: str) -> Column:
    return F.get_json_object(payload(token), f"$.{name}")


def expires(token: Column | str) -> Column:
    return F.timestamp_seconds(claim(token, "exp").cast("long"))


def fault(token: Column | str, secret: str, issuer: str | None = None, audience: str | None = None, now: Column | None = None) -> Column:
    """Why a token is refused, null if it is good. exp and nbf count where present; issuer and audience only if both sides have them."""
    t = col(token)
    at = F.unix_timestamp() if now is None else now
    parts = F.split(t, r"\.")
    signed = F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    mark = F.rtrim(F.translate(F.base64(F.unhex(hmac_hex(signed, secret))), "+/", "-_"), F.lit("="))
    out = F.when(F.coalesce(t, F.lit("")) == "", "empty").when(F.size(parts) != 3, "format").when(F.get(parts, F.lit(2)) != mark, "signature")
    out = out.when(claim(t, "exp").cast("long") < at, "expired").when(claim(t, "nbf").cast("long") > at, "early")
    if issuer:
        out = out.when(claim(t, "iss") != issuer, "issuer")
    if audience:
        out = out.when(claim(t, "aud") != audience, "audience")
    return out


def is_valid(token: Column | str, secret: str, issuer: str | None = None, audience: str | None = None, now: Column | None = None) -> Column:
    return fault(token, secret, issuer, audience, now).isNull()


def refreshed(token: str, secret: str, minutes: int = 60, issuer: str | None = None, audience: str | None = None) -> str:
    """A new token with the claims of one whose signature holds."""
    signed, _, mark = token.rpartition(".")
    if mark != base64url(hmac.new(secret.encode(), signed.encode(), hashlib.sha256).digest()):
        raise ValueError("the token's signature does not hold")
    import base64

    body = signed.split(".")[1]
    claims = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
    return issue({k: v for k, v in claims.items() if k not in ("iat", "exp", "nbf", "iss", "aud")}, secret, minutes, issuer, audience)
