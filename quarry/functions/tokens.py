"""Opaque hit tokens, made and checked on the driver."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import secrets


def issue(payload: dict, key: bytes) -> str:
    """A signed token of a payload; a random nonce makes each one different."""
    body = json.dumps({**payload, "nonce": secrets.token_hex(8)}, sort_keys=True, separators=(",", ":")).encode()
    mac = hmac.new(key, body, hashlib.sha256).digest()
    return base64.urlsafe_b64encode(mac + body).rstrip(b"=").decode()


def verify(token: str, key: bytes) -> dict | None:
    """The payload, or None for anything that this key did not sign."""
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
    except (ValueError, TypeError):
        return None
    mac, body = raw[:32], raw[32:]
    if not hmac.compare_digest(mac, hmac.new(key, body, hashlib.sha256).digest()):
        return None
    return {k: v for k, v in json.loads(body).items() if k != "nonce"}
