"""Keys for encrypted frames: a fixed key, a table or function by key id, or keys derived by HKDF-SHA-256."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from dataclasses import dataclass

from .errors import ConfigurationError, EncryptionKeyError


def hkdf(root: bytes, salt: bytes, info: bytes, size: int = 32) -> bytes:
    """HKDF-SHA-256 (RFC 5869)."""
    prk = hmac.new(salt or bytes(32), root, hashlib.sha256).digest()
    out, block = b"", b""
    for i in range(1, -(-size // 32) + 1):
        block = hmac.new(prk, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:size]


@dataclass(frozen=True)
class Keys:
    """``fixed`` with an optional id, a ``resolve`` function, or a ``root`` to derive from."""

    fixed: bytes | None = None
    fixed_id: str | None = None
    resolve: Callable[[str | None], bytes | None] | None = None
    root: bytes | None = None
    salt: bytes = b""

    def __post_init__(self):
        if sum(x is not None for x in (self.fixed, self.resolve, self.root)) != 1:
            raise ConfigurationError("one source of keys is wanted")
        if self.root is not None and len(self.root) < 16:
            raise ConfigurationError("a root key has at least 16 bytes")

    def get(self, key_id: str | None, size: int = 32) -> bytes:
        """The key of an id, of the algorithm's length."""
        if self.fixed is not None:
            if self.fixed_id is not None and key_id != self.fixed_id:
                raise EncryptionKeyError(f"no key is named {key_id}")
            key = self.fixed
        elif self.root is not None:
            if not key_id:
                raise EncryptionKeyError("derived keys need a key id")
            return hkdf(self.root, self.salt, key_id.encode(), size)
        else:
            try:
                key = self.resolve(key_id)
            except EncryptionKeyError:
                raise
            except Exception as e:
                raise EncryptionKeyError(f"the key of {key_id} can't be had: {e}") from e
        if not isinstance(key, (bytes, bytearray)):
            raise EncryptionKeyError(f"no key is named {key_id}")
        if len(key) != size:
            raise EncryptionKeyError(f"the key of {key_id} has {len(key)} bytes, not {size}")
        return bytes(key)
