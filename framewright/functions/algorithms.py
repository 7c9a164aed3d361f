"""Checksums, compression and encryption by id and name, and the surface for one's own.

A custom algorithm is any object with these members:

checksum      ``size`` (1 to 255) and ``compute(data) -> bytes``
compression   ``compress(data) -> bytes`` and ``decompress(data, size) -> bytes``
encryption    ``key_size``, ``authenticates`` (whether the header is bound), ``encrypt(data, key, header) -> bytes``,
              ``decrypt(data, key, header) -> bytes`` and ``stored_size(n) -> int``
"""

from __future__ import annotations

import importlib.util
import zlib

from .errors import ConfigurationError, FormatError, NotSupportedError

#: The ids that headers carry.
CUSTOM = 255
CHECKSUM = {"none": 0, "crc32": 1, "xxh3": 2, "xxh128": 3}
COMPRESSION = {"none": 0, "deflate": 1, "brotli": 2}
ENCRYPTION = {"none": 0, "aes256gcm": 1, "chacha20poly1305": 2}
CHECKSUM_SIZE = {1: 4, 2: 8, 3: 16}
LABEL = {
    "checksum": {0: "None", 1: "Crc32", 2: "XxHash3", 3: "XxHash128", 255: "Custom"},
    "compression": {0: "None", 1: "Deflate", 2: "Brotli", 255: "Custom"},
    "encryption": {0: "None", 1: "Aes256Gcm", 2: "ChaCha20Poly1305", 255: "Custom"},
}
MEMBERS = {"checksum": ("size", "compute"), "compression": ("compress", "decompress"), "encryption": ("key_size", "encrypt", "decrypt", "stored_size")}
NONCE, TAG = 12, 16


def is_a(what: str, algorithm: object) -> bool:
    return algorithm is not None and all(hasattr(algorithm, m) for m in MEMBERS[what])


def available(what: str, name: str) -> None:
    """Refuse what this platform lacks."""
    if what == "compression" and name == "brotli" and importlib.util.find_spec("brotli") is None:
        raise NotSupportedError("no brotli module is installed")


def authenticates(name: str, custom: dict) -> bool:
    return name in ("aes256gcm", "chacha20poly1305") or bool(getattr(custom.get(name), "authenticates", False))


def key_size(name: str, custom: dict) -> int:
    return 32 if name in ENCRYPTION else custom[name].key_size


def named(what: str, ident: int, name: str | None, custom: dict):
    """The registered algorithm that a header names."""
    found = custom.get(name)
    if not is_a(what, found):
        raise NotSupportedError(f"no {what} algorithm is registered as {name}")
    return found


def checksum(ident: int, data: bytes, name: str | None = None, custom: dict | None = None) -> bytes:
    if ident == 1:
        return zlib.crc32(data).to_bytes(4, "little")
    if ident in (2, 3):
        import xxhash

        return (xxhash.xxh3_64 if ident == 2 else xxhash.xxh3_128)(data).digest()
    a = named("checksum", ident, name, custom or {})
    out = a.compute(data)
    if len(out) != a.size:
        raise ConfigurationError(f"{name} made {len(out)} bytes, not {a.size}")
    return out


def compress(ident: int, data: bytes, level: int = 6, name: str | None = None, custom: dict | None = None) -> bytes:
    if ident == 1:
        # A window no larger than the data: setting up the full one costs more than small payloads do.
        bits = min(15, max(9, len(data).bit_length()))
        c = zlib.compressobj(level, zlib.DEFLATED, -bits, min(8, max(1, bits - 6)))
        return c.compress(data) + c.flush()
    if ident == 2:
        available("compression", "brotli")
        import brotli

        return brotli.compress(data, lgwin=22)
    return named("compression", ident, name, custom or {}).compress(data)


def decompress(ident: int, data: bytes, size: int, name: str | None = None, custom: dict | None = None) -> bytes:
    """Exactly ``size`` bytes, and no more memory than that."""
    if ident == 1:
        d = zlib.decompressobj(-15)
        try:
            out = d.decompress(data, size + 1)
            if len(out) <= size and not d.eof:
                out += d.flush()
        except zlib.error as e:
            raise FormatError(f"malformed compression: {e}") from e
        if not d.eof or d.unused_data:
            raise FormatError("the compressed bytes don't end where they should")
    elif ident == 2:
        available("compression", "brotli")
        import brotli

        d, out = brotli.Decompressor(), b""
        try:  # in steps, so that no more than the declared size is ever held
            for at in range(0, len(data), 1 << 12):
                out += d.process(data[at : at + (1 << 12)])
                if len(out) > size:
                    break
        except brotli.error as e:
            raise FormatError("malformed compression") from e
    else:
        try:
            out = named("compression", ident, name, custom or {}).decompress(data, size)
        except (ValueError, zlib.error) as e:
            raise FormatError(f"malformed compression: {e}") from e
    if len(out) != size:
        raise FormatError(f"{len(out)} bytes uncompressed, {size} declared")
    return out
