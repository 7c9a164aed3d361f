"""ChaCha20-Poly1305 (RFC 8439), for platforms whose Python has no cipher module: the blocks of many texts at once in numpy."""

from __future__ import annotations

import hmac

import numpy as np

U32 = np.uint32
#: The words "expand 32-byte k", Poly1305's clamp and prime, the bit above a whole block.
CONSTANT = np.frombuffer(b"expand 32-byte k", "<u4")
CLAMP, PRIME = 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF, (1 << 130) - 5
TOP = 1 << 128
#: How many blocks a state holds, which stays in a core's cache, and how many bytes of texts have their stream at once (a longer text alone).
BLOCKS, TEXTS = 2048, 4 << 20


def keystream(keys: np.ndarray, nonces: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """The 64 bytes of each block, a row a block; a block has a row of ``keys`` (8 words), one of ``nonces`` (3 words) and its counter."""
    out = np.empty((len(counters), 64), np.uint8)
    for at in range(0, len(counters), BLOCKS):
        here = slice(at, at + BLOCKS)
        n = len(counters[here])
        start = np.empty((16, n), U32)
        start[:4], start[4:12], start[12], start[13:] = CONSTANT[:, None], keys[here].T, counters[here], nonces[here].T
        a, b, c, d = (start[i : i + 4].copy() for i in (0, 4, 8, 12))  # a row of the state holds the same part of four quarter rounds
        high = np.empty_like(a)

        def add_turn(x: np.ndarray, y: np.ndarray, z: np.ndarray, by: int) -> None:
            """x += y; z ^= x; z turned to the left."""
            np.add(x, y, out=x)
            np.bitwise_xor(z, x, out=z)
            np.left_shift(z, U32(by), out=high)
            np.right_shift(z, U32(32 - by), out=z)
            np.bitwise_or(z, high, out=z)

        for k in range(20):
            for x, y, z, by in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                add_turn(x, y, z, by)
            way = 1 if k % 2 == 0 else -1  # the diagonals become columns, and back
            b, c, d = (np.concatenate([x[i:], x[:i]]) for x, i in ((b, way % 4), (c, 2), (d, -way % 4)))
        out[here] = (np.concatenate([a, b, c, d]) + start).T.astype("<u4", order="C").view(np.uint8)
    return out


def poly1305(key: bytes, data: bytes) -> bytes:
    r, s = int.from_bytes(key[:16], "little") & CLAMP, int.from_bytes(key[16:32], "little")
    total, number, full = 0, int.from_bytes, len(data) & ~15
    for at in range(0, full, 16):
        total = (total + number(data[at : at + 16], "little") + TOP) * r % PRIME
    if full < len(data):
        total = (total + number(data[full:] + b"\x01", "little")) * r % PRIME
    return ((total + s) & ((1 << 128) - 1)).to_bytes(16, "little")


def _tag(once: bytes, sealed: bytes, header: bytes) -> bytes:
    pad = lambda x: x + bytes(-len(x) % 16)
    return poly1305(once, pad(header) + pad(sealed) + len(header).to_bytes(8, "little") + len(sealed).to_bytes(8, "little"))


def _streams(keys: list[bytes], nonces: list[bytes], datas: list[bytes]):
    """(one-time key, data xor stream) of each text in turn; the blocks of many texts are made at once."""
    at = 0
    while at < len(datas):
        end, total = at, 0
        while end < len(datas) and (end == at or total + len(datas[end]) <= TEXTS):
            total += len(datas[end]) + 64
            end += 1
        size = np.array([len(x) for x in datas[at:end]], np.int64)
        blocks = 1 + -(-size // 64)  # block 0 is the one-time key's
        first = np.cumsum(blocks) - blocks
        row = np.repeat(np.arange(end - at), blocks)
        words = lambda xs, n: np.frombuffer(b"".join(xs), "<u4").reshape(-1, n)[row]
        counters = (np.arange(len(row)) - first[row]).astype(U32)
        stream = keystream(words(keys[at:end], 8), words(nonces[at:end], 3), counters).reshape(-1)
        for i in range(at, end):
            x, n = int(first[i - at]) * 64, len(datas[i])
            yield stream[x : x + 32].tobytes(), (np.frombuffer(datas[i], np.uint8) ^ stream[x + 64 : x + 64 + n]).tobytes()
        at = end


def seal_all(keys: list[bytes], nonces: list[bytes], datas: list[bytes], headers: list[bytes]) -> list[bytes]:
    """Nonce, sealed bytes and tag of each."""
    return [n + sealed + _tag(once, sealed, head) for n, head, (once, sealed) in zip(nonces, headers, _streams(keys, nonces, datas))]


def open_all(keys: list[bytes], stored: list[bytes], headers: list[bytes]) -> list[bytes | None]:
    """The data of each, or None if it doesn't authenticate."""
    sealed = [x[12:-16] for x in stored]
    made = _streams(keys, [x[:12] for x in stored], sealed)
    return [plain if hmac.compare_digest(_tag(once, x, head), whole[-16:]) else None for x, whole, head, (once, plain) in zip(sealed, stored, headers, made)]


def seal(key: bytes, nonce: bytes, data: bytes, header: bytes) -> bytes:
    """Nonce, sealed bytes and tag."""
    return seal_all([key], [nonce], [data], [header])[0]


def open_(key: bytes, stored: bytes, header: bytes) -> bytes | None:
    """The data, or None if it doesn't authenticate."""
    return open_all([key], [stored], [header])[0]
