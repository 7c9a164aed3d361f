"""How frames are written and read. Contradictions are refused once, when the options are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import algorithms as A
from .errors import ConfigurationError
from .keys import Keys
from .limits import DEFAULT, Limits


@dataclass(frozen=True)
class Options:
    compression: str = "none"  #: none, deflate, brotli or a registered name
    level: int = 6
    checksum: str = "none"  #: none, crc32, xxh3, xxh128 or a registered name
    encryption: str = "none"  #: none, aes256gcm, chacha20poly1305 or a registered name
    keys: Keys | None = None
    key_id: str | None = None
    version: int = 1
    references: bool = False
    allow_v0: bool = False
    require_encryption: bool = False
    require_checksum: bool = False
    limits: Limits = DEFAULT
    custom: dict[str, object] = field(default_factory=dict)  #: name -> algorithm object

    def __post_init__(self):
        if self.version not in (0, 1):
            raise ConfigurationError(f"version {self.version} is not supported")
        for what, table in (("compression", A.COMPRESSION), ("checksum", A.CHECKSUM), ("encryption", A.ENCRYPTION)):
            name = getattr(self, what)
            if name not in table and not A.is_a(what, self.custom.get(name)):
                raise ConfigurationError(f"{name} is no {what} algorithm")
        for name, a in self.custom.items():
            if not name or len(name.encode()) > 256:
                raise ConfigurationError("a custom algorithm's name has 1 to 256 bytes")
            if A.is_a("checksum", a) and not 1 <= a.size <= 255:
                raise ConfigurationError(f"{name}: a checksum has 1 to 255 bytes")
        if self.encryption != "none" and self.keys is None:
            raise ConfigurationError("encryption needs keys")
        if self.require_encryption and (self.encryption == "none" or not A.authenticates(self.encryption, self.custom)):
            raise ConfigurationError("require_encryption needs an algorithm that authenticates the header")
        if self.require_checksum and self.checksum == "none":
            raise ConfigurationError("require_checksum needs a checksum algorithm")
        if (self.require_encryption or self.require_checksum) and (self.version == 0 or self.allow_v0):
            raise ConfigurationError("headerless payloads have no protection to require")
        if self.encryption != "none" and self.keys is not None and self.keys.fixed is not None and len(self.keys.fixed) != A.key_size(self.encryption, self.custom):
            raise ConfigurationError("the fixed key has the wrong length")
        if self.key_id is not None and len(self.key_id.encode()) > 256:
            raise ConfigurationError("a key id has at most 256 bytes")
        A.available("compression", self.compression)
        A.available("encryption", self.encryption)
