"""What one frame may cost. Budgets are of a frame, never of a partition."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .errors import ConfigurationError, FormatError, LimitError

MIB = 1 << 20
MAX_INT = (1 << 31) - 1


@dataclass(frozen=True)
class Limits:
    # The defaults, so that the same frames are refused.
    max_depth: int = 512
    max_array_length: int = 1_000_000
    max_collection_length: int = 1_000_000
    max_dictionary_entries: int = 1_000_000
    max_string_bytes: int = 4_000_000
    max_byte_blob_bytes: int = 16_000_000
    max_total_elements: int = 10_000_000
    max_object_graph_nodes: int = 1_000_000
    max_keyed_fields: int = 1_000_000
    max_total_keyed_fields: int = 10_000_000
    max_payload_bytes: int = 64 * MIB
    max_compressed_bytes: int = 64 * MIB
    max_decompression_ratio: int = 10_000
    max_encrypted_bytes: int = 64 * MIB + 64 * 1024
    max_wire_bytes: int = 80 * MIB

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) <= 0:
                raise ConfigurationError(f"{f.name} must be positive")


DEFAULT = Limits()


class Budget:
    """What a frame has used so far."""

    __slots__ = ("depth", "elements", "keyed", "limits", "nodes")

    def __init__(self, limits: Limits = DEFAULT):
        self.limits = limits
        self.depth = self.elements = self.nodes = self.keyed = 0

    def enter(self) -> None:
        """One more level and one more node."""
        self.depth += 1
        if self.depth > self.limits.max_depth:
            raise LimitError(f"depth exceeds max_depth {self.limits.max_depth}")
        self.nodes += 1
        if self.nodes > self.limits.max_object_graph_nodes:
            raise LimitError(f"nodes exceed max_object_graph_nodes {self.limits.max_object_graph_nodes}")

    def leave(self) -> None:
        self.depth -= 1

    def count(self, n: int, limit: str) -> int:
        """A count of elements, checked before anything is read for it."""
        if n > getattr(self.limits, limit):
            raise LimitError(f"count {n} exceeds {limit} {getattr(self.limits, limit)}")
        self.elements += n
        if self.elements > self.limits.max_total_elements:
            raise LimitError(f"elements exceed max_total_elements {self.limits.max_total_elements}")
        return n

    def fields(self, n: int) -> int:
        if n > self.limits.max_keyed_fields:
            raise LimitError(f"{n} keyed fields exceed max_keyed_fields {self.limits.max_keyed_fields}")
        self.keyed += n
        if self.keyed > self.limits.max_total_keyed_fields:
            raise LimitError(f"keyed fields exceed max_total_keyed_fields {self.limits.max_total_keyed_fields}")
        return n

    def size(self, n: int, limit: str) -> int:
        if n < 0:
            raise FormatError("negative length")
        if n > getattr(self.limits, limit):
            raise LimitError(f"length {n} exceeds {limit} {getattr(self.limits, limit)}")
        return n
