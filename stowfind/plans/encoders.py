"""Named encoders for the semantic side of a search."""

from __future__ import annotations

from dataclasses import dataclass, field

from stowfind.operators.dense import BatchEncoder

SPARSE = "sparse-tags"
SPARSE_VERSION = 2


@dataclass
class Encoders:
    """Encoders by id; the sparse tag vectors are always there and are no batch encoder."""

    dense: dict[str, BatchEncoder] = field(default_factory=dict)

    def register(self, encoder: BatchEncoder) -> None:
        if encoder.id == SPARSE or encoder.id in self.dense:
            raise ValueError(f"encoder {encoder.id} exists already")
        self.dense[encoder.id] = encoder

    def ids(self) -> list[str]:
        return [SPARSE, *sorted(self.dense)]

    def identity(self, name: str) -> tuple[str, int]:
        """Provider id and version stored beside vectors."""
        if name == SPARSE:
            return SPARSE, SPARSE_VERSION
        if name not in self.dense:
            raise LookupError(f"no encoder {name}; known are {', '.join(self.ids())}")
        return self.dense[name].provider_id, self.dense[name].version
