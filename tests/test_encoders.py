import pytest

from stowfind.operators.dense import BatchEncoder
from stowfind.plans.encoders import SPARSE, Encoders


def test_registry():
    known = Encoders()
    assert known.ids() == [SPARSE] and known.identity(SPARSE) == (SPARSE, 2)
    encoder = BatchEncoder("letters", 3, len, 2)
    known.register(encoder)
    assert known.identity("letters") == (encoder.provider_id, 3)
    for repeated in (encoder, BatchEncoder(SPARSE, 1, len, 2)):
        with pytest.raises(ValueError):
            known.register(repeated)
    with pytest.raises(LookupError):
        known.identity("missing")
