"""Short keyed names for values: ``CLASS_`` and eight hex digits of BLAKE2s over ``class:value``.

Spark has no BLAKE2, so the digest is the one Python function of the library.  It sees Arrow
batches, hashes each distinct value of a batch once, and needs no shuffle.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST_BYTES = 4


def _digests(values: pa.Array, size: int) -> pa.Array:
    encoded = values.dictionary_encode()
    hashed = [
        None if v is None else hashlib.blake2s(v.encode("utf-8"), digest_size=size).hexdigest()
        for v in encoded.dictionary.to_pylist()
    ]
    return pa.array(hashed, pa.string()).take(encoded.indices)


def blake_hex(text: Column, size: int = DIGEST_BYTES) -> Column:
    """Hex digest of a text column; null stays null."""

    @F.arrow_udf("string")
    def digest(values: pa.Array) -> pa.Array:
        return _digests(values, size)

    return digest(text)


def blake_hex_list(texts: Column, size: int = DIGEST_BYTES) -> Column:
    """The same for every item of an array column."""

    @F.arrow_udf("array<string>")
    def digest(values: pa.Array) -> pa.Array:
        flat = _digests(values.flatten(), size)
        lengths = values.value_lengths().fill_null(0)
        offsets = pa.array([0] + lengths.to_numpy(zero_copy_only=False).cumsum().tolist(), pa.int32())
        return pa.ListArray.from_arrays(offsets, flat)

    return digest(texts)


def sha_hex(text: Column, size: int = DIGEST_BYTES) -> Column:
    """A digest with built-in functions only, for users who need not match existing pseudonyms."""
    return F.left(F.sha2(text, 256), F.lit(2 * size))


def sha_hex_list(texts: Column, size: int = DIGEST_BYTES) -> Column:
    """The same for every item of an array column."""
    return F.transform(texts, lambda t: F.left(F.sha2(t, 256), F.lit(2 * size)))
