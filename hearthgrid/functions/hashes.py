"""Spark's ``xxhash64`` on arrays of states: each hash is the seed of the next one, as in ``F.xxhash64(a, b, ...)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

SEED = 42
#: Types of values that :func:`plain` and :func:`with_value` take.
TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BinaryType)

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    out = h << np.uint64(by)
    out |= h >> np.uint64(64 - by)
    return out


def _mixed(h: np.ndarray, into: np.ndarray, rotate: int, factor: np.uint64, plus: np.uint64) -> np.ndarray:
    h = h ^ into
    h = _rotated(h, rotate)
    h *= factor
    h += plus
    return h


def _finished(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def _word(value: int) -> np.ndarray:
    k = np.array([value & 0xFFFFFFFFFFFFFFFF], np.uint64)
    return _rotated(k * _P2, 31) * _P1


def with_value(state: np.ndarray, value: int | bytes | None, wide: bool = False) -> np.ndarray:
    """Hashes of one value by the seeds ``state``; ``wide`` numbers have 64 bits, others 32. NULL leaves the state."""
    if value is None:
        return state
    if isinstance(value, bytes):
        return _bytes(state, value)
    if wide:
        return _finished(_mixed(state + (_P5 + np.uint64(8)), _word(value), 27, _P1, _P4))
    return with_numbers(state, np.array([value]))


def with_numbers(state: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of 32-bit numbers, one for each seed or for all."""
    low = values.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    return _finished(_mixed(state + (_P5 + np.uint64(4)), low * _P1, 23, _P2, _P3))


def _bytes(state: np.ndarray, value: bytes) -> np.ndarray:
    at, end = 0, len(value)
    word = lambda i, n=8: int.from_bytes(value[i : i + n], "little")
    if end >= 32:
        lanes = [state + _P1 + _P2, state + _P2, state.copy(), state - _P1]
        while at + 32 <= end:
            lanes = [_rotated(v + np.array([word(at + 8 * k)], np.uint64) * _P2, 31) * _P1 for k, v in enumerate(lanes)]
            at += 32
        h = sum(_rotated(v, r) for v, r in zip(lanes, (1, 7, 12, 18), strict=True))
        for v in lanes:
            h ^= _rotated(v * _P2, 31) * _P1
            h *= _P1
            h += _P4
    else:
        h = state + _P5
    h += np.uint64(end)
    while at + 8 <= end:
        h, at = _mixed(h, _word(word(at)), 27, _P1, _P4), at + 8
    if at + 4 <= end:
        h, at = _mixed(h, np.array([word(at, 4)], np.uint64) * _P1, 23, _P2, _P3), at + 4
    for b in value[at:]:
        h ^= np.array([b], np.uint64) * _P5
        h = _rotated(h, 11)
        h *= _P1
    return _finished(h)


def plain(column: pa.Array) -> tuple[list, bool]:
    """Values of a column of one of ``TYPES`` as numbers or bytes, and whether its numbers have 64 bits."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return [None if v is None else v.encode() for v in column.to_pylist()], False
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return column.to_pylist(), False
    wide = pa.types.is_int64(kind) or pa.types.is_timestamp(kind)
    return column.cast(pa.int64() if wide else pa.int32()).to_pylist(), wide
