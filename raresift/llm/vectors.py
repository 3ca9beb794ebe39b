"""Arrow columns of vectors as whole numbers (shared by the vector operators)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_numbers(column: pa.Array, scale: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors hold only finite components, and floor(scale * x) of those.

    The second array has a row for each such vector, padded with zeros to the
    longest of them; numbers beyond ``limit`` become ``limit``."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is NaN
    odd = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    stop = np.cumsum(size)
    whole = (odd[stop] == odd[stop - size]) & ~column.is_null().to_numpy(zero_copy_only=False)
    kept = size[whole]
    out = np.zeros((len(kept), int(kept.max()) if len(kept) else 0), np.int64)
    at = np.repeat(np.arange(len(kept)), kept)
    place = np.arange(len(at)) - np.repeat(np.cumsum(kept) - kept, kept)
    with np.errstate(over="ignore"):
        number = np.floor(scale * x[np.repeat(whole, size)])
    out[at, place] = np.clip(number, -limit, limit).astype(np.int64)
    return whole, out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in 16 bits if they fit, else in 32."""
    fits = not x.size or (x.min() >= -(1 << 15) and x.max() < 1 << 15)
    return np.ascontiguousarray(x, "<i2" if fits else "<i4")


def packed(x: np.ndarray) -> bytes:
    return narrow(x).tobytes()


def unpacked(blob: bytes, rows: int, width: int) -> np.ndarray:
    """What ``packed`` made of an array of rows x width."""
    kind = "<i4" if rows * width and len(blob) == 4 * rows * width else "<i2"
    return np.frombuffer(blob, kind).reshape(rows, width)
