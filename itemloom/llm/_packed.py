"""Integer arrays packed into one binary value: bytes of equal weight side by side, then zstd."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join([len(arrays).to_bytes(8, "little"), *(len(a).to_bytes(8, "little") for a in arrays), *(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def spread(packed: bytes) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    count = int.from_bytes(raw[:8], "little")
    lengths = [int.from_bytes(raw[8 * i + 8 : 8 * i + 16], "little") for i in range(count)]
    at, out = 8 + 8 * count, []
    for n in lengths:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).reshape(-1).view(np.int64))
        at += 8 * n
    return out


def fold(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of what stands with each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[head], *(np.add.reduceat(s[order], head) if len(keys) else s for s in sums))
