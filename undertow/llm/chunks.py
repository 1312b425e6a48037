"""Token ids of many texts by their chunks: cut where no token crosses, each different chunk encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


class ChunkCoder:
    """Texts to ids. ``cuts[x, y]`` tells whether a chunk ends between bytes x and y, ``prefix`` goes before each
    text that isn't empty, ``encode`` gives the ids of new chunks as bytes.

    The ids of the chunks of the last two generations stay in memory: ``most`` chunks each.
    """

    def __init__(self, cuts: np.ndarray, prefix: bytes, kind: str, encode: Callable[[list[bytes]], list[bytes]], most: int) -> None:
        self.cuts, self.prefix, self.kind, self.new, self.most = cuts, prefix, np.dtype(kind), encode, most
        self.kept: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        parts = [self.prefix + t if t else t for t in texts]
        data = b"".join(parts)
        if not data:
            return np.empty(0, self.kind), np.zeros(len(texts), np.int64)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        c = np.frombuffer(data, np.uint8)
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = self.cuts.ravel()[(c[:-1].astype(np.uint16) << 8) | c[1:]]
        cut[ends] = True
        at = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        ids = self._ids(chunks.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        begin = np.cumsum(size) - size
        which = chunks.indices.to_numpy()
        n = size[which]
        done = np.concatenate(([0], np.cumsum(n)))
        flat = np.frombuffer(b"".join(ids), self.kind)
        values = flat[np.repeat(begin[which] - done[:-1], n) + np.arange(done[-1])]
        upto = done[np.searchsorted(at, ends)]
        return values, np.diff(upto, prepend=0)

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        kept, old = self.kept, self.old
        out = list(map(kept.get, chunks))
        missing = [i for i, x in enumerate(out) if x is None]
        fresh = []
        for i in missing:
            if (x := old.get(chunks[i])) is None:
                fresh.append(i)
            else:
                out[i] = kept[chunks[i]] = x
        if fresh:
            for i, x in zip(fresh, self.new([chunks[i] for i in fresh]), strict=True):
                out[i] = x
                if len(chunks[i]) <= 64:
                    kept[chunks[i]] = x
        if len(kept) > self.most:
            self.kept, self.old = {}, kept
        return out
