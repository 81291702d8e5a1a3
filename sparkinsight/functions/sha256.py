"""SHA-256 whose state can be put aside and taken up in another task.

``hashlib`` does not give out the state of a hash, so the same OpenSSL that it uses is called by way of its
own library.  Python builds that hide these functions still hash a stream within one task.
"""

from __future__ import annotations

import ctypes
import hashlib

import _hashlib
import pyarrow as pa

# Bytes of OpenSSL's SHA256_CTX: eight words of state, a bit count, one block and two counters, 32 bits each.
STATE_BYTES = 112


def _openssl():
    """The library with SHA256_Init, SHA256_Update and SHA256_Final, or None."""
    lib = ctypes.CDLL(getattr(_hashlib, "__file__", None))
    return lib if all(hasattr(lib, f"SHA256_{f}") for f in ("Init", "Update", "Final")) else None


def resumable() -> bool:
    return _openssl() is not None


class Sha256:
    def __init__(self, state: bytes | None = None):
        self._lib = _openssl()
        if self._lib is None:
            if state is not None:
                raise RuntimeError("this Python cannot take up the state of a SHA-256")
            self._plain = hashlib.sha256()
            return
        self._ctx = ctypes.create_string_buffer(state or b"", STATE_BYTES)
        if state is None:
            self._lib.SHA256_Init(self._ctx)

    def update(self, data: pa.Buffer) -> None:
        if self._lib is None:
            self._plain.update(data)
        elif data.size:
            self._lib.SHA256_Update(self._ctx, ctypes.c_void_p(data.address), ctypes.c_size_t(data.size))

    def state(self) -> bytes | None:
        return None if self._lib is None else self._ctx.raw

    def hexdigest(self) -> str:
        """The hash of the bytes so far; more may follow."""
        if self._lib is None:
            return self._plain.hexdigest()
        end, out = ctypes.create_string_buffer(self._ctx.raw, STATE_BYTES), ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(out, end)
        return out.raw.hex()


def take_up(batches):
    """Rows (key, content), sorted by key and then in the order of a stream: one row (key, state, hash) a key.

    ``begun`` marks the row, first of its key, that holds the state of the blocks before.
    """
    now, sha, first = None, None, True

    def out():
        return pa.RecordBatch.from_pydict({"key": [now], "state": pa.array([sha.state()], pa.binary()), "hash": [sha.hexdigest()]})

    for b in batches:
        content = b.column("content")
        for i, (key, begun) in enumerate(zip(b.column("key").to_pylist(), b.column("begun").to_pylist())):
            if first or key != now:
                if not first:
                    yield out()
                now, first, sha = key, False, Sha256(content[i].as_py() if begun else None)
            if not begun:
                sha.update(content[i].as_buffer())
    if not first:
        yield out()
