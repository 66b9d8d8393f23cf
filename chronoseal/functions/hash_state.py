"""SHA-256 with a state that can be saved, so that another task goes on with it.

``hashlib`` keeps its state to itself. The context of libcrypto, the library behind ``hashlib``, is a plain structure of
112 bytes and is used here through ``ctypes``.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools

# sizeof(SHA256_CTX): eight words, two counters, a block of sixteen words, two numbers.
CONTEXT_BYTES = 112


@functools.cache
def _library() -> ctypes.CDLL:
    import _hashlib

    for name in (_hashlib.__file__, ctypes.util.find_library("crypto")):
        try:
            found = ctypes.CDLL(name)
            found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
            found.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
            found.SHA256_Init.argtypes = [ctypes.c_void_p]
            return found
        except (OSError, AttributeError, TypeError):
            continue
    raise RuntimeError("libcrypto was not found: files above artifacts.WHOLE_BYTES cannot be hashed in splits")


class RunningSha256:
    """A hash that begins anew or from a saved state."""

    def __init__(self, saved: bytes | None = None) -> None:
        # Room beyond the structure, should another build have a longer one.
        self._context = ctypes.create_string_buffer(2 * CONTEXT_BYTES)
        if saved is None:
            _library().SHA256_Init(self._context)
        else:
            ctypes.memmove(self._context, saved, len(saved))

    def update(self, data: bytes) -> RunningSha256:
        _library().SHA256_Update(self._context, data, len(data))
        return self

    def saved(self) -> bytes:
        return self._context.raw

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), RunningSha256(self.saved())
        _library().SHA256_Final(out, last._context)
        return out.raw.hex()
