"""Word splitting shared by the operators that work on `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""

from __future__ import annotations

#: A-Z to a-z; every other ASCII byte that is no letter or digit to a space; bytes above ASCII stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def raw(value) -> bytes:
    """The bytes of an Arrow binary value; null is empty."""
    return value.as_buffer().to_pybytes() if value.is_valid else b""
