"""Content identifiers: version 1, content type, hash type, digest."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from . import multibase

# fixed values: codes of the multicodec table
RAW, DAG_CBOR, DAG_CBOR_UNRESTRICTED = 0x55, 0x71, 0x0171
IDENTITY, BLAKE2B_256 = 0x00, 0xB220
#: Contents up to so many bytes are their own digest.
INLINE_BYTES = 34


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, position after it); at most eight bytes, none of them needless."""
    value = 0
    for i in range(8):
        if at + i >= len(data):
            raise ValueError("varint is cut off")
        b = data[at + i]
        value |= (b & 0x7F) << (7 * i)
        if b < 0x80:
            if i and not b:
                raise ValueError("varint has a needless byte")
            return value, at + i + 1
    raise ValueError("varint is too long")


@dataclass(frozen=True, order=True)
class CID:
    """Orders bytewise, as Spark's BINARY does."""

    data: bytes

    @classmethod
    def calculate(cls, content_type: int, content: bytes, hash_type: int | None = None) -> CID:
        if hash_type is None:
            hash_type = IDENTITY if len(content) <= INLINE_BYTES else BLAKE2B_256
        digest = content if hash_type == IDENTITY else hashlib.blake2b(content, digest_size=32).digest()
        return cls(put_varint(1) + put_varint(content_type) + put_varint(hash_type) + put_varint(len(digest)) + digest)

    @classmethod
    def load(cls, data: bytes) -> tuple[CID, int]:
        """The CID at the start of data and its size; one leading 0 byte may stand before it."""
        data = bytes(data)
        start = at = 1 if data[:1] == b"\0" else 0
        version, at = get_varint(data, at)
        content_type, at = get_varint(data, at)
        hash_type, at = get_varint(data, at)
        n, at = get_varint(data, at)
        if version != 1 or content_type not in (RAW, DAG_CBOR, DAG_CBOR_UNRESTRICTED):
            raise ValueError("unsupported CID")
        if hash_type not in (IDENTITY, BLAKE2B_256) or hash_type == BLAKE2B_256 and n != 32:
            raise ValueError("unsupported hash")
        if at + n > len(data):
            raise ValueError("CID is cut off")
        return cls(data[start : at + n]), at + n

    @classmethod
    def from_bytes(cls, data: bytes) -> CID:
        cid, n = cls.load(data)
        if n != len(data):
            raise ValueError("bytes after the CID")
        return cid

    @classmethod
    def parse(cls, text: str) -> CID:
        return cls.from_bytes(multibase.decode(text))

    def _fields(self) -> tuple[int, int, bytes]:
        _, at = get_varint(self.data, 0)
        content_type, at = get_varint(self.data, at)
        hash_type, at = get_varint(self.data, at)
        _, at = get_varint(self.data, at)
        return content_type, hash_type, self.data[at:]

    @property
    def content_type(self) -> int:
        return self._fields()[0]

    @property
    def is_identity(self) -> bool:
        return self._fields()[1] == IDENTITY

    @property
    def hash_bytes(self) -> bytes:
        return self._fields()[2]

    def as_string(self, base: str = "base64url") -> str:
        return multibase.encode(self.data, base)

    def __str__(self) -> str:
        return self.as_string()
