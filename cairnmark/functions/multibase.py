"""Multibase text encodings of bytes, as plain functions and as Spark columns."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: name -> (prefix, encoder). Fixed values of the multibase table.
BASES = {
    "base16": ("f", lambda b: b.hex()),
    "base16upper": ("F", lambda b: b.hex().upper()),
    "base32": ("b", lambda b: base64.b32encode(b).decode().rstrip("=").lower()),
    "base32upper": ("B", lambda b: base64.b32encode(b).decode().rstrip("=")),
    "base64": ("m", lambda b: base64.b64encode(b).decode().rstrip("=")),
    "base64pad": ("M", lambda b: base64.b64encode(b).decode()),
    "base64url": ("u", lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")),
    "base64urlpad": ("U", lambda b: base64.urlsafe_b64encode(b).decode()),
}
_BY_PREFIX = {p: name for name, (p, _) in BASES.items()}
_ALPHABETS = {
    "base16": "0123456789abcdef", "base16upper": "0123456789ABCDEF",
    "base32": "abcdefghijklmnopqrstuvwxyz234567", "base32upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def encode(data: bytes, base: str = "base64url") -> str:
    prefix, enc = BASES[base]
    return prefix + enc(bytes(data))


def decode(text: str) -> bytes:
    """Bytes of a multibase string; left-over bits may be set, padding must be as the base asks."""
    if not text or text[0] not in _BY_PREFIX:
        raise ValueError("unknown multibase prefix")
    name, body = _BY_PREFIX[text[0]], text[1:]
    padded = name.endswith("pad")
    alphabet = _ALPHABETS[name.removesuffix("pad")]
    if padded:
        stripped = body.rstrip("=")
        if len(body) % 4 or len(body) - len(stripped) != -len(stripped) % 4:
            raise ValueError("wrong padding")
        body = stripped
    bits = (len(alphabet) - 1).bit_length()
    value = 0
    for c in body:
        at = alphabet.find(c)
        if at < 0:
            raise ValueError(f"bad character {c!r}")
        value = value << bits | at
    n = len(body) * bits
    if n % 8 >= bits:
        raise ValueError("incomplete byte")
    return (value >> n % 8).to_bytes(n // 8, "big")


def encode_column(data: Column, base: str = "base64url") -> Column:
    """Encodes a binary column with built-in functions; base 32 alone needs a pandas UDF."""
    prefix = F.lit(BASES[base][0])
    if base.startswith("base16"):
        text = F.hex(data) if base == "base16upper" else F.lower(F.hex(data))
    elif base.startswith("base64"):
        text = F.translate(F.base64(data), "+/\r\n", "-_" if "url" in base else "+/")  # Spark breaks lines
        text = text if base.endswith("pad") else F.rtrim(text, F.lit("="))
    else:

        @F.pandas_udf(T.StringType())
        def b32(s: pd.Series) -> pd.Series:
            return s.map(lambda b: None if b is None else BASES[base][1](bytes(b)))

        text = b32(data)
    return F.concat(prefix, text)


@F.pandas_udf(T.BinaryType())
def decode_column(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else decode(t))
