"""Media columns as baseline JPEG: bytes are stored as the DC terms of 8 x 8 luminance blocks.

With a DC quantizer of 8 the DC term of a flat block is its sample less 128, so a block holds one byte without loss and
the DC-only thumbnail of the image is the payload. A tile is 24 blocks wide with one restart interval per block row;
payloads beyond 341 x 576 bytes take several tiles one after another. The reader parses markers of any baseline
stream and decodes Huffman-coded scans for all restart intervals at once, column by column, in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .shingles import arrow_rows

UNIT, ROW = 576, 24
TILE_ROWS = 341 * ROW
TILE = TILE_ROWS * ROW
# fixed values of the JPEG standard (T.81, table K.3): code lengths and categories of luminance DC differences
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
#: AC table with end-of-block alone, one bit long.
AC_BITS, AC_VALUES = [1] + [0] * 15, [0]


def canonical(bits: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(value, code, length) of a Huffman table given as in DHT."""
    out, code, k = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((values[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(bits: list[int], values: list[int]) -> np.ndarray:
    """By the next 16 bits: value * 32 + code length (0: no code)."""
    t = np.zeros(1 << 16, np.int32)
    for v, code, length in canonical(bits, values):
        t[code << (16 - length) : (code + 1) << (16 - length)] = v * 32 + length
    return t


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([8] + [1] * 63))
_TAIL = (
    _segment(0xC4, bytes([0x00, *DC_BITS, *DC_VALUES])) + _segment(0xC4, bytes([0x10, *AC_BITS, *AC_VALUES]))
    + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
#: By DC difference + 255: code with its extra bits and the end-of-block bit, and their number.
_CODE, _LENGTH = np.zeros(511, np.uint32), np.zeros(511, np.int64)
for _v, _c, _l in canonical(DC_BITS, DC_VALUES):
    for _d in range(-255, 256):
        if abs(_d).bit_length() == _v:
            _extra = _d if _d >= 0 else _d + (1 << _v) - 1
            _CODE[_d + 255], _LENGTH[_d + 255] = ((_c << _v) | _extra) << 1, _l + _v + 1


def _entropy_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of every row of samples (rows, 24), and how many of them; filled with 1 bits."""
    v = samples.astype(np.int16)
    d = np.diff(v, axis=1, prepend=np.int16(128)) + 255
    code, length = _CODE[d].astype(np.uint64), _LENGTH[d]
    ends = np.cumsum(length, axis=1)
    n = (ends[:, -1] + 7) >> 3
    width = ROW * 15 // 8 + 8
    out = np.zeros((len(v), width), np.uint8)
    flat, base = out.reshape(-1), np.arange(len(v), dtype=np.int64) * width
    for j in range(ROW):
        start = ends[:, j] - length[:, j]
        at = base + (start >> 3)
        x = code[:, j] << (24 - (start & 7) - length[:, j]).astype(np.uint64)
        flat[at] |= (x >> np.uint64(16)).astype(np.uint8)
        flat[at + 1] |= (x >> np.uint64(8)).astype(np.uint8)
        flat[at + 2] |= x.astype(np.uint8)
    fill = (n << 3) - ends[:, -1]
    flat[base + n - 1] |= ((1 << fill) - 1).astype(np.uint8)
    return out, n


def encode(payloads: list[bytes]) -> list[bytes]:
    """JPEG streams of payloads whose sizes are positive multiples of 576."""
    rows, n = _entropy_rows(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW))
    # stuffed: a 0 after each 255; then a restart marker after each row
    inside = np.arange(rows.shape[1]) < n[:, None]
    data = rows[inside]
    row_of = np.repeat(np.arange(len(n)), n)
    full = data == 0xFF
    size = n + np.bincount(row_of[full], minlength=len(n)) + 2
    ends = np.cumsum(size)
    place = np.arange(len(data)) + np.concatenate([[0], np.cumsum(full)[:-1]]) + 2 * row_of
    stream = np.zeros(int(ends[-1]), np.uint8)
    stream[place] = data
    stream[ends - 2] = 0xFF
    out, row = [], 0
    for p in payloads:
        tiles, left = [], len(p) // ROW
        while left:
            k = min(left, TILE_ROWS)
            stream[ends[row : row + k] - 1] = 0xD0 + np.arange(k) % 8
            first = int(ends[row] - size[row])
            frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * k, 8 * ROW, 1, 1, 0x11, 0))
            tiles.append(_HEAD + frame + _TAIL + stream[first : int(ends[row + k - 1]) - 2].tobytes() + b"\xff\xd9")
            row, left = row + k, left - k
        out.append(b"".join(tiles))
    return out


class Frame:
    """What the markers of one baseline image say."""

    __slots__ = ("height", "width", "parts", "quant", "dc", "ac", "restart", "scan")


def parse(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """The image that starts at `at`, and where it ends. Raises ValueError on what is no baseline image of one scan."""
    try:
        return _parse(data, at)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"broken marker: {e}") from e


def _parse(data: bytes, at: int) -> tuple[Frame, int]:
    f = Frame()
    f.quant, f.dc, f.ac, f.restart, f.parts, f.scan = {}, {}, {}, 0, [], b""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            if not f.parts or any(len(p) < 6 or p[4] not in f.dc or p[5] not in f.ac or p[3] not in f.quant for p in f.parts):
                raise ValueError("no scan, or a scan without its tables")
            return f, at + 2
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                f.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                k = sum(body[1:17])
                (f.ac if body[0] >> 4 else f.dc)[body[0] & 15] = (body[1:17], body[17 : 17 + k])
                body = body[17 + k :]
        elif marker == 0xC0:
            _, f.height, f.width, k = struct.unpack_from(">BHHB", body)
            f.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            (f.restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            if f.scan or body[0] != len(f.parts):
                raise ValueError("components in separate scans")
            tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            f.parts = [(*p, *tables[p[0]]) for p in f.parts]
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("scan without an end")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            f.scan, at = data[at:end], end


def _restart_segments(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of scans without stuffing and markers, and where each restart interval starts in them."""
    full = np.flatnonzero(scan[:-1] == 0xFF)
    marks = full[(scan[full + 1] & 0xF8) == 0xD0]
    keep = np.ones(len(scan), bool)
    keep[full[scan[full + 1] == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    before = np.cumsum(keep)
    return scan[keep], np.concatenate([[0], before[marks]])


def luminance(frames: list[Frame]) -> list[np.ndarray]:
    """DC-only luminance thumbnails, one sample per 8 x 8 block, of frames with the same tables and sampling."""
    head = frames[0]
    tall, wide = max(p[2] for p in head.parts), max(p[1] for p in head.parts)
    if len(head.parts) == 1:
        tall = wide = 1
    tables = {}
    for p in head.parts:
        for kind, k in ((0, p[4]), (1, p[5])):
            bits, values = (head.dc, head.ac)[kind][k]
            tables[kind, k] = lookup(list(bits), list(values))
    data, starts, units, shape = [], [], [], []
    offset = 0
    for f in frames:
        across, down = -(-f.width // (8 * wide)), -(-f.height // (8 * tall))
        own, first = _restart_segments(np.frombuffer(f.scan, np.uint8))
        step = f.restart or across * down
        units.append(np.minimum(step, across * down - step * np.arange(len(first))))
        if step * len(first) < across * down:
            raise ValueError("restart intervals are missing")
        data.append(own)
        starts.append(first + offset)
        offset += len(own)
        shape.append((down, across, step, len(first)))
    raw = np.concatenate([*data, np.full(16, 255, np.uint8)])
    word = np.zeros(len(raw) - 7, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | raw[i : len(raw) - 7 + i]
    pos = np.concatenate(starts).astype(np.int64) * 8
    units = np.concatenate(units)
    limit = (len(word) - 1) * 8
    n, most = len(pos), int(units.max())
    h, v = (1, 1) if len(head.parts) == 1 else (head.parts[0][1], head.parts[0][2])
    dc = np.zeros((n, most, v * h), np.int32)
    last = {p[0]: np.zeros(n, np.int32) for p in head.parts}

    def code(at: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value, code length, and the 57 bits or more that follow the position, left-aligned."""
        w = word[at >> 3] << (at & 7).astype(np.uint64)
        found = t[(w >> np.uint64(48)).astype(np.int64)]
        return found >> 5, found & 31, w

    for j in range(most):
        live = np.flatnonzero(units > j)
        whole = len(live) == n
        at = pos if whole else pos[live]
        for p in head.parts:
            for b in range(1 if len(head.parts) == 1 else p[1] * p[2]):
                cat, length, w = code(at, tables[0, p[4]])
                if not length.all():
                    raise ValueError("bad code in a scan")
                c64 = cat.astype(np.uint64)
                extra = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - c64)).astype(np.int64)
                diff = np.where(extra < (np.int64(1) << cat.astype(np.int64)) >> 1, extra - (np.int64(1) << cat.astype(np.int64)) + 1, extra)
                at = at + length + cat
                if whole:
                    last[p[0]] += diff.astype(np.int32)
                    now = last[p[0]]
                else:
                    last[p[0]][live] += diff.astype(np.int32)
                    now = last[p[0]][live]
                if p is head.parts[0]:
                    dc[live, j, b] = now
                # AC terms are read past
                k, open_ = np.ones(len(at), np.int64), np.arange(len(at))
                while len(open_):
                    rs, length, _ = code(np.minimum(at[open_], limit), tables[1, p[5]])
                    if not length.all():
                        raise ValueError("bad code in a scan")
                    at[open_] += length + (rs & 15)
                    k[open_] = np.where(rs == 0, 64, k[open_] + (rs >> 4) + 1)
                    open_ = open_[k[open_] < 64]
        at = np.minimum(at, limit)
        if whole:
            pos = at
        else:
            pos[live] = at
    q = head.quant[head.parts[0][3]]
    value = np.clip(np.floor_divide(dc * q + 4, 8) + 128, 0, 255).astype(np.uint8)
    out, row = [], 0
    for f, (down, across, step, k) in zip(frames, shape, strict=True):
        flat = np.concatenate([value[row + i, : min(step, down * across - i * step)] for i in range(k)]) if step != across else value[row : row + k, :across].reshape(-1, v * h)
        row += k
        grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        # blocks that only fill the last units up belong to no pixel
        out.append(grid[: -(-f.height * v // (8 * tall)), : -(-f.width * h // (8 * wide))])
    return out


def decode(streams: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, thumbnail) of each stream; tiles of a stream are set one under another.

    Tiles with the same tables are decoded together.
    """
    tiles, groups = [], {}
    for i, s in enumerate(streams):
        at = 0
        while at < len(s):
            f, at = parse(s, at)
            groups.setdefault((tuple(f.parts), *(tuple(sorted(t.items())) for t in (f.quant, f.dc, f.ac))), []).append(len(tiles))
            tiles.append([i, f, None])
    for own in groups.values():
        for k, thumb in zip(own, luminance([tiles[k][1] for k in own]), strict=True):
            tiles[k][2] = thumb
    out = [[0, 0, []] for _ in streams]
    for i, f, thumb in tiles:
        out[i][0], out[i][1] = f.width, out[i][1] + f.height
        out[i][2].append(thumb)
    return [(w, h, t[0] if len(t) == 1 else np.concatenate(t)) for w, h, t in out]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which cells of an 8 x 8 grid are brighter than the grid's mean."""
    rows = np.add.reduceat(thumb, np.arange(8) * len(thumb) // 8, axis=0, dtype=np.int64)
    grid = np.add.reduceat(rows, np.arange(8) * thumb.shape[1] // 8, axis=1)
    count = np.diff(np.append(np.arange(8) * len(thumb) // 8, len(thumb)))[:, None] * np.diff(np.append(np.arange(8) * thumb.shape[1] // 8, thumb.shape[1]))[None]
    mean = grid / count
    return np.packbits((mean > mean.mean()).reshape(-1)).tobytes().hex()


def payload(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


CHUNK = 1 << 20
SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def features(texts: list[bytes | None], keep: bool = False) -> list[tuple]:
    """A row of SCHEMA for each text, and its stored form if asked for. Features come from the bytes read back."""
    full = [payload(t or b"") for t in texts]
    media = encode(full)
    out = []
    for t, m, (w, h, thumb) in zip(texts, media, decode(media), strict=True):
        back = thumb.tobytes()
        row = (len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{w}x{h}:{thumbnail_hash(thumb)}", w, h)
        out.append((*row, m) if keep else row)
    return out


def media_features(docs: DataFrame, keep_media: bool = False, text: str = "text") -> DataFrame:
    """doc_id and media features of every row of docs; with keep_media also `media`, the JPEG bytes.

    Null and empty texts are one unit of padding; texts of any length are stored whole, a bounded number of bytes at
    a time; repeated rows give equal values; other columns are ignored; an empty table gives no rows.
    """
    source = docs.select("doc_id", F.col(text).cast("binary").alias("data"))
    fields = [x.split() for x in (SCHEMA + (", media binary" if keep_media else "")).split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        for batch in batches:
            held, size = [], 0

            def flush(held):
                rows = features([x for _, x in held], keep_media)
                columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], batch.schema.field(0).type), *columns], ["doc_id", *[n for n, _ in fields]])

            for doc_id, data in arrow_rows([batch], 0, 1):
                held.append((doc_id, data))
                size += len(data or b"")
                if size >= CHUNK or len(held) >= 1024:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, " + SCHEMA + (", media binary" if keep_media else ""))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents")).drop("width", "height")
