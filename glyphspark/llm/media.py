"""Media columns: baseline JPEG files, read by marker parsing and Huffman decoding in numpy.

A decoder of JPEG's entropy-coded data works bit by bit, but the segments
between restart markers don't depend on each other. All segments of a batch,
of whatever images, are decoded in step: in each step every segment takes one
Huffman symbol and its extra bits by table look-up. Only the DC coefficients
are kept; scaled by the quantiser they are the luminance thumbnail, one sample
for each 8 x 8 block.

The encoder writes an 8-bit grey image whose blocks are flat: with quantiser 8
a block's DC coefficient is its sample less 128, so that the thumbnail holds
the samples without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a unit of payload, which is one restart interval.
UNIT = 576
#: Blocks that a side of an image can have: sides are below 2**16 samples.
MOST = 65535 // 8
#: Bytes of payload that are encoded or decoded at once, and that one file holds; a longer payload takes several files, end to end.
BATCH = 1 << 22
PART = BATCH // UNIT * UNIT
#: ITU-T T.81, table K.3: codes of each length from 1 to 16 for luminance DC categories 0 to 11. Fixed values.
DC_LENGTHS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_VALUES = bytes(range(12))
#: One AC code, end of block, of one bit.
AC_LENGTHS, AC_VALUES = bytes([1] + [0] * 15), b"\0"


def codes(lengths: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """(value, code, bits) of a Huffman table, by the rule of T.81 annex C."""
    out, code, at = [], 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out.append((values[at], code, bits))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(lengths: bytes, values: bytes) -> np.ndarray:
    """For each 16 bits: the symbol they begin with, and 256 times its length; 0 if none."""
    table = np.zeros(1 << 16, np.int32)
    for value, code, bits in codes(lengths, values):
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | value
    return table


def shape(units: int) -> tuple[int, int]:
    """Width and height in blocks of an image of so many units; the width is in whole units."""
    wide = -(-units // MOST)
    if wide * UNIT > MOST:
        raise ValueError("a JPEG file can't hold more than 65535 x 65535 samples")
    return wide * UNIT, -(-units // wide)


def header(units: int) -> bytes:
    w, h = shape(units)
    quant = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64)
    frame = b"\xff\xc0" + struct.pack(">HBHHB3B", 11, 8, h * 8, w * 8, 1, 1, 0x11, 0)
    dc = b"\xff\xc4" + struct.pack(">HB", 19 + len(DC_VALUES), 0x00) + DC_LENGTHS + DC_VALUES
    ac = b"\xff\xc4" + struct.pack(">HB", 19 + len(AC_VALUES), 0x10) + AC_LENGTHS + AC_VALUES
    return b"\xff\xd8" + quant + frame + dc + ac + b"\xff\xdd" + struct.pack(">HH", 4, UNIT) + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0x00, 0, 63, 0)


_CODE = np.zeros(12, np.int64)
_BITS = np.zeros(12, np.int64)
for _v, _c, _b in codes(DC_LENGTHS, DC_VALUES):
    _CODE[_v], _BITS[_v] = _c, _b
_SIZE = np.array([int(abs(d)).bit_length() for d in range(-255, 256)], np.int64)


def encode_segments(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes of rows of UNIT samples, stuffed, and where each row's begin."""
    n = len(samples)
    dc = samples.astype(np.int16) - 128
    diff = np.diff(dc, axis=1, prepend=np.int16(0)).astype(np.int64)
    size = _SIZE[diff + 255]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    bits = _BITS[size] + size + 1
    word = (_CODE[size] << size | extra) << 1  # the code, the extra bits and the end of block, 0
    ends = np.cumsum(bits, axis=1)
    length = -(-ends[:, -1] // 8)
    starts = np.concatenate([[0], np.cumsum(length)])
    pad = length * 8 - ends[:, -1]
    at = starts[:n, None] * 8 + ends - bits
    word <<= 24 - (at & 7) - bits  # 15 bits at most, from bit 7 at the latest
    first = (at >> 3).ravel()
    word = word.ravel()
    out = np.zeros(int(starts[-1]) + 8)
    for j in range(3):
        out += np.bincount(first + j, weights=(word >> (16 - 8 * j)) & 255, minlength=len(out))
    out = out[: int(starts[-1])].astype(np.uint8)
    out[starts[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)  # pad with ones
    full = np.flatnonzero(out == 255)
    starts += np.searchsorted(full, starts)
    return np.insert(out, full + 1, 0), starts


def payload(text: bytes) -> bytes:
    """A text's bytes, filled up with 255 to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG file for each payload, a positive multiple of UNIT bytes.

    The last row of a wide image is filled up with 255.
    """
    filled, units = [], []
    for p in payloads:
        w, h = shape(len(p) // UNIT)
        filled.append(p.ljust(w * h, b"\xff"))
        units.append(w * h // UNIT)
    data, starts = encode_segments(np.frombuffer(b"".join(filled), np.uint8).reshape(-1, UNIT))
    data, at, out = data.tobytes(), 0, []
    for p, n in zip(payloads, units, strict=True):
        parts = [header(len(p) // UNIT)]
        cuts = starts[at : at + n + 1].tolist()
        for i in range(n):
            parts.append(data[cuts[i] : cuts[i + 1]])
            parts.append(b"\xff\xd9" if i == n - 1 else bytes([0xFF, 0xD0 + i % 8]))
        out.append(b"".join(parts))
        at += n
    return out


class Parsed:
    """What the markers of a baseline JPEG file say, and its entropy-coded segments."""

    def __init__(self, file: bytes, at: int = 0):
        if file[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quant, self.tables, self.restart, at = {}, {}, 0, at + 2
        while True:
            while file[at : at + 2] == b"\xff\xff":
                at += 1
            if file[at] != 0xFF:
                raise ValueError("a marker is missing")
            mark = file[at + 1]
            size = struct.unpack_from(">H", file, at + 2)[0]
            body = file[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif mark == 0xC0:
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("baseline JPEG has 8 bits a sample")
                self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif 0xC1 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline JPEG")
            elif mark == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif mark == 0xDA:
                break
        n = body[0]
        if n != len(self.parts):
            raise ValueError("scans of single components aren't read")
        scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
        self.luma = scan[0][0]
        #: For each block of a minimum coded unit: component, DC table, AC table. A scan of one component has one block.
        self.blocks = [(i, t >> 4, 0x10 | t & 15) for i, (c, t) in enumerate(scan) for _ in range(1 if n == 1 else self.parts[c][0] * self.parts[c][1])]
        self.h, self.v = (1, 1) if n == 1 else self.parts[self.luma][:2]
        most_h, most_v = (1, 1) if n == 1 else (max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values()))
        self.across, self.down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        self.thumb = (-(-self.height * self.v // (8 * most_v)), -(-self.width * self.h // (8 * most_h)))
        self.segments, self.units = [], []
        left = self.across * self.down
        while left > 0:
            end = at
            while True:
                end = file.find(b"\xff", end)
                if end < 0:
                    end = len(file)
                    break
                if file[end + 1 : end + 2] != b"\0":
                    break
                end += 2
            self.segments.append(file[at:end].replace(b"\xff\0", b"\xff"))
            self.units.append(min(left, self.restart or left))
            left -= self.units[-1]
            at = end + 2
            if left > 0 and not 0xD0 <= file[end + 1 : end + 2][0] <= 0xD7:
                raise ValueError("the scan ends early")
        self.end = at


def read_back(media: bytes, n: int) -> bytes:
    """The first n samples of the thumbnails of files that stand end to end."""
    at, out = 0, []
    while at < len(media):
        p = Parsed(media, at)
        out.append(decode_thumbnails([p])[0].tobytes()[: n - PART * len(out)])
        at = p.end
    return b"".join(out)


def decode_thumbnails(files: list[Parsed]) -> list[np.ndarray]:
    """The DC-only luminance thumbnails of parsed files, as 8-bit samples."""
    kinds: dict[tuple, int] = {}
    tables: list[np.ndarray] = []

    def table(spec: tuple[bytes, bytes]) -> int:
        if spec not in kinds:
            kinds[spec] = len(tables)
            tables.append(lookup(*spec))
        return kinds[spec]

    width = max(len(f.blocks) for f in files)
    dc_of, ac_of, part_of = (np.zeros((len(files), width), np.int32) for _ in range(3))
    for i, f in enumerate(files):
        for j, (part, dc, ac) in enumerate(f.blocks):
            dc_of[i, j], ac_of[i, j], part_of[i, j] = table(f.tables[dc]), table(f.tables[ac]), part
    look = np.concatenate(tables)
    image = np.repeat(np.arange(len(files)), [len(f.segments) for f in files])
    n_blocks = np.array([len(f.blocks) for f in files])[image]
    total = np.array([u for f in files for u in f.units]) * n_blocks
    segments = [s for f in files for s in f.segments]
    begin = np.concatenate([[0], np.cumsum([len(s) + 8 for s in segments])])
    data = np.frombuffer(b"".join(s + b"\xff" * 8 for s in segments), np.uint8).astype(np.uint32)
    words = np.zeros(len(data), np.uint32)  # the 32 bits from each byte
    words[:-4] = data[:-4] << 24 | data[1:-3] << 16 | data[2:-2] << 8 | data[3:-1]
    words = words.astype(np.int64)
    pos = begin[:-1] * 8
    limit = begin[1:] * 8 - 48
    out_at = np.concatenate([[0], np.cumsum(total)])
    coefs = np.zeros(out_at[-1], np.int32)
    dest, stop = out_at[:-1].copy(), out_at[1:]
    coef, block = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    pred = np.zeros((len(pos), 4), np.int32)
    lanes = np.arange(len(pos))
    while len(lanes):
        img, b = image[lanes], block
        is_dc = coef == 0
        which = np.where(is_dc, dc_of[img, b], ac_of[img, b])
        w = words[pos >> 3] << (pos & 7)
        hit = look[which << 16 | (w >> 16) & 0xFFFF]
        bits, symbol = hit >> 8, hit & 255
        if (bits == 0).any() or (pos > limit[lanes]).any():
            raise ValueError("the entropy-coded data is damaged")
        size = symbol & 15
        at = pos + bits
        w = words[at >> 3] << (at & 7)
        extra = ((w & 0xFFFFFFFF) >> (32 - size)) & ((1 << size) - 1)
        value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        pos = at + size
        if is_dc.any():
            k = lanes[is_dc]
            part = part_of[img[is_dc], b[is_dc]]
            pred[k, part] += value[is_dc].astype(np.int32)
            coefs[dest[k]] = pred[k, part]
        run = symbol >> 4
        coef = np.where(is_dc, 1, np.where(symbol == 0, 64, coef + run + 1))
        over = coef >= 64
        if over.any():
            dest[lanes[over]] += 1
            coef = np.where(over, 0, coef)
            block = np.where(over, (block + 1) % n_blocks[lanes], block)
            live = dest[lanes] < stop[lanes]
            if not live.all():
                lanes, pos, coef, block = lanes[live], pos[live], coef[live], block[live]
    thumbs, at = [], 0
    for f in files:
        n, m = f.across * f.down, len(f.blocks)
        dc = coefs[at : at + n * m].reshape(f.down, f.across, m)[:, :, : f.h * f.v]
        at += n * m
        grid = dc.reshape(f.down, f.across, f.v, f.h).transpose(0, 2, 1, 3).reshape(f.down * f.v, f.across * f.h)
        q = f.quant[f.parts[f.luma][2]]
        thumbs.append(np.clip((grid[: f.thumb[0], : f.thumb[1]] * q + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    return thumbs


def thumbnail_hash(thumb: np.ndarray) -> str:
    """A difference hash of 64 bits: the thumbnail as 8 rows of 9 means, each compared with its right neighbour."""
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), _cuts(thumb.shape[0], 8), axis=0), _cuts(thumb.shape[1], 9), axis=1)
    rows, cols = (np.diff(np.append(_cuts(n, k), n)).clip(1) for n, k in zip(thumb.shape, (8, 9), strict=True))
    means = sums / (rows[:, None] * cols[None, :])
    return f"{int.from_bytes(np.packbits(means[:, 1:] > means[:, :-1]).tobytes(), 'big'):016x}"


def _cuts(n: int, parts: int) -> np.ndarray:
    return np.minimum(np.arange(parts) * n // parts, n - 1)


def feature(file: Parsed, thumb: np.ndarray) -> str:
    return f"{file.width}x{file.height}:{thumbnail_hash(thumb)}"


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: bool = True) -> DataFrame:
    """Stores every text as a grey JPEG file, reads it back and describes it.

    The text's UTF-8 bytes, filled up with 255, are the thumbnail's samples in
    rows. Returns the id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (dimensions and thumbnail hash) and,
    with files=True, media. A null or empty text is one unit of 255s; an empty
    table gives no rows. A payload above PART bytes is stored as several files
    end to end, with their features joined by semicolons, so a text of any
    length is taken in parts of a bounded size. Equal texts give equal values;
    each row gives one row; other columns of df are not read.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def stored(parts: list[tuple[int, bytes]], rows: list[_Row]) -> None:
        files_ = encode([p for _, p in parts])
        parsed = [Parsed(f) for f in files_]
        for (i, p), f, q, thumb in zip(parts, files_, parsed, decode_thumbnails(parsed), strict=True):
            rows[i].take(f, thumb.tobytes()[: len(p)], feature(q, thumb), files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[_Row] = []
            held: list[tuple[int, bytes]] = []
            size = 0
            for i, t in enumerate(batch.column(1)):
                text = t.as_py() or b""
                rows.append(_Row(len(text)))
                whole = payload(text)
                for at in range(0, len(whole), PART):
                    part = whole[at : at + PART]
                    if held and size + len(part) > BATCH:
                        stored(held, rows)
                        held, size = [], 0
                    held.append((i, part))
                    size += len(part)
            if held:
                stored(held, rows)
            cols = [
                batch.column(0), pa.array([r.n_bytes for r in rows], pa.int64()), pa.array([r.payload_bytes for r in rows], pa.int64()), pa.array([r.payload_sha.hexdigest() for r in rows], pa.string()), pa.array([zlib.crc32(r.tail) for r in rows], pa.int64()),
                pa.array([r.media_bytes for r in rows], pa.int64()), pa.array([r.media_sha.hexdigest() for r in rows], pa.string()), pa.array([";".join(r.features) for r in rows], pa.string()),
            ]
            names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([b"".join(r.media) for r in rows], pa.binary())] * files, names=names + ["media"] * files)

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * files
    return df.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, schema)


class _Row:
    """What is known of a row's stored files and of what was read back from them."""

    def __init__(self, n_bytes: int):
        self.n_bytes, self.payload_bytes, self.media_bytes = n_bytes, 0, 0
        self.payload_sha, self.media_sha, self.tail = hashlib.sha256(), hashlib.sha256(), b""
        self.features, self.media = [], []

    def take(self, file: bytes, back: bytes, told: str, keep: bool) -> None:
        self.payload_bytes += len(back)
        self.media_bytes += len(file)
        self.payload_sha.update(back)
        self.media_sha.update(file)
        self.tail = (self.tail + back[-32:])[-32:]
        self.features.append(told)
        if keep:
            self.media.append(file)


def describe_media(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Width, height and thumbnail hash of a column of baseline JPEG files; null for null, and an error text for what can't be read."""
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f in batch.column(1).to_pylist():
                try:
                    p = Parsed(f) if f is not None else None
                    rows.append((p.width, p.height, thumbnail_hash(decode_thumbnails([p])[0]), None) if p else (None,) * 4)
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((None, None, None, str(e)))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, "width", "height", "thumbnail_hash", "error"])

    return df.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, width long, height long, thumbnail_hash string, error string")
