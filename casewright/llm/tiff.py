"""TIFF images as media columns: decoding to a row a page, and a lossless store.

`pages` walks the chain of image directories and decodes strips and tiles that
are raw or packed with PackBits, LZW or deflate, undoes horizontal predictors,
and yields one page a directory: 8-bit samples, chunky or planar. `encode`
writes such files. Bytes are handled a file at a time within Arrow batches, so
memory is bound by the largest file: a page that claims more samples than its
bytes could unpack to is refused before anything is made.

`store` cuts bytes into pages of PAGE_ROWS rows at most, and gives each page the
one of LAYOUTS that a checksum of the bytes and the page's number name, so that
every packing, predictor and tiling takes part in what is stored and read back.

Defined cases: a null text is empty, padded to one row of pixels; null media and
those whose directories can't be followed give one row with `error` and no
samples, after the pages before; so does each page that can't be decoded, also
for want of bytes, and the pages after it are read; equal bytes give equal
rows; an empty table gives no rows; only the named columns are read.
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

RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Tag numbers of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
#: The store pads to rows of this many bytes: 64 pixels of three samples.
ROW, PIXELS = 192, 64
_STRIP_ROWS = 256
#: Rows of a stored page, and how pages are packed: compression, predictor, tile, rows of a strip.
PAGE_ROWS = 512
LAYOUTS = ((DEFLATE, 2, 0, 256), (LZW, 1, 0, 128), (DEFLATE, 2, 64, 0), (PACKBITS, 1, 0, 64), (RAW, 2, 64, 0), (DEFLATE, 1, 0, 512), (PACKBITS, 2, 32, 0), (DEFLATE, 2, 0, 32))
#: The most bytes that a byte can unpack to, by compression; of raw ones a few missing are told where they are read.
_GROWTH = {RAW: 64, LZW: 2560, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of equal bytes as a run each, what lies between as it is; both of 128 at most."""
    if not data:
        return b""
    x = np.frombuffer(data, np.uint8)
    cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
    length = np.diff(cut)
    out, plain = bytearray(), 0  # plain: where what isn't packed yet begins

    def literal(end: int) -> None:
        for k in range(plain, end, 128):
            n = min(128, end - k)
            out.append(n - 1)
            out.extend(data[k : k + n])

    for i in np.flatnonzero(length > 2).tolist():
        at, n = int(cut[i]), int(length[i])
        literal(at)
        for k in range(0, n, 128):
            m = min(128, n - k)
            out.extend((257 - m, data[at]) if m > 1 else (0, data[at]))
        plain = at + n
    literal(len(data))
    return bytes(out)


#: How many codes of a table have 9, 10 and 11 bits; all later ones have 12.
_LZW_RUNS = ((9, 254), (10, 512), (11, 1024))
_CLEAR, _END, _FULL = 256, 257, 4095


def _lzw_codes(bits: np.ndarray, at: int) -> Iterator[list[int]]:
    """Codes from a bit on, as long as no table is cleared; wider ones one code early."""
    for width, count in (*_LZW_RUNS, *((12, 4096) for _ in range(len(bits) // (12 * 4096) + 1))):
        n = min(count, (len(bits) - at) // width)
        if n <= 0:
            return
        yield (bits[at : at + n * width].reshape(n, width) @ (1 << np.arange(width - 1, -1, -1))).tolist()
        at += n * width


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit on."""
    bits, at, out = np.unpackbits(np.frombuffer(data, np.uint8)), 0, []
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    while at < len(bits):
        table, last, k, cleared = single[:], b"", 0, False
        for codes in _lzw_codes(bits, at):
            for code in codes:
                k += 1
                if code >= _CLEAR and code <= _END:
                    cleared = True
                    break
                if code < len(table):
                    entry = table[code]
                elif last and code == len(table):
                    entry = last + last[:1]
                else:
                    raise ValueError("LZW code out of order")
                out.append(entry)
                if last:
                    table.append(last + entry[:1])
                last = entry
            if cleared:
                break
        if not cleared or code == _END:
            break
        for width, count in (*_LZW_RUNS, (12, k)):  # the bits of the k codes up to the cleared table
            n = min(k, count)
            at, k = at + n * width, k - n
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    codes, table, free = [_CLEAR], {}, 258
    get, put = table.get, codes.append
    prefix = data[0] if data else None
    for byte in data[1:]:
        key = prefix << 8 | byte
        code = get(key)
        if code is None:
            put(prefix)
            table[key] = free
            free += 1
            if free == _FULL:
                put(_CLEAR)
                table.clear()
                free = 258
            prefix = byte
        else:
            prefix = code
    if prefix is not None:
        put(prefix)
    put(_END)
    x = np.array(codes, np.int64)
    # a code's bits follow from how many codes there were since the last cleared table
    clear = np.maximum.accumulate(np.where(np.concatenate(([True], x[:-1] == _CLEAR)), np.arange(len(x)), 0))
    free_then = 258 + np.arange(len(x)) - clear
    width = 9 + (free_then >= 512) + (free_then >= 1024) + (free_then >= 2048)
    wide = np.unpackbits((x << (16 - width)).astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(wide[np.arange(16) < width[:, None]]).tobytes()


def _inflate(data: bytes, most: int) -> bytes:
    """At most so many bytes; what is cut short gives what there is."""
    return zlib.decompressobj().decompress(data, most)


_UNPACK = {RAW: lambda b, n: bytes(b), LZW: lambda b, n: unpack_lzw(b), DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: lambda b, n: unpack_bits(b)}
_PACK = {RAW: bytes, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """The byte order, and the integer values of each tag, for each directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            size = _SIZE.get(kind, 1) * count
            where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            if kind in _CODE and (size <= 4 or where + size <= len(data)):  # a page that needs what isn't there fails by itself
                tags[tag] = list(struct.unpack_from(f"{order}{count}{_CODE[kind]}", data, where))
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _block(raw: bytes, compression: int, predictor: int, rows: int, width: int, samples: int) -> np.ndarray:
    """A strip or tile as rows x width x samples."""
    if compression not in _UNPACK:
        raise ValueError(f"compression {compression} isn't supported")
    need = rows * width * samples
    data = np.frombuffer(_UNPACK[compression](raw, need), np.uint8)
    if len(data) < need:
        raise ValueError(f"a strip or tile has {len(data)} of {need} bytes")
    block = data[:need].reshape(rows, width, samples)
    return np.cumsum(block, axis=1, dtype=np.uint8) if predictor == 2 else block


def decode(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    """The samples of a directory's page: height x width x samples, 8 bits each."""
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not width or not height or not samples or min(width, height, samples) < 0:
        raise ValueError("a page has no samples")
    if any(b != 8 for b in tags.get(BITS, [1])):
        raise ValueError("samples aren't of 8 bits")
    compression, predictor, planes = one(COMPRESSION, 1), one(PREDICTOR, 1), samples if one(PLANAR, 1) == 2 else 1
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} isn't supported")
    depth = samples // planes
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not bw or not bh or min(bw, bh) < 0:
        raise ValueError("a strip or tile has no samples")
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    held = sum(min(max(size, 0), len(data)) for size in sizes)
    if max(height * width * samples, bw * bh * depth) > held * _GROWTH.get(compression, 0) and compression in _UNPACK:
        raise ValueError(f"{held} bytes can't hold {height} x {width} x {samples} samples")
    out = np.zeros((height, width, samples), np.uint8)
    across, down = -(-width // bw), -(-height // bh)
    if len(offsets) < across * down * planes:
        raise ValueError(f"{len(offsets)} of {across * down * planes} strips or tiles")
    for k, (start, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, k = divmod(k, across * down)
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        block = _block(data[start : start + size], compression, predictor, rows, bw, depth)
        out[y : y + rows, x : x + bw, plane * depth : (plane + 1) * depth] = block[: height - y, : width - x]
    return out


def pages(data: bytes) -> Iterator[np.ndarray]:
    """The samples of each page of a file."""
    for _, tags in directories(data):
        yield decode(data, tags)


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int = 0, strip_rows: int = _STRIP_ROWS) -> bytes:
    """A little-endian TIFF file with a directory for each image (height x width x samples)."""
    return encode_pages([(image, (compression, predictor, tile, strip_rows)) for image in images])


def encode_pages(laid: list[tuple[np.ndarray, tuple[int, int, int, int]]]) -> bytes:
    """The same of images that each have a layout of their own."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image, (compression, predictor, tile, strip_rows) in laid:
        height, width, samples = image.shape
        bh, bw = (tile, tile) if tile else (strip_rows, width)
        offsets, sizes = [], []
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                block = image[y : y + bh, x : x + bw]
                if tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
                packed = _PACK[compression](block.tobytes())
                offsets.append(len(out))
                sizes.append(len(packed))
                out += packed
        tags = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8] * samples), (COMPRESSION, [compression]), (PHOTOMETRIC, [2 if samples == 3 else 1]), (SAMPLES, [samples]), (PLANAR, [1]), (PREDICTOR, [predictor])]
        tags += [(TILE_WIDTH, [bw]), (TILE_HEIGHT, [bh]), (TILE_OFFSETS, offsets), (TILE_BYTES, sizes)] if tile else [(STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [bh]), (STRIP_BYTES, sizes)]
        entries, wide = bytearray(), {WIDTH, HEIGHT, STRIP_OFFSETS, STRIP_BYTES, TILE_OFFSETS, TILE_BYTES, ROWS_PER_STRIP}
        for tag, values in sorted(tags):
            kind = 4 if tag in wide else 3
            value = struct.pack(f"<{len(values)}{_CODE[kind]}", *values)
            if len(value) > 4:
                out += b"\0" * (len(out) % 2)
                value, body = struct.pack("<I", len(out)), value
                out += body
            entries += struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def feature(image: np.ndarray) -> str:
    """Height, the mean of each sample, and a 64-bit difference hash, of a page."""
    height = image.shape[0]
    means = image.mean(axis=(0, 1), dtype=np.float64)
    grey = image.sum(axis=2, dtype=np.int64)
    cut = np.arange(8) * height // 8
    rows = np.add.reduceat(grey, cut, axis=0) if height >= 8 else grey[cut]
    cells = np.add.reduceat(rows, np.arange(9) * image.shape[1] // 9, axis=1) if image.shape[1] >= 9 else rows[:, np.arange(9) * image.shape[1] // 9]
    bits = np.packbits((cells[:, 1:] > cells[:, :-1]).ravel()).tobytes().hex()
    return f"{height}:{','.join(f'{m:.3f}' for m in means)}:{bits}"


def store(payload: bytes) -> bytes:
    """Bytes, a multiple of ROW, as pages of PIXELS x 3 samples a row."""
    image, first = np.frombuffer(payload, np.uint8).reshape(-1, PIXELS, 3), zlib.crc32(payload)
    return encode_pages([(image[at : at + PAGE_ROWS], LAYOUTS[(first + at // PAGE_ROWS) % len(LAYOUTS)]) for at in range(0, len(image), PAGE_ROWS)])


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_STORED_DDL = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            payload = raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))
            media = store(payload)
            page = np.concatenate(list(pages(media)))  # read back from the stored bytes
            back = page.tobytes()
            rows.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(page)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_STORED), _STORED, strict=True)], schema=_STORED)


def stored_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a TIFF file, and what its bytes hold when they are read back."""
    part = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return part.mapInArrow(_store_batches, _STORED_DDL)


_PAGE_DDL = "id bigint, page int, height int, width int, samples int, pixels binary, error string"
_PAGE = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("samples", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])


_BROKEN = (ValueError, KeyError, TypeError, IndexError, ZeroDivisionError, OverflowError, MemoryError, struct.error, zlib.error)


def _pages_of(key: int | None, media: bytes | None) -> Iterator[tuple]:
    failed = lambda k, error: (key, k, None, None, None, None, f"{type(error).__name__}: {error}")
    k = 0
    try:
        if media is None:
            raise ValueError("no media")
        for _, tags in directories(media):
            try:
                image = decode(media, tags)
                yield key, k, *image.shape, image.tobytes(), None
            except _BROKEN as error:
                yield failed(k, error)
            k += 1
    except _BROKEN as error:
        yield failed(k, error)


def _page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = list(_pages_of(key, media))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_PAGE), _PAGE, strict=True)], schema=_PAGE)


def page_rows(media: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """One row a page of the TIFF files in the binary column `content`."""
    return media.select(F.col(key).cast("bigint").alias("id"), F.col(content).alias("content")).mapInArrow(_page_batches, _PAGE_DDL)
