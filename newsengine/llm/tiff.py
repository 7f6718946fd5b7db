"""TIFF media columns: write sample planes, walk directories, one row per page."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsengine.llm.frames import map_columns, prepare_workers, release

# Fixed values of the format: tags, compression schemes and field sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
SCHEMES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
SCHEME_OF = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
FIELD = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4)}
LZW_CLEAR, LZW_END = 256, 257
#: A page of more samples than a BINARY value can hold is refused.
MAX_PAGE = (1 << 31) - 1
#: How pages can be stored: scheme, predictor, and tiles or strips of rows.
LAYOUTS = [(scheme, predictor, tile) for scheme in ("deflate", "packbits", "lzw", "none") for predictor in (1, 2) for tile in (None, (32, 64))]


class TiffError(ValueError):
    """The bytes are no TIFF that this reader knows."""


def packbits(data: bytes) -> bytes:
    """Runs of equal bytes and literal stretches, at most 128 each."""
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate([[0], edges]).tolist()
    ends = np.concatenate([edges, [len(a)]]).tolist()
    out = bytearray()
    literal = 0

    def flush(upto: int) -> None:
        for i in range(literal, upto, 128):
            piece = data[i : min(i + 128, upto)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for s, e in zip(starts, ends, strict=True):
        if e - s < 3:
            continue
        flush(s)
        for i in range(s, e, 128):
            n = min(128, e - i)
            out.extend((257 - n, data[i]) if n > 1 else (0, data[i]))
        literal = e
    flush(len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one code early.

    A string is known by its code and next byte, so a step is one look-up;
    the codes become bits in one pass over arrays.
    """
    codes, widths = [LZW_CLEAR], [9]
    known: dict[int, int] = {}
    nxt, width, now = 258, 9, -1
    for b in data:
        if now < 0:
            now = b
            continue
        key = now << 8 | b
        longer = known.get(key)
        if longer is not None:
            now = longer
            continue
        codes.append(now)
        widths.append(width)
        known[key] = nxt
        nxt += 1
        now = b
        if nxt == 4095:
            codes.append(LZW_CLEAR)
            widths.append(width)
            known = {}
            nxt, width = 258, 9
        elif nxt >> width:
            width += 1
    if now >= 0:
        codes.append(now)
        widths.append(width)
        nxt += 1
        if nxt >> width and width < 12:
            width += 1
    codes.append(LZW_END)
    widths.append(width)
    w = np.array(widths)
    bits = (np.array(codes)[:, None] >> (w[:, None] - 1 - np.arange(12)).clip(0)) & 1
    return np.packbits(bits[np.arange(12) < w[:, None]].astype(np.uint8)).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    out = bytearray()
    table: list[bytes] = []
    acc = bits = at = 0
    width, last = 9, b""
    while len(out) < size:
        while bits < width and at < len(data):
            acc = acc << 8 | data[at]
            at += 1
            bits += 8
        if bits < width:
            break
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if not table:
            raise TiffError("LZW data that does not begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def pack(raw: bytes, scheme: str) -> bytes:
    return {"none": bytes, "packbits": packbits, "lzw": lzw, "deflate": lambda x: zlib.compress(x, 1)}[scheme](raw)


def unpack(raw: bytes, scheme: str, size: int) -> bytes:
    if scheme == "deflate":
        try:
            out = zlib.decompressobj().decompress(raw, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    else:
        out = {"none": lambda: raw[:size], "packbits": lambda: unpackbits(raw, size), "lzw": lambda: unlzw(raw, size)}[scheme]()
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out[:size]


def write_tiff(pages: list[np.ndarray], scheme: str = "deflate", predictor: int = 1, rows: int = 128, tile: tuple[int, int] | None = None) -> bytes:
    """Little-endian TIFF of 8-bit pages, (height, width) or (height, width, samples).

    Strips of ``rows`` rows, or tiles of ``tile`` = (height, width), both
    multiples of 16; predictor 2 stores differences to the left neighbour.
    """
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        h, w, spp = page.shape
        th, tw = tile or (min(rows, h), w)
        blocks = []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                block = page[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                blocks.append(pack(block.tobytes(), scheme))
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * spp), (COMPRESSION, 3, [SCHEMES[scheme]]), (PHOTOMETRIC, 3, [2 if spp == 3 else 1]), (SAMPLES, 3, [spp]), (PREDICTOR, 3, [predictor])]
        if tile:
            fields += [(TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, [len(b) for b in blocks])]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [th]), (STRIP_COUNTS, 4, [len(b) for b in blocks])]
        entries = b""
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"<{len(values)}{FIELD[kind][0]}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack("<I", len(out))
                out += body
            else:
                place = body.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, len(values)) + place
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """Fields of each image directory, in file order; a loop of links is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    try:
        while at:
            if at in seen:
                raise TiffError("directories form a loop")
            seen.add(at)
            fields = {}
            (n,) = struct.unpack_from(f"{order}H", data, at)
            for k in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
                if kind not in FIELD:
                    continue
                letter, size = FIELD[kind]
                place = at + 10 + 12 * k
                if count * size > 4:
                    (place,) = struct.unpack_from(f"{order}I", data, place)
                if place + count * size > len(data):
                    raise TiffError("a field lies outside the file")
                fields[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
            yield fields
            (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    except struct.error:
        raise TiffError("a directory lies outside the file") from None


def read_page(data: bytes, fields: dict[int, list[int]]) -> tuple[np.ndarray, str]:
    """Samples (height, width, samples per pixel) of one directory, and its compression."""
    one = lambda tag, default=None: fields[tag][0] if fields.get(tag) else default
    w, h, spp = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    scheme = SCHEME_OF.get(one(COMPRESSION, 1))
    if not w or not h or scheme is None or set(fields.get(BITS, [1])) != {8} or w * h * spp > MAX_PAGE:
        raise TiffError("a page of unknown kind")
    if TILE_OFFSETS in fields:
        tw, th, offsets, counts = one(TILE_WIDTH), one(TILE_HEIGHT), fields[TILE_OFFSETS], fields.get(TILE_COUNTS, [])
    else:
        tw, th, offsets, counts = w, min(one(ROWS_PER_STRIP, h), h), fields.get(STRIP_OFFSETS, []), fields.get(STRIP_COUNTS, [])
    if not tw or not th:
        raise TiffError("a page of unknown kind")
    across, down = -(-w // tw), -(-h // th)
    if len(offsets) < across * down or len(counts) < across * down:
        raise TiffError("strips or tiles are missing")
    page = np.empty((h, w, spp), np.uint8)
    for k in range(across * down):
        y, x = k // across * th, k % across * tw
        rows = th if TILE_OFFSETS in fields else min(th, h - y)
        raw = unpack(data[offsets[k] : offsets[k] + counts[k]], scheme, rows * tw * spp)
        block = np.frombuffer(raw, np.uint8).reshape(rows, tw, spp)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        page[y : y + rows, x : x + tw] = block[: h - y, : w - x]
    return page, scheme


def features(page: np.ndarray) -> str:
    """Size, mean, spread, entropy in bits and mean step to the right neighbour."""
    counts = np.bincount(page.ravel(), minlength=256)
    p = counts[counts > 0] / page.size
    values = np.arange(256)
    mean = float((counts * values).sum() / page.size)
    spread = float(np.sqrt(max(0.0, (counts * values**2).sum() / page.size - mean**2)))
    step = float(np.abs(np.diff(page.astype(np.int16), axis=1)).mean()) if page.shape[1] > 1 else 0.0
    return f"{page.shape[1]}x{page.shape[0]}x{page.shape[2]} mean={mean:.4f} spread={spread:.4f} entropy={float(-(p * np.log2(p)).sum()):.4f} step={step:.4f}"


def tiff_store(docs: DataFrame, text_col: str = "text", media_col: str = "media", width: int = 64, layouts: list[tuple] | None = None, rows: int = 128, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``media_col`` BINARY: the text's UTF-8 bytes as one page of 8-bit samples.

    Bytes 0 pad the text to a positive multiple of ``width``; null or empty
    text is one row of zeros. The text's checksum deals it one of ``layouts``
    (all of LAYOUTS by default), so equal texts give equal bytes. An existing
    column named ``media_col`` is replaced.
    """
    chosen = layouts or LAYOUTS

    def make():
        def work(texts):
            out = []
            for t in texts:
                raw = (t or "").encode("utf-8")
                scheme, predictor, tile = chosen[zlib.crc32(raw) % len(chosen)]
                raw += b"\0" * (-len(raw) % width or (0 if raw else width))
                out.append(write_tiff([np.frombuffer(raw, np.uint8).reshape(-1, width)], scheme, predictor, rows, tile))
            return (out,)

        return work

    return map_columns(docs, docs.columns if keep is None else keep, [text_col], [T.StructField(media_col, T.BinaryType())], make, rows=256)


PAGE_FIELDS = [
    T.StructField("page", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("samples", T.IntegerType()),
    T.StructField("compression", T.StringType()),
    T.StructField("pixels", T.BinaryType()),
    T.StructField("feature", T.StringType()),
    T.StructField("error", T.StringType()),
]


def tiff_pages(media: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row per page of each TIFF: page number from 0, size, samples, pixels, feature.

    Null media gives no row. Bytes that cannot be read give their readable
    pages, then one row whose only page column is ``error``. Columns of
    ``media`` that clash with the page columns are replaced.
    """
    made = {f.name for f in PAGE_FIELDS}
    keep = [c for c in (media.columns if keep is None else keep) if c.lower() not in made]
    schema = T.StructType([media.schema[c] for c in keep] + PAGE_FIELDS)
    source = media.select(*keep, media[media_col].alias("__media"))

    def pages(data: bytes) -> Iterator[tuple]:
        try:
            for k, fields in enumerate(directories(data)):
                page, scheme = read_page(data, fields)
                yield k, page.shape[1], page.shape[0], page.shape[2], scheme, page.tobytes(), features(page), None
        except TiffError as e:
            yield (*[None] * 7, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                rows, owner = [], []
                for i, data in enumerate(part.column(len(keep)).to_pylist()):
                    for row in pages(data) if data is not None else ():
                        rows.append(row)
                        owner.append(i)
                at_owner = pa.array(owner, pa.int64())
                cols = [part.column(i).take(at_owner) for i in range(len(keep))]
                cols += [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(PAGE_FIELDS)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])
        release()

    prepare_workers(media.sparkSession)
    return source.mapInArrow(run, schema)
