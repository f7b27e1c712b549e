"""TIFF as a media column: writing, walking image directories, and reading samples back.

Reader: little and big endian, strips and tiles, no compression, PackBits, LZW and
deflate, predictors 1 and 2, 8-bit samples, any number of pages.  Writer: the same but
big endian.  Texts become pages of at most PAGE_ROWS rows, so no page needs unbounded
memory; how a file is packed follows from a checksum of its payload, so that every packing
meets texts of every length and equal texts are packed alike.

Defined cases: null text counts as empty and gives one block of 192 spaces; rows are
independent; extra columns are ignored; a damaged file, a predictor or a sample format that
the reader does not know, or a page that says it is larger than max_bytes, raises ValueError
with the reason before memory for it is taken, and explode_pages() gives a row with the
error behind the pages that could be read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship

BLOCK = 192
WIDTH, SAMPLES = 64, 3
PAGE_ROWS = 4096
#: Samples of a page that the reader takes memory for.
MAX_BYTES = 1 << 28
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


# -- codecs ---------------------------------------------------------------------


def packbits_decode(data: bytes, limit: int = MAX_BYTES) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < limit:
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more bytes as a count and the byte, all else as it is, in packets of at most 128."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    start = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
    size = np.diff(start)
    out, at = [], 0

    def plain(lo: int, hi: int) -> None:
        for i in range(lo, hi, 128):
            out.append(bytes((min(128, hi - i) - 1,)) + data[i : min(hi, i + 128)])

    for k in np.flatnonzero(size >= 3):
        lo, n = int(start[k]), int(size[k])
        plain(at, lo)
        at = lo + n
        full, rest = divmod(n, 128)
        out.append(bytes((129, data[lo])) * full)
        if rest >= 2:
            out.append(bytes((257 - rest, data[lo])))
        elif rest:
            at -= 1
    plain(at, len(x))
    return b"".join(out)


#: Fixed by the format: how wide each code behind a clear code is; the width grows one code early.
_LZW_MOST = 4095 - 258
_LZW_WIDTHS = np.array([9 + (258 + j > 511) + (258 + j > 1023) + (258 + j > 2047) for j in range(_LZW_MOST + 2)])


def lzw_codes(data: bytes) -> Iterator[np.ndarray]:
    """The codes between clear codes, all of a stretch read at once: a code's width follows from its place."""
    x = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    ends = np.cumsum(_LZW_WIDTHS)
    at, bits = 0, 8 * len(data)
    while at < bits:
        here = at + ends - _LZW_WIDTHS
        here, width = here[at + ends <= bits], _LZW_WIDTHS[at + ends <= bits]
        if not len(here):
            return
        k = here >> 3
        code = ((x[k] << 16 | x[k + 1] << 8 | x[k + 2]) >> (24 - (here & 7) - width)) & ((1 << width) - 1)
        stop = np.flatnonzero((code == 256) | (code == 257))
        if not len(stop):
            yield code
            return
        yield code[: stop[0]]
        if code[stop[0]] == 257:
            return
        at = int(here[stop[0]] + width[stop[0]])


def lzw_decode(data: bytes, limit: int = MAX_BYTES) -> bytes:
    """TIFF's LZW: most significant bit first, code width grows one code early."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, size = [], 0
    for codes in lzw_codes(data):
        table, prev = list(first), b""
        for code in codes.tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and prev:
                entry = prev + prev[:1]
            else:
                raise ValueError("LZW code out of range")
            if prev:
                table.append(prev + entry[:1])
            out.append(entry)
            prev = entry
            size += len(entry)
            if size >= limit:
                return b"".join(out)
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of prefix and byte, with a clear code where the table is full; all codes become bits at once."""
    codes, places = [256], [0]
    table: dict[int, int] = {}
    w, n = -1, 0  # the code so far; codes since the last clear code
    for c in data:
        if w < 0:
            w = c
            continue
        key = w << 8 | c
        found = table.get(key)
        if found is not None:
            w = found
            continue
        codes.append(w)
        places.append(n)
        table[key] = 258 + n
        n += 1
        if n == _LZW_MOST:
            codes.append(256)
            places.append(n)
            table, n = {}, 0
        w = c
    if w >= 0:
        codes.append(w)
        places.append(n)
        n += 1
    codes.append(257)
    places.append(n)
    width = _LZW_WIDTHS[places]
    code, bit = np.repeat(np.array(codes), width), np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    return np.packbits((code >> (np.repeat(width, width) - 1 - bit)) & 1).tobytes()


def _decode(kind: int, data: bytes, limit: int) -> bytes:
    """At least limit bytes, where the data hold as many; never much more."""
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return packbits_decode(data, limit)
    if kind == LZW:
        return lzw_decode(data, limit)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, limit)
    raise ValueError(f"compression {kind} is not supported")


def _encode(kind: int, data: bytes) -> bytes:
    return {NONE: lambda x: x, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}[kind](data)


# -- writer -----------------------------------------------------------------------


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 1024, tile: int = 0) -> bytes:
    """A little-endian TIFF. pages: uint8 arrays (rows, columns, samples). tile: side of square tiles, a multiple of 16, or 0 for strips."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for img in pages:
        h, w, s = img.shape
        blocks = []
        if tile:
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    b = np.zeros((tile, tile, s), np.uint8)
                    part = img[y : y + tile, x : x + tile]
                    b[: part.shape[0], : part.shape[1]] = part
                    blocks.append(b)
        else:
            blocks = [img[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1)
            data = _encode(compression, np.ascontiguousarray(b).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags: list[tuple[int, int, list[int]]] = [
            (256, 4, [w]), (257, 4, [h]), (258, 3, [8] * s), (259, 3, [compression]), (262, 3, [2 if s == 3 else 1]), (277, 3, [s]), (284, 3, [1]), (317, 3, [predictor]),
        ]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [rows_per_strip]), (279, 4, counts)]
        entries = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{_FORMATS[kind]}", *values)
            if len(raw) > 4:
                entries.append(struct.pack("<HHII", tag, kind, len(values), len(out)))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# -- reader -----------------------------------------------------------------------


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The tags of each image directory, in file order."""
    if data[:4] == b"II*\0":
        e = "<"
    elif data[:4] == b"MM\0*":
        e = ">"
    else:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(e + "I", data, 4)
    seen = set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("damaged directory chain")
        seen.add(at)
        (n,) = struct.unpack_from(e + "H", data, at)
        tags: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
            if kind not in _FORMATS:
                continue
            where = at + 10 + 12 * i
            if _SIZES[kind] * count > len(data):
                raise ValueError(f"tag {tag} is longer than the file")
            if _SIZES[kind] * count > 4:
                (where,) = struct.unpack_from(e + "I", data, where)
            tags[tag] = list(struct.unpack_from(f"{e}{count}{_FORMATS[kind]}", data, where))
        yield tags
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def read_page(data: bytes, tags: dict[int, list[int]], max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The samples of one page: (rows, columns, samples), uint8."""
    one = lambda tag, default=None: (tags.get(tag) or [default])[0]
    w, h, s = one(256), one(257), one(277, 1)
    if not w or not h or not s:
        raise ValueError("a page without width, height or samples")
    if any(x != 8 for x in tags.get(258, [1])) or one(284, 1) != 1 or one(339, 1) != 1:
        raise ValueError("only interleaved unsigned 8-bit samples are supported")
    kind, predictor = one(259, 1), one(317, 1)
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not supported")
    if 324 in tags:
        bw, bh, offsets, sizes = one(322), one(323), tags[324], tags.get(325, [])
    else:
        bw, bh, offsets, sizes = w, min(one(278, h), h), tags.get(273, []), tags.get(279, [])
    if not bw or not bh:
        raise ValueError("strips or tiles without a size")
    across, down = -(-w // bw), -(-h // bh)
    if max(w * h * s, bw * bh * s) > max_bytes:
        raise ValueError(f"a page of {w} x {h} x {s} is larger than {max_bytes} bytes")
    if len(offsets) != len(sizes) or len(offsets) != across * down:
        raise ValueError("strips or tiles are missing")
    img = np.empty((h, w, s), np.uint8)
    for i, (off, size) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = i // across * bh, i % across * bw
        # the last strip ends with the page, tiles are whole
        rows = bh if 324 in tags else min(bh, h - y)
        raw = np.frombuffer(_decode(kind, data[off : off + size], rows * bw * s), np.uint8)
        if raw.size < rows * bw * s:
            raise ValueError("a strip or tile is too short")
        b = raw[: rows * bw * s].reshape(rows, bw, s)
        if predictor == 2:
            b = np.cumsum(b, axis=1, dtype=np.uint8)
        img[y : y + rows, x : x + bw] = b[: h - y, : w - x]
    return img


def read_pages(data: bytes, max_bytes: int = MAX_BYTES) -> Iterator[np.ndarray]:
    """The pages of a file in order; ValueError with the reason at the first that is damaged."""
    try:
        for tags in directories(data):
            yield read_page(data, tags, max_bytes)
    except (struct.error, zlib.error) as e:
        raise ValueError(f"damaged file: {e}") from e


def explode_pages(media: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per page of each TIFF: id, page_no, width, height, samples, mean, sha256 of the samples, error."""
    ship(media.sparkSession)
    src = media.select(media[id_col].cast("bigint").alias("id"), media[data_col].alias("data"))
    names = ["id", "page_no", "width", "height", "samples", "mean", "sha256", "error"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                no = -1
                try:
                    for no, img in enumerate(read_pages(data)):
                        rows.append((i, no, img.shape[1], img.shape[0], img.shape[2], float(img.mean()) if img.size else 0.0, hashlib.sha256(img.tobytes()).hexdigest(), None))
                except ValueError as e:
                    rows.append((i, no + 1, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return src.mapInArrow(run, "id bigint, page_no int, width int, height int, samples int, mean double, sha256 string, error string")


# -- texts as media -----------------------------------------------------------------


def pad(data: bytes, block: int = BLOCK) -> bytes:
    return data.ljust(max(block, -(-len(data) // block) * block), b" ")


#: The packings, dealt evenly.
PACKINGS = (
    {"compression": LZW, "predictor": 1},
    {"compression": PACKBITS, "predictor": 1},
    {"compression": DEFLATE, "predictor": 2},
    {"compression": DEFLATE, "predictor": 2, "tile": 64},
)


def packing_of(payload: bytes) -> dict[str, int]:
    """How a payload is packed: by its checksum."""
    return PACKINGS[zlib.crc32(payload) % len(PACKINGS)]


def to_tiff(payload: bytes, page_rows: int = PAGE_ROWS, packing: dict[str, int] | None = None) -> bytes:
    img = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, SAMPLES)
    return write_tiff([img[y : y + page_rows] for y in range(0, len(img), page_rows)], **(packing or packing_of(payload)))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text as a TIFF file, for explode_pages() and other readers."""
    ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_tiff(pad((t or "").encode())) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, media binary")


def feature_of(pages: list[np.ndarray]) -> str:
    """16 hex digits: an average hash of 64 column-block means, over all pages."""
    total, rows = np.zeros((WIDTH, SAMPLES), np.int64), 0
    for p in pages:
        total += p.sum(axis=0, dtype=np.int64)
        rows += p.shape[0]
    means = total.sum(axis=1) / max(1, rows * SAMPLES)
    bits = means > means.mean()
    return np.packbits(bits).tobytes().hex()


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as TIFF samples, read the stored bytes back and describe them."""
    ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode()
                media = to_tiff(pad(raw))
                pages = list(read_pages(media))
                back = b"".join(p.tobytes() for p in pages)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pages), len(pages)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=names)

    return src.mapInArrow(
        run,
        f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pages bigint",
    )
