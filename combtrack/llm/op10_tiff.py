"""TIFF columns: pages of 8-bit samples, written and read."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: tags, compressions, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 323, 324, 325
FILL_ORDER, PLANES = 266, 284
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}

_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits(data: bytes) -> bytes:
    out = bytearray()

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = data[i : min(b, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    at = 0
    for run in _RUN.finditer(data):
        literal(at, run.start())
        out.append(257 - (run.end() - run.start()))
        out.extend(run[1])
        at = run.end()
    literal(at, len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, held = [], 0, 0
    while at < len(data) and held < size:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
            continue
        held += len(out[-1])
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early, as the format asks."""
    out, bits, count = bytearray(), 256, 9  # begins with the clear code
    fresh = {bytes([i]): i for i in range(256)}
    known, free, width, held = dict(fresh), 258, 9, b""
    for i in range(len(data)):
        more = data[i : i + 1]
        longer = held + more
        if longer in known:
            held = longer
            continue
        bits, count = bits << width | known[held], count + width
        known[longer] = free
        free += 1
        if free == 4095:
            bits, count = bits << width | 256, count + width
            known, free, width = dict(fresh), 258, 9
        elif free + 1 > 1 << width:
            width += 1
        held = more
        while count >= 8:
            count -= 8
            out.append(bits >> count & 255)
        bits &= (1 << count) - 1
    if held:
        bits, count = bits << width | known[held], count + width
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    bits, count = bits << width | 257, count + width
    pad = -count % 8
    return bytes(out) + (bits << pad).to_bytes((count + pad) // 8, "big")


def unlzw(data: bytes, size: int) -> bytes:
    """Up to about `size` bytes; a code that the table doesn't have yet is an error."""
    out, bits, count, width, held = [], 0, 0, 9, 0
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    known, before = list(fresh), b""
    for byte in data:
        bits, count = (bits << 8 | byte) & 0xFFFFFF, count + 8
        if count < width:
            continue
        count -= width
        code = bits >> count & (1 << width) - 1
        if code == 256:
            known, before, width = list(fresh), b"", 9
            continue
        if code == 257 or held >= size:
            break
        if code > len(known) or code == len(known) and not before:
            raise ValueError("an LZW code out of turn")
        if not before:
            entry = known[code]
        else:
            entry = known[code] if code < len(known) else before + before[:1]
            if len(known) < 4096:
                known.append(before + entry[:1])
        out.append(entry)
        held += len(entry)
        before = entry
        if len(known) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def inflate(data: bytes, size: int) -> bytes:
    """No more than `size` bytes of a deflate stream."""
    return zlib.decompressobj().decompress(data, max(1, size))


PACK = {NONE: bytes, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits}
UNPACK = {NONE: lambda data, size: data, LZW: unlzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpackbits}
#: Bytes that a page may declare: more is an error, not an allocation.
LARGEST = 1 << 28


def predict(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def unpredict(block: np.ndarray) -> np.ndarray:
    return np.cumsum(block, axis=1, dtype=np.uint8)


@dataclass(frozen=True)
class Layout:
    """How write_tiff stores a page; rows: of a strip, tile: the side of square tiles, or 0 for strips."""

    compression: int = DEFLATE
    predictor: int = 1
    rows: int = 64
    tile: int = 0
    page_rows: int = 256


def write_tiff(samples: np.ndarray, layout: Layout) -> bytes:
    """A little-endian file with a page for each `page_rows` rows of the 2-D array of bytes."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    width = samples.shape[1]
    for top in range(0, len(samples), layout.page_rows):
        page = samples[top : top + layout.page_rows]
        side = layout.tile
        if side:
            padded = np.zeros((-(-len(page) // side) * side, -(-width // side) * side), np.uint8)
            padded[: len(page), :width] = page
            blocks = [padded[y : y + side, x : x + side] for y in range(0, len(padded), side) for x in range(0, padded.shape[1], side)]
        else:
            blocks = [page[y : y + layout.rows] for y in range(0, len(page), layout.rows)]
        places, sizes = [], []
        for block in blocks:
            data = PACK[layout.compression]((predict(block) if layout.predictor == 2 else np.ascontiguousarray(block)).tobytes())
            places.append(len(out))
            sizes.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)

        def array(values: list[int]) -> int:
            if len(values) == 1:
                return values[0]
            at = len(out)
            out.extend(struct.pack(f"<{len(values)}I", *values))
            return at

        tags = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, len(page)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, layout.compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, layout.predictor)]
        if side:
            tags += [(TILE_WIDTH, 4, 1, side), (TILE_HEIGHT, 4, 1, side), (TILE_AT, 4, len(blocks), array(places)), (TILE_BYTES, 4, len(blocks), array(sizes))]
        else:
            tags += [(STRIP_ROWS, 4, 1, layout.rows), (STRIP_AT, 4, len(blocks), array(places)), (STRIP_BYTES, 4, len(blocks), array(sizes))]
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags)) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The image directories of a file, each as tag -> values. A file that is no TIFF is a ValueError, one that ends early a struct.error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    if not at:
        raise ValueError("no image directory")
    while at:
        if at in seen:
            raise ValueError("image directories in a circle")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in FIELD:
                code, size = FIELD[kind]
                place = at + 10 + 12 * i
                if size * count > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                if place + size * count > len(data):
                    raise ValueError(f"the values of tag {tag} lie outside the file")
                tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_page(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    """(height, width * samples) bytes of one page; what is missing, contradictory or of another kind than 8-bit chunky samples is a ValueError."""

    def one(tag: int, other: int | None = None, least: int = 1) -> int:
        values = tags.get(tag) or ([] if other is None else [other])
        if not values or values[0] < least:
            raise ValueError(f"tag {tag} is missing or too small")
        return values[0]

    if set(tags.get(BITS, [1])) != {8}:
        raise ValueError("only 8-bit samples")
    if one(PLANES, 1) != 1 or one(FILL_ORDER, 1) != 1:
        raise ValueError("only chunky samples with the high bit first")
    predictor, packing, samples = one(PREDICTOR, 1), one(COMPRESSION, NONE), one(SAMPLES, 1)
    if predictor not in (1, 2) or packing not in UNPACK:
        raise ValueError(f"predictor {predictor}, compression {packing}")
    height, width = one(HEIGHT), one(WIDTH) * samples
    tiled = TILE_AT in tags
    rows, across = (one(TILE_HEIGHT), one(TILE_WIDTH) * samples) if tiled else (min(one(STRIP_ROWS, height), height), width)
    down, columns = -(-height // rows), -(-width // across)
    if down * rows * columns * across > LARGEST:
        raise ValueError("larger than any page here")
    places, sizes = (tags.get(x, []) for x in ((TILE_AT, TILE_BYTES) if tiled else (STRIP_AT, STRIP_BYTES)))
    if len(places) != down * columns or len(sizes) != len(places):
        raise ValueError("another number of strips or tiles than the page needs")
    out = np.zeros((down * rows, columns * across), np.uint8)
    for i, (at, size) in enumerate(zip(places, sizes, strict=True)):
        y, x = i // columns * rows, i % columns * across
        if at + size > len(data):
            raise ValueError("a strip or tile lies outside the file")
        n = rows if tiled else min(rows, height - y)
        block = np.frombuffer(UNPACK[packing](data[at : at + size], n * across), np.uint8)[: n * across]
        if len(block) < n * across:
            raise ValueError("a strip or tile ends early")
        block = block.reshape(n, across)
        if predictor == 2:
            block = unpredict(block.reshape(n, -1, samples)).reshape(n, across)
        out[y : y + n, x : x + across] = block
    return out[:height, :width]


def pages(data: bytes | None) -> Iterator[tuple[int, dict, np.ndarray | None, str | None]]:
    """(page, tags, samples, error): a page that can't be read has an error, and so has the place where the directories can't be followed."""
    walk, page = directories(data or b""), 0
    while True:
        try:
            tags = next(walk, None)
        except (ValueError, struct.error) as e:
            yield page, {}, None, f"{type(e).__name__}: {e}"
            return
        if tags is None:
            return
        try:
            yield page, tags, read_page(data, tags), None
        except (ValueError, struct.error, zlib.error) as e:
            yield page, tags, None, f"{type(e).__name__}: {e}"
        page += 1


def text_layout(payload: bytes) -> Layout:
    """Chosen by content, so that equal texts are stored alike and every codec is in use; LZW, the slowest here, least often."""
    kind = zlib.crc32(payload) % 16
    if kind == 0:
        return Layout(LZW, 1)
    if kind < 4:
        return Layout(PACKBITS, 1)
    if kind < 8:
        return Layout(DEFLATE, 2, tile=64)
    return Layout(DEFLATE, 1 + kind % 2)


def pad(data: bytes, row: int = 576) -> bytes:
    """With bytes 255 up to a positive multiple of a row."""
    return data + b"\xff" * (max(row, -(-len(data) // row) * row) - len(data))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = 576) -> DataFrame:
    """(doc_id, media binary): every whole text as the samples of a TIFF, `row` to an image row. Null texts are empty; repeated rows and null ids stay."""

    def run(batches):
        for batch in batches:
            media = []
            for text in batch.column(1):
                payload = pad((text.as_py() or "").encode(), row)
                media.append(write_tiff(np.frombuffer(payload, np.uint8).reshape(-1, row), text_layout(payload)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, media binary")


def read_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: (doc_id, page, width, height, compression, predictor, samples, error).

    A page that can't be read has its number, no samples and the error, and the pages after it follow; where the file
    or its chain of directories can't be read, a row with the next number has the error. Null media are unreadable.
    Repeated rows and null ids stay; other columns are not read.
    """
    names = ["doc_id", "page", "width", "height", "compression", "predictor", "samples", "error"]
    kinds = [pa.int32()] * 5 + [pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                for page, tags, pixels, error in pages(data.as_py()):
                    known = [None] * 4 if error else [tags[WIDTH][0], tags[HEIGHT][0], tags.get(COMPRESSION, [1])[0], tags.get(PREDICTOR, [1])[0]]
                    values = [page, *known, None if error else pixels.tobytes(), error]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([v], t) for v, t in zip(values, kinds, strict=True))], names)

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(media[id_col].alias("doc_id"), media[media_col].alias("media")).mapInArrow(run, f"doc_id {kind}, page int, width int, height int, compression int, predictor int, samples binary, error string")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = 576) -> DataFrame:
    """Stores every text, walks the stored file's pages and describes what was read back, in one pass.

    Null and empty texts are one row of padding; equal texts give equal values; repeated rows and null ids stay; other
    columns are not read. A stored page that can't be read is an error.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def digest(text: str) -> tuple:
        raw = text.encode()
        payload = pad(raw, row)
        media = write_tiff(np.frombuffer(payload, np.uint8).reshape(-1, row), text_layout(payload))
        read, packing = [], 0
        for _, tags, pixels, error in pages(media):
            if error:
                raise ValueError(error)
            read.append(pixels)
            packing = tags[COMPRESSION][0]
        back = np.concatenate(read)
        data = back.tobytes()
        share = np.bincount(back.ravel(), minlength=256) / back.size
        entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
        feature = f"pages={len(read)};rows={len(back)};compression={packing};mean={float((share * np.arange(256)).sum()):.4f};entropy={entropy:.4f}"
        return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches):
        for batch in batches:
            rows = [digest(t.as_py() or "") for t in batch.column(1)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
