"""Baseline JPEG: payloads stored losslessly as quantised coefficients, and a numpy decoder for 8-bit baseline files.

The unit of storage is the quantised DCT coefficient, which a decoder gets back exactly. A tile of 576 payload bytes is 3 x 3 blocks of
64 coefficients, and each image is 24 pixels wide, with a restart marker after each block. A byte b is the coefficient with category 8
whose extra bits are b: b from 128 up, b - 255 below.

The decoder parses markers and tables of any baseline file (several components, subsampling, restart intervals, one or more scans) and
runs the Huffman decoding of all restart intervals of a batch in lockstep, one symbol a step.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import flat, map_arrow, parts, table

TILE = 576
#: Tiles of an image: 24 * TILES rows fit into 16 bits. Longer payloads are several images, one after the other.
TILES = 2730

#: Zigzag order is that of the stored coefficients; the first is the DC coefficient.
_HUFF = bytes([1 if k == 8 else 0 for k in range(1, 17)]) + bytes([8])  # a single code of 8 bits, for category 8


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(tiles: int) -> bytes:
    sof = bytes([8]) + (24 * tiles).to_bytes(2, "big") + (24).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0]) + bytes([4]) + bytes([1]) * 63)  # DC steps of 4: thumbnails use most of the grey range
        + _segment(0xC0, sof)
        + _segment(0xC4, bytes([0x00]) + _HUFF)
        + _segment(0xC4, bytes([0x10]) + _HUFF)
        + _segment(0xDD, (1).to_bytes(2, "big"))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def pad(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bytes with bytes 255 up to a positive multiple of TILE."""
    n = np.diff(offsets)
    to = np.maximum(1, -(-n // TILE)) * TILE
    at = np.concatenate([[0], np.cumsum(to)])
    out = np.full(at[-1], 255, np.uint8)
    out[np.arange(len(raw)) + np.repeat(at[:-1] - offsets[:-1], n)] = raw
    return out, at


def encode(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The stored form of each row's payload, a positive multiple of TILE bytes."""
    blocks = len(payload) // 64
    codes = np.zeros((blocks, 130), np.uint8)
    codes[:, 1:128:2] = payload.reshape(-1, 64)
    first = offsets[:-1] // 64
    within = np.arange(blocks) - np.repeat(first, np.diff(offsets) // 64)
    within %= TILES * 9
    last = np.zeros(blocks, bool)
    last[offsets[1:] // 64 - 1] = True
    last[np.flatnonzero(within == TILES * 9 - 1)] = True
    codes[:, 128] = 0xFF
    codes[:, 129] = np.where(last, 0xD9, 0xD0 + within % 8)
    data = codes.ravel()
    stuffed = codes[:, 1:128:2] == 255
    extra = stuffed.sum(1)
    ends = np.cumsum(130 + extra)
    out = np.insert(data, (np.flatnonzero(stuffed.ravel()) // 64) * 130 + (np.flatnonzero(stuffed.ravel()) % 64) * 2 + 2, 0) if extra.any() else data
    raw = out.tobytes()
    result = []
    for a, b in zip(offsets[:-1] // 64, offsets[1:] // 64, strict=True):
        images = []
        for i in range(int(a), int(b), TILES * 9):
            j = min(int(b), i + TILES * 9)
            images += [_head((j - i) // 9), raw[ends[i - 1] if i else 0 : ends[j - 1]]]
        result.append(b"".join(images))
    return result


@dataclass
class Image:
    """A parsed frame; components: id -> (h, v, quantisation table); scans: (component ids, tables, restart interval, start, end of data)."""

    height: int = 0
    width: int = 0
    components: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    quant: dict[int, bytes] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)


_tables: dict[bytes, int] = {}
_luts: list[np.ndarray] = []


def _lut(spec: bytes) -> int:
    """Index of a Huffman table's lookup by 16 bits: code length * 256 + symbol; 0 where no code begins so."""
    if spec not in _tables:
        lut, code, k = np.zeros(1 << 16, np.uint16), 0, 16
        for length in range(1, 17):
            for _ in range(spec[length - 1]):
                lut[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | spec[k]
                code, k = code + 1, k + 1
            code <<= 1
        _tables[spec] = len(_luts)
        _luts.append(lut)
    return _tables[spec]


def parse(data: bytes) -> list[Image]:
    """Marker by marker; raises ValueError for what isn't baseline."""
    images: list[Image] = []
    at, n = 0, len(data)
    huff: dict[int, bytes] = {}
    interval = 0
    while at + 1 < n:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD8:
            images.append(Image())
            huff, interval = {}, 0
            at += 2
            continue
        if marker == 0xD9:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                if body[k] >> 4:
                    raise ValueError("16-bit quantisation isn't baseline")
                images[-1].quant[body[k] & 15] = body[k + 1 : k + 65]
                k += 65
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                m = sum(body[k + 1 : k + 17])
                huff[body[k]] = body[k + 1 : k + 17 + m]
                k += 17 + m
        elif marker == 0xC0:
            images[-1].height, images[-1].width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            images[-1].components = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            ids = [body[1 + 2 * k] for k in range(body[0])]
            tables = [(_lut(huff[body[2 + 2 * k] >> 4]), _lut(huff[0x10 | body[2 + 2 * k] & 15])) for k in range(body[0])]
            start = at
            while True:  # the scan ends at a marker other than a restart
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= n:
                    at = n
                    break
                if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                    # jump on through the many stuffed bytes with numpy
                    rest = np.frombuffer(data, np.uint8, offset=at)
                    hits = np.flatnonzero(rest[:-1] == 0xFF)
                    after = rest[hits + 1]
                    stop = hits[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7)) & (after != 0xFF)]
                    at = at + int(stop[0]) if len(stop) else n
                break
            images[-1].scans.append((ids, tables, interval, start, at))
    return images


def decode(files: list[bytes]) -> list[list[tuple[Image, dict[int, np.ndarray]]]]:
    """For each file its images, each with the coefficients of each component: (blocks in scan order, 64) in zigzag order."""
    plans, streams = [], []  # of each file; (data, first block, blocks, layout)
    total = 0
    for data in files:
        images = []
        raw = np.frombuffer(data, np.uint8)
        for image in parse(data):
            hmax = max((c[0] for c in image.components.values()), default=1)
            vmax = max((c[1] for c in image.components.values()), default=1)
            where = {}
            for ids, tables, interval, start, end in image.scans:
                if len(ids) == 1:
                    h, v, _ = image.components[ids[0]]
                    across, down = -(-(-(-image.width * h // hmax)) // 8), -(-(-(-image.height * v // vmax)) // 8)
                    layout = [(0, *tables[0])]
                else:
                    across, down = -(-image.width // (8 * hmax)), -(-image.height // (8 * vmax))
                    layout = [(k, *tables[k]) for k, i in enumerate(ids) for _ in range(image.components[i][0] * image.components[i][1])]
                units = across * down
                scan = raw[start:end]
                ff = np.flatnonzero(scan[:-1] == 0xFF)
                rst = ff[(scan[ff + 1] >= 0xD0) & (scan[ff + 1] <= 0xD7)]
                cuts = np.concatenate([[0], rst + 2]), np.concatenate([rst, [len(scan)]])
                per = interval or units
                if len(cuts[0]) != -(-units // per):
                    raise ValueError("restart markers are missing")
                streams.append((scan, *cuts, total, per, units, layout))
                for k, i in enumerate(ids):
                    own = [j for j, x in enumerate(layout) if x[0] == k]
                    where[i] = (total, units, len(layout), own)
                total += units * len(layout)
            images.append((image, where))
        plans.append(images)
    coefficients = _huffman(streams, total)
    out = []
    for images in plans:
        out.append([(image, {i: coefficients[t : t + units * m].reshape(units, m, 64)[:, own].reshape(-1, 64) for i, (t, units, m, own) in where.items()}) for image, where in images])
    return out


def _huffman(scans: list[tuple], total: int) -> np.ndarray:
    """All blocks of all scans: one symbol of each restart interval a step. DC coefficients are summed up within their interval."""
    out = np.zeros((total, 64), np.int16)
    if not total:
        return out
    data = np.concatenate([s[0] for s in scans] + [np.zeros(8, np.uint8)])
    base = np.cumsum([0] + [len(s[0]) for s in scans])
    stuffing = np.zeros(len(data), bool)
    stuffing[1:] = (data[1:] == 0) & (data[:-1] == 0xFF)
    gone = np.cumsum(stuffing)  # up to and with each byte
    starts = np.concatenate([s[1] + b for s, b in zip(scans, base, strict=False)])
    starts = starts - np.concatenate([[0], gone])[starts]
    block = np.concatenate([t + np.arange(len(a)) * per * len(lay) for _, a, _, t, per, _, lay in scans])
    blocks = np.concatenate([np.minimum(per, units - np.arange(len(a)) * per) * len(lay) for _, a, _, _, per, units, lay in scans])
    layouts = {tuple(s[6]): k for k, s in reversed(list(enumerate(scans)))}
    order = {lay: i for i, lay in enumerate(layouts)}
    which = np.concatenate([np.full(len(s[1]), order[tuple(s[6])]) for s in scans])
    longest = max(map(len, layouts))
    dc, ac, comp = (np.zeros((len(layouts), longest), np.int64) for _ in range(3))
    period = np.zeros(len(layouts), np.int64)
    for lay, i in order.items():
        period[i] = len(lay)
        for j, (k, d, a) in enumerate(lay):
            comp[i, j], dc[i, j], ac[i, j] = k, d, a
    data = data[~stuffing]
    wide = np.zeros(len(data) + 8, np.uint32)
    wide[: len(data)] = data
    w32 = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    lut = np.concatenate(_luts)
    bit, k, done = starts * 8, np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    flatc = out.ravel()
    predicted = np.zeros((len(starts), int(comp.max()) + 1), np.int64)
    live = np.arange(len(starts))
    single = len(layouts) == 1 and longest == 1
    while len(live):
        slot = 0 if single else done % period[which]
        lay = 0 if single else which
        tables = np.where(k == 0, dc[lay, slot], ac[lay, slot])
        hit = lut[(tables << 16) | ((w32[bit >> 3] >> (16 - (bit & 7)).astype(np.uint32)) & 0xFFFF)].astype(np.int64)
        if not hit.all():
            raise ValueError("a bad Huffman code")
        bit = bit + (hit >> 8)
        symbol = hit & 255
        size = symbol & 15
        is_dc = k == 0
        size = np.where(is_dc, symbol, size)
        extra = (w32[bit >> 3] << (bit & 7).astype(np.uint32)).astype(np.uint32) >> np.uint32(1)
        extra = (extra >> (31 - size).astype(np.uint32)).astype(np.int64)
        value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        bit = bit + size
        run = np.where(is_dc, 0, symbol >> 4)
        end = ~is_dc & (size == 0) & (run != 15)
        if is_dc.any():
            rows = np.flatnonzero(is_dc)
            c = comp[lay, slot] if single else comp[lay, slot][rows]
            predicted[rows, c] += value[rows]
            value[rows] = predicted[rows, c]
        k = k + run
        put = ~end & (is_dc | (size > 0))
        if put.all():
            flatc[(block + done) * 64 + k] = value
        else:
            flatc[((block + done) * 64 + k)[put]] = value[put]
        k = np.where(end, 64, k + 1)
        if (full := k >= 64).any():
            k[full] = 0
            done = done + full
            stay = done < blocks
            if not stay.all():
                bit, k, done, block, blocks, which, predicted, live = (x[stay] for x in (bit, k, done, block, blocks, which, predicted, live))
    return out


def payload_of(images: list[tuple[Image, dict[int, np.ndarray]]]) -> bytes:
    """The bytes that encode() stored."""
    out = []
    for _, c in images:
        v = next(iter(c.values()))
        out.append(np.where(v >= 128, v, v + 255).astype(np.uint8).tobytes())
    return b"".join(out)


def thumbnail(image: Image, coefficients: dict[int, np.ndarray]) -> np.ndarray:
    """Luminance (first component) at an eighth of its size, of DC coefficients alone."""
    i, (h, v, q) = next(iter(image.components.items()))
    hmax, vmax = max(c[0] for c in image.components.values()), max(c[1] for c in image.components.values())
    across, down = -(-(-(-image.width * h // hmax)) // 8), -(-(-(-image.height * v // vmax)) // 8)
    grey = np.clip((coefficients[i][:, 0].astype(np.int32) * image.quant[q][0] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    if len(image.components) > 1 and len(grey) != across * down or h * v > 1 and any(len(s[0]) > 1 for s in image.scans):
        units = -(-image.width // (8 * hmax))
        grey = grey.reshape(-1, units, v, h).transpose(0, 2, 1, 3).reshape(-1, units * h)
        return grey[:down, :across]
    return grey[: across * down].reshape(down, across)


def thumb_hash(thumb: np.ndarray) -> str:
    """64 bits, one for each cell of an 8 x 8 grid: whether its mean is above that of all cells."""
    y = np.arange(9) * thumb.shape[0] // 8
    x = np.arange(9) * thumb.shape[1] // 8
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)
    y0, y1, x0, x1 = y[:-1], np.maximum(y[1:], y[:-1] + 1), x[:-1], np.maximum(x[1:], x[:-1] + 1)
    y1, x1 = np.minimum(y1, thumb.shape[0]), np.minimum(x1, thumb.shape[1])
    y0, x0 = np.minimum(y0, y1 - 1), np.minimum(x0, x1 - 1)
    s = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    mean = s / ((y1 - y0)[:, None] * (x1 - x0)[None])
    return np.packbits(mean > mean.mean()).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the padded UTF-8 of each text as JPEG. A null text is empty."""

    def run(batch):
        for part in parts(batch):
            raw, at = flat(part["text"])
            payload, to = pad(raw, at)
            yield {"doc_id": part["doc_id"], "n_bytes": np.diff(at), "media": pa.array(encode(payload, to), pa.binary())}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumb_hash string"


def features(ids: pa.Array, n_bytes, media: list[bytes]) -> dict:
    """The columns of COLUMNS, of media that can be read."""
    out: dict[str, list] = {k.split()[0]: [] for k in COLUMNS.split(", ")[2:]}
    for data, images in zip(media, decode(media), strict=True):
        payload = payload_of(images)
        thumbs = [thumbnail(*x) for x in images]
        out["payload_bytes"].append(len(payload))
        out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
        out["tail_crc32"].append(zlib.crc32(payload[-32:]))
        out["media_bytes"].append(len(data))
        out["media_sha256"].append(hashlib.sha256(data).hexdigest())
        marks = [thumb_hash(t) for t in thumbs]
        out["width"].append(images[0][0].width)
        out["height"].append(sum(x.height for x, _ in images))
        out["thumb_hash"].append(marks[0])
        out["feature"].append(";".join(f"{x.width}x{x.height}:{m}:{hashlib.sha256(t.tobytes()).hexdigest()[:16]}" for (x, _), t, m in zip(images, thumbs, marks, strict=True)))
    return {"doc_id": ids, "n_bytes": n_bytes} | out


def inspect(stored: DataFrame) -> DataFrame:
    """What is read back from rows (doc_id, n_bytes, media): payload digests, dimensions and thumbnail hashes.

    Media that is null, empty, cut short or no baseline JPEG gives nulls, and the reason in `error`, which is null elsewhere. Repeated rows
    give repeated results, no rows none; other columns are ignored.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")[2:]]

    def run(batch):
        for part in parts(batch, "media"):
            media = part["media"].to_pylist()
            try:
                if not all(media):
                    raise ValueError("no media")
                yield features(part["doc_id"], part["n_bytes"], media) | {"error": [None] * len(media)}
            except Exception:  # one of them is damaged: each is read by itself
                rows = []
                for data in media:
                    try:
                        if not data:
                            raise ValueError("no media")
                        rows.append({c: x[0] for c, x in features(None, None, [data]).items() if c in names} | {"error": None})
                    except Exception as e:  # whatever a damaged file leads to
                        rows.append(dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"})
                yield {"doc_id": part["doc_id"], "n_bytes": part["n_bytes"]} | {c: [r[c] for r in rows] for c in (*names, "error")}

    return map_arrow(stored.select("doc_id", "n_bytes", "media"), run, f"{COLUMNS}, error string")


def store_and_inspect(docs: DataFrame) -> DataFrame:
    """store() and inspect() of each text, a few megabytes at a time within one Python pass.

    Each row stands alone: repeated rows and equal texts give equal values, no rows none, other columns are ignored. A null or empty text is
    stored as one tile of bytes 255. Payloads beyond TILES tiles are several images in a row; `feature` then names each.
    """

    def run(batch):
        for part in parts(batch, limit=1 << 20):
            raw, at = flat(part["text"])
            payload, to = pad(raw, at)
            yield features(part["doc_id"], np.diff(at), encode(payload, to))

    return map_arrow(docs.select("doc_id", "text"), run, COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_inspect(table(spark, sf_dir, "documents"))
