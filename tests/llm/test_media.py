import hashlib
import zlib

import numpy as np
import pytest
from helpers import documents, empty

from lexdrift.llm import media


def test_payloads_come_back(spark):
    docs = documents(spark)
    two = media.inspect(media.store(docs)).where("error is null").drop("error").collect()
    one = media.store_and_inspect(docs).collect()
    assert sorted(one, key=str) == sorted(two, key=str)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in one:
        raw = texts[r.doc_id]
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert media.store_and_inspect(empty(spark)).count() == 0


def test_several_images():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 576 * (media.TILES + 3), dtype=np.uint8)
    files = media.encode(raw, np.array([0, len(raw)]))
    images = media.decode(files)[0]
    assert len(images) == 2 and media.payload_of(images) == raw.tobytes()


def huffman(lengths):
    """Codes of a canonical table: symbol -> (code, length)."""
    code, out, spec, symbols = 0, {}, [], b""
    for n in range(1, 17):
        own = [s for s, k in lengths if k == n]
        spec.append(len(own))
        for s in own:
            out[s] = (code, n)
            symbols += bytes([s])
            code += 1
        code <<= 1
    return out, bytes(spec) + symbols


def scan(blocks, layout, dc, ac, interval):
    """Entropy-coded data by the standard's rules, a bit at a time; blocks[unit][k] are zigzag coefficients of a component."""
    out, bits, last, count = b"", "", {}, 0

    def flush():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        out += raw.replace(b"\xff", b"\xff\x00")
        bits = ""

    def put(code):
        nonlocal bits
        bits += format(code[0], f"0{code[1]}b")

    def value(v):
        n = abs(int(v)).bit_length()
        return n, "" if not n else format(v if v > 0 else v + (1 << n) - 1, f"0{n}b")

    for u, unit in enumerate(blocks):
        if interval and u and u % interval == 0:
            flush()
            out += bytes([0xFF, 0xD0 + count % 8])
            count, last = count + 1, {}
        for c, block in zip(layout, unit, strict=True):
            n, extra = value(int(block[0]) - last.get(c, 0))
            last[c] = int(block[0])
            put(dc[n])
            bits += extra
            run = 0
            for k in range(1, 64):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    put(ac[0xF0])
                    run -= 16
                n, extra = value(int(block[k]))
                put(ac[run << 4 | n])
                bits += extra
                run = 0
            if run:
                put(ac[0])
    flush()
    return out


@pytest.mark.parametrize("interval", [0, 2])
@pytest.mark.parametrize("colour", [False, True])
def test_any_baseline_file(interval, colour):
    rng = np.random.default_rng(3)
    dc, dc_spec = huffman([(s, 4) for s in range(12)])
    ac, ac_spec = huffman([(0, 2)] + [(r << 4 | n, 9) for r in range(16) for n in range(1, 11)] + [(0xF0, 9)])
    layout = [1, 1, 1, 1, 2, 3] if colour else [1]
    units = 6

    def block():
        b = rng.integers(-60, 60, 64) * (rng.random(64) < 0.15)
        b[0] = rng.integers(-300, 300)
        return b

    blocks = [[block() for _ in layout] for _ in range(units)]
    width, height = (40, 30) if colour else (23, 11)
    parts = [(1, 0x22, 0), (2, 0x11, 0), (3, 0x11, 0)] if colour else [(1, 0x11, 0)]
    data = b"\xff\xd8" + media._segment(0xE0, b"JFIF\x00") + media._segment(0xDB, b"\x00" + bytes([2] * 64))
    data += media._segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes(p) for p in parts))
    data += media._segment(0xC4, b"\x00" + dc_spec + b"\x10" + ac_spec)
    if interval:
        data += media._segment(0xDD, interval.to_bytes(2, "big"))
    data += media._segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p[0], 0]) for p in parts) + bytes([0, 63, 0]))
    data += scan(blocks, layout, dc, ac, interval) + b"\xff\xd9"
    ((image, found),) = media.decode([data])[0]
    assert (image.width, image.height) == (width, height)
    for c in set(layout):
        expected = np.array([b for unit in blocks for x, b in zip(layout, unit, strict=True) if x == c])
        assert (found[c] == expected).all()
    thumb = media.thumbnail(image, found)
    assert thumb.shape == (-(-height // 8), -(-width // 8))
    assert thumb[0, 0] == np.clip((int(blocks[0][0][0]) * 2 + 4) // 8 + 128, 0, 255)
    assert len(media.thumb_hash(thumb)) == 16


def test_not_baseline():
    with pytest.raises(ValueError):
        media.parse(b"\xff\xd8" + media._segment(0xC2, bytes(15)))


def test_media_that_cannot_be_read(spark):
    """Null, empty, cut and foreign media have a reason each, and leave the other rows of their batch alone."""
    whole = media.store(spark.createDataFrame([(1, "a text that is stored")], "doc_id long, text string")).first().media
    given = [bytes(whole), None, b"", bytes(whole[: len(whole) // 2]), bytes(whole[:-1]), b"not a picture", b"\xff\xd8", bytes(whole)]
    rows = spark.createDataFrame([(k, 5, None if x is None else bytearray(x)) for k, x in enumerate(given)], "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r.doc_id: r for r in media.inspect(rows.withColumn("error", rows.doc_id)).collect()}
    assert len(got) == len(given) and got[0].error is None and got[0].payload_sha256 == got[7].payload_sha256
    for k in (1, 2, 3, 5, 6):
        assert got[k].error and got[k].payload_sha256 is None and got[k].feature is None and got[k].n_bytes == 5, (k, got[k])
    assert media.inspect(rows.limit(0)).count() == 0
