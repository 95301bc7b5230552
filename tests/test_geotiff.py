import random
import struct
import zlib

import numpy as np
import pytest

from strata.sources import geotiff as gt


def lzw(data):
    """The encoder that belongs to the reader's codes."""
    out, bits, table, word, width = 0, 0, {bytes([k]): k for k in range(256)}, b"", 9

    def put(code):
        nonlocal out, bits
        out, bits = out << width | code, bits + width

    put(256)
    count = 258
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more], count = count, count + 1
        word = data[k : k + 1]
        width = count.bit_length()
        if count == 4094:
            put(256)
            table, count, width = {bytes([k]): k for k in range(256)}, 258, 9
    if word:
        put(table[word])
        count += 1
        width = min(12, count.bit_length())
    put(257)
    return (out << -bits % 8).to_bytes((bits + 7) // 8, "big")


def tiff(array, packed=1, tile=None, rows=2, predictor=1, order="<", big=False, bands=1, nodata=b"-1\0"):
    """A file of one image; blocks are strips of ``rows`` rows or square tiles."""
    height, width = array.shape
    kind = {"f": 3, "i": 2, "u": 1}[array.dtype.kind]
    squash = {1: bytes, 5: lzw, 8: zlib.compress}[packed]
    parts = []
    for r in range(0, height, tile or rows):
        for c in range(0, width, tile or width):
            block = array[r : r + (tile or rows), c : c + (tile or width)]
            if tile:
                block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1])))
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=block.dtype.type(0))
            block = np.repeat(block[:, :, None], bands, 2)
            parts.append(squash(block.astype(block.dtype.newbyteorder(order)).tobytes()))
    head = 16 if big else 8
    starts = [head + sum(map(len, parts[:k])) for k in range(len(parts))]
    wide, entry = ("Q", 20) if big else ("I", 12)
    tags = [(256, 3, (width,)), (257, 3, (height,)), (258, 3, (array.dtype.itemsize * 8,) * bands), (259, 3, (packed,)), (277, 3, (bands,)), (317, 3, (predictor,)), (339, 3, (kind,) * bands), (33550, 12, (0.5, 0.5, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 10.0, 50.0, 0.0)), (42113, 2, nodata)]
    tags += [(322, 3, (tile,)), (323, 3, (tile,)), (324, 4, tuple(starts)), (325, 4, tuple(map(len, parts)))] if tile else [(273, 4, tuple(starts)), (278, 3, (rows,)), (279, 4, tuple(map(len, parts)))]
    body = b"".join(parts)
    at = head + len(body)
    place = at + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
    entries = extra = b""
    for tag, what, value in sorted(tags):
        raw = value if what == 2 else struct.pack(f"{order}{len(value)}{gt.FIELDS[what]}", *value)
        entries += struct.pack(order + "HH" + wide, tag, what, len(value))
        if len(raw) > (8 if big else 4):
            entries += struct.pack(order + wide, place + len(extra))
            extra += raw
        else:
            entries += raw.ljust(8 if big else 4, b"\0")
    start = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return start + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + bytes(8 if big else 4) + extra


def test_lzw_round_trip():
    rng = random.Random(1)
    for data in (b"", b"a", b"abababababab" * 50, bytes(rng.randrange(4) for _ in range(30_000)), bytes(rng.randrange(256) for _ in range(9000))):
        assert gt.unpack_lzw(lzw(data)) == data


FORMS = [{}, {"packed": 8}, {"packed": 5}, {"tile": 16}, {"tile": 16, "packed": 8, "order": ">"}, {"packed": 5, "tile": 16, "predictor": 2}, {"rows": 50}, {"big": True, "packed": 8}, {"bands": 3, "tile": 16}, {"predictor": 2, "order": ">"}]


@pytest.mark.parametrize("form", FORMS)
def test_layouts(spark, tmp_path, form):
    array = np.random.default_rng(2).integers(-1, 300, (37, 41)).astype(np.int16 if form.get("predictor") == 2 else np.float32)
    (tmp_path / "a.tif").write_bytes(tiff(array, **form))
    got = {(r["row"], r["col"]): r["value"] for r in gt.read(spark, str(tmp_path / "a.tif"), part=2000).collect()}
    assert got == {(r, c): (None if array[r, c] == -1 else float(array[r, c])) for r in range(37) for c in range(41)}
    some = {(r["row"], r["col"]): r["value"] for r in gt.read(spark, str(tmp_path), rows=(5, 20), cols=(30, 90)).collect()}
    assert some == {k: v for k, v in got.items() if 5 <= k[0] < 20 and k[1] >= 30}
    t = gt.transforms(spark, str(tmp_path / "a.tif")).first()
    assert (t["height"], t["width"], t["a"], t["c"], t["e"], t["f"]) == (37, 41, 0.5, 10.0, -0.5, 50.0)


def test_a_window_reads_only_its_blocks(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(np.zeros((64, 64), np.float32), tile=16))
    assert gt.blocks(spark, str(tmp_path / "a.tif")).count() == 16
    assert sorted((r["row"], r["col"]) for r in gt.blocks(spark, str(tmp_path / "a.tif"), rows=(17, 20), cols=(10, 33)).collect()) == [(16, 0), (16, 16), (16, 32)]
    assert gt.read(spark, str(tmp_path / "a.tif"), part=1024).rdd.getNumPartitions() > 1
    # a header that promises four gigabytes of blocks is enough to plan them
    tags = {256: (32768,), 257: (32768,), 322: (256,), 323: (256,), 324: tuple(range(16384)), 325: (262144,) * 16384, "order": "<"}
    assert len(gt.layout(tags)) == 16384


def test_what_is_no_such_file():
    with pytest.raises(ValueError):
        gt.header(b"no tiff at all at all")
    with pytest.raises(ValueError):
        gt.layout({256: (4,), 257: (4,), 259: (7,), 273: (8,), 279: (16,)})
