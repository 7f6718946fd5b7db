import numpy as np
import pytest

from newsengine.llm.tiff import SCHEMES, TiffError, directories, lzw, packbits, read_page, tiff_pages, tiff_store, unlzw, unpackbits, write_tiff


@pytest.mark.parametrize("scheme", SCHEMES)
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_round_trip(scheme, predictor, tile):
    rng = np.random.default_rng(len(scheme) + predictor)
    for _ in range(6):
        pages = [rng.integers(0, rng.choice([3, 256]), (rng.integers(1, 90), rng.integers(1, 70), rng.choice([1, 3]))).astype(np.uint8) for _ in range(rng.integers(1, 4))]
        data = write_tiff([*pages, np.zeros((40, 200), np.uint8)], scheme, predictor, int(rng.integers(1, 64)), tile)
        got = [read_page(data, f) for f in directories(data)]
        assert len(got) == len(pages) + 1
        for a, (b, name) in zip(pages, got):
            assert name == scheme and np.array_equal(a, b)


def test_known_codes():
    known = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")  # the format's published PackBits example
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert unpackbits(known, 24) == plain and unpackbits(packbits(plain), 24) == plain
    for size in (0, 1, 253, 254, 255, 5000, 70000):
        data = bytes(np.random.default_rng(size).integers(0, 7, size).astype(np.uint8))
        assert unlzw(lzw(data), size) == data
        assert unpackbits(packbits(data), size) == data


def test_big_endian_directory():
    import struct

    body = struct.pack(">2sHI", b"MM", 42, 8)
    fields = [(256, 3, 2), (257, 3, 1), (258, 3, 8), (259, 3, 1), (273, 4, 200), (277, 3, 1), (278, 3, 1), (279, 4, 2)]
    ifd = struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields) + b"\0\0\0\0"
    data = (body + ifd).ljust(200, b"\0") + b"\x05\x09"
    page, _ = read_page(data, next(directories(data)))
    assert page.ravel().tolist() == [5, 9]


def test_malformed():
    good = write_tiff([np.ones((4, 4), np.uint8)])
    for bad in (b"", b"GIF89a..", good[:20], b"II*\0\xff\xff\xff\xff"):
        with pytest.raises(TiffError):
            [read_page(bad, f) for f in directories(bad)]


def test_frames(spark):
    texts = [None, "", "a", "é" * 100, "x" * 64, "long " * 20000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'q' as media", "7 as page")
    pages = tiff_pages(tiff_store(df)).collect()
    assert len(pages) == len(texts)
    for r in pages:
        raw = (texts[r.doc_id] or "").encode()
        assert bytes(r.pixels) == raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)) and r.error is None and r.page == 0
    two = spark.createDataFrame([(1, bytearray(write_tiff([np.ones((2, 2), np.uint8), np.zeros((3, 1), np.uint8)]))), (2, bytearray(b"no")), (3, None)], "k int, media binary")
    got = sorted((r.k, r.page, r.error is not None) for r in tiff_pages(two).select("k", "page", "error").na.fill(-1).collect())
    assert got == [(1, 0, False), (1, 1, False), (2, -1, True)]
    assert tiff_pages(tiff_store(df.limit(0))).count() == 0
