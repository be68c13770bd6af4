"""Packed TIFF stacks that the tests pack themselves, read back through the data source."""

import struct
import zlib

import numpy as np
import pytest

from fluxtrace.functions import packing
from fluxtrace.sources.movies import TiffMovie


def pack_bits(data):
    out, i = b"", 0
    while i < len(data):
        run = next((n for n in range(1, 128) if data[i + n : i + n + 1] != data[i : i + 1]), 128)
        out += bytes([257 - run]) + data[i : i + 1] if run > 1 else bytes([0]) + data[i : i + 1]
        i += run
    return out + bytes([128])  # a count that does nothing


def pack_lzw(data):
    table, codes, word = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
    at, width = 258, 9
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        codes.append((table[word], width))
        table[more] = at
        at += 1
        width = 9 + (at > 511) + (at > 1023) + (at > 2047)
        if at == 4094:
            codes.append((256, width))
            table, at, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = data[k : k + 1]
    if word:
        codes.append((table[word], width))
        at += 1
        width = 9 + (at > 511) + (at > 1023) + (at > 2047)
    codes.append((257, width))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def stack(path, frames, kind, pack, order="<", predictor=1, rows=5):
    out, where = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0)), 4
    for frame in frames:
        stored = np.diff(frame, axis=1, prepend=frame.dtype.type(0)) if predictor == 2 else frame
        strips = [pack(stored[i : i + rows].astype(frame.dtype.newbyteorder(order)).tobytes()) for i in range(0, len(frame), rows)]
        offsets = [len(out) + sum(map(len, strips[:i])) for i in range(len(strips))]
        out += b"".join(strips)
        lists = len(out)
        out += struct.pack(f"{order}{2 * len(strips)}I", *offsets, *map(len, strips))
        struct.pack_into(order + "I", out, where, len(out))
        tags = [(256, frame.shape[1]), (257, frame.shape[0]), (258, 8 * frame.itemsize), (259, kind), (262, 1), (273, lists), (277, 1), (278, rows), (279, lists + 4 * len(strips)), (317, predictor)]
        out += struct.pack(order + "H", len(tags))
        for tag, value in tags:
            out += struct.pack(order + "HHII", tag, 4, len(strips) if tag in (273, 279) else 1, value)
        where = len(out)
        out += struct.pack(order + "I", 0)
    path.write_bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize(("kind", "pack"), [(1, bytes), (5, pack_lzw), (8, zlib.compress), (32773, pack_bits)])
def test_packed_stacks_come_back(spark, tmp_path, kind, pack, predictor, order):
    rng = np.random.default_rng(kind)
    smooth = np.add.outer(np.arange(17) * 3, np.arange(23) * 2)
    frames = [(smooth * 700 + rng.integers(0, 2, (17, 23))).astype("u2"), np.zeros((17, 23), "u2"), rng.integers(0, 65536, (17, 23)).astype("u2")]
    stack(tmp_path / "a.tif", frames, kind, pack, order, predictor)
    spark.dataSource.register(TiffMovie)
    got = spark.read.format("tiff_movie").options(path=str(tmp_path / "a.tif")).load().orderBy("frame").collect()
    assert [(r["h"], r["w"]) for r in got] == [(17, 23)] * 3
    assert all(r["data"] == f.ravel().tolist() for r, f in zip(got, frames, strict=True))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 600, 40_000])
@pytest.mark.parametrize("letters", [1, 2, 256])
def test_strips_of_every_length(n, letters):
    data = np.random.default_rng(n).integers(0, letters, n).astype("u1").tobytes()
    assert packing.unpack_lzw(pack_lzw(data)) == data  # 40,000 fill the table more than once
    assert packing.unpack_bits(pack_bits(data)) == data


def test_unknown_packing_is_an_error(spark, tmp_path):
    stack(tmp_path / "a.tif", [np.zeros((4, 4), "u2")], 7, bytes)
    with open(tmp_path / "a.tif", "rb") as file, pytest.raises(NotImplementedError):
        from fluxtrace.sources.movies import tiff_pages

        tiff_pages(file)
