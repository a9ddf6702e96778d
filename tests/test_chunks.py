"""Chunked array stores against the arrays that were written."""

import gzip
import json
import shutil

import numpy as np
import pytest

from tissuegrid.sources import chunks


def write(folder, data, chunk_rows, packed=False, big=False):
    kind = data.dtype.name
    codecs = [{"name": "bytes", "configuration": {"endian": "big" if big else "little"}}] + ([{"name": "gzip", "configuration": {"level": 1}}] if packed else [])
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(data.shape), "data_type": kind, "fill_value": 0, "codecs": codecs}
    meta["chunk_grid"] = {"name": "regular", "configuration": {"chunk_shape": [chunk_rows, data.shape[1]]}}
    folder.mkdir(parents=True)
    (folder / "zarr.json").write_text(json.dumps(meta))
    for i in range(-(-len(data) // chunk_rows)):
        part = np.zeros((chunk_rows, data.shape[1]), data.dtype)
        own = data[i * chunk_rows : (i + 1) * chunk_rows]
        part[: len(own)] = own
        raw = part.astype(part.dtype.newbyteorder(">" if big else "<")).tobytes()
        (folder / "c" / str(i)).mkdir(parents=True)
        (folder / "c" / str(i) / "0").write_bytes(gzip.compress(raw) if packed else raw)


@pytest.fixture
def store(tmp_path):
    rng = np.random.default_rng(1)
    slides = {"s1": (25, 10, False, False), "s2": (7, 10, True, True), "s3": (40, 8, True, False)}
    made = {}
    for name, (n, rows, packed, big) in slides.items():
        coords, features = rng.integers(0, 99, (n, 2)).astype(np.int32), rng.normal(size=(n, 5)).astype(np.float32)
        write(tmp_path / name / "coords", coords, rows, packed, big)
        write(tmp_path / name / "features", features, rows, packed, big)
        made[name] = (coords, features)
    return tmp_path, made


def test_reads_what_was_written(spark, store):
    path, made = store
    rows = chunks.read_chunked_tiles(spark, str(path)).collect()
    assert len(rows) == 72
    for r in rows:
        coords, features = made[r["slide_id"]]
        assert (r["gx"], r["gy"]) == tuple(coords[r["tile_idx"]])
        assert np.array_equal(np.array(r["features"], np.float32), features[r["tile_idx"]])


def test_chunks_outside_the_range_are_never_opened(spark, store):
    path, made = store
    for name, i in (("s1", 0), ("s3", 0), ("s3", 4)):
        (path / name / "coords" / "c" / str(i) / "0").write_bytes(b"not a chunk")
    # rows 10 to 15 lie in chunk 1 of ten rows, and of eight
    rows = chunks.read_chunked_tiles(spark, str(path), features=False, rows=(10, 16)).collect()
    assert {(r["slide_id"], r["tile_idx"]): (r["gx"], r["gy"]) for r in rows} == {
        (s, i): tuple(made[s][0][i]) for s in ("s1", "s3") for i in range(10, 16)
    }
    with pytest.raises(Exception, match="not a gzip|gzipped|reshape|BadGzip|buffer size"):
        chunks.read_chunked_tiles(spark, str(path), features=False).collect()


def test_coordinates_do_without_features(spark, store):
    path, _ = store
    for name in ("s1", "s2", "s3"):
        shutil.move(path / name / "features", path.parent / f"away-{path.name}-{name}")
    assert chunks.read_chunked_tiles(spark, str(path), features=False).count() == 72
    assert chunks.read_chunked_tiles(spark, str(path), features=False, rows=(5, 5)).count() == 0


def test_what_is_not_understood_is_refused():
    with pytest.raises(ValueError):
        chunks.decode_chunk(b"", "float32", False, ["bytes", "blosc"], 2)
    with pytest.raises(ValueError):
        chunks.decode_chunk(b"", "complex64", False, ["bytes"], 2)
