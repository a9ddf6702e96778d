"""The checksum byte of a digest sees every byte of a long text."""

from tissuegrid.llm.fingerprints import digest


def test_checksum_sums_all_bytes():
    for size in (0, 1, 4, 997, 1994, 50_000):
        text = bytes(i * i % 251 for i in range(size))
        assert int(digest(text)[2:4], 16) == sum(text) % 256
    text = b"abcd" * 1000
    assert digest(text[:1] + b"z" + text[2:])[2:4] != digest(text)[2:4]
