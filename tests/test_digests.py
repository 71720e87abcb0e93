"""Digests of files of any size."""

from __future__ import annotations

import hashlib

from gaugeflow.sources import readers as rd


def test_files_beyond_a_row_are_hashed_in_chunks(spark, tmp_path):
    (tmp_path / "part a").mkdir()
    files = {"part a/small.bin": b"abc" * 1000, "large.bin": bytes(range(256)) * 50_000}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    with open(tmp_path / "sparse.bin", "wb") as f:  # over what a row can hold
        f.truncate(2_200_000_000)
    zeros = hashlib.sha256()
    for _ in range(22):
        zeros.update(bytes(100_000_000))
    for whole in (5_000, 1 << 28):
        rows = {r["path"].rsplit("/")[-1]: r for r in rd.checksum_manifest(spark, str(tmp_path), "*.bin", whole).collect()}
        assert len(rows) == 3 and rows["sparse.bin"]["sha256"] == zeros.hexdigest() and rows["sparse.bin"]["size"] == 2_200_000_000
        for name, content in files.items():
            r = rows[name.rsplit("/")[-1]]
            assert (r["size"], r["md5"], r["sha256"]) == (len(content), hashlib.md5(content).hexdigest(), hashlib.sha256(content).hexdigest())
