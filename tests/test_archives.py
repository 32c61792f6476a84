"""Archives as a data source."""

import io
import os
import tarfile
import zipfile

import pytest

from basaltine.sources import archives


def packed(path, members):
    if str(path).endswith(".zip"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in members:
                z.writestr(name, body)
    else:
        with tarfile.open(path, "w:gz" if str(path).endswith("gz") else "w") as t:
            for name, body in members:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))


def test_members_of_all_archives(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    files = {"a.zip": [("x/1.py", b"one"), ("x/", b""), ("2.txt", os.urandom(9000))], "deep/b.tar.gz": [("3", b"three"), ("é/4", b"")], "c.tar": [("5", b"five" * 5000)], "empty.zip": []}
    for name, members in files.items():
        packed(tmp_path / name, members)
    (tmp_path / "note.txt").write_text("no archive")
    want = sorted((name, n, b) for name, members in files.items() for n, b in members if not n.endswith("/"))
    for options in ({}, {"rangeBytes": 1}, {"rangeBytes": 5000}):
        got = archives.read_archives(spark, str(tmp_path), **options)
        assert sorted((os.path.relpath(r.archive, tmp_path), r.name, bytes(r.content)) for r in got.collect()) == want
    assert archives.read_archives(spark, f"file://{tmp_path}/a.zip").count() == 2
    assert archives.read_archives(spark, str(tmp_path / "deep"), rangeBytes=1).rdd.getNumPartitions() == 1


def test_ranges_cover_all_members(tmp_path):
    packed(tmp_path / "big.zip", [(str(k), os.urandom(1000)) for k in range(50)])
    parts = archives.ArchiveReader({"path": str(tmp_path), "rangebytes": "5000"}).partitions()
    assert len(parts) > 5 and parts[0].first == 0 and parts[-1].end == 50
    assert all(a.end == b.first for a, b in zip(parts, parts[1:]))


def link_in_zip(path):
    info = zipfile.ZipInfo("link")
    info.external_attr = 0o120777 << 16
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(info, "/etc/passwd")


def link_in_tar(path):
    info = tarfile.TarInfo("link")
    info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
    with tarfile.open(path, "w") as t:
        t.addfile(info)


def lying_size(path):
    """A member that declares ten bytes and unpacks to a million."""
    packed(path, [("bomb", b"\0" * 1_000_000)])
    raw = path.read_bytes()
    at = raw.rindex(b"PK\x01\x02")
    path.write_bytes(raw[: at + 24] + (10).to_bytes(4, "little") + raw[at + 28 :])


BAD = {
    "link.zip": link_in_zip,
    "link.tar": link_in_tar,
    "up.zip": lambda p: packed(p, [("../x", b"")]),
    "root.tar.gz": lambda p: packed(p, [("/x", b"")]),
    "many.zip": lambda p: packed(p, [(str(k), b"") for k in range(21)]),
    "many.tgz": lambda p: packed(p, [(str(k), b"") for k in range(21)]),
    "bomb.zip": lambda p: packed(p, [("z", b"\0" * 200_000)]),
    "bomb.tar.gz": lambda p: packed(p, [("y", b"\0" * 60_000), ("z", b"\0" * 60_000)]),
    "lie.zip": lying_size,
}


@pytest.mark.parametrize("name", sorted(BAD))
def test_what_is_not_allowed_ends_the_reading(name, tmp_path):
    BAD[name](tmp_path / name)
    reader = archives.ArchiveReader({"path": str(tmp_path), "maxmembers": "20", "maxbytes": "100000"})
    with pytest.raises((ValueError, zipfile.BadZipFile)):
        for part in reader.partitions():
            list(reader.read(part))


def test_an_error_ends_the_query(spark, tmp_path):
    link_in_zip(tmp_path / "link.zip")
    with pytest.raises(Exception, match="is not allowed"):
        archives.read_archives(spark, str(tmp_path)).count()
