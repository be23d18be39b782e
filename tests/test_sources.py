"""Folders and archives as data sources."""

import io
import stat
import tarfile
import zipfile

import pytest

from quillmesh.sources import corpus, files



def test_folders(spark, tmp_path):
    """Hidden names, roots in order, each file once, an excluded folder, texts that aren't UTF-8."""
    names = {"one/a.md": "A\r\nb\rc", "one/_x.md": "x", "one/.y.md": "y", "one/sub/b.md": "b", "one/_sub/c.md": "c", "one/out/d.md": "d", "one/e.MD": "no", "one/f.txt": "no", "two/c.md": b"\xff\xfe", "three.md": "3"}
    for name, body in names.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body if isinstance(body, bytes) else body.encode())
    root = lambda *x: [str(tmp_path / i) for i in x]
    found = corpus.from_files(spark, root("one", "two", "one/sub", "gone", "three.md", "three.md"), tuple(root("one/out")))
    got = {r.path: (r.text, r.error) for r in found.collect()}
    assert got == {"a.md": ("A\nb\nc", None), "_x.md": ("x", None), ".y.md": ("y", None), "sub/b.md": ("b", None), "_sub/c.md": ("c", None), "c.md": (None, "not UTF-8"), "three.md": ("3", None)}
    assert found.count() == 7 and found.where("mtime > 0").count() == 7
    # what a path is relative to: the first root that holds the file
    assert {r.path for r in corpus.from_files(spark, root("one/sub", "one/a.md", "one"), tuple(root("one/out"))).collect()} == {"b.md", "a.md", "_x.md", ".y.md", "_sub/c.md"}
    assert {r.path for r in corpus.from_files(spark, ["file://" + str(tmp_path / "two")]).collect()} == {"c.md"} and corpus.from_files(spark, root("none")).count() == 0
    assert {r.path for r in corpus.from_spark_files(spark, root("one"), tuple(root("one/out"))).collect()} == {"a.md", "sub/b.md"}
    parts = files.FolderReader({"roots": str(tmp_path / "one")}).partitions()
    assert len(parts) == 4  # a task for each folder


def zipped(at, *members):
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            z.writestr(name, body)
    return str(at)


def tarred(at, *members, mode="w:gz"):
    with tarfile.open(at, mode) as t:
        for name, body in members:
            m = tarfile.TarInfo(name) if isinstance(name, str) else name
            m.size = len(body)
            t.addfile(m, io.BytesIO(body))
    return str(at)


def test_archives(spark, tmp_path):
    some = [("a.MD", b"one\r\ntwo"), ("d/b.Markdown", b"x"), ("c.txt", b"no"), ("_h.md", b"\xff")]
    paths = [zipped(tmp_path / "x.zip", *some), tarred(tmp_path / "y.tgz", *some), tarred(tmp_path / "z.tar", *some, mode="w"), tarred(tmp_path / "w.tar.xz", *some, mode="w:xz"), tarred(tmp_path / "v.tar.bz2", *some, mode="w:bz2")]
    got = corpus.from_archives(spark, paths).collect()
    want = {("a.md", "one\ntwo", None), ("d/b.md", "x", None), ("_h.md", None, "not UTF-8")}
    assert len(got) == 15 and all({(r.path, r.text, r.error) for r in got if r.archive == p} == want for p in paths)
    many = zipped(tmp_path / "m.zip", *((f"{i}.md", str(i) * 50) for i in range(100)))
    reader = files.ArchiveReader({"paths": many, "partitionBytes": "1000"})
    assert len(reader.partitions()) == 10 and sum(1 for p in reader.partitions() for _ in reader.read(p)) == 100  # members dealt to tasks


def link(kind):
    m = tarfile.TarInfo("l.md")
    m.type, m.linkname = kind, "a.md"
    return m


@pytest.mark.parametrize(
    "make, says",
    [
        (lambda p: zipped(p / "x", ("../a.md", b"x")), "unsafe"), (lambda p: zipped(p / "x", ("/a.md", b"x")), "unsafe"), (lambda p: zipped(p / "x", ("c:\\a.md", b"x")), "unsafe"),
        (lambda p: tarred(p / "x", ("a/../../b.md", b"x")), "unsafe"), (lambda p: tarred(p / "x", (link(tarfile.SYMTYPE), b"")), "link"), (lambda p: tarred(p / "x", (link(tarfile.LNKTYPE), b"")), "link"),
        (lambda p: tarred(p / "x", (link(tarfile.FIFOTYPE), b"")), "special"), (lambda p: zipped(p / "x", ("a.md", b"x"), ("a.markdown", b"y")), "become"), (lambda p: tarred(p / "x", ("a.md", b"x"), ("./a.md", b"y")), "become"),
        (lambda p: zipped(p / "x", *((f"{i}.txt", b"") for i in range(21))), "too many"), (lambda p: tarred(p / "x", *((f"{i}.md", b"") for i in range(21))), "too many"),
        (lambda p: zipped(p / "x", ("a.md", b"x" * 1001)), "limits"), (lambda p: tarred(p / "x", ("a.md", b"x" * 1001)), "limits"), (lambda p: zipped(p / "x", *((f"{i}.md", b"x" * 900) for i in range(6))), "limits"),
        (lambda p: tarred(p / "x", ("bomb.bin", b"0" * 200_000)), "limits"),
    ],
)
def test_unsafe_archives_and_limits(tmp_path, make, says):
    reader = files.ArchiveReader({"paths": make(tmp_path), "entries": "20", "fileBytes": "1000", "totalBytes": "5000"})
    with pytest.raises(ValueError, match=says):
        for p in reader.partitions():
            list(reader.read(p))


def test_links_in_zip_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        m = zipfile.ZipInfo("l.md")
        m.external_attr = (stat.S_IFLNK | 0o777) << 16
        z.writestr(m, "a.md")
    with pytest.raises(ValueError, match="link"):
        files.ArchiveReader({"paths": str(tmp_path / "x.zip")}).partitions()


def test_errors_reach_the_query(spark, tmp_path):
    with pytest.raises(Exception, match="unsafe"):
        corpus.from_archives(spark, zipped(tmp_path / "x.zip", ("../a.md", b"x"))).collect()


def test_tables_of_archives(spark, tmp_path):
    """Many small archives share tasks, large ones are dealt to several; limits hold as for a list of paths."""
    paths = [zipped(tmp_path / f"{i}.zip", (f"{i}.md", b"# %d" % i)) for i in range(40)]
    paths.append(zipped(tmp_path / "big.zip", *((f"b{i}.md", b"x" * 1000) for i in range(20))))
    table = spark.createDataFrame([(str(p),) for p in paths], "path string")
    got = corpus.from_archive_table(table, part_bytes=4000)
    assert got.rdd.getNumPartitions() < 20
    assert sorted((r.path, r.text, r.error) for r in got.collect()) == sorted([(f"{i}.md", f"# {i}", None) for i in range(40)] + [(f"b{i}.md", "x" * 1000, None) for i in range(20)])
    with pytest.raises(Exception, match="exceeds its limits"):
        corpus.from_archive_table(table, file_bytes=999).collect()
    assert corpus.from_archive_table(table.limit(0)).count() == 0
