import glob
import hashlib
import zlib

import pytest

from eventide.llm import media


def padded(text):
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")


def test_images_come_back_whole(spark, docs, tmp_path):
    path = f"file://{tmp_path}/archive"
    media.write_images(docs, path)
    rows = docs.collect()
    for split in (500, 1 << 20):
        got = media.describe_images(media.read_images(spark, path, split)).collect()
        expected = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), hashlib.sha256(p := padded(r["text"])).hexdigest(), len(p), zlib.crc32(p[-16:])) for r in rows)
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["payload_sha256"], r["payload_bytes"], r["tail_crc32"]) for r in got) == expected
    same = [r for r in got if r["doc_id"] in (7, 8)]
    assert len({(r["media_sha256"], r["feature"], r["media_bytes"]) for r in same}) == 1
    assert media.read_images(spark, path, 500).rdd.getNumPartitions() > media.read_images(spark, path, 1 << 20).rdd.getNumPartitions()


def test_a_whole_table_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = media.op9_media_columns(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        data, image = padded(texts[r["doc_id"]]), media.to_image((texts[r["doc_id"]] or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((texts[r["doc_id"]] or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        counts = [sum(32 * k <= x < 32 * k + 32 for x in data) / len(data) for k in range(8)]
        assert r["feature"].startswith(f"mean={sum(data) / len(data):.4f};") and r["feature"].endswith("shares=" + ",".join(f"{c:.4f}" for c in counts))


def test_overwriting_and_appending(spark, docs, tmp_path):
    path = f"file:{tmp_path}/archive"  # one slash, as Hadoop writes it
    media.write_images(docs, path)
    media.write_images(docs, path)
    assert media.read_images(spark, path).count() == 2 * docs.count()
    one = media.read_images(spark, path).where("doc_id = 7").limit(1).collect()
    spark.createDataFrame(one, media.SCHEMA).write.format("media_archive").mode("overwrite").save(path)
    assert [r["doc_id"] for r in media.read_images(spark, path).collect()] == [7]


def test_parts_of_a_long_index(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "INDEX_ROWS", 4)
    offsets = media.np.cumsum(media.np.random.default_rng(0).integers(1, 9, 500)).astype("<i8")
    (tmp_path / "x.idx").write_bytes(offsets.tobytes())
    fs, at = media.files.place(f"{tmp_path}/x.idx")
    for start, stop in ((0, 1), (0, 10**6), (700, 720), (int(offsets[9]), int(offsets[10])), (10**6, 10**7)):
        expected = offsets[(offsets >= start) & (offsets < stop)]
        assert media.offsets_between(fs, at, start, stop).tolist() == expected.tolist()


def test_an_empty_table(spark, docs, tmp_path):
    media.write_images(docs.limit(0), f"file://{tmp_path}/none")
    assert media.read_images(spark, f"file://{tmp_path}/none").count() == 0


def test_a_member_is_read_again_by_its_offset(spark, docs, tmp_path):
    path = f"file://{tmp_path}/archive"
    media.write_images(docs.coalesce(1), path)
    (archive,) = glob.glob(f"{tmp_path}/archive/*.arc")
    fs, place = media.files.place(f"file://{archive}")
    offsets = media.np.frombuffer(open(archive[:-4] + ".idx", "rb").read(), "<i8")

    class Breaks:
        """A file system whose first handle fails once, inside a member."""

        def __init__(self):
            self.opened = 0

        def open_input_stream(self, p):
            return fs.open_input_stream(p)

        def open_input_file(self, p):
            file = fs.open_input_file(p)
            self.opened += p.endswith(".arc")
            if self.opened != 1 or p.endswith(".idx"):
                return file

            class Short:
                reads = 0

                def __enter__(self):
                    return self

                def __exit__(self, *args):
                    file.close()

                def seek(self, at):
                    file.seek(at)

                def read(self, n):
                    self.reads += 1
                    return file.read(n)[:5] if self.reads == 8 else file.read(n)

            return Short()

    broken = Breaks()
    reader, usual = media.ArchiveReader(path, 1 << 30), media.files.place
    try:
        media.files.place = lambda p: (broken, usual(p)[1])
        (part,) = [media.Range(archive.split("/")[-1][:-4], 0, 1 << 30)]
        rows = [x for b in reader.read(part) for x in b["doc_id"].to_pylist()]
    finally:
        media.files.place = usual
    assert broken.opened == 3 and len(rows) == len(offsets) == docs.count()

    body = bytearray(open(archive, "rb").read())
    body[int(offsets[2]) + 40] ^= 1
    open(archive, "wb").write(body)
    with pytest.raises(ValueError):
        media.retry_member(fs, place, int(offsets[2]), wait=0)
    assert media.retry_member(fs, place, int(offsets[3]), wait=0)
