"""Scans and sinks: image files, payloads, packing, manifest, dispatch."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.functions.png import encode_png
from kiln.sources import images, parquet
from kiln.sources.derived import f3_images, F2_SPEC, f2_orders
from kiln.spec import TensorSpec

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def png_dir(tmp_dir):
    """F4 + F5: PNGs of several sizes, a grayscale one and a corrupt file."""
    d = os.path.join(tmp_dir, "imgs")
    os.makedirs(d)
    imgs = {}
    for k, (h, w) in enumerate([(4, 5), (8, 8), (3, 7)]):
        img = ((np.arange(h * w * 3) * (k + 3)) % 256).astype(np.uint8).reshape(h, w, 3)
        imgs[k] = img
        with open(os.path.join(d, f"{k}.png"), "wb") as f:
            f.write(encode_png(img))
    grey = (np.arange(12) * 9 % 256).astype(np.uint8).reshape(3, 4)
    with open(os.path.join(d, "10.png"), "wb") as f:
        f.write(encode_png(grey))
    imgs[10] = np.repeat(grey[:, :, None], 3, axis=2)
    with open(os.path.join(d, "99.png"), "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\ncorrupt")
    return d, imgs


@pytest.mark.parametrize("fmt", ["image", "binary"])
def test_image_files(spark, png_dir, fmt):
    d, imgs = png_dir
    df = images.load_images(spark, d, format=fmt, on_invalid="drop")
    rows = {int(os.path.basename(r.path).split(".")[0]): r for r in df.collect()}
    assert set(rows) == set(imgs)  # corrupt file dropped
    for k, img in imgs.items():
        r = rows[k]
        assert (r.height, r.width, r.channels) == img.shape
        np.testing.assert_array_equal(np.array(r.image).reshape(img.shape), img)


def test_image_files_keep_invalid_as_null(spark, png_dir):
    d, _ = png_dir
    rows = images.load_images(spark, d, format="binary", on_invalid="null").collect()
    assert sum(r.image is None for r in rows) == 1


@pytest.mark.parametrize("fmt", ["image", "binary"])
def test_undecodable_files_fail_unless_asked(spark, png_dir, fmt):
    with pytest.raises(Exception):
        images.load_images(spark, png_dir[0], format=fmt).collect()


def test_readers_see_the_same_files(spark, tmp_dir):
    img = (np.arange(48) % 256).astype(np.uint8).reshape(4, 4, 3)
    for p in ("a.png", "plain", "x/b.png", "x/y/c.PNG", "z/d", "_hidden/e.png", "x/.f.png"):
        p = os.path.join(tmp_dir, p)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(encode_png(img))
    for fmt in ("image", "binary", "sharded"):
        rows = images.load_images(spark, tmp_dir, format=fmt).collect()
        assert sorted(os.path.basename(r.path) for r in rows) == ["a.png", "b.png", "c.PNG", "d", "plain"], fmt


def test_null_payload_is_an_error(spark):
    with pytest.raises(Exception, match="null payload"):
        images.read_payloads(spark.createDataFrame([(None,)], "payload binary"), "a long").collect()


def test_unknown_format():
    with pytest.raises(ValueError, match="accepted: parquet, image, binary"):
        images.load_images(None, "/nowhere", format="tiff")


def test_payload_roundtrip_and_ceiling(spark):
    src = f2_orders(spark, SF)
    pay = images.to_payloads(src, rows_per_payload=100)
    assert pay.agg(F.max("rows")).first()[0] <= 100
    back = images.read_payloads(pay, "o_orderkey long, image array<short>")
    assert back.count() == src.count() == 1500
    with pytest.raises(Exception, match="exceeds"):
        images.to_payloads(src, rows_per_payload=1000, max_payload_bytes=100).collect()


def test_pack_rows_per_file(spark, tmp_dir):
    out = os.path.join(tmp_dir, "packed")
    res = parquet.pack(f2_orders(spark, SF), out, rows_per_file=200, partitions=2)
    assert res["rows"] == 1500
    man = parquet.manifest(spark, out).collect()
    assert sum(r.rows for r in man) == 1500 and max(r.rows for r in man) <= 200 and len(man) >= 8


def test_pack_merges_small_partitions(spark, tmp_dir):
    out = os.path.join(tmp_dir, "merged")
    assert parquet.pack(f2_orders(spark, SF).repartition(50), out, rows_per_file=1000)["rows"] == 1500
    rows = sorted(r.rows for r in parquet.manifest(spark, out).collect())
    assert sum(rows) == 1500 and rows[-1] <= 1000 and len(rows) <= 4


def test_manifest_lists_files_without_rows(spark, tmp_dir):
    out = os.path.join(tmp_dir, "with space")
    spark.range(5).coalesce(1).write.parquet(out)
    spark.range(0).coalesce(1).write.mode("append").parquet(out)
    man = parquet.manifest(spark, out).collect()
    assert sorted(r.rows for r in man) == [0, 5] and all(r.bytes > 0 for r in man)
    by_spark = parquet.manifest(spark, out, by_executors=False).collect()
    assert sorted(by_spark) == sorted(man) and all(os.path.exists(r.file_path) for r in man)


def test_manifest_of_an_empty_folder(spark, tmp_dir):
    os.makedirs(empty := os.path.join(tmp_dir, "none"))
    assert parquet.manifest(spark, empty).collect() == [] == parquet.manifest(spark, empty, by_executors=False).collect()


def test_read_tensors_checks(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t")
    parquet.write_parquet(f2_orders(spark, SF), p)
    d = parquet.read_tensors(spark, p, "image", keep=["o_orderkey"])
    assert TensorSpec.of(d, "image") == F2_SPEC  # spec came back from the file metadata
    with pytest.raises(parquet.SchemaMismatch):
        parquet.read_tensors(spark, p, "nope")
    with pytest.raises(parquet.SchemaMismatch):
        parquet.read_tensors(spark, p, "o_orderkey", F2_SPEC)


def test_collect_bounded(spark):
    assert len(parquet.collect_bounded(spark.range(5), 5)) == 5
    with pytest.raises(parquet.TooManyRows):
        parquet.collect_bounded(spark.range(6), 5)


def test_noop_and_drain(spark):
    from kiln.streaming.batches import drain, iter_batches

    d = f2_orders(spark, SF)
    assert parquet.write_noop(d)["rows"] == 1500
    assert drain(d).agg(F.sum("rows")).first()[0] == 1500
    batches = list(iter_batches(d.limit(25), batch_size=10))
    assert [b.num_rows for b in batches] == [10, 10, 5]


def test_sharded_listing_on_executors(spark, tmp_dir):
    root = os.path.join(tmp_dir, "sharded")
    want = {}
    for shard in ("a", "b"):
        os.makedirs(os.path.join(root, shard, "deeper"))
        for k in range(3):
            img = ((np.arange(5 * 4 * 3) + k + ord(shard)) % 256).astype(np.uint8).reshape(5, 4, 3)
            p = os.path.join(root, shard, "deeper" if k == 2 else "", f"{shard}{k}.png")
            with open(p, "wb") as f:
                f.write(encode_png(img))
            want[f"{shard}{k}"] = img
    with open(os.path.join(root, "a", "notes.txt"), "w") as f:
        f.write("not an image")
    with open(os.path.join(root, "b", "broken.png"), "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\nbroken")
    assert images.list_files(spark, root).count() == 8  # 6 images, a broken one, a text
    listed = images.list_files(spark, [f"{root}/a", f"file://{root}/b"], (".PNG",)).collect()
    assert len(listed) == 7 and sum(r.path.startswith("file://") for r in listed) == 4
    assert images.list_files(spark, root, recursive=False).count() == 0
    rows = images.load_images(spark, root, format="sharded", on_invalid="drop").collect()
    got = {os.path.basename(r.path)[:-4]: r for r in rows}
    assert set(got) == set(want)
    for k, img in want.items():
        np.testing.assert_array_equal(np.array(got[k].image).reshape(img.shape), img)


def test_raw_jvm_images_fused_into_map_images(spark, png_dir):
    from kiln.functions import Preprocess
    from kiln.operators.score import map_images

    d, imgs = png_dir
    pre = Preprocess(TensorSpec.image(8, 8, 3), resize=4, crop=4, scale=255.0, dtype="float64")
    two_step = map_images(images.read_image_files(spark, d, on_invalid="drop"), pre, keep=["path"])
    raw = images.read_image_files(spark, d, raw=True, on_invalid="null")
    fused = map_images(raw, pre, column="data", channels="channels", bgr=True, keep=["path"], on_invalid="null")
    a = {os.path.basename(r.path): r.tensor for r in two_step.collect()}
    b = {os.path.basename(r.path): r.tensor for r in fused.collect()}
    assert b.pop("99.png") is None  # the corrupt file: -1 size from the JVM decoder -> null output
    assert a == b and len(a) == len(imgs)


def test_skewed_tree_is_listed_like_other_readers_do(spark, tmp_dir):
    root = f"{tmp_dir}/tree"
    folders = ["a/b/c/d/e/f"] * 40 + [f"wide/{i}" for i in range(30)] + ["", "_hidden", "a/.git", "a/b"]
    for i, folder in enumerate(folders):
        os.makedirs(f"{root}/{folder}", exist_ok=True)
        with open(f"{root}/{folder}/f{i}.bin", "wb") as f:
            f.write(b"x" * (i + 1))
    for name in ("a/b/_SUCCESS", "a/empty/none/.keep"):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w"):
            pass
    got = sorted((r.path, r.size) for r in images.list_files(spark, root).collect())
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length").collect()
    assert got == sorted((r.path.removeprefix("file:"), r.length) for r in want) and len(got) == 72


def test_read_leaves_the_session_as_it_was(spark, tmp_dir):
    wide = TensorSpec.image(256, 256, 3)
    path = f"{tmp_dir}/wide"
    f3_images(spark, SF, "supplier", "s_suppkey").write.parquet(path)
    before = dict(spark.conf.getAll)
    df = parquet.read_tensors(spark, path, "image", wide, tasks=3)
    assert df.count() == 10 and dict(spark.conf.getAll) == before
    assert int(df.sparkSession.conf.get(parquet.READER_BATCH)) == (64 << 20) // wide.nbytes
    both = df.join(spark.range(1, 6).withColumnRenamed("id", "s_suppkey"), "s_suppkey")  # of two sessions
    assert both.count() == 5
    narrow = parquet.read_tensors(spark, f"{SF}/embeddings.parquet", "embedding", TensorSpec.vector(64))
    assert narrow.sparkSession is spark or narrow.sparkSession.conf.get(parquet.READER_BATCH, "4096") == "4096"


def test_split_read_spreads_without_exchange(spark, tmp_dir):
    path = f"{tmp_dir}/many"
    f2_orders(spark, SF).repartition(12).write.parquet(path)
    one = parquet.read_tensors(spark, path, "image", F2_SPEC, tasks=1)
    many = parquet.read_tensors(spark, path, "image", F2_SPEC, tasks=12)
    assert one.rdd.getNumPartitions() < many.rdd.getNumPartitions() and many.count() == 1500
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()


def test_small_files_share_tasks(spark, tmp_path):
    """Tasks of the file readers are cut by what small files cost to open, not by Spark's 4 MiB for each."""
    from kiln.sources import images

    for i in range(100):
        (tmp_path / f"{i}.png").write_bytes(encode_png(np.full((4, 4, 3), i, np.uint8)))
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, 1 << 20)
    try:
        for format in ("image", "binary"):
            rows = images.load_images(spark, str(tmp_path), format=format)
            assert rows.rdd.getNumPartitions() <= 20
            assert sorted(r.image[0] for r in rows.select("image").collect()) == list(range(100))
    finally:
        spark.conf.set(key, before)
    assert spark.conf.get("spark.sql.files.openCostInBytes").startswith("4194304")


def test_full_size_images_are_made_by_all_tasks(spark):
    """A table of keys is one split; the images made from it are not one task's."""
    small = TensorSpec((2, 2, 3), "HWC", "int16")
    made = f3_images(spark, SF, "supplier", "s_suppkey", small)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    want = {r.s_suppkey: [(r.s_suppkey + 7 * i) % 256 for i in range(12)] for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    assert {r.s_suppkey: r.image for r in made.collect()} == want and len(want) == 10


def test_queries_write_image_files_into_folders(spark, tmp_dir):
    """No folder holds all the files of a table, and the readers find those of all folders."""
    from kiln.plans import catalog

    keys = spark.range(300).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size")
    keys.coalesce(1).write.parquet(f"{tmp_dir}/part.parquet")
    for path in (catalog._png_folder(spark, tmp_dir), catalog._cut_png_folder(spark, tmp_dir)):
        held = [len(files) for _, _, files in os.walk(path)]
        assert sum(held) == 300 and max(held) < 30
        report = images.image_report(spark, path).first()
        assert (report.files, report.decoded + report.invalid) == (300, 300) and report.invalid == (30 if "-cut-" in path else 0)
    got = {r.p_partkey: r.image for r in catalog.s3_image_files(spark, tmp_dir).collect()}
    assert got == {k: [(k * 17 + i * 5) % 256 for i in range(192)] for k in range(300)}


def test_tasks_of_the_image_readers_stay_short(spark, tmp_path):
    """A file costs a decoder milliseconds: a task takes as many files as 128 KiB each allow, not thousands."""
    for i in range(100):
        (tmp_path / f"{i}.png").write_bytes(encode_png(np.full((4, 4, 3), i, np.uint8)))
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, 1 << 20)
    try:
        rows = images.load_images(spark, str(tmp_path), format="image")
        held = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(held) == 100 and max(held) <= 8
    finally:
        spark.conf.set(key, before)


def _png(rows, ctype, w, h, depth=8, extra=b""):
    """A PNG of filtered lines."""
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = chunk(b"IDAT", zlib.compress(rows)[:9]) + chunk(b"IDAT", zlib.compress(rows)[9:])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, ctype, 0, 0, 0)) + extra + data + chunk(b"IEND", b"")


@pytest.fixture()
def odd_files(tmp_dir):
    """Files of many kinds, in folders and under names that patterns and URIs would read otherwise."""
    import struct
    import zlib

    rng, files = np.random.default_rng(2), {}
    for c, ctype in ((1, 0), (2, 4), (3, 2), (4, 6)):
        for kinds in ([0] * 5, [1, 2, 0, 2, 1], [2, 2, 1, 1, 0], [1, 3, 4, 0, 2]):
            lines = b"".join(bytes([k]) + rng.integers(0, 256, 7 * c, dtype=np.uint8).tobytes() for k in kinds)
            files[f"c{c}/{''.join(map(str, kinds))}.png"] = _png(lines, ctype, 7, 5)
    good = files["c3/00000.png"]
    palette = struct.pack(">I", 12) + b"PLTE" + bytes(range(12)) + struct.pack(">I", zlib.crc32(b"PLTE" + bytes(range(12))))
    files["palette.png"] = _png(b"".join(bytes([0, 0, 1, 2, 3]) for _ in range(3)), 3, 4, 3, extra=palette)
    files["deep.png"] = _png(b"".join(bytes([0]) + bytes(range(12)) for _ in range(2)), 2, 2, 2, depth=16)
    pixels = bytes(range(24))
    files["x.bmp"] = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + 24, 0, 0, 54, 40, 4, 2, 1, 24, 0, 24, 0, 0, 0, 0) + pixels
    files |= {f"cut/{n}.png": good[:n] for n in (0, 5, 8, 20, 32, 33, 60, len(good) - 14, len(good) - 5)}
    files |= {"bad sum.png": good[:-1] + b"?", "tail.png": good + b"??", "text.txt": b"no image", "a [b]{c}*?/x%41 é,&\"#.png": good, "a=b/_c=d/in.png": good,
              "_out/no.png": good, "x/.no.png": good, "x/no._COPYING_": good, "_metadata": b"read by Spark"}
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{tmp_dir}/{name}"), exist_ok=True)
        with open(f"{tmp_dir}/{name}", "wb") as f:
            f.write(data)
    return tmp_dir


@pytest.mark.parametrize("on_invalid", ["null", "drop"])
@pytest.mark.parametrize("indexed", [50_000, 7])
def test_listed_images_are_those_of_sparks_source(spark, odd_files, monkeypatch, on_invalid, indexed):
    """Whatever the executors decode themselves and whatever is left to the JVM, at once or in parts: the same rows."""
    monkeypatch.setattr(images, "INDEXED_FILES", indexed)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for glob in (None, "*.png", "{x*,?al*}"):
        got = images.read_image_files(spark, odd_files, on_invalid=on_invalid, glob=glob, raw=True)
        want = rows(images._jvm_images(spark, [odd_files], on_invalid, glob))
        assert rows(got) == want and len(want) > (5 if glob is None else 1)
    kept = images.read_image_files(spark, odd_files, on_invalid=on_invalid)
    assert kept.where("image is null").count() == (0 if on_invalid == "drop" else kept.count() - kept.where("height > 0").count())


def test_binary_images_keep_their_paths(spark, odd_files):
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(odd_files)
    got = images.read_binary_images(spark, odd_files, on_invalid="null")
    assert sorted(r.path for r in got.collect()) == sorted(r.path for r in source.select("path").collect())
    some = images.read_binary_images(spark, odd_files, on_invalid="drop", glob="0*.png")
    assert some.count() == 4 and {os.path.basename(r.path) for r in some.collect()} == {"00000.png"}


@pytest.mark.parametrize("fmt", ["image", "binary"])
def test_the_driver_does_not_index_image_files(spark, png_dir, fmt):
    """The files are listed and read by tasks: no scan of Spark's lies over the folder."""
    df = images.load_images(spark, png_dir[0], format=fmt, on_invalid="null")
    assert png_dir[0] not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 5
    assert images.load_images(spark, f"{png_dir[0]}/1.png", format=fmt).count() == 1
    assert images.load_images(spark, f"{png_dir[0]}/[01].png", format=fmt).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        images.load_images(spark, f"{png_dir[0]}/none", format=fmt).count()
