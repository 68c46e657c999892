"""The frame source and its sink; pairs in lock-step, as a batch and as a stream."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import pairing
from lanewise.sources import frames as S


def rows(spark, n=60, videos=3, per_part=4, size=(4, 2, 1)):
    w, h, c = size
    k = F.floor(F.col("id") / videos)
    pixels = F.unhex(F.repeat(F.lpad(F.hex(F.col("id") % 256), 2, "0"), w * h * c))
    part = (F.floor(k / per_part) + 1).cast("int")
    return spark.range(n).select((F.col("id") % videos).cast("string").alias("video_id"), part.alias("part_no"), k.alias("frame_index"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(c).alias("channels"), pixels.alias("pixels"))


@pytest.fixture
def folder(spark, tmp_path):
    S.write_frames(rows(spark), f"file://{tmp_path}/frames")
    return f"{tmp_path}/frames"


def read(spark, path, **options):
    return spark.read.format(S.NAME).options(**options).load(path)


def test_what_is_written_is_read(spark, folder):
    want = {(r.video_id, r.part_no, r.frame_index, bytes(r.pixels)) for r in rows(spark).collect()}
    got = read(spark, folder).collect()
    assert len(got) == 60 and {(r.video_id, r.part_no, r.frame_index, bytes(r.pixels)) for r in got} == want
    assert all(r.frame == r.frame_index % 4 and (r.width, r.height, r.channels) == (4, 2, 1) for r in got)
    small = read(spark, folder, head=3, tail=2, gap=4, taskBytes=30)
    assert sorted((r.video_id, r.frame_index) for r in small.collect()) == [(v, i) for v in "012" for i in (4, 8, 12, 16)]
    assert read(spark, folder, taskBytes=30).rdd.getNumPartitions() > 15


def test_conditions_prune_partitions(spark, folder):
    df = read(spark, folder, taskBytes=1)  # a frame a partition
    assert df.rdd.getNumPartitions() == 60
    for condition, n in (("video_id = '1'", 20), ("video_id in ('0', '2') and part_no = 2", 8), ("frame_index >= 18", 6), ("video_id = '1' and frame_index > 3 and frame_index < 7", 3), ("frame_index = 5 and part_no = 1", 0), ("frame_index between 3 and 4 and light > 0", 6)):
        some = df.withColumn("light", F.length("pixels")).filter(condition)
        assert (some.rdd.getNumPartitions(), some.count()) == (max(1, n), n), condition
    assert df.filter("video_id = 'none'").count() == 0


def test_small_parts_share_a_task(spark, tmp_path):
    """300 files of one frame: a few tasks read them, and in the folders each file's name is looked up once."""
    S.write_frames(rows(spark, n=300, per_part=1), f"{tmp_path}/many")
    assert len(list(tmp_path.glob("many/video_id=*/*.pnm"))) == 300
    df = read(spark, f"{tmp_path}/many")
    assert df.rdd.getNumPartitions() == 2
    want = {(r.video_id, r.part_no, r.frame_index, bytes(r.pixels)) for r in rows(spark, n=300, per_part=1).collect()}
    assert {(r.video_id, r.part_no, r.frame_index, bytes(r.pixels)) for r in df.collect()} == want
    some = read(spark, f"{tmp_path}/many", head=1, tail=1, gap=7).filter("video_id <> '1'")
    assert sorted((r.video_id, r.frame_index) for r in some.collect()) == [(v, i) for v in "02" for i in range(7, 99, 7)]


def test_a_commit_lists_each_folder_once(tmp_path, monkeypatch):
    """Listing a folder for each of its files grows with the square of the files."""
    lists = []
    writer = S.FrameWriter(str(tmp_path / "out"))
    batch = S.pa.RecordBatch.from_pydict({"video_id": ["a"] * 40, "part_no": list(range(1, 41)), "width": [1] * 40, "height": [1] * 40, "channels": [1] * 40, "pixels": [b"x"] * 40})
    message = writer.write(iter([batch]))
    selector = S.pafs.FileSelector
    monkeypatch.setattr(S.pafs, "FileSelector", lambda *a, **b: lists.append(a) or selector(*a, **b))
    writer.commit([message])
    assert len(lists) == 1 and len(list(tmp_path.glob("out/video_id=a/*.pnm"))) == 40


def test_a_missing_part_ends_a_video(spark, folder, tmp_path):
    late = rows(spark).filter("video_id = '0' and part_no = 5").withColumn("part_no", F.lit(7))
    S.write_frames(late, folder)
    assert read(spark, folder).filter("video_id = '0'").count() == 20
    S.write_frames(late.withColumn("part_no", F.lit(6)), folder)
    assert read(spark, folder).filter("video_id = '0'").count() == 28


def test_a_part_is_replaced_and_a_failed_job_leaves_nothing(spark, folder, tmp_path):
    again = rows(spark, size=(2, 2, 3)).filter("video_id = '1' and part_no = 2")
    S.write_frames(again, folder)
    got = read(spark, folder).filter("video_id = '1'").collect()
    assert {(r.part_no, r.channels) for r in got} == {(1, 1), (2, 3), (3, 1), (4, 1), (5, 1)} and len(got) == 20
    wrong = again.unionByName(rows(spark).filter("video_id = '1' and part_no = 2"))
    with pytest.raises(Exception, match="differ in size"):
        S.write_frames(wrong, folder)
    assert read(spark, folder).filter("video_id = '1'").count() == 20
    assert not [p for p in (tmp_path / "frames").iterdir() if p.name.startswith("_temporary")]


def test_stream_of_frames_equals_batch(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format(S.NAME).option("head", 2).option("gap", 3).load(folder)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()

    def seen():
        return sorted((r.video_id, r.frame_index, bytes(r.pixels)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for more in (None, rows(spark, 90).filter("part_no > 5"), None):
        if more is not None:
            S.write_frames(more, folder)
        run()
        assert seen() == sorted((r.video_id, r.frame_index, bytes(r.pixels)) for r in read(spark, folder, head=2, gap=3).collect())


def plain_pairs(main, sub, tolerance, used):
    """A reader of two videos, frame by frame."""
    if not main or not sub:
        return []
    i = j = 0
    if abs(main[0][1] - sub[0][1]) > tolerance:
        while i < len(main) and main[i][1] < sub[0][1]:
            i += 1
        while j < len(sub) and sub[j][1] < main[0][1]:
            j += 1
    out = []
    for n, (a, b) in enumerate(zip(main[i + used :], sub[j + used :], strict=False)):
        out.append((n, *a, *b))
    return out


def clocks(rng, n, start, gap):
    frames = np.cumsum(rng.integers(1, 3, n))
    return [(int(f), float(t)) for f, t in zip(frames, start + np.cumsum(rng.uniform(0.5, 1.5, n) * gap).round(), strict=True)]


@pytest.fixture(scope="module")
def two_videos():
    rng = np.random.default_rng(21)
    sides = {}
    for pair, (a, b, gap_a, gap_b) in enumerate(((0, 0, 40, 40), (0, 900, 40, 33), (5000, 0, 33, 40), (0, 100_000, 40, 40), (10, 0, 40, 80))):
        sides[pair] = (clocks(rng, 120, 1_700_000_000_000 + a, gap_a), clocks(rng, 90, 1_700_000_000_000 + b, gap_b))
    sides[7] = (clocks(rng, 5, 0, 40), [])
    return sides


def side(spark, videos, i):
    return spark.createDataFrame([(p, f, t) for p, both in videos.items() for f, t in both[i]], "pair long, frame_index long, unix_ms double")


def test_lock_step_equals_a_plain_reader(spark, two_videos, monkeypatch):
    monkeypatch.setattr(pairing, "BLOCK", 16)
    for tolerance, used in ((60.0, 1), (0.0, 0)):
        got = pairing.lock_step(side(spark, two_videos, 0), side(spark, two_videos, 1), ["pair"], tolerance=tolerance, used=used).collect()
        got = sorted((r.pair, r.n, r.main_frame_index, r.main_unix_ms, r.sub_frame_index, r.sub_unix_ms) for r in got)
        assert got == sorted((p, *x) for p, both in two_videos.items() for x in plain_pairs(*both, tolerance, used))


def test_numbers_block_by_block(spark):
    df = spark.createDataFrame([(k, int(v)) for k in range(3) for v in np.random.default_rng(k).permutation(500)[:200]], "k int, v long")
    got = pairing.ranked(df, ["k"], "v", block=37).collect()
    for k in range(3):
        assert [r.n for r in sorted((r for r in got if r.k == k), key=lambda r: r.v)] == list(range(200))


def test_stream_of_pairs_equals_batch(spark, two_videos, tmp_path, rocksdb):
    """Frames arrive in several batches, over a restart, one side behind the other; frames that come late are left out."""
    from lanewise.streaming.pairing import paired_stream

    schema = "pair long, frame_index long, unix_ms double"
    for s in (0, 1):
        (tmp_path / f"in{s}").mkdir()

    def feed(batch, s, part):
        some = {p: [list(both[0])[part], []] if s == 0 else [[], list(both[1])[part]] for p, both in two_videos.items()}
        side(spark, some, s).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{s}"))

    def run():
        sides = [spark.readStream.schema(schema).parquet(str(tmp_path / f"in{s}")) for s in (0, 1)]
        pairs = paired_stream(*sides, "pair", tolerance=60.0, delay="10 minutes", idle_ms=10_000_000)
        pairs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    for batch, (a, b) in enumerate(((slice(0, 30), slice(0, 10)), (slice(30, 31), slice(10, 60)), (slice(31, 120), slice(60, 90)))):
        feed(batch, 0, a)
        feed(batch, 1, b)
        run()
    feed(3, 0, slice(3, 4))  # long past
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("pair", "n", "main_frame", "main_ms", "sub_frame", "sub_ms").collect())
    assert got == sorted((p, *x) for p, both in two_videos.items() for x in plain_pairs(*both, 60.0, 1))
