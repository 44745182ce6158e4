"""Line assembly on a stream against the batch form, over random cuts and restarts."""

import random
import time

import pytest

from emberlog.sources.chunks import lines_from_chunks
from emberlog.streaming import lines as lines_module
from emberlog.streaming.lines import stream_lines, unfinished_lines

SCHEMA = "stream_id string, kind string, seq bigint, chunk string"
COLUMNS = ["stream_id", "kind", "open_seq", "line_no", "line"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def write(spark, rows, folder, no):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{no:03d}")
    time.sleep(0.05)


def run(spark, folder, out, checkpoint, **options):
    chunks = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    query = (
        stream_lines(chunks, **options).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def random_chunks(rng):
    rows = []
    for stream, n in (("hot", 60), ("cold", 4), (None, 5)):
        for kind in ("stdout", "stderr"):
            for seq in sorted(rng.sample(range(-50, 10_000), n)):
                text = "".join(rng.choice(["ab", "é", "\n", "\r\n", "\r", " ", ""]) for _ in range(rng.randrange(6)))
                rows.append((stream, kind, seq, text if rng.random() > 0.1 else None))
    return sorted(rows, key=lambda r: r[2])


@pytest.mark.parametrize("seed", [1, 2])
def test_like_the_batch_form_over_any_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = random_chunks(rng)
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), 4)), len(rows)]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for no, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = rows[a:b]
        rng.shuffle(part)
        write(spark, part, folder, no)
        if no in (1, 4):  # ends and begins again from its checkpoint
            run(spark, folder, out, checkpoint)
    got = spark.read.parquet(out).unionByName(unfinished_lines(spark, checkpoint))
    assert rows_of(got) == rows_of(lines_from_chunks(spark.createDataFrame(rows, SCHEMA)))


def test_idle_streams_are_flushed_and_late_chunks_kept(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "progress"))
    write(spark, [("a", "stdout", 5, "one\ntw"), ("b", "stdout", 1, "x")], folder, 0)
    run(spark, folder, out, checkpoint)
    assert rows_of(unfinished_lines(spark, checkpoint)) == sorted(
        [("a", "stdout", 5, 1, "tw"), ("b", "stdout", None, 0, "x")], key=repr)
    write(spark, [("a", "stdout", 6, "o\n"), ("a", "stdout", 3, "late\r\nlater")], folder, 1)
    run(spark, folder, out, checkpoint)
    want = [("a", "stdout", None, 0, "one"), ("a", "stdout", 3, 0, "late"), ("a", "stdout", 3, 1, "later"), ("a", "stdout", 5, 1, "two")]
    assert rows_of(spark.read.parquet(out)) == sorted(want, key=repr)
    # Short of a chunk for as long as the idle time, what is open comes out.
    join = lines_module._joiner(["stream_id", "kind"], 1)
    (frame,) = join(("b", "stdout"), iter(()), Held((None, 0, "x", 1)))
    assert frame.to_dict("records")[0]["line"] == "x"


class Held:
    """A state that has timed out."""

    exists = hasTimedOut = True

    def __init__(self, value):
        self.get = value

    def remove(self):
        self.exists = False
