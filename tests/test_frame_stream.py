"""Groups of frames over files that arrive in any order, in batches, with a restart and late records."""

import random

from cirrus.streaming import frames


def test_groups_over_shuffled_files_and_a_restart(spark, tmp_path):
    rng = random.Random(5)
    records = [(i, rng.randrange(100)) for i in range(150)] + [(None, 5)]
    rng.shuffle(records)
    path, at = f"{tmp_path}/in", f"file://{tmp_path}/state"
    write = lambda rows: spark.createDataFrame(rows, "frame_id int, num_proj long").coalesce(1).write.mode("append").parquet(path)
    plain = lambda rows: {g: (sum(r[0] // 32 == g for r in rows), sum(r[1] for r in rows if r[0] // 32 == g), max(r[0] for r in rows if r[0] // 32 == g)) for g in {r[0] // 32 for r in rows}}
    for upto in (90, 151):
        for k in range(0 if upto == 90 else 90, upto, 31):
            write(records[k : min(k + 31, upto)])
        out = frames.drained(frames.groups_of_frames(frames.stream(spark, path, 1)), "gof", "gof", at=at)
        got = {r.gof: (r.frames, r.points, r.last_frame) for r in out.collect()}
        assert got == plain([r for r in records[:upto] if r[0] is not None])


def test_groups_that_are_over_stay_as_they_are(spark, tmp_path):
    path, at = f"{tmp_path}/in", f"file://{tmp_path}/state"
    for rows in ([(1, 10), (40, 1)], [(500, 1)], [(2, 10), (501, 1)]):
        spark.createDataFrame(rows, "frame_id int, num_proj long").coalesce(1).write.mode("append").parquet(path)
        out = frames.drained(frames.groups_of_frames(frames.stream(spark, path), late=10), "gof", "gof", at=at)
        last = {r.gof: (r.frames, r.points) for r in out.collect()}
    assert last == {0: (1, 10), 1: (1, 1), 15: (2, 2)}
