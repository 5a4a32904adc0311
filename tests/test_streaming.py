import os

from itemloom.sources.directory import source_items
from itemloom.streaming.watch import listing, listing_stream, refresher, to_files


def test_listing_stream_sees_edits_and_removals(spark, tmp_path):
    root = tmp_path / "data"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("1")
    (root / "sub" / "b.txt").write_text("1")
    seen, errors = [], []

    def refresh(batch):
        if any("bad" in r["path"] for r in batch.collect()):
            raise ValueError("bad metadata")
        seen.append(sorted((r["label"], r["fingerprint"]["length"]) for r in source_items(to_files(batch)).collect()))

    query = listing_stream(spark, str(root)).writeStream.foreachBatch(refresher(refresh, errors)).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:

        def wait_for(state):
            import time

            end = time.time() + 60
            while time.time() < end and not state():
                time.sleep(0.1)
            assert state()

        wait_for(lambda: seen and seen[-1] == [("a.txt", 1), ("b.txt", 1)])
        (root / "a.txt").write_text("22")
        wait_for(lambda: seen[-1] == [("a.txt", 2), ("b.txt", 1)])
        os.remove(root / "sub" / "b.txt")
        wait_for(lambda: seen[-1] == [("a.txt", 2)])
        (root / "bad").write_text("x")
        wait_for(lambda: errors == ["ValueError: bad metadata"])
        os.remove(root / "bad")
        wait_for(lambda: not errors)
    finally:
        query.stop()


def test_listing_sees_every_file(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name in ("_a.txt", "b.txt", "sub/_c.txt", "sub/deep/d.txt", ".hidden", "tags.txt"):
        (tmp_path / name).write_text("x")
    assert sorted(r["label"] for r in source_items(listing(spark, str(tmp_path))).collect()) == ["_a.txt", "_c.txt", "b.txt", "d.txt"]
    assert sorted(r["label"] for r in source_items(listing(spark, str(tmp_path), recursive=False)).collect()) == ["_a.txt", "b.txt"]
