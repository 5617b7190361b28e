import datetime
import random

from pyspark.sql import functions as F

from skuforge.operators import review as batch
from skuforge.streaming import review

SCHEMA = "sku string, field_key string, decision_id long, ts timestamp, decision string, new_value string"
START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def run(spark, tmp_path, files, late="10 days", stale="2 days"):
    """All files in one go each, with a restart between any two."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    spark.conf.set(*review.STATE_STORE)
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"f{k}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(source))
        q = review.cells(stream, late, stale).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    spark.conf.unset(review.STATE_STORE[0])
    return spark.read.schema(review.OUT).parquet(out)


def by_hand(rows):
    found = {}
    for sku, field in {(r[0], r[1]) for r in rows}:
        taken = []
        for _, i, decision, value in sorted({(r[3], r[2], r[4], r[5]) for r in rows if (r[0], r[1]) == (sku, field)}, key=lambda x: x[:2]):
            if decision == "undone":
                if taken and taken[-1][0] != "submitted":
                    taken.pop()
            else:
                taken.append((decision, value))
            found[sku, field] = (i, decision, review.STATES[taken[-1][0]] if taken else "machine", taken[-1][1] if taken else None)
    return found


def test_any_order_with_restarts_equals_the_log_in_order(spark, tmp_path):
    draw = random.Random(2)
    rows = []
    for i in range(150):
        decision = draw.choice(("submitted", "approved", "edited", "rejected", "undone"))
        rows.append((f"s{draw.randrange(8)}", draw.choice("ab"), i, at(draw.randrange(0, 2000)), decision, f"v{i}" if decision == "edited" else None))
    end = [("end", "x", 10_000 + k, at(100_000 + 50_000 * k), "approved", None) for k in range(2)]
    odd = [("s1", "a", 500, at(5), "unknown", None), (None, "a", 501, at(5), "approved", None), ("s1", "a", None, at(5), "approved", None)]
    shuffled = rows + rows[:20]
    draw.shuffle(shuffled)
    got = run(spark, tmp_path, [shuffled[:60] + odd, shuffled[60:120], shuffled[120:], end[:1], end[1:]])
    found = {(r.sku, r.field_key): (r.decision_id, r.decision, r.state, r.new_value) for r in review.settled(got).collect() if r.sku != "end"}
    assert found == by_hand(rows)


def test_without_undoing_it_is_the_latest_decision_and_stale_cells_are_told_once(spark, tmp_path):
    rows = [("s1", "a", 1, at(10), "submitted", None), ("s1", "a", 2, at(30), "edited", "x"), ("s1", "a", 3, at(20), "rejected", None), ("s2", "a", 4, at(15), "submitted", None), ("s3", "b", 5, at(1), "approved", None)]
    end = [("end", "x", 100 + k, at(100_000 + 50_000 * k), "approved", None) for k in range(3)]
    got = run(spark, tmp_path, [rows[::-1], end[:1], end[1:2], end[2:]]).cache()
    last = {(r.sku, r.decision_id, r.decision) for r in review.settled(got).collect() if r.sku != "end"}
    want = {(r.sku, r.decision_id, r.decision) for r in batch.latest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert last == want
    assert [(r.sku, r.state) for r in got.filter(F.col("decision") == "stale").collect()] == [("s2", "stale")]
