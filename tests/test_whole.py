"""Queries over whole inputs, against plain Python on small tables with large ids."""

from collections import Counter, defaultdict

from lithos.operators import workflow as W
from lithos.plans import boxes, extra


def test_range_join_takes_all_spans(spark, tmp_path):
    events = [(i, i * 31 % 97) for i in range(1500)]
    spans = list(range(1, 701))
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(c,) for c in spans], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    want = sorted((e, c) for e, u in events for c in spans if u % 20 == c % 20 and c * 13 % 9000 <= e * 7 % 9000 < c * 13 % 9000 + 40 + c % 200)
    assert sorted(map(tuple, boxes.range_join_intervals(spark, str(tmp_path)).collect())) == want and max(want, key=lambda r: r[1])[1] > 300


def test_order_gaps_takes_all_events(spark, tmp_path):
    events = [(i, i * 31 % 97) for i in range(2500, 4500)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    groups = defaultdict(list)
    for e, u in events:
        groups[u].append(e % 60 + 1 if e % 11 else None)
    want = set()
    for g, o in groups.items():
        c = Counter(x for x in o if x is not None)
        want.add((g, len(o), o.count(None), ",".join(str(x) for x in range(1, len(o) + 1) if x not in c), sum(v > 1 for v in c.values())))
    assert {tuple(r) for r in boxes.order_gaps(spark, str(tmp_path)).collect()} == want


def test_workflow_replay_takes_all_events(spark, tmp_path):
    events = [(i, i * 31 % 23) for i in range(3900, 4200)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    steps = [
        ("save_content", {"text": "ab"}), ("detect", {"boxes": [[0, 0, 5, 5], [0, 6, 5, 9]], "damaged": 1}), ("sort_boxes", {"order": [2, 1]}), ("next", {}),
        ("statuses", {"ids": [1], "damaged": True, "level": 2}), ("next", {}), ("crop", {"bbox": [0, 0, 9, 9]}), ("next", {}), ("save", {}),
    ]
    states, done, want = {}, Counter(), set()
    for _, u in events:
        done[u] += 1
        why = None
        try:
            states[u] = W.apply(states.get(u) or W.start(10, 10), *steps[min(done[u], 9) - 1])
        except W.Rejected as e:
            why = str(e)
        want.add((str(u), done[u], why is None, why))
    assert {tuple(r) for r in extra.workflow_replay(spark, str(tmp_path)).collect()} == want and len(want) == 300
