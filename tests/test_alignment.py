"""Alignments kept or dealt anew, sequences and statuses, on hand-made documents."""

from lithos.operators import alignment as L


def realigned(spark, chars, order, old, kind=None, excluded=None, extra_ids=None):
    docs = spark.createDataFrame([("i", chars, kind, excluded, extra_ids)], "image string, chars array<string>, kind string, excluded array<string>, extra_ids array<string>")
    rows = spark.createDataFrame([("i", u, p) for p, u in enumerate(order, 1)], "image string, uid string, pos int")
    was = spark.createDataFrame([("i", u, p, t, n) for p, (u, t, n) in enumerate(old, 1)], "image string, uid string, pos int, token string, token_id string")
    return [(r.uid, r.token, r.token_id) for r in L.realigned(docs, rows, was).orderBy("pos").collect()]


def test_what_an_order_keeps(spark):
    old = [("a", "寺", "7"), ("b", "永", "3")]
    assert realigned(spark, ["永", "寺"], "ab", old) == [("a", "寺", "7"), ("b", "永", "3")]  # signs that were moved stay moved
    assert realigned(spark, ["永", "寺"], "ba", old) == [("b", "永", "1"), ("a", "寺", "2")]  # another order
    assert realigned(spark, ["永", "樂"], "ab", old) == [("a", "永", "1"), ("b", "樂", "2")]  # another text
    assert realigned(spark, ["永", "寺"], "ab", [*old, ("c", "x", "9")]) == [("a", "永", "1"), ("b", "寺", "2")]  # a box is gone
    assert realigned(spark, ["永", "寺"], "ab", [("a", "寺", None), ("b", "永", "3")]) == [("a", "寺", "1"), ("b", "永", "2")]  # signs, but not all ids
    assert realigned(spark, ["永"], "ab", [("a", "MISS", "7"), ("b", "永", "3")], "missing_text") == [("a", "MISS", "7"), ("b", "永", "3")]
    assert realigned(spark, ["永"], "abc", old, "missing_text") == [("a", "永", "1"), ("b", "MISS", "2"), ("c", "MISS", "3")]
    assert realigned(spark, ["永", "寺", "樂"], "ab", old, "extra_text") == [("a", "永", "1"), ("b", "寺", "2"), (None, "樂", "3")]
    assert realigned(spark, ["永", "寺", "樂"], "ab", old, "extra_text", ["樂"], ["5"]) == [("a", "寺", "7"), ("b", "永", "3"), (None, "樂", "5")]
    assert realigned(spark, ["永", "寺", "樂"], "ab", old, "other") == [("a", None, None), ("b", None, None)]
    assert realigned(spark, ["永"], "", [], "extra_text") == [(None, "永", "1")] and realigned(spark, [], "", []) == []


def test_sequences(spark):
    now = spark.createDataFrame([("i", p, t, n) for p, t, n in ((1, "a", "x"), (2, "b", "y"), (3, "a", "z"))], "image string, pos int, token string, token_id string")
    run = lambda s: sorted((r.pos, r.token, r.token_id, r.accepted) for r in L.resequenced(now, spark.createDataFrame([("i", p, t) for p, t in enumerate(s, 1)], "image string, pos int, token string")).collect())
    assert run("aab") == [(1, "a", "x", True), (2, "a", "z", True), (3, "b", "y", True)]
    for bad in ("aa", "abb", "aabb"):
        assert run(bad) == [(1, "a", "x", False), (2, "b", "y", False), (3, "a", "z", False)]


def test_statuses_as_a_whole(spark):
    kind = "image string, uid int, status string, damage_level int, unknown boolean, unavailable_font boolean, expert_prediction boolean, suspicious boolean"
    boxes = spark.createDataFrame([("i", 1, "damaged", 2, True, False, False, False, "x"), ("i", 2, "intact", None, False, False, False, False, "MISS"), ("j", 1, "intact", None, False, False, False, False, "x")], kind + ", token string")
    update = [("i", 1, "damaged", 3, None, None, None, True), ("i", 2, "damaged", 1, None, True, None, None)]
    run = lambda u: {(r.image, r.uid): tuple(r)[2:8] + (r.accepted,) for r in L.replaced_statuses(boxes, spark.createDataFrame(u, kind)).collect()}
    same = {("i", 1): ("damaged", 2, True, False, False, False, False), ("i", 2): ("intact", None, False, False, False, False, False), ("j", 1): ("intact", None, False, False, False, False, False)}
    got = run(update)
    assert got == same | {("i", 1): ("damaged", 3, False, False, False, True, True), ("i", 2): ("damaged", 1, False, False, False, False, True)}
    for bad in (update[:1], [*update, update[0]], [*update, ("i", 3, "intact", None, None, None, None, None)], [update[0], ("i", 2, "damaged", 4, None, None, None, None)], [update[0], ("i", 2, None, None, None, None, None, None)]):
        assert run(bad) == same
