"""Split arrays, committed outputs, the cached source and the registry, on small files."""

import json
import os
import random
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.sources import arrays as A
from lithos.sources import commits as C
from lithos.sources import readers
from lithos.sources.cache import RecordCache
from lithos.sources.fonts import synchronize_fonts
from lithos.sources.registry import Registry


@pytest.fixture
def split(spark):
    """Sets the size of a file's blocks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {n: spark.conf.get(n) for n in names}

    def to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield to
    for n, v in was.items():
        spark.conf.set(n, v)


def name(path):
    return unquote(path.rsplit("/", 1)[1])


# ---------------------------------------------------------------- arrays


def value(rnd, depth):
    kind = rnd.randrange(7 if depth else 4)
    if kind < 4:
        return (rnd.choice(('a"}],{[b', "\\", 'x\\"y', "漢}字", "", ",", "}}}}", "\\\\")), rnd.randrange(1000), None, True)[kind]
    if kind == 4:
        return [value(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return {f"k{i}": value(rnd, depth - 1) for i in range(rnd.randrange(4))}


@pytest.mark.parametrize("size", [23, 300, 1 << 20])
def test_arrays_are_whole_however_files_are_split(spark, tmp_path, split, monkeypatch, size):
    rnd, want = random.Random(1), {}
    for i in range(8):
        a = [{"id": j, "v": value(rnd, 3)} if rnd.random() < 0.8 else value(rnd, 2) for j in range(rnd.choice((0, 1, 3, 120)))]
        want[f"{'aB'[i % 2]}é {i}.json"] = a
        (tmp_path / f"{'aB'[i % 2]}é {i}.json").write_text((" \n" if i % 3 else "") + json.dumps(a, ensure_ascii=i % 2 == 0, indent=None if i % 2 else 1) + "\n" * (i % 3))
    split(size)
    monkeypatch.setattr(A, "CHUNK", 64)
    rows = A.split_elements(spark, str(tmp_path)).collect()
    got = {}
    for r in rows:
        got.setdefault(name(r.file), {})[r["index"]] = json.loads(r.value)
    assert got == {f: dict(enumerate(a)) for f, a in want.items() if a}
    order = sorted(want, key=lambda f: f.casefold())
    assert {name(r.file): r.file_order for r in rows} == {f: order.index(f) for f, a in want.items() if a}


def test_one_file_is_read_by_several_tasks(spark, tmp_path, split):
    (tmp_path / "x.json").write_text(json.dumps([{"i": i, "t": "}" * (i % 5)} for i in range(2000)]))
    split(4000)
    rows = A.read_array(spark, str(tmp_path), "i int, t string")
    assert rows.rdd.getNumPartitions() > 5
    assert sorted((r["index"], r.record.i, r.record.t) for r in rows.collect()) == [(i, i, "}" * (i % 5)) for i in range(2000)]


@pytest.mark.parametrize("bad", ["[1,]", "[,1]", "[1]}", '{"a":1}', "[1] 2", "[1", '["a]', "", "[1]]", "x[1]", "1", '{"a":[1]},[2]'])
def test_what_is_not_one_array_is_refused(spark, tmp_path, bad):
    (tmp_path / "x.json").write_text(bad)
    with pytest.raises(Exception, match="x.json"):
        A.split_elements(spark, str(tmp_path)).collect()


def test_repeated_keys_at_any_depth(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": [{"b": {"c": 1, "c": 2}}]}, {"a": {"b": 1, "B": 2}}]')
    (tmp_path / "b.json").write_text('[{"a": 1}{"b": 2}]')
    (tmp_path / "c+d e.json").write_text('[{"a": 1, "a": 1}]')
    assert {tuple(r) for r in readers.duplicate_key_files(spark, str(tmp_path)).collect()} == {("a.json", 1), ("b.json", 0), ("c+d e.json", 0)}
    with pytest.raises(Exception, match="element 1 is not JSON or repeats a key"):
        A.read_array(spark, str(tmp_path), "a string", "a.json").collect()


def test_structure_of_text():
    text = rb'"a\\", {"\"[": [1, "]"]}, "\\\"'
    outside, depth, inside = A.structure(np.frombuffer(text, np.uint8), False)
    assert inside and depth.max() == 2 and depth[-1] == 0
    assert [chr(text[i]) for i in np.flatnonzero(outside & (depth == 0)) if text[i] == ord(",")] == [",", ","]
    assert A.structure(np.frombuffer(b'x", [', np.uint8), True)[1].tolist() == [0, 0, 0, 0, 1]


def test_a_row_without_a_file_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="names no file"):
        A.write_arrays(spark.createDataFrame([(None, 1)], "f string, k int"), str(tmp_path / "p"), "f", ["k"])


def test_written_arrays_replace_files_of_their_name(spark, tmp_path):
    df = spark.createDataFrame([("a b", 2, "x"), ("a b", 1, None), ("é", 3, "é\n")], "f string, k int, t string")
    assert A.write_arrays(df, str(tmp_path), "f", [F.desc("k")]) == ["a b", "é"]
    assert json.loads((tmp_path / "a b.json").read_text()) == [{"k": 2, "t": "x"}, {"k": 1, "t": None}]
    assert json.loads((tmp_path / "é.json").read_text()) == [{"k": 3, "t": "é\n"}]
    A.write_arrays(df.where("k = 1"), str(tmp_path), "f", ["k"])
    assert json.loads((tmp_path / "a b.json").read_text()) == [{"k": 1, "t": None}] and (tmp_path / "é.json").exists()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a b.json", "é.json"]


# ---------------------------------------------------------------- commits


def rows_of(spark, root, output, version=None):
    return sorted(tuple(r) for r in C.read_output(spark, root, output, version).collect())


def saved(spark, rows):
    return spark.createDataFrame(rows, "output string, key int, body string").repartition(3)


def test_one_commit_for_all_outputs(spark, tmp_path):
    root = str(tmp_path / "o")
    assert C.read_version(root).number == 0
    assert C.write_outputs(saved(spark, [("doc", 1, "a"), ("doc", 2, None), ("meta", 1, "m")]), root).number == 1
    assert C.write_outputs(saved(spark, [("doc", 3, "b"), ("content", 3, "c")]), root).number == 2
    assert rows_of(spark, root, "doc") == [(1, "a"), (2, None), (3, "b")] and rows_of(spark, root, "meta") == [(1, "m")]
    assert rows_of(spark, root, "doc", 1) == [(1, "a"), (2, None)]
    v = C.write_outputs(saved(spark, [("doc", 9, "z")]), root, replace=["doc", "meta"])
    assert (v.number, rows_of(spark, root, "doc"), rows_of(spark, root, "meta"), rows_of(spark, root, "content")) == (3, [(9, "z")], [], [(3, "c")])
    assert rows_of(spark, root, "meta", 2) == [(1, "m")]
    with pytest.raises(KeyError):
        C.read_output(spark, root, "other")


def test_a_failed_task_leaves_every_output_as_it_was(spark, tmp_path):
    root = str(tmp_path / "o")
    C.write_outputs(saved(spark, [("doc", 1, "a"), ("meta", 1, "m"), ("content", 1, "c")]), root)
    before = C.read_version(root), sorted(p.name for p in (tmp_path / "o" / "data").iterdir())
    bad = saved(spark, [("doc", i, "x") for i in range(40)] + [("meta", 7, "n"), (None, 8, "lost"), ("content", 9, "d")])
    with pytest.raises(Exception, match="names no output"):
        C.write_outputs(bad, root)
    assert (C.read_version(root), sorted(p.name for p in (tmp_path / "o" / "data").iterdir())) == before
    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        C.commit(spark, root, {"doc": spark.range(2), "meta": broken}, replace=["doc"])
    assert (C.read_version(root), sorted(p.name for p in (tmp_path / "o" / "data").iterdir())) == before
    assert rows_of(spark, root, "doc") == [(1, "a")] and rows_of(spark, root, "content") == [(1, "c")]


def test_only_one_writer_of_a_version(spark, tmp_path):
    root = str(tmp_path / "o")
    C.commit(spark, root, {"t": spark.range(1)})
    with pytest.raises(C.Conflict):
        C.commit(spark, root, {"t": spark.range(5)}, expected=0)
    with pytest.raises(C.Conflict):
        C.publish(root, C.Version(1))
    assert C.read_version(root).number == 1 and not [p for p in (tmp_path / "o" / "versions").iterdir() if p.name.startswith(".")]
    calls = []

    def attempt():
        calls.append(1)
        return C.commit(spark, root, {"t": spark.range(2)}, expected=0 if len(calls) < 3 else 1)

    assert C.retried(attempt).number == 2 and len(calls) == 3 and C.read_output(spark, root, "t").count() == 3


def test_overwriting_needs_names(spark, tmp_path):
    spark.dataSource.register(C.CommittedOutputs)
    for df, mode in ((saved(spark, [("a", 1, "b")]), "overwrite"), (spark.range(3), "append")):
        with pytest.raises(Exception):  # noqa: B017
            df.write.format("committed").option("path", str(tmp_path / "o")).mode(mode).save()
    assert C.read_version(str(tmp_path / "o")).number == 0


# ---------------------------------------------------------------- cached source

SCHEMA = "so_van_bia int, noi_dung array<struct<ky_hieu:string>>"


def write(folder, file, records, at=None):
    (folder / file).write_text(json.dumps([{"so_van_bia": n, "noi_dung": [{"ky_hieu": c} for c in codes]} for n, codes in records]))
    if at:
        os.utime(folder / file, (at, at))


def places(cache):
    return sorted((r.code, name(r.file), r["index"], r.face) for r in cache.index().collect())


def full_read(folder):
    out = []
    for p in folder.glob("*.json"):
        for i, r in enumerate(json.loads(p.read_text())):
            out += [("None" if f["ky_hieu"] is None else f["ky_hieu"], p.name, i, j) for j, f in enumerate(r["noi_dung"])]
    return sorted(out)


def test_only_changed_files_are_parsed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(12):
        write(src, f"f [{i}].json", [(i * 10 + j, [f"{i}{j}", f"{i}{j}b"][: 1 + j % 2]) for j in range(4)])
    cache = RecordCache(spark, str(src), str(tmp_path / "cache"), SCHEMA, buckets=4)
    assert len(cache.refresh().parsed) == 12 and places(cache) == full_read(src)
    again = cache.refresh()
    assert (again.version, again.parsed, again.gone) == (1, (), ())
    write(src, "f [3].json", [(1, ["new", None]), (2, [])], at=2_000_000_000)  # changed
    write(src, "z.json", [(5, ["z"])])  # new
    (src / "f [5].json").unlink()  # gone
    done = cache.refresh()
    assert (done.version, sorted(map(name, done.parsed)), list(map(name, done.gone))) == (2, ["f [3].json", "z.json"], ["f [5].json"])
    assert places(cache) == full_read(src) and cache.records().count() == 10 * 4 + 2 + 1
    write(src, "z.json", [(5, ["z"])], at=2_000_000_001)  # the same text at another time is read again, as its time may be all that tells
    assert list(map(name, cache.refresh().parsed)) == ["z.json"]
    old = C.read_output(spark, str(tmp_path / "cache"), "records").count()
    cache.compact()
    assert places(cache) == full_read(src) and C.read_output(spark, str(tmp_path / "cache"), "records").count() == 43 < old
    assert cache.refresh().parsed == ()


def test_a_broken_file_leaves_the_cache(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "a.json", [(1, ["x"])])
    cache = RecordCache(spark, str(src), str(tmp_path / "cache"), SCHEMA)
    cache.refresh()
    (src / "b.json").write_text('[{"so_van_bia": 1, "so_van_bia": 2, "noi_dung": []}]')
    with pytest.raises(Exception, match="repeats a key"):
        cache.refresh()
    assert places(cache) == [("x", "a.json", 0, 0)]


def test_lookup_reads_the_buckets_of_its_codes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "a.json", [(1, ["7", "twice"]), (2, ["0012", "x.y"]), (3, ["twice", "12"])])
    cache = RecordCache(spark, str(src), str(tmp_path / "cache"), SCHEMA, buckets=16)
    cache.refresh()
    images = spark.createDataFrame([(x,) for x in ("007.jpg", "twice.png", "0012.jpg", "00012.jpg", "x.y.png", "none", ".12")], "image string")
    got = {r.image: (r.matches, r["index"], r.face) for r in cache.locate(images).collect()}
    assert got == {"007.jpg": (1, 0, 0), "twice.png": (2, None, None), "0012.jpg": (1, 1, 0), "00012.jpg": (1, 2, 1), "x.y.png": (1, 1, 1), "none": (0, None, None), ".12": (0, None, None)}
    one = cache.locate(images.where("image = '7.jpg' or image = '007.jpg'"))
    files = [f for f in one.inputFiles() if "/index/" in f]
    assert 0 < len({f.rsplit("/", 2)[1] for f in files}) <= 2


# ---------------------------------------------------------------- registry


def sizes(root):
    return {str(p): p.stat().st_size for p in Path(root).rglob("*.parquet")}


def test_registry_by_plain_python(spark, tmp_path):
    rnd, root = random.Random(6), str(tmp_path / "r")
    registry, want, first = Registry(spark, root, "k", ["seq"], buckets=4), {}, {}
    assert registry.read() is None
    for n in range(6):
        batch = [(rnd.choice([None, *range(12)]), n * 20 + rnd.randrange(15), rnd.choice("abc")) for _ in range(15)]
        registry.upsert(spark.createDataFrame(batch, "k int, seq int, v string"), "w", n)
        for k, seq, v in batch:
            first[k] = min(first.get(k, seq), seq)
            want[k] = max(want.get(k, (-1, "")), (seq, v))
        if n == 3:
            held = registry.compact(2).number
    out = {r.k: ((r.seq, r.v), r.first_seq.seq) for r in registry.read().collect()}
    assert out == {k: (want[k], first[k]) for k in want}
    again = registry.upsert(spark.createDataFrame([(1, 999, "z")], "k int, seq int, v string"), "w", 5)
    assert again.number == C.read_version(root).number and {r.k: ((r.seq, r.v), r.first_seq.seq) for r in registry.read().collect()} == out
    assert max(map(len, C.read_version(root, held).files.values())) == 1 and registry.read(1).count() <= 13


def test_bytes_written_follow_the_batch(spark, tmp_path):
    root = str(tmp_path / "r")
    registry = Registry(spark, root, "k", ["seq"], buckets=8)
    registry.upsert(spark.range(40_000).select(F.col("id").alias("k"), F.lit(0).alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    big = sizes(root)
    registry.upsert(spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("seq"), F.lit("x").alias("v")))
    new = {p: s for p, s in sizes(root).items() if p not in big}
    assert sum(new.values()) < sum(big.values()) / 50 and all(sizes(root)[p] == s for p, s in big.items())
    assert registry.read().where("v = 'x'").count() == 5 and registry.read().count() == 40_000
    # a batch whose columns may be null, where those of the others could not
    registry.upsert(spark.createDataFrame([(3, 2, None)], "k long, seq int, v string"))
    assert registry.read().where("v is null").count() == 1 and registry.compact(2).number == 4 and registry.read().count() == 40_000


# ---------------------------------------------------------------- fonts of a project


def test_fonts_are_written_back_where_they_changed(spark, tmp_path):
    kind = "name string, xref int, type string, ext string, encoding string"
    rows = [("ABCDEF+Nom Na-Bold", 3, "Type0", "cff", "Identity-H"), ("GHIJKL+nomna bold", 9, "Type0", "ttf", "Identity-V"), ("Other", 4, "Type0", "ttf", "Identity-H"), ("Plain", 5, "TrueType", "ttf", "Identity-H")]
    fonts = spark.createDataFrame(rows, kind)
    (tmp_path / "conf").mkdir()
    at = tmp_path / "conf" / "tap_1.json"
    at.write_text(json.dumps({"title": "é", "encoded_fonts": {"Old": "x.ttf"}, "last": 1}))
    references = spark.createDataFrame([("nomnabold", str(tmp_path / "fonts" / f), p) for f, p in (("b.ttf", 1), ("a.ttf", 1), ("0.ttf", 2))], "key string, file string, style_priority int")
    done = synchronize_fonts(at, fonts, references)
    assert (done.found, done.missing, done.changed) == (("ABCDEF+Nom Na-Bold",), ("Other",), True)
    text = at.read_text()
    assert json.loads(text) == {"title": "é", "encoded_fonts": {"ABCDEF+Nom Na-Bold": "../fonts/a.ttf"}, "last": 1} and "é" in text
    stamp = at.stat().st_mtime_ns
    assert not synchronize_fonts(at, fonts, references).changed and at.stat().st_mtime_ns == stamp
    assert synchronize_fonts(at, fonts, references.where("false")).missing == ("ABCDEF+Nom Na-Bold", "Other") and json.loads(at.read_text())["encoded_fonts"] == {}
