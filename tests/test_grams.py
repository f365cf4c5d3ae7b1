"""Keys in strings and patterns in names, against comparing all."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoebox.operators import catalog as C
from shoebox.operators import grams as G


def test_containing_equals_all_comparisons(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = [word(rng.randrange(0, 30)) for _ in range(150)] + ["aaaaaa", "aaaaaa", None]
    keys = sorted({word(rng.randrange(1, 12)) for _ in range(60)}) + ["", "", "aaaaa", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    known = spark.createDataFrame([(k,) for k in keys], "key string")
    want = sorted((i, k) for i, t in enumerate(texts) if t is not None for k in {k for k in keys if k is not None} if k in t)
    for n in (1, 3, 5):
        assert sorted((r.id, r.key) for r in G.containing(rows, known, n=n).collect()) == want
    assert not re.search("NestedLoop(?!.*BuildRight)|Cartesian", G.containing(rows, known.filter("key <> ''"))._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight", ""))
    assert G.containing(rows.limit(0), known).count() == 0 and G.containing(rows, known.limit(0)).count() == 0


def test_scene_of_an_image_by_order_and_length(spark):
    images = spark.createDataFrame([("x_set_10_a",), ("set_1",), ("none",), (None,)], "image_id string")
    scenes = spark.createDataFrame([("set_1",), ("set_10",), ("",), ("10",)], "scene string")
    assert {r.image_id: r.scene for r in C.scene_of_image(images, scenes).collect()} == {"x_set_10_a": "", "set_1": "", "none": ""}
    assert {r.image_id: r.scene for r in C.scene_of_image(images, scenes, True).collect()} == {"x_set_10_a": "set_10", "set_1": "set_1", "none": ""}


def test_name_search_equals_a_scan_and_reads_less(spark, tmp_path):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefgh_%") for _ in range(rng.randrange(0, 12))) for _ in range(3000)] + ["Straße 7", "ÉTÉ", None]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    path = str(tmp_path / "index")
    G.write_name_index(rows, path, "id", "name", files=16)
    for pattern in ("abc", "ABCD", "ab", "", "a_c", "ab%cde", "abc_", "straSSe", "étÉ", "raße", "zzz", "ab\\_c"):
        got = sorted(r.id for r in G.search_names(spark, path, rows, pattern, "id", "name").collect())
        assert got == sorted(r.id for r in rows.filter(F.col("name").ilike(f"%{pattern}%")).collect())
    assert "PushedFilters: [In(run" in G.candidates(spark, path, ["abcd"])._jdf.queryExecution().executedPlan().toString()
    files = spark.read.parquet(path).select("run", F.input_file_name().alias("f"))
    assert files.filter("run = 'abc'").select("f").distinct().count() < files.select("f").distinct().count() / 4


def test_find_by_pattern_with_and_without_the_index(spark, tmp_path):
    rows = [(str(i), f"{i % 7}.jpg", f"set_{i}/{i % 7}.jpg") for i in range(300)] + [("0a1b2c3d-0000-4000-8000-00000000000f", "z.jpg", "z")]
    images = spark.createDataFrame(rows, "id string, filename string, file_path string")
    path = str(tmp_path / "index")
    G.write_name_index(images, path, "id", C.file_names())
    for pattern in ("3.jp", "set_29", "3", "nowhere", "0a1b2c3d-0000-4000-8000-00000000000f", "SET_29", "pg\nset"):
        with_index, scan = (C.find_by_pattern(images, pattern, p).collect() for p in (path, None))
        assert with_index == scan


def test_only_runs_of_the_keys_lengths_are_made(spark):
    """FINDINGS_r03 F11: runs of one to four characters, which all texts share, were made and shuffled without a key so short."""
    rows = spark.createDataFrame([("x_one_1",), ("x_two_22",)], "text string")
    plan = lambda *keys: G.containing(rows, spark.createDataFrame([(k,) for k in keys], "key string"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan("x_one", "two_2").count("substring(") < plan("x_one", "two_", "tw").count("substring(")
    assert sorted(r.key for r in G.containing(rows, spark.createDataFrame([("x_one",), ("tw",), ("o",), ("zz",)], "key string")).collect()) == ["o", "o", "tw", "x_one"]


def _plain(names, n):
    out = {}
    for at, name in enumerate(names):
        for run in {name[i : i + n] for i in range(len(name) - n + 1)}:
            out.setdefault(run, []).append(at)
    return out


def _packed(names, n):
    out = {}
    for runs, offsets, rows in G._postings(pa.array(names, pa.string()), n):
        assert len(offsets) == len(runs) + 1 and all(0 < b - a <= G.POSTED for a, b in zip(offsets[:-1], offsets[1:]))
        for i, run in enumerate(runs):
            out.setdefault(run, []).extend(rows[offsets[i] : offsets[i + 1]].tolist())
    return out


@pytest.mark.parametrize("letters", ["ab", "abé漢😀\x00", "0123456789/.jpg\n", "".join(map(chr, range(0x4E00, 0x9000)))])
def test_packed_postings_equal_plain_ones(letters):
    """FINDINGS_r03 F15. The last alphabet is so large that names are taken by halves."""
    rng = random.Random(5)
    for size, n in ((0, 3), (1, 3), (40, 1), (40, 2), (700, 3), (700, 4)):
        names = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(size)]
        assert _packed(names, n) == _plain(names, n)


def test_few_rows_are_shuffled_for_a_name_index(spark, tmp_path):
    """FINDINGS_r03 F15: one row for each run of each name was made, twice, and then shuffled and sorted."""
    names = [f"{i % 7}.jpg\n{i * 7919}/{i % 7}.jpg{'_' * 120}" for i in range(20_000)] + [None, "", "ab"]
    rows = spark.createDataFrame([(str(i), name) for i, name in enumerate(names)], "id string, name string").coalesce(1)  # over SORTED_BYTES a batch
    path = str(tmp_path / "index")
    G.write_name_index(rows, path, "id", "name")
    stored, got = spark.read.parquet(path), {}
    for r in stored.collect():
        got.setdefault(r["run"], []).extend(r["ids"])
    want = {run: sorted(map(str, at)) for run, at in _plain([name or "" for name in names], 3).items()}
    assert {run: sorted(ids) for run, ids in got.items()} == want
    assert stored.count() < sum(map(len, want.values())) / 20


def test_names_that_are_no_utf8_are_found(spark, tmp_path):
    rows = spark.sql("select cast(id as int) id, cast(unhex(x) as string) name from values (1, 'E2616263FF78797A'), (2, '616263'), (3, 'FF') t(id, x)").coalesce(1)
    path = str(tmp_path / "index")
    G.write_name_index(rows, path, "id", "name")
    found = {part: sorted(r.id for r in G.candidates(spark, path, [part]).collect()) for part in ("abc", "xyz", "cxy")}
    assert found == {"abc": [1, 2], "xyz": [1], "cxy": []}


def test_a_pattern_that_ends_in_sigma_is_found_within_words(spark, tmp_path):
    """A pattern's last Σ became ς and the name's σ, so that the index had not the pattern's runs."""
    images = spark.createDataFrame([(1, "x", "ΟΔΟΣΑ"), (2, "ΟΔΟΣ", "y"), (3, "οδοσα ΟΔΟΣ", "z")], "id int, filename string, file_path string")
    path = str(tmp_path / "index")
    G.write_name_index(images, path, "id", C.file_names())
    for pattern in ("ΟΔΟΣ", "ΔΟΣΑ", "οδοσ", "οδος"):
        with_index, scan = (C.find_by_pattern(images, pattern, p).collect() for p in (path, None))
        assert with_index == scan
        assert G.search_names(spark, path, images, pattern, "id", "file_path").collect() == images.filter(F.col("file_path").ilike(f"%{pattern}%")).collect()
