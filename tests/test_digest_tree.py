"""Digest trees against a comparison of all files."""

import hashlib
import random

import pytest

from turnloom.operators import digest_tree, resume


def table(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, sha256 string").repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_differences_equal_a_full_comparison_and_few_folders_are_read(spark, tmp_path, depth):
    draw = random.Random(depth)
    left = {f"data/é {i}.json": sha(str(i)) for i in range(600)}
    right = dict(left)
    for name in draw.sample(sorted(left), 4):
        right[name] = sha(name)
    del right[draw.choice(sorted(right))]
    right["data/new"] = sha("new")
    sides = [str(tmp_path / x) for x in ("left", "right")]
    for files, path in zip((left, right), sides):
        digest_tree.save_tree(table(spark, files), path, depth)
    found = {tuple(r) for r in digest_tree.compare_trees(spark, *sides).collect()}
    assert found == {tuple(r) for r in resume.compare_checksums(table(spark, left), table(spark, right)).collect()} and len(found) >= 5
    buckets = digest_tree.differing_buckets(spark, *sides)
    read = digest_tree.saved_leaves(spark, sides[0], buckets).count()
    assert len(buckets) <= 6 and (read == 600 if depth == 0 else read < 600 * 6 * 2 / 16**depth + 10)
    assert digest_tree.compare_trees(spark, sides[0], sides[0]).isEmpty()
    assert digest_tree.differing_buckets(spark, sides[0], sides[0]) == []


def test_empty_trees_other_depths_and_repeated_paths(spark, tmp_path):
    files = {"a": sha("a"), "b": sha("b")}
    full, empty, deep = (str(tmp_path / x) for x in ("full", "empty", "deep"))
    digest_tree.save_tree(table(spark, files), full)
    digest_tree.save_tree(table(spark, files).limit(0), empty)
    digest_tree.save_tree(table(spark, files), deep, 1)
    assert {tuple(r) for r in digest_tree.compare_trees(spark, full, empty).collect()} == {(k, v, None) for k, v in files.items()}
    assert digest_tree.compare_trees(spark, empty, empty).isEmpty()
    with pytest.raises(ValueError, match="depth"):
        digest_tree.compare_trees(spark, full, deep)
    with pytest.raises(Exception, match="several digests"):
        digest_tree.save_tree(table(spark, files).unionAll(table(spark, {"a": sha("z")})), str(tmp_path / "bad"))
    assert digest_tree.depth_for(10) == 0 and digest_tree.depth_for(10**5) == 2 and digest_tree.depth_for(10**12) == 3
