"""The Merkle manifest against a tree built naively, level by level."""

import random
import zlib
from hashlib import sha256

import pytest

from turnloom.llm import merkle_manifest as mm

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, place int, total string, digest string"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return h("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values)


def low(text):
    return None if text is None else "".join(x.lower() if "A" <= x <= "Z" else x for x in text)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, i):
    """(siblings before, siblings after) of node i on each level."""
    out = []
    for nodes in tree[:-1]:
        a = i // 8 * 8
        out.append((nodes[a:i], nodes[i + 1 : a + 8]))
        i //= 8
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0], leaf(row, row[1]), row))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        members = sorted(groups[lang], key=lambda x: (x[0], x[1] or 0, x[2]))
        trees.append((members, levels([x[2] for x in members])))
    upper = levels([tree[-1][0] for _, tree in trees])
    out = []
    for k, (members, tree) in enumerate(trees):
        for i, (_, doc_id, digest, row) in enumerate(members):
            steps = way(tree, i) + way(upper, k)
            struck = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            folded = leaf(row, low(row[1])) if struck else digest
            for before, after in steps:
                folded = h([*before, folded, *after])
            proof = h(x for before, after in steps for x in before + after)
            out.append((doc_id, digest, tree[-1][0], upper[-1][0], proof, folded, folded == upper[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], SCHEMA)
    columns = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in columns) for r in mm.manifest(table.repartition(3)).collect()), key=repr)


@pytest.mark.parametrize("counts", [{"en": 1}, {"en": 8, "de": 9, None: 1}, {"en": 64, "é": 65, "fr": 513, "": 7}])
def test_small_trees(spark, counts):
    draw = random.Random(1)
    rows = [(i + 1000 * k, f"Text Ü {i}", lang, draw.choice(["s", None]), i) for k, (lang, n) in enumerate(counts.items()) for i in range(n)]
    assert found(spark, rows) == brute(rows)


def test_a_tree_of_several_slices_and_many_trees(spark):
    rows = [(i, f"T{i % 50}", "big", "s", 1) for i in range(9000)] + [(i, None, f"g{i % 70}", None, None) for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, "A", "en", None, 1), (None, "A", "en", None, 1), (3, None, None, None, None), (5, "", "en", "", 0),
            (5, "x" * 300000, "en", "s", 3), (7, "Same", "en", "s", 4), (7, "Same", "en", "s", 4), (2, "é漢😀", "", "s", 3)]
    assert found(spark, rows) == brute(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert mm.manifest(empty).collect() == []


def test_tampering_is_noticed_and_only_where_it_changes_the_text(spark):
    rows = [(i, "UPPER" if i % 2 else "lower", "en", "s", 5) for i in range(60)]
    for doc_id, *_, verified in found(spark, rows):
        assert verified == (not (zlib.crc32(str(doc_id).encode()) % 3 == 0 and doc_id % 2))


def test_paths_fold_to_the_root():
    for n in (1, 2, 8, 9, 100, 4096):
        digests = [h([str(i)]) for i in range(n)]
        tree = levels(digests)
        root = mm.slice_root(digests, mm.levels_of(n))
        assert root == tree[-1][0]
        for i in {0, n // 2, n - 1}:
            path = mm.paths(digests, mm.levels_of(n), b"")[i]
            assert mm.fold(digests[i], path) == root
            assert mm.proof_digest(path) == h(x for a, b in way(tree, i) for x in a + b)


def test_missing_columns_count_as_null(spark):
    table = spark.createDataFrame([(1, "A"), (2, "b")], "doc_id bigint, text string")
    rows = [(1, "A", None, None, None), (2, "b", None, None, None)]
    assert sorted(r["leaf"] for r in mm.manifest(table).collect()) == sorted(x[1] for x in brute(rows))
