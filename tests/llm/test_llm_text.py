"""Brute-force versions of the operators that compare texts."""

import random
from collections import Counter

import numpy as np
import pytest

from turnloom.llm import common, decontaminate, line_dedup, ngram_join, substring_dedup
from turnloom.llm.components import components


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def noisy(draw, words, share):
    return [draw.choice("qrstuvw") * 3 if draw.random() < share else w for w in words]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [draw.choice(words) for _ in range(120)]
    passage = [draw.choice(words) for _ in range(30)]
    out = []
    for i in range(60):  # one large group of near copies
        out.append(noisy(draw, base, 0.01))
    for i in range(40):
        own = [draw.choice(words) for _ in range(draw.randrange(0, 150))]
        out.append([*own, *passage] if i % 3 else own)
    for i in range(30):
        source = draw.choice(out)
        out.append(noisy(draw, source, draw.choice([0, 0.01, 0.03, 0.1])))
    draw.shuffle(out)
    return [draw.choice([" ", "\n"]).join(x) for x in out]


def jaccard_components(texts):
    sets = []
    for text in texts:
        w = text.lower().encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = {i: {i} for i in range(len(sets))}
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                near[i].add(j)
                near[j].add(i)
    found = {}
    for i in near:
        if i not in found:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in found:
                    found[k] = i
                    todo += near[k]
    return {i: (len(s), found[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("part, paired", [(4096, 8), (4, 2)])
def test_join_finds_every_component(spark, texts, monkeypatch, part, paired):
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "PARTNERS", 7)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    found = {r[0]: (r[1], r[2]) for r in ngram_join.joined(frame(spark, texts)).collect()}
    assert found == jaccard_components(texts)


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (7, a), (9, b), (2, "else")]
    found = ngram_join.joined(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r[0], r[2]) for r in found} == {(5, 5), (7, 5), (9, 5), (2, 2)}


def test_repeated_rows_count_once(spark):
    words = [f"s{i}" for i in range(104)]
    near = [*words[:92], *(f"o{i}" for i in range(12))]  # 88 of 112 shingles are shared
    far = [*words[:84], *(f"p{i}" for i in range(20))]  # 80 of 120
    rows = [(1, words), (1, words), (2, near)]
    found = ngram_join.joined(spark.createDataFrame([(k, " ".join(x)) for k, x in rows], "doc_id bigint, text string")).collect()
    assert {(r[0], r[2]) for r in found} == {(1, 1), (2, 1)}
    # the ends stand elsewhere, too, so that all shingles are as frequent and spread evenly
    rows = [(1, words), (1, words), (2, far), (3, words[80:]), (4, far[80:]), (5, far[80:])]
    found = ngram_join.joined(spark.createDataFrame([(k, " ".join(x)) for k, x in rows], "doc_id bigint, text string")).collect()
    assert {(r[0], r[2]) for r in found} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(3, 7), (50, 51), (51, 50), (60, 60)]
    random.Random(1).shuffle(edges)
    found = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    wanted = {i: 100 for i in range(100, 141)} | {i: 3 for i in [3, 7, *range(8, 30)]} | {50: 50, 51: 50}
    assert {k: v for k, v in found.items() if k != 60} == wanted


def test_rolling_hash_follows_the_window():
    values = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    found = common.rolling(values, 4)
    by = {}
    for i, h in enumerate(found.tolist()):
        by.setdefault(h, set()).add(tuple(values[i : i + 4].tolist()))
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(set().union(*by.values()))
    assert len(common.rolling(values[:3], 4)) == 0


def test_substrings_of_thirteen_words(spark, texts):
    lists = [t.encode().split() for t in texts]
    first = {}
    for i, w in enumerate(lists):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    wanted = {}
    for i, w in enumerate(lists):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        wanted[i] = (len(w), len(gone), substring_dedup._digest([x for k, x in enumerate(w) if k not in gone]))
    found = {r[0]: (r[1], r[2], r[3]) for r in substring_dedup.deduplicated(frame(spark, texts)).collect()}
    assert found == wanted and any(x[1] for x in wanted.values())


def without_later_runs(docs, min_words):
    """Kept lines and removed maximal runs of each text, from the longest common run at every two places."""
    split = {i: t.split("\n") for i, t in docs.items()}
    words = {i: [len(x.encode().split()) for x in lines] for i, lines in split.items()}
    places = [(i, k) for i in sorted(split) for k in range(len(split[i]))]
    out = {}
    for i, lines in split.items():
        gone = set()
        for k in range(len(lines)):
            for j, m in places:
                n = 0
                while (j, m) < (i, k) and k + n < len(lines) and m + n < len(split[j]) and lines[k + n] == split[j][m + n]:
                    n += 1
                whole = k == m == 0 and n == len(lines) == len(split[j]) and sum(words[i]) > 0
                if n and (sum(words[i][k : k + n]) >= min_words or whole):
                    gone.update(range(k, k + n))
        runs = "".join("x" if k in gone else " " for k in range(len(lines))).split()
        out[i] = ([x for k, x in enumerate(lines) if k not in gone], [len(r) for r in runs])
    return out


@pytest.mark.parametrize("min_words", [1, 4, 9, 50])
def test_later_copies_of_line_runs_go(spark, min_words):
    draw = random.Random(min_words)
    pool = [" ".join(f"w{i}" for _ in range(draw.choice([1, 1, 2, 3, 7, 60]))) for i in range(14)] + ["", " "]
    docs = ["\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 14))) for _ in range(25)]
    docs += [docs[3], docs[3] + "\nmore", "head\n" + docs[7] + "\n" + docs[7], "a", "a", "", "", "a\nb"]
    wanted = without_later_runs(dict(enumerate(docs)), min_words)
    table = frame(spark, docs).repartition(3)
    left = {r[0]: r[1] for r in line_dedup.dedup_lines(table, min_words).collect()}
    assert left == {i: "\n".join(kept) for i, (kept, runs) in wanted.items() if kept}
    found = {r["doc_id"]: (r["n_removed"], r["n_runs"], r["longest_run"]) for r in line_dedup.report(table, min_words).collect()}
    assert found == {i: (sum(runs), len(runs), max(runs, default=0)) for i, (_, runs) in wanted.items()}


def test_runs_are_told_by_words_and_reported_whole(spark):
    said = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(200)]
    five, long = "\n".join(said[:5]), " ".join(f"v{k}" for k in range(51))
    short = "\n".join(f"one{i}" for i in range(70))
    docs = [
        "top\n" + five + "\nend", "other\n" + five + "\nlast", long + "\nx", "y\n" + long, "\n\n\n\nq", "\n\n\n\nr", "z\nz2",
        short + "\n1", "2\n" + short, "z\nz2", "\n".join(said[20:24]) + "\na", "b\n" + "\n".join(said[20:24])]
    found = {r["doc_id"]: (r["n_removed"], r["n_runs"], r["longest_run"]) for r in line_dedup.report(frame(spark, docs)).collect()}
    gone = {1: (5, 1, 5), 3: (1, 1, 1), 8: (70, 1, 70), 9: (2, 1, 2)}
    assert found == {i: gone.get(i, (0, 0, 0)) for i in range(12)}


def test_line_dedup_stays_in_the_jvm(spark):
    plan = line_dedup.report(frame(spark, ["a\nb\nc", "a\nb\nc"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hamming_blocks_find_everything_within_the_radius():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 2**63, 200).astype(np.uint64)
    queries = values[draw.integers(0, 200, 500)]
    for _ in range(9):
        queries = queries ^ np.where(draw.random(500) < 0.8, np.uint64(1) << draw.integers(0, 64, 500).astype(np.uint64), np.uint64(0))
    found = set(zip(*(x.tolist() for x in decontaminate.Blocks(values).near(queries))))
    wanted = {(i, j) for i in range(500) for j in range(200) if bin(int(queries[i] ^ values[j])).count("1") <= decontaminate.RADIUS}
    assert found == wanted and wanted


def test_simhash_of_windows_is_the_majority():
    hashes = np.random.default_rng(5).integers(0, 2**63, 300).astype(np.uint64)
    for size, step in ((8, 2), (48, 5), (128, 1)):
        found = decontaminate.fingerprints(decontaminate.bit_sums(hashes), size, step)
        for i, value in enumerate(found.tolist()):
            window = hashes[i * step : i * step + size].tolist()
            assert value == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in window) > size)


def test_decontamination_finds_all_that_is_similar(spark):
    draw = random.Random(2)
    words = [f"v{i}" for i in range(400)]
    items = [[draw.choice(words) for _ in range(draw.randrange(5, 60))] for _ in range(40)]
    docs = []
    for i in range(120):
        own = [draw.choice(words) for _ in range(draw.randrange(0, 300))]
        if i % 2:
            at = draw.randrange(len(own) + 1)
            own[at:at] = noisy(draw, draw.choice(items), draw.choice([0, 0, 0.02, 0.3]))
        docs.append(" ".join(own))
    index = decontaminate.Index([(i, " ".join(x).encode()) for i, x in enumerate(items)])
    wanted = set()
    for i, text in enumerate(docs):
        _, hashes, _ = common.split_batch([text.encode()])
        for k, item in enumerate(index.items):
            n = len(item.hashes)
            for a in range(max(1, len(hashes) - n + 1)):
                there = Counter(decontaminate.shingles(hashes[a : a + n]).tolist()) if len(hashes) else Counter()
                if there and decontaminate.similarity(item.shingles, there, index.weights, index.usual) >= 0.75:
                    wanted.add((i, k))
                    break
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    found = {(r[0], r[1]) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert found <= wanted and len(found) >= 0.98 * len(wanted) > 30
    left = {r[0] for r in decontaminate.decontaminated(frame(spark, docs), bench).collect()}
    assert left == set(range(120)) - {i for i, _ in found}


def test_blocks_of_the_benchmark_change_no_similarity(spark, monkeypatch):
    draw = random.Random(6)
    words = [f"v{i}" for i in range(300)]
    common = [draw.choice(words) for _ in range(15)]
    items = [[*common, *(draw.choice(words) for _ in range(25))] for _ in range(30)]
    docs = [" ".join([*items[i][:-3], *(draw.choice(words) for _ in range(9))]) for i in range(30)]
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (90, " ")], "item_id bigint, text string")
    whole = sorted(tuple(r) for r in decontaminate.contaminated(frame(spark, docs), bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 400)
    assert len(list(decontaminate.indexes(bench))) > 2
    found = sorted(tuple(r) for r in decontaminate.contaminated(frame(spark, docs), bench).collect())
    assert [x[:2] + x[3:] for x in found] == [x[:2] + x[3:] for x in whole] and len(whole) >= 20
    assert [x[2] for x in found] == pytest.approx([x[2] for x in whole], abs=1e-12)


def test_rows_before_a_text_do_not_matter():
    draw = random.Random(8)
    words = [f"v{i}" for i in range(300)]
    items = [[draw.choice(words) for _ in range(draw.randrange(20, 60))] for _ in range(30)]
    index = decontaminate.Index([(i, " ".join(x).encode()) for i, x in enumerate(items)])
    docs = [" ".join([*(draw.choice(words) for _ in range(i % 9)), *noisy(draw, item, 0.15)]).encode() for i, item in enumerate(items * 8)]
    alone = [index.batch([x], 0.2)[0] for x in docs]
    assert index.batch(docs, 0.2) == alone and sum(map(bool, alone)) > 50
    assert all(index.batch([b" ".join([b"x"] * k), *docs], 0.2)[1:] == alone for k in range(1, 17))


def near_miss(count, words=150, changed=3, seed=1):
    """Texts whose similarity lies just below the threshold, and a few chains of similar ones."""
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(count):
        text = list(base)
        for at in draw.sample(range(words // 5), changed):
            text[5 * at] = f"x{i}y{at}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("count", [100, 400])
def test_texts_just_below_the_threshold_make_no_pairs(spark, count, monkeypatch):
    made = []
    kept = ngram_join._joining

    def watched(documents, apart, *rest):
        links = kept(documents, apart, *rest)
        made.append((apart.count(), apart.select("node").distinct().count(), links.count()))
        return links

    monkeypatch.setattr(ngram_join, "_joining", watched)
    given = near_miss(count)
    given += [given[0].replace("w149", "z1"), given[0].replace("w149", "z1").replace("w148", "z2"), given[3]]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.joined(docs).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in given]
    tops = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((tops[i], tops[j]))
                tops = [a if x == b else x for x in tops]
    assert found == dict(enumerate(tops))
    for rows, nodes, links in made:
        leads = 8  # frequent shingles with different holders, whatever the number of texts
        assert rows <= leads * nodes * (nodes // ngram_join.BLOCK + 1) and links < leads * nodes


def test_matrices_and_forests():
    draw = np.random.default_rng(2)
    sets = [np.sort(draw.choice(9000, 4500, replace=False)).astype(np.uint64) for _ in range(7)]
    assert (ngram_join.count_matrix(sets[:3], sets[3:]) == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:3]]).all()
    assert ngram_join.count_matrix([], sets).shape == (0, 7)
    rows = np.array([(i, i, 0, 1) for i in range(30)], ngram_join._HELD)
    links = ngram_join.forest(rows, rows, ~np.eye(30, dtype=bool))
    assert len(links) == 29 and {x for e in links for x in e} == set(range(30))
