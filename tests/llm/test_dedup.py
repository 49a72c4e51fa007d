import hashlib
import random
import re

import pytest
from llm_cases import HARD, PROSE, texts
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def make(spark, rows):
    return spark.createDataFrame(rows, PAIR)


def later(i):
    return (i is None, i or 0)


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), later(i), i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        best = min(g, key=lambda x: x[:2])
        out.append((i, best[2], len(g), best[2] == i and best[0] == -len(t or ""), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("table_bytes", [200, 2000, 48 << 20])
def test_exact(spark, hard, none, table_bytes):
    from riskloom.llm.exact_dedup import exact_duplicates

    draw = random.Random(5)
    rows = [(i, t) for i, t, _ in HARD] + [(100 + k, " ".join(draw.choices("ab", k=draw.randint(0, 6)))) for k in range(300)]
    got = exact_duplicates(make(spark, rows), carry=["doc_id"], table_bytes=table_bytes)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()), key=repr) == brute_exact(rows)
    if table_bytes == 200:
        assert exact_duplicates(hard).filter("kept and score = 'score'").count() == sum(r[3] for r in brute_exact([(i, t) for i, t, _ in HARD]))
        assert exact_duplicates(none).collect() == []


def test_grace_deals_again():
    """Contents whose hashes agree in many bits are dealt again until they differ, and compared whole where they do not."""
    from riskloom.llm.exact_dedup import grace

    records = [((j := k % 100) % 7 << 61 | j % 50, f"content {j}".encode(), (9, k), 1) for k in range(1000)]
    for limit in (100, 1 << 20):
        assert sorted((c, n, best) for _, c, best, n in grace(records, limit)) == sorted((f"content {j}".encode(), 10, (9, j)) for j in range(100))


def union(links, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_components(spark):
    from riskloom.llm.graph import components

    draw = random.Random(2)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(draw.randint(200, 400), draw.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for pair in links if pair[0] != pair[1] for x in pair}
    assert got == union([p for p in links], nodes | {7})
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    named = [(i, s) for i, s in sets if i is not None and s]
    links = [(i, j) for k, (i, s) in enumerate(named) for j, t in named[:k] if 100 * len(s & t) >= percent * len(s | t)]
    root = union(links, {i for i, _ in rows if i is not None})
    return sorted(((i, len(s), root.get(i), i is None or root[i] == i) for i, s in sets), key=repr)


def variants(seed, n, words=90, changes=2):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(2000)]
    out = []
    base = draw.choices(vocabulary, k=words)
    for _ in range(n):
        w = list(draw.choice(out)) if out and draw.random() < 0.6 else list(base)
        for _ in range(draw.randint(0, changes)):
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        out.append(w)
    return [" ".join(w) for w in out]


def test_near(spark, hard, none):
    from riskloom.llm.near_dedup import near_duplicates

    near = [t for s in range(6) for t in variants(s, 40)] + variants(99, 300, words=60)
    rows = [(i, t) for i, t, _ in HARD] + [(1000 + k, t) for k, t in enumerate(near)]
    got = near_duplicates(make(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute_near(rows)
    hard_got = near_duplicates(hard).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hard_got), key=repr) == brute_near([(i, t) for i, t, _ in HARD])
    assert near_duplicates(none).collect() == []


def test_near_blocks(spark, monkeypatch):
    """Nodes of many documents, dealt into many small blocks."""
    from riskloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "SKETCH_BLOCK", 6)
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    rows = [(k, t) for k, t in enumerate([t for s in (1, 2) for t in variants(s, 50, changes=4)])]
    got = near_dedup.near_duplicates(make(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute_near(rows)


def brute_repeats(rows, size=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: later(r[0])):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [5, 20])
def test_repeats(spark, hard, none, size):
    from riskloom.llm.substring_dedup import remove_repeats

    draw = random.Random(8)
    words = [f"v{k}" for k in range(60)]
    passages = [draw.choices(words, k=draw.randint(15, 70)) for _ in range(12)] + [["la"] * 45, ["do", "re"] * 30]
    rows = [(i, t) for i, t, _ in HARD]
    for k in range(150):
        parts = [draw.choice(passages) if draw.random() < 0.5 else draw.choices(words, k=draw.randint(1, 30)) for _ in range(draw.randint(1, 6))]
        rows.append((100 + (k * 37) % 150, " ".join(x for p in parts for x in p)))
    got = remove_repeats(make(spark, rows).repartition(5), size=size, keep_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute_repeats(rows, size)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    if size == 20:
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(hard).collect()), key=repr) == brute_repeats([(i, t) for i, t, _ in HARD])
        assert remove_repeats(none).collect() == []


def test_symbols_are_the_same_in_equal_windows():
    """Windows with equal words have the same representative at the same place."""
    from riskloom.llm.substring_dedup import Slice, _new_words, representatives, window_hashes

    draw = random.Random(1)
    passage = " ".join(draw.choices("abcdefgh", k=60))
    s = Slice(_new_words(), [f"{' '.join(draw.choices('xyzab', k=draw.randint(0, 9)))} {passage} {' '.join(draw.choices('xyzab', k=9))}".encode() for _ in range(40)])
    name, first, span, left = representatives(s, 20)
    chosen = {}
    for n, f, k in zip(name.tolist(), first.tolist(), span.tolist(), strict=True):
        for p in range(f, f + k):
            chosen.setdefault(p, set()).add(n)
    places = s.starts(20)
    assert set(places.tolist()) == set(chosen) | set(left.tolist())
    words, _ = window_hashes(s, places, 20)
    by_words = {}
    for p, w in zip(places.tolist(), words.tolist(), strict=True):
        by_words.setdefault(w, []).append(chosen.get(p, set()) if p not in set(left.tolist()) else set())
    for group in by_words.values():
        assert len(group) == 1 or not any(group) or set.intersection(*group)


def brute_normal(line):
    return re.sub("[1-9]", "0", re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", line.lower())).strip(" ")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows, sims, distance=3, similarity=0.8):
    named = lambda x: brute_normal(x) or (("\n" + x.strip(" \t\n\v\f\r")) if x.strip(" \t\n\v\f\r") else "")
    lines = [((i is not None, i or 0), i, k, named(x)) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    marks = {x for *_, x in lines if x[:1] == "\n"}
    normals = sorted({x for *_, x in lines if x} - marks)
    links = []
    for k, a in enumerate(normals):
        for b in normals[:k]:
            most = max(len(a), len(b))
            if bin((sims[a] ^ sims[b]) & (1 << 64) - 1).count("1") <= distance and edits(a, b) <= int(most * (1 - similarity) + 1e-9):
                links.append((a, b))
    root = union(links, normals) | {x: x for x in marks}
    first = {}
    for order, i, k, x in sorted(lines, key=lambda v: (v[0], v[2])):
        if x:
            first.setdefault(root[x], (i, k))
    return sorted(((i, k, (i, k) == first[root[x]] if x else True) for _, i, k, x in lines), key=repr)


def fuzzy_rows():
    draw = random.Random(4)
    words = [f"{a}{b}" for a in ("stone", "river", "cloud", "amber", "north") for b in ("", "ing", "ed", "ly", "er")]
    base = [draw.choices(words, k=draw.randint(25, 60)) for _ in range(6)]
    rows = [(i, t) for i, t, _ in HARD]
    for k in range(40):
        lines = []
        for _ in range(draw.randint(1, 4)):
            w = list(draw.choice(base))
            for _ in range(draw.randint(0, 2)):
                w[draw.randrange(len(w))] = draw.choice(words)
            lines.append(" ".join(w) + draw.choice(["", ".", f" {draw.randint(10, 99)}"]))
        rows.append((500 + k, "\n".join(lines)))
    return rows + [(600 + k, f"----\n{' ' * k}|||\t\n \n####{'#' * (k % 3)}") for k in range(5)]


def test_lines(spark, hard, none):
    from riskloom.llm.line_dedup import by_document, fuzzy_lines, normal_form, simhash, split_lines, without_removed

    rows = fuzzy_rows()
    docs = make(spark, rows)
    normals = split_lines(docs).select(normal_form(F.col("line")).alias("n")).filter("n <> ''").distinct()
    sims = {r.n: r.s for r in normals.select("n", simhash(F.col("n")).alias("s")).collect()}
    assert set(sims) == {n for _, t in rows for x in (t or "").split("\n") if (n := brute_normal(x))}
    decided = fuzzy_lines(docs)
    got = sorted(((r.doc, r.pos, r.kept) for r in decided.collect()), key=repr)
    assert got == brute_lines(rows, sims)
    assert sum(not k for *_, k in got) > 20
    per = by_document(decided)
    kept = {}
    for i, k, stays in sorted(got, key=lambda v: (repr(v[0]), v[1])):
        if stays:
            kept.setdefault(i, []).append((dict(rows)[i] or "").split("\n")[k])
    cut = {r.doc_id: r.text for r in without_removed(docs, per).collect()}
    assert all((cut[i] or "") == "\n".join(kept.get(i, [])) for i in cut)
    assert by_document(fuzzy_lines(none)).collect() == []
    assert by_document(fuzzy_lines(hard)).count() == len({i for i, _, _ in HARD})


def test_lines_as_the_query_has_them(spark, hard, none):
    """Nulls, repeated ids, ties, marks and an empty table on the registered path."""
    from riskloom.llm.line_dedup import by_document, fuzzy_lines

    rows = [(1, "----\nthe same line of some words\n\n  ***"), (1, "----"), (None, "the same line, of some words!"), (2, None), (3, ""), (4, "*** \nother text that is alone\n----\n "), (None, "== \n==")]
    got = sorted((repr(r.doc), r.pos, repr(r.keep_doc), r.keep_pos, r.kept) for r in fuzzy_lines(make(spark, rows), sketches=True).collect())
    blank = [("1", 2, "1", 2, True), ("2", 0, "2", 0, True), ("3", 0, "3", 0, True), ("4", 3, "4", 3, True)]
    dashes = [("1", 0, "1", 0, True), ("1", 0, "1", 0, True), ("4", 2, "1", 0, False)]
    stars = [("1", 3, "1", 3, True), ("4", 0, "1", 3, False)]
    words = [("None", 0, "None", 0, True), ("1", 1, "None", 0, False), ("4", 1, "4", 1, True)]
    assert got == sorted([*blank, *dashes, *stars, *words, ("None", 0, "None", 0, True), ("None", 1, "None", 0, False)])
    assert by_document(fuzzy_lines(none, sketches=True)).collect() == []
    assert by_document(fuzzy_lines(hard, sketches=True)).count() == len({i for i, _, _ in HARD})


def test_simhash_of_long_lines(spark):
    from riskloom.llm.line_dedup import simhash

    words = [f"w{k % 977}" for k in range(70_000)]
    row = spark.createDataFrame([(" ".join(words),)], "n string").select(simhash(F.col("n")).alias("s"), F.transform(F.split("n", " "), lambda w: F.xxhash64(w)).alias("h")).first()
    want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in row.h) > len(row.h))
    assert row.s & (1 << 64) - 1 == want


def test_prose_is_hard_enough():
    assert len(PROSE.split()) > 20 and texts()[4] == ""
