"""Exact dedup, line dedup, SimHash and components against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftloom.llm import components, exact_dedup, line_dedup, near_copies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASH = ["norm", "recipe", "n", "largest", "fp", "root", "key", "low", "mark", "line", "rank", "depth", "words", "size", "token", "score", "kept", "keep_id", "component_id"]


def docs_of(spark, texts, clash=True):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOCS)
    return df.withColumns({c: F.lit(7) for c in CLASH}) if clash else df


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", ".", ",", "!\n"]) for _ in range(n))


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def copies():
    long = prose(1, 3000)
    texts = [long, long.upper(), long + "x", prose(2, 40), "", None, "É", "é", "A", "a", prose(3, 500), prose(3, 500)]
    texts += ["one line"] * 60 + [long.replace("w7", "w8", 1)]
    return [*enumerate(texts), (3, prose(2, 40)), (None, "one line"), (None, None)]


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(ascii_lower(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[ascii_lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(ascii_lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_hash", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(1).cast("long")])
def test_exact_groups(spark, chunk_hash):
    """Also with chunk hashes that collide: identifiers are verified by text."""
    rows = copies()
    got = exact_dedup.exact_groups(docs_of(spark, rows), chunk_hash=chunk_hash)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == exact_by_hand(rows)


def test_chunks_are_the_text(spark):
    texts = [prose(5, 2000), "x" * 20_000, "", "ünï\n" * 900, "a" * 255 + "."]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", exact_dedup.chunks_of(F.col("text")).alias("c")).collect():
        assert "".join(r["c"]) == r["text"]
        assert all(len(c) <= exact_dedup.MAX_CHARS for c in r["c"])


def test_exact_keep_one(spark):
    rows = copies()
    df = docs_of(spark, rows)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    texts = [ascii_lower(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({ascii_lower(t) for _, t in rows})
    assert exact_dedup.keep_one(df.limit(0)).count() == 0


def runs_by_hand(rows, least):
    """Text left and lines deleted by the definition: every run of any length with ``least`` words that occurs before."""
    seen, out = set(), {}
    for has, i, t in sorted({(i is not None, i or 0, t or "") for i, t in rows}):
        lines, gone = t.split("\n"), set()
        weight = [max(1, len(x.split())) for x in lines]
        for s in range(len(lines)):
            w = 0
            for e in range(s, len(lines)):
                w += weight[e]
                if w >= least:
                    run = hash(tuple(lines[s : e + 1]))
                    if run in seen:
                        gone |= set(range(s, e + 1))
                    seen.add(run)
        assert (has, i) not in out  # the order of texts under one id is by hash; not checked here
        out[(has, i)] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)
    return out


def paragraph(seed, n=30):
    r = random.Random(f"p{seed}")
    return " ".join(f"w{r.randrange(90)}" for _ in range(n))


def test_line_dedup(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(paragraph(r.randrange(25), r.choice([3, 12, 30, 70])) if r.random() < 0.7 else r.choice(["", "the end", "same short line"]) for _ in range(r.randrange(1, 14)))))
    rows += [(100, None), (101, ""), (102, "\n".join([paragraph("loop", 20)] * 50)), (103, "\n" * 300), (104, "\n" * 200), (None, paragraph("q", 80)), (105, paragraph("q", 80)), (5, rows[5][1])]
    got = line_dedup.without_repeats(docs_of(spark, rows)).collect()
    want = runs_by_hand(rows, 50)
    assert len(got) == len(rows)
    for g in got:
        assert (g["text"], g["n_deleted"]) == want[(g["doc_id"] is not None, g["doc_id"] or 0)]
    assert line_dedup.without_repeats(docs_of(spark, rows).limit(0)).count() == 0


def test_whole_runs(spark):
    """The end of a repeated run goes as well, whatever the lengths of its lines."""
    r = random.Random(6)
    a, b, c, d = paragraph("a", 25), paragraph("b", 25), paragraph("c", 3), paragraph("d", 100)
    rows = [(0, "\n".join([a, b, c, "x"])), (1, "\n".join(["y", a, b, c])), (2, "\n".join([d, c, "q"])), (3, "\n".join([d, c, "r"]))]
    lines = [paragraph(k, r.choice([2, 5, 20, 30, 60])) for k in range(12)]
    rows += [(10 + i, "\n".join(lines[(k + j) % 12] if r.random() < 0.95 else f"own {i} {j}" for j in range(r.randrange(2, 9)))) for i in range(50) for k in [r.randrange(12)]]
    rows += [(100, "\n".join([paragraph("loop", 20)] * 30)), (101, "\n" * 120)]
    got = {g["doc_id"]: (g["text"], g["n_deleted"]) for g in line_dedup.without_repeats(docs_of(spark, rows)).collect()}
    assert got == {i: v for (_, i), v in runs_by_hand(rows, 50).items()}
    assert got[1] == ("y", 3) and got[3] == ("r", 2)


def test_same_id_different_text(spark):
    rows = [(1, paragraph("a", 80)), (1, paragraph("b", 80)), (2, paragraph("a", 80))]
    got = line_dedup.without_repeats(docs_of(spark, rows)).collect()
    assert sorted((g["doc_id"], g["n_deleted"]) for g in got) == [(1, 0), (1, 0), (2, 1)]


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_by_hand(rows):
    fps = {r: fingerprint_by_hand(r[1]) for r in rows}
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for (i, _), f in fps.items():
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return sorted(((i, f"{f:016x}", low.get(find(f))) for (i, _), f in fps.items()), key=repr)


def close_copies():
    base = prose(11, 400).split()
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "one two"), (5, "ONE two three"), (6, "one\ttwo  three")]
    r = random.Random(3)
    for i in range(150):
        words = list(base)
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = "new"
        rows.append((10 + i, " ".join(words)))
    rows += [(200 + i, prose(i, 60)) for i in range(40)]
    rows += [(300, "x " * 30_000), (None, "nobody's text at all"), (None, rows[20][1])]
    return rows


def test_fingerprints_and_components(spark):
    rows = close_copies()
    got = simhash.near_groups(docs_of(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == near_by_hand(rows)


@pytest.mark.parametrize("bucket", [0, 4, 256])
def test_links_join_all_within_two_bits(spark, bucket):
    """Few and crowded buckets give the same components."""
    r = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        f = r.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for _ in range(r.randrange(1, 4)):
                f ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket=bucket)
    for e in edges.collect():
        assert ((e["a"] ^ e["b"]) & ((1 << 64) - 1)).bit_count() <= 2
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    linked = {f for f in signed if any(f != g and find(f) == find(g) for g in signed)}
    assert got == {f: min(g for g in signed if find(g) == find(f)) for f in linked}


def test_golay_code_is_perfect():
    index = simhash.codeword_index()
    counts = np.bincount(index, minlength=4096)
    assert (counts == 2048).all()
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 2000)
    keys = simhash.golay_keys(words)
    assert max(len(set(k)) for k in keys.tolist()) == 6
    for _ in range(300):  # two words within two errors share a key
        w = int(r.integers(0, 1 << 23))
        v = w ^ (1 << int(r.integers(23))) ^ (1 << int(r.integers(23)))
        a, b = simhash.golay_keys(np.array([w, v]))
        assert set(a.tolist()) & set(b.tolist())


def kept_by_hand(rows, root):
    """Of each group one row: the smallest id, a null id last; of texts under one id any."""
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(root[k], []).append((i is None, i, t))
    return {g: {(i, t) for none, i, t in own if (none, i) == min((n, x) for n, x, _ in own)} for g, own in groups.items()}


def assert_kept(kept, rows, root):
    want, left = kept_by_hand(rows, root), {(r["doc_id"], r["text"]): 0 for r in kept.collect()}
    for r in kept.collect():
        left[(r["doc_id"], r["text"])] += 1
    of = {(i, t): root[k] for k, (i, t) in enumerate(rows)}
    assert set(left.values()) <= {1}
    assert sorted(of[x] for x in left) == sorted(want)  # one row a group, none lost
    assert all(x in want[of[x]] for x in left)


AGAIN = [(3, "a text that stands alone under this id"), (5, "the same long text is here two times over"), (5, "the same long text is here two times over"), (5, "another text under a number that is taken"), (9, "a lone pair of rows"), (9, "a lone pair of rows"), (3, "the same long text is here two times over")]


def test_simhash_keep_one(spark):
    rows = close_copies() + [(i + 9000, t) for i, t in AGAIN]
    df = docs_of(spark, rows)
    kept = simhash.keep_one(df, similarity=None)
    assert kept.columns == df.columns
    fps = [fingerprint_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        before = list(root)
        for k, a in enumerate(fps):
            root[k] = min(root[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2)
        if root == before:
            break
    assert_kept(kept, rows, root)
    assert simhash.near_groups(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0


def jaccard_roots(rows):
    """A number for each row's group: all pairs by sets of five-word shingles."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    held = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(held):
        for j, b in enumerate(held[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return [find(k) for k in range(len(rows))]


def jaccard_groups_by_hand(rows):
    """Sorted (id, smallest id of its group)."""
    root, low = jaccard_roots(rows), {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root[k]] = min(low.get(root[k], i), i)
    return sorted(((i, low.get(root[k])) for k, (i, _) in enumerate(rows)), key=repr)


def jaccard_copies():
    """Copies with up to eight words changed, of a base that is not there; chains; a very common line."""
    r, rows = random.Random(12), [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c d e"), (7, "a  b c d e")]
    for g, (n, copies) in enumerate([(150, 120), (60, 80), (30, 40)]):
        base = prose(50 + g, n, 5000).split()
        for i in range(copies):
            words = list(base)
            for k in range(r.randrange(9)):
                words[r.randrange(len(words))] = f"new{g}x{i}x{k}"
            rows.append((100 + 1000 * g + i, " ".join(words)))
    chain = prose(70, 400, 5000).split()
    rows += [(5000 + k, " ".join(chain[6 * k : 6 * k + 90])) for k in range(40)]
    line = prose(80, 30, 5000)
    rows += [(6000 + k, line + " " + prose(900 + k, 12 + k % 7, 5000)) for k in range(80)]
    return rows + [(None, "nobody's text at all"), (None, rows[40][1]), rows[30]]


def test_similar_groups_by_hand(spark, monkeypatch):
    rows = jaccard_copies()
    want = jaccard_groups_by_hand(rows)
    assert len({i for i, low in want if i != low}) > 100
    assert sorted((tuple(r) for r in simhash.similar_groups(docs_of(spark, rows)).collect()), key=repr) == want
    monkeypatch.setattr(near_copies, "MOST_COMMON", 0)  # another order, the same groups
    assert sorted((tuple(r) for r in simhash.similar_groups(docs_of(spark, rows)).collect()), key=repr) == want
    assert simhash.similar_groups(docs_of(spark, rows).limit(0)).count() == 0


def test_similar_groups_without_candidates(spark, monkeypatch):
    """The exact search alone finds every link as well."""
    rows = jaccard_copies()[:150]
    monkeypatch.setattr(simhash, "candidates", lambda rows: rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    assert sorted((tuple(r) for r in simhash.similar_groups(docs_of(spark, rows)).collect()), key=repr) == jaccard_groups_by_hand(rows)


def test_pipeline_near_copies(spark, sf):
    """The stage leaves one text of each group at 0.8, by all pairs; texts under one id are told apart."""
    import corpus_pipeline

    rows = jaccard_copies() + AGAIN + [(None, None), (None, "one")]
    docs = docs_of(spark, rows, clash=False)
    assert_kept(corpus_pipeline.near_dedup_filter(spark, docs, sf), rows, jaccard_roots(rows))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
