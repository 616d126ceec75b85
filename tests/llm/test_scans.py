"""License scans, quality, tokens, decontamination, chat, mixing and URLs against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftloom.llm import chat_format, decontaminate, license_rules, licenses, mixing, quality, queries, tokens, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["words", "label", "label_id", "keywords", "found", "base", "small", "n_words", "score", "size", "tie", "p", "target", "token", "items", "verdict", "rule", "host", "judged", "parts", "turns", "item_id"]


def docs_of(spark, texts, source=None):
    rows = [(i, t, None, source(i) if source else None, None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in CLASH})


def base_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())
    hits = [(i, label) for phrase, label in license_rules.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({h[1] for h in hits}))


LICENSE_TEXTS = [
    None, "", "Released under the MIT License.", "mit license mit LICENSE", "permit license", "MIT-license", "mit.\nlicense é", "émit license", "mit licensee", "the MIT  (license)",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: BSD-3-Clause", "apache license " * 300, "no words here", "İMIT LİCENSE mit license", "word " * 5000 + "Apache License",
]


def test_base_places(spark):
    rows = list(enumerate(LICENSE_TEXTS)) + [(2, LICENSE_TEXTS[2])]
    got = licenses.license_summary(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == sorted((i, *base_by_hand(t)) for i, t in rows)
    by = {r["doc_id"]: r for r in got}
    assert "gpl-3.0" in by[10]["labels"] and "apache-2.0" in by[11]["labels"] and "cc-by-nc-4.0" in by[12]["labels"] and by[13]["labels"] == "bsd-3-clause"
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)
    assert licenses.license_summary(docs_of(spark, rows).limit(0)).count() == 0


MIXED_TEXTS = [
    LICENSE_TEXTS[10] + " " + LICENSE_TEXTS[13],
    "GNU General Public License version 2, GPL-3.0+ with the classpath exception; LGPL v2.1, https://www.gnu.org/licenses/gpl-3.0 and Lesser General Public License",
    "Apache License, Version 2.0 (Apache-2.0) https://www.apache.org/licenses/LICENSE-2.0 Apache licensed. apache license",
    "CC BY-NC-SA 4.0, CC BY-NC 4.0, CC-BY-SA-4.0, Creative Commons Attribution-NonCommercial-ShareAlike 4.0 https://creativecommons.org/licenses/by-nc/4.0",
    "Neither the name of X nor the names of its contributors may be used to endorse; new BSD license, BSD 3-clause, BSD-licensed, SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-License-Identifier: MIT, MIT license; licensed under the terms of the MIT License, Copyright (c) 2020. All rights reserved. EULA: end-user license agreement, royalty-free license",
    "mit license mit license MIT  license public domain, dedicated to the public domain",
]


def test_contained_detections_go(spark):
    rows = licenses.scan(docs_of(spark, list(enumerate(MIXED_TEXTS)))).collect()
    assert len(rows) == len(MIXED_TEXTS)
    for row in rows:
        text, found = row["text"], []
        for k, label, keyword, kind, regex in license_rules.rules():
            if keyword in text.lower():
                found += [(m.start(), m.end(), license_rules.PRIORITY[kind], k, label) for m in re.finditer(regex.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"), text)]

        def covered(a, found=found):
            return any(b != a and b[0] <= a[0] and b[1] >= a[1] and (b[2] > a[2] or b[2] == a[2] and ((b[0], b[1]) != (a[0], a[1]) or b[3] < a[3])) for b in found)

        want = sorted(d for d in found if d[2] == 6 or not covered(d))
        assert len(want) > 1
        assert sorted((d["start"], d["stop"], d["priority"], d["rule"], d["label"]) for d in row["detections"]) == want


def test_rules_hold_their_keyword():
    rules = license_rules.rules()
    assert len(rules) > 200
    for _, _, keyword, _, _ in rules:
        assert any(s in keyword for s in license_rules.STEMS)


def spellings(items):
    """Texts that the parsed regex matches: one for each of its branches, options and listed characters."""
    out = [""]
    for op, arg in items:
        kind = str(op)
        if kind == "LITERAL":
            more = [chr(arg)]
        elif kind == "IN":
            signs = [" \n" if "SPACE" in str(v) else "1" if "DIGIT" in str(v) else "x" if str(k) in ("NEGATE", "CATEGORY") else chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
            more = ["x"] if str(arg[0][0]) == "NEGATE" else list("".join(signs))
        elif kind == "BRANCH":
            more = [t for branch in arg[1] for t in spellings(branch)]
        elif kind == "SUBPATTERN":
            more = spellings(arg[3])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [t * n for n in {arg[0], min(arg[0] + 1, arg[1])} for t in spellings(arg[2])]
        else:
            more = ["x"] if kind in ("ANY", "NOT_LITERAL") else [""]
        out = list(dict.fromkeys(a + b for a in out for b in more))
        if len(out) > 3000:
            out = random.Random(1).sample(out, 3000)
    return out


def test_every_spelling_holds_the_keyword():
    seen = 0
    for _, label, keyword, kind, regex in license_rules.rules():
        if kind != "base":
            texts = [t for t in spellings(re._parser.parse(regex)) if re.search(regex, t)]
            assert texts, regex
            assert [t for t in texts if keyword not in t.lower()] == [], (label, keyword)
            seen += len(texts)
    assert seen > 1000


def test_spellings_are_found(spark):
    texts = {"end-user license agreement": "eula", "licence ouverte": "etalab-2.0", "SPDX-License-Identifier: Python-2.0": "python-2.0", "BigCode Open RAIL-M": "openrail", "Anti996 License": "anti-996", "Ruby licence": "ruby", "Vim licence": "vim", "curl licence": "curl", "Fair licence": "fair"}
    got = {r["doc_id"]: r["labels"] for r in licenses.license_summary(docs_of(spark, list(enumerate(texts)))).collect()}
    assert all(label in got[i].split(",") for i, label in enumerate(texts.values())), got


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    sf1 = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf1}/documents.parquet"), spark.read.parquet(f"{sf1}/labels.parquet")
    w = quality.train(docs, labels.filter(~quality.held_out()))
    assert (w == quality.train(docs.repartition(3), labels.filter(~quality.held_out()).repartition(2))).all()
    out = quality.score(docs, w).join(labels, "doc_id").filter(quality.held_out()).collect()
    assert len(out) > 40
    assert np.mean([(r["score"] >= 0.3) == bool(r["quality"]) for r in out]) >= 0.95
    kept = quality.keep_good(docs, w)
    assert kept.columns == docs.columns and kept.schema == docs.schema


def features_by_hand(text):
    """Values of the hashed features of a text: words, shapes, pairs of each, and words that repeat their neighbour."""
    from zlib import crc32

    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in (text or "").encode().split()]
    whole = [crc32(w) + 1 for w in words]
    shapes = []
    for w in words:
        marks = [97 if b > 127 or chr(b).isalnum() else b for b in w]
        shapes.append(crc32(bytes(m for k, m in enumerate(marks) if not k or marks[k - 1] != m), 7) + 3)
    own = [(h, 0) for h in whole] + [(h, 1) for h in shapes] + [(a * 0x100000001B3 + b, k) for k, hs in ((2, whole), (3, shapes)) for a, b in zip(hs, hs[1:], strict=False)] + [(5, 4) for a, b in zip(whole, whole[1:], strict=False) if a == b]
    counts = {}
    for h, salt in own:
        at = ((h + (salt << 40)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - quality.BITS
        counts[at] = counts.get(at, 0) + 1
    return {at: quality.SCALE * n / len(own) for at, n in counts.items()}


def model_by_hand(rows):
    """Scores by FTRL-proximal updates in plain loops; rows of (features, label) in order."""
    z, n = {}, {}

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= quality.L1 else -(v - math.copysign(quality.L1, v)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    def score(x):
        return 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items()) - weight(-1)))

    for _ in range(quality.EPOCHS):
        for x, label in rows:
            x = x | {-1: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            w = {i: weight(i) for i in x}
            for i, v in x.items():
                g = (p - label) * v
                had = n.get(i, 0.0)
                n[i] = had + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(had)) / quality.ALPHA * w[i]
    return score


def quality_fixture(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["The", "river", "runs", "north,", "and", "École", "stands."]) for _ in range(r.randrange(1, 60)))
    bad = lambda: " ".join(r.choice(["buy!!", "buy!!", "$$$", "now", "###", "x1x1"]) for _ in range(r.randrange(1, 60)))
    rows = [(i, good() if i % 3 else bad()) for i in range(150)] + [(200, None), (201, ""), (202, "now now now " * 9000)]
    labels = [(i, int(i % 3 > 0)) for i in range(100)] + [(200, 1), (5, None), (900, 1)]
    return rows, labels


def by_hand(spark, rows, labels):
    """The score of every row, by the plain model of the labelled rows that may teach."""
    may = {i: q for i, q in labels if q is not None and zlib.crc32(str(i).encode()) % 5 and i in dict(rows)}
    order = [r["i"] for r in spark.createDataFrame([(i,) for i in may], "i long").orderBy(F.xxhash64("i", F.lit("order")), "i").collect()]
    score = model_by_hand([(features_by_hand(dict(rows)[i]), may[i]) for i in order])
    return {i: score(features_by_hand(t)) for i, t in rows}


def test_quality_by_hand(spark):
    rows, labels = quality_fixture(spark)
    want = by_hand(spark, rows, labels)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    w = quality.train(docs_of(spark, rows), table.filter(~quality.held_out()))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs_of(spark, rows), w).collect()}
    assert got == pytest.approx(want, abs=2e-4)
    assert min(got.values()) < 0.3 < max(got.values())


def test_quality_edges(spark):
    df = docs_of(spark, [(1, None), (2, ""), (3, "a b " * 20_000), (3, "a b " * 20_000), (None, "x")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    w = quality.train(df, none)
    assert [r["score"] for r in quality.score(df, w).collect()] == [0.5] * 5
    some = spark.createDataFrame([(3, 1, 0), (3, None, 0), (99, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    w = quality.train(df, some)
    assert all(r["score"] > 0.5 for r in quality.score(df, w).collect())
    assert quality.score(df.limit(0), w).count() == 0


def test_ftrl_step_by_hand():
    m, at, x = quality.Ftrl(4), np.array([1, 3]), np.array([2.0, 1.0])
    m.learn(at, x, 1)
    g = (0.5 - 1) * np.array([2.0, 1.0])
    sigma = np.abs(g) / quality.ALPHA
    assert m.z[[1, 3]] == pytest.approx(g - sigma * 0)
    assert m.n[[1, 3]] == pytest.approx(g * g)
    z, n = m.z[1], m.n[1]
    assert m.weights()[1] == pytest.approx(-(z - np.sign(z) * quality.L1) / ((quality.BETA + np.sqrt(n)) / quality.ALPHA + quality.L2))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


@pytest.fixture(scope="module")
def counter():
    with open(queries.vocabulary(), encoding="utf-8") as f:
        return tokens.PrefixCounter(f.read())


PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "é", "漢", "字", "🙂", "1", "23", "!", "?!", "...", " the", "<|endoftext|>", "<|end", "\u2028", "\xa0", "\x85", "ſ", "$$$", "=====", "----", "ing", "tion"]


def sizes(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_at_every_prefix(library, counter):
    r = random.Random(2)
    for _ in range(400):
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(12)))
        index = counter.index(text)
        want = sizes(library, [text[:k] for k in range(len(text) + 1)])
        assert [index.tokens(k) for k in range(len(text) + 1)] == want
        for limit in (0, 1, 3, 6):
            assert index.fits(limit) == counter.fits(text, limit) == max(k for k in range(len(text) + 1) if want[k] <= limit)


def test_token_query(spark, sf, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(9001, None), (9002, ""), (9003, "x" * 30_000), (9004, "=" * 5000 + " " * 5000), (9004, "again"), (None, "<|endoftext|> x")]
    got = tokens.token_counts(docs_of(spark, rows), queries.vocabulary(), 1024).collect()
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, sizes(library, [t or "" for _, t in rows]), strict=True)]
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)


def leaks_by_hand(docs, items):
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").encode().lower().decode())
    has = [(i, shingles(words(t))) for i, t in docs]
    out = []
    for k, t in items:
        want = shingles(words(t))
        if len(words(t)) < 5 and want:  # a short item is one shorter shingle
            n = len(words(t))
            out += [(i, k) for i, d in docs if any(tuple(words(d)[j : j + n]) in want for j in range(len(words(d))))]
        elif want:
            out += [(i, k) for i, h in has if len(want & h) >= 0.8 * len(want) - 1e-9]
    return sorted(out, key=repr)


def test_leaks(spark, monkeypatch):
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(60)}" for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((6, 9, 20, 31, 50, 64, 100, 1))] + [(50, None), (51, ""), (52, "w1 w2"), (53, "W1, w2!"), (3, "alpha beta gamma")]
    docs = [(i, text(300)) for i in range(20)] + [(90, None), (91, ""), (92, "w1 w2"), (93, "Alpha; BETA gamma")]
    for i, (_, t) in enumerate(items[:7]):
        words = t.split()
        docs.append((100 + i, text(4000) + " " + t.upper().replace(" ", ", ") + " " + text(50)))
        for m in range(1, 4):  # with words changed, on both sides of the threshold
            w = list(words)
            for _ in range(m):
                w[r.randrange(len(w))] = "other"
            docs.append((200 + 10 * i + m, text(20) + " " + " ".join(w)))
    docs.append((100, docs[-1][1]))
    item_df = spark.createDataFrame(items, "item_id long, text string")
    want = leaks_by_hand(docs, items)
    for block in (8_000_000, 500):  # one block, and several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.leaks(docs_of(spark, docs), item_df)
        assert sorted(((x["doc_id"], x["item_id"]) for x in got.collect()), key=repr) == want
        kept = decontaminate.clean(docs_of(spark, docs), item_df)
        assert kept.columns == docs_of(spark, docs).columns
        gone = {(i, k) for i, k in want}
        assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, t in docs if not any(i == a and (i, t) in [(b, s) for b, s in docs if b == i and leaks_by_hand([(b, s)], items)] for a, _ in gone))
    assert decontaminate.leaks(docs_of(spark, docs).limit(0), item_df).count() == 0
    assert decontaminate.leaks(docs_of(spark, docs), item_df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "a\\<|b\\\\", "", None, "\n", "<\\|im_end|>", "é🙂<|image:0|>", "x" * 50_000]
    rows = [(c, t, role, hard[(c + t) % len(hard)]) for c in range(8) for t, role in enumerate(("system", "user", "assistant", "assistant"))]
    rows += [(20, 0, None, "no role"), (20, None, "user", "no turn"), (20, 1, "as\nsistant", "odd"), (20, 1, "assistant", "tie"), (20, 1, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in CLASH})
    rendered = chat_format.render(df)
    got = {r["conv_id"]: r for r in chat_format.read_back(rendered).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in turns).encode()).hexdigest()
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r["conv_id"]: r["formatted"] for r in chat_format.conversations(rendered).collect()}
    assert all(len(whole[c]) == got[c]["formatted_chars"] for c in whole)
    assert chat_format.parse(whole[3])[1] == ("user", hard[4] or "")
    assert chat_format.read_back(chat_format.render(df.limit(0))).count() == 0


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "see <|image:9|> "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b.wav", "seconds": 2.5}, {"type": "document", "ref": "c.pdf", "pages": 3}, None]
    turn = chat_format.format_turn("user", parts)
    assert turn["text"] == "see <|image:9|> <|image:0|><|audio:1|><|document:2|>"
    assert "<\\|image:9|>" in turn["formatted"] and turn["loss"] == (0, 0)
    assert [(a["kind"], a["ref"], a["tokens"]) for a in turn["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 63), ("document", "c.pdf", 1800)]
    with pytest.raises(ValueError):
        chat_format.format_turn("user", [{"type": "video"}])
    schema = "conv_id long, turn long, role string, content array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    df = spark.createDataFrame([(1, 0, "assistant", [("text", "hi", None, None, None, None, None), ("image", None, "x", 1, 1, None, None)]), (1, 1, "user", None)], schema)
    out = chat_format.render(df, "content").orderBy("turn").collect()
    assert out[0]["text"] == "hi<|image:0|>" and out[1]["text"] == ""
    assert out[0]["formatted"][out[0]["loss_start"] : out[0]["loss_end"]] == "hi<|image:0|>"


def targets_by_hand(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    w = [weights[i % 3] for i in range(len(sizes))]
    while free:
        share = sum(w[i] for i in free)
        over = {i for i in free if left * w[i] / share > cap * sizes[i]}
        for i in over or free:
            out[i] = cap * sizes[i] if over else left * w[i] / share
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 5], [7, 0, 9, 100, 3], [1] * 40 + [5000], [0, 0], []])
def test_targets(spark, sizes):
    names = [f"s{i:03d}" for i in range(len(sizes) - 1)] + [None] * bool(sizes)
    per = spark.createDataFrame(list(zip(names, sizes, [1] * len(sizes), strict=True)), "source string, words long, n long").repartition(3)
    got = {r["source"]: r["target"] for r in mixing.targets(per).collect()}
    assert got == pytest.approx(dict(zip(names, targets_by_hand(sizes), strict=True)))


def test_flight_keeps_totals():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 50, 400):
        p, size = np.full(n, 0.37), r.integers(1, 2000, n).astype(float)
        out = mixing.flight(p, size, "k")
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(p.sum(), abs=1e-6)
        assert (out * size).sum() == pytest.approx((p * size).sum(), rel=1e-6, abs=1e-6)
    assert (mixing.flight(np.full(9, 0.5), np.full(9, 4.0), "k") * 4).sum() == pytest.approx(18)


@pytest.mark.parametrize("block", [2000, 16])
def test_mix(spark, block):
    r = random.Random(6)
    rows = [(i, "w " * r.randrange(1, 200)) for i in range(900)] + [(5000, None), (5001, ""), (5002, "w " * 60_000), (7, "w w")]
    source = lambda i: None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 4}"
    df = docs_of(spark, rows, source)
    got = mixing.mix(df, block=block).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(x) for x in got) == sorted(tuple(x) for x in mixing.mix(df.repartition(5), block=block).collect())
    names = sorted({source(i) for i, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len((t or "").split()) for i, t in rows if source(i) == s) for s in names}
    want = dict(zip(names, targets_by_hand([size[s] for s in names]), strict=True))
    for s in names:
        mine = [x for x in got if source(x["doc_id"]) == s]
        assert all(x["source_size"] == size[s] and x["target"] == pytest.approx(want[s]) and x["taken"] <= 3 * x["size"] and x["taken"] == x["copies"] * x["size"] for x in mine)
        taken = sum(x["taken"] for x in mine)
        if s != source(5002):  # one document holds half of that source's words
            assert abs(taken - want[s]) <= 200
    assert mixing.mix(df.limit(0)).count() == 0


URLS = [
    None, "", "no scheme", "http://EXAMPLE.org/es/1?q=1", "https://a.example.org/en/15", "https://a.example.org/en/25", "https://b.org", "https://b.org/", "https://notexample.org/es/x", "http://x.com/fr/1",
    "http://x.com/de/1#f", "http://x.com/de?x", "http://x.net/de/1", "ftp://h://y/z", "://org/x", "http://org/a", "http://ÉX.org/p", "https://sub.com/fr/" + "a" * 9000, "http://x.net/es/7",
]


def judge_by_hand(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ((m[1].encode().lower().decode(), m[2]) if m else ("", ""))
    fit = [(len(h + p), h + p, v) for v, r in queries.URL_RULES for h, p in [(r.split("/")[0], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best and best[2]


def test_url_tokens(spark):
    df = spark.createDataFrame([("HTTPS://M.Shop.example.ORG/en/Item12/?q=1&ref=x&q=2#top",), ("http://h",), ("none",), (None,)], "url string")
    host, path = url_filter.split_url(F.col("url"))
    got = [set(r["t"]) for r in df.withColumn("h", host).withColumn("p", path).select(url_filter.tokens(F.col("url"), F.col("h"), F.col("p")).alias("t")).collect()]
    assert got[0] == {"scheme:https", "tld:org", "host:m", "host:shop", "host:example", "host:org", "path:en", "path:item#", "query:q", "query:ref"}
    assert got[1:] == [{"scheme:http", "tld:h", "host:h"}, set(), set()]


def test_urls(spark):
    rows = list(enumerate(URLS)) + [(3, URLS[3])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in CLASH if c not in ("host", "rule")})
    rules = [url_filter.url_rule(*r) for r in queries.URL_RULES]
    got = url_filter.judge(df, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = judge_by_hand(dict(rows)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert all(r["verdict"] == "allow" for r in url_filter.judge(df, []).collect())


def test_mined_rules_by_hand(spark):
    """Verdicts of unruled URLs equal those by all token sets counted by hand."""
    from itertools import combinations

    r = random.Random(8)
    urls = [f"http://{r.choice(['a', 'b', 'cc'])}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['de', 'fr', 'es', 'en'])}/{r.randrange(9)}" + r.choice(["", "?q=1", "?ref=2"]) for _ in range(400)]
    rules = [url_filter.url_rule(*x) for x in queries.URL_RULES]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = url_filter.split_url(F.col("url"))
    bags = {x["page_id"]: set(x["t"]) for x in df.withColumn("h", host).withColumn("p", path).select("page_id", url_filter.tokens(F.col("url"), F.col("h"), F.col("p")).alias("t")).collect()}
    given = {i: judge_by_hand(u)[3] for i, u in enumerate(urls)}
    labelled = [i for i in given if given[i]]
    count = {}
    for i in labelled:
        for n in (1, 2, 3):
            for c in combinations(sorted(bags[i]), n):
                a = count.setdefault(c, [0, 0])
                a[0] += 1
                a[1] += given[i] == "block"
    strong = {c for c, (n, b) in count.items() if b / n >= 0.9 and b >= 0.02 * len(labelled)}
    got = {x["page_id"]: x["verdict"] for x in url_filter.judge(df, rules, min_support=0.02).collect()}
    for i in given:
        assert got[i] == (given[i] or ("block" if any(set(c) <= bags[i] for c in strong) else "allow"))
    assert {"block", "allow"} == {got[i] for i in given if not given[i]}


def test_rules_of_four_tokens(spark):
    """Only all four path segments together go with block."""
    rules = [url_filter.url_rule(v, f"h.net{p}") for v, p in (("block", "/a/b/c/d"), ("allow", "/a/b/c"), ("allow", "/a/b/d"), ("allow", "/a/c/d"), ("allow", "/b/c/d"))]
    urls = [f"http://h.net{p}" for p in ("/a/b/c/d", "/a/b/c", "/a/b/d", "/a/c/d", "/b/c/d")] * 10 + ["http://o.org/a/b/c/d", "http://o.org/a/b/c"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules).collect()}
    assert (got[50], got[51]) == ("block", "allow")


def test_forty_tokens_of_one_template(spark):
    """Tokens that always come together are one item; each of them alone tells the class."""
    rules = [url_filter.url_rule("block", "bad.net/"), url_filter.url_rule("allow", "good.org/")]
    query = "&".join(f"k{i}=1" for i in range(40))
    urls = [f"http://bad.net/{c}?{query}" for c in "abcdefgh" * 6] + [f"http://good.org/{c}" for c in "abcdefgh" * 6] + ["http://o.com/a?k7=2", "http://o.com/a"]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert (got[96]["verdict"], got[97]["verdict"]) == ("block", "allow")


def test_labelled_urls(spark):
    """URLs with a verdict of their own teach beside the rules; others teach nothing."""
    pages = spark.createDataFrame([(1, "http://x.shop/win"), (2, "http://y.shop/news"), (3, None)], "page_id long, url string")
    labels = spark.createDataFrame([("http://a.shop/win", "block"), ("http://b.shop/win", "block"), ("http://c.shop/news", "allow"), ("http://d.shop/news", "maybe"), (None, "block"), ("http://e.shop/news", None)], "url string, verdict string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [], min_support=0.3, labels=labels).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_mix_of_repeated_rows(spark):
    """Rows alike are dealt in lots; reruns agree."""
    rows = [(1, "a b c d")] * 1700 + [(i, "w " * (i % 40)) for i in range(2, 400)]
    df = docs_of(spark, rows, lambda i: "hot" if i < 300 else "s2")
    got = mixing.mix(df, block=64).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(x) for x in got) == sorted(tuple(x) for x in mixing.mix(df.repartition(7), block=64).collect())
    for name in ("hot", "s2"):
        own = [x for x in got if (x["doc_id"] < 300) == (name == "hot")]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 80


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    sql = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0


def test_pipeline_stages_by_hand(spark, tmp_path):
    """Each stage against its brute-force version, on its predecessor's rows: nulls, repeats, empty texts, ids that repeat."""
    import corpus_pipeline
    from test_dedup import assert_kept, jaccard_roots

    rows, labels = quality_fixture(spark)
    item = "seven small ships sail slowly past the old stone harbour wall tonight"
    base = " ".join(f"The river{k} runs north," for k in range(40))
    rows += [(300, base), (301, base.upper()), (302, base.replace("river3 ", "lake ")), (303, "The river and École " + item + " stands. The river runs"), (304, item), (300, base), (300, "École stands."), (None, "The river runs"), (None, base)]
    docs = spark.createDataFrame([(i, t, "en", None if i is None else "hot" if i % 4 else "cold", len(t or "")) for i, t in rows], DOCS)
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    kept = corpus_pipeline.quality_filter(spark, docs, str(tmp_path))
    teaching = {}
    for i, t in rows:  # texts under one id teach as the largest of them
        teaching[i] = max(teaching.get(i) or "", t or "")
    score = by_hand(spark, [(i, teaching[i]) for i, _ in labels if i in teaching and i is not None] + [(("row", k), t) for k, (_, t) in enumerate(rows)], labels)
    assert sorted(texts(kept), key=repr) == sorted((r for k, r in enumerate(rows) if score[("row", k)] >= 0.3), key=repr)
    assert 20 < kept.count() < len(rows)

    once = corpus_pipeline.exact_dedup_filter(spark, kept, str(tmp_path))
    groups = {}
    for i, t in texts(kept):
        key = (t or "").encode().lower()
        groups[key] = max(groups.get(key, -1), -1 if i is None else i)
    assert sorted(((t or "").encode().lower(), -1 if i is None else i) for i, t in texts(once)) == sorted(groups.items())

    apart = corpus_pipeline.near_dedup_filter(spark, once, str(tmp_path))
    assert_kept(apart, texts(once), jaccard_roots(texts(once)))
    assert apart.count() < once.count()

    clean = corpus_pipeline.decontamination_filter(spark, apart, str(tmp_path))
    leaks = [k for k, row in enumerate(texts(apart)) if leaks_by_hand([(0, row[1])], [(1, item)])]
    assert len(leaks) == 2
    assert sorted(texts(clean), key=repr) == sorted((row for k, row in enumerate(texts(apart)) if k not in leaks), key=repr)
    for df in (kept, once, apart, clean):
        assert df.columns == docs.columns

    mixed = corpus_pipeline.source_mix(spark, clean, str(tmp_path)).collect()
    source = {i: None if i is None else "hot" if i % 4 else "cold" for i, _ in texts(clean)}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    size = [sum(len((t or "").split()) for i, t in texts(clean) if source[i] == s) for s in names]
    assert len(mixed) == clean.count()
    for s, want in zip(names, targets_by_hand(size), strict=True):
        own = [x for x in mixed if source[x["doc_id"]] == s]
        assert own[0]["target"] == pytest.approx(want) and all(x["taken"] <= 3 * x["size"] for x in own)
        assert abs(sum(x["taken"] for x in own) - want) <= max(x["size"] for x in own)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((tuple(r) for r in final.collect()), key=repr) == sorted((tuple(r) for r in mixed), key=repr)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns
        assert out.exceptAll(now).count() == 0  # a filter changes no row
        now = out
    texts = [r["text"] for r in now.collect()]
    assert len({t.encode().lower() for t in texts}) == len(texts)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert leaks_by_hand([(r["doc_id"], r["text"]) for r in now.collect()], items) == []
    final = corpus_pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in final.collect()) == sorted(r["doc_id"] for r in now.collect())
