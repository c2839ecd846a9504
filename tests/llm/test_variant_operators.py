"""Conversation trie, spelling variants and license scan against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basisflow.llm import licenses, prefix_trie, spelling
from tests.llm import samples

_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CONV = "conv_id long, turn long, role string, text string"


def conversations():
    """Families with shared beginnings, copies, prefixes of each other, a long one, null cells, null ids, repeated rows, a family without its first one."""
    rows = []
    for base in (0, 100):
        for c in range(base, base + 14):
            n = 1 + (c * 7) % 9
            rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"family {base} turn {t} {'same' if c % 3 else c}") for t in range(n)]
    rows += [(c, t, "user", f"copy {t}") for c in (205, 206, 207, 290) for t in range(12)]
    rows += [(c, t, "user", f"copy {t}" + (" other" if (c, t) == (209, 11) else "")) for c in (208, 209) for t in range(12)]
    rows += [(301, t, "user", f"long {t}é😀") for t in range(70)] + [(302, 0, "user", "head"), (303, 0, "user", "head")]
    rows += [(400, None, None, None), (400, 2, "user", ""), (400, 1, "user", None), (400, 1, "user", "tie"), (400, 1, "user", "tie")]
    rows += [(None, 0, "user", "nobody"), (-5, 0, "a", "x"), (-5, 1, "a", "y"), (-100, 0, "a", "x"), (-100, 1, "a", "z")]
    return rows


def plain_trie(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((t is not None, t or 0, digest, (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(not kids[q] for q in below),
                    sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_equals_the_plain_one(spark):
    rows = conversations()
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, CONV).repartition(5))
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_trie(rows)


def test_trie_of_nothing_and_of_other_columns(spark):
    none = spark.createDataFrame([], CONV)
    assert prefix_trie.conversation_trie(none).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], CONV)).count() == 0
    rows = [(1, 0, "a", "b"), (2, 0, "a", "b")]
    wide = spark.createDataFrame(rows, CONV)
    for name in ("depth", "k1", "pos", "digest", "n", "path", "head", "own"):
        wide = wide.withColumn(name, F.lit("x"))
    assert sorted([tuple(r) for r in prefix_trie.conversation_trie(wide).collect()], key=str) == plain_trie(rows)


def test_many_ids_at_one_node_pass_in_ranges(spark):
    """Member lists over several ranges of ids, far apart, give one digest."""
    ids = [1, 2, 65535, 65536, 200000, 5_000_000_000, -3, -70000]
    ends = spark.createDataFrame([(c, 0, 0, 0) for c in ids], "conv_id long, depth int, k1 long, k2 long")
    row = prefix_trie.sequences(ends).collect()
    assert len(row) == 1 and row[0].n == len(ids) and row[0].conv_id == -70000
    assert row[0].ends == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def spelled():
    """Texts with frequent words, one-edit variants, chains of forms, ties, short, long, accented and upper-case words."""
    texts = [("longest variants Variants VARIANTS " * 40) + "variant " * 6 + "varient " * 5 + "vaariants " * 5, "ÉTUDES études etudes " * 30 + "étude " * 7,
             "planet " * 300 + "planets " * 50 + "planetse " * 9 + "plannet " * 5 + "planetes " * 8, "gardens " * 200 + "garden " * 40 + "gardin " * 8 + "abcdef " * 30 + "bbcdef " * 30 + "acdef abcdeff " * 6,
             "z" * 5000 + " " + ("z" * 5001 + " ") * 26, "short word five", "aaaaaa " * 5 + "aaaaaaa " * 25 + "aaaaab " * 5, "x×y÷zabc " * 9 + "straße日本straße " * 7]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "planet variants " * 5), (3, texts[3]), (3, texts[3]), (77, None), (78, ""), (4, ("z" * 5000 + "-") * 5)]


def plain_forms(rows):
    count = Counter()
    for key, text in rows:
        for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(_UP))).items():
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += n
    v = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w in v:
        around = [x for x in v if near(w, x)]
        best = min(around, key=lambda x: (-v[x], x), default=None)
        form[w], n_near[w] = best if best and v[best] >= 5 * v[w] else None, len(around)
    out = []
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, v[w], n_near[w], v.get(form[w])))
    return sorted(out, key=str)


def test_variants_equal_the_plain_ones(spark):
    rows = spelled() + [(1000 + i, "planets variants études " * 3) for i in range(400)]  # some of these lose a letter
    got = spelling.group_variants(samples.documents(spark, rows)).collect()
    want = plain_forms(rows)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert any(r[1] and r[2] != r[1] for r in want), "no chain in the fixture"


def test_variants_of_nothing_and_of_other_columns(spark):
    assert spelling.group_variants(samples.empty(spark)).count() == 0
    d = samples.documents(spark, [(1, "planet " * 9 + "planets " * 50)]).withColumn("word", F.lit(1)).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    assert {r.word: r.form for r in spelling.group_variants(d).collect()} == {"planet": "planets", "planets": None}


def test_long_texts_are_cut_behind_runs(monkeypatch):
    text = "alpha Beta-" * 500
    whole = spelling.words_of(text)
    monkeypatch.setattr(spelling, "_PIECE", 7)
    assert spelling.words_of(text) == whole == Counter({b"alpha": 500, b"beta": 500})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=7), st.integers(1, 40))
def test_neighbourhood_has_every_edit_once(symbols, cells):
    s = np.array([symbols], np.uint64)
    want = {tuple(symbols)}
    for i in range(len(symbols) + 1):
        want |= {(*symbols[:i], c, *symbols[i:]) for c in (1, 2, 3)}
        want |= {(*symbols[:i], c, *symbols[i + 1:]) for c in (1, 2, 3) if i < len(symbols)}
        want |= {(*symbols[:i], *symbols[i + 1:])} if i < len(symbols) else set()
    old, spelling._CELLS = spelling._CELLS, cells
    try:
        keys = np.concatenate([k for _, k in spelling.neighbourhood(s, 3)])
    finally:
        spelling._CELLS = old
    value = lambda w: int(spelling._heads(np.array([w], np.uint64).reshape(1, -1))[0, -1])
    assert sorted(keys.tolist()) == sorted(value(w) for w in want)


def plain_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_UP))
    hits = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    blocks = []
    for k, t in enumerate(licenses.TEMPLATES):
        tokens = set(t.words)
        for start in range(0, max(len(w) - t.width, 1), t.width):
            block = w[start:start + 2 * t.width]
            shared = len(tokens & set(block))
            if shared >= t.need:
                blocks.append((start, len(block), k, t.label, shared / len(tokens)))
    at = [i for i, _ in hits]
    return (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})),
            ",".join(sorted({x for _, x in hits} | {b[3] for b in blocks})), 1.0 if hits else max([b[4] for b in blocks], default=0.0), sorted(blocks))


def licensed():
    t = licenses.TEMPLATES
    filler = " ".join(f"w{i}" for i in range(300))
    texts = [f"{filler} {x.text.upper()}, {filler}" for x in t] + [x.text.replace(" ", ".\n") for x in t]
    texts += [" ".join(x.words[:-2]) + " end" for x in t] + [" ".join(x.words[1:]) for x in t] + [" ".join(reversed(x.words)) for x in t]
    texts += ["cc by CC-BY Cc_bY ccby cc, by 4", "All rights reserved. all RIGHTS\nreserved all rights", "general public licenseé general public license",
              "Kll rights", "liİcense K", "日本 cc by 語", filler * 40 + " licensed under cc by 4 0 " + filler * 40, " ", "\x00"]
    return list(enumerate(texts)) + [(None, texts[0]), (None, texts[0]), (None, texts[1]), (2, texts[3]), (900, None), (901, "")]


def test_license_scan_equals_the_plain_one(spark):
    rows = licensed()
    docs = samples.documents(spark, rows).withColumn("key", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("row", F.lit(2)).withColumn("Labels", F.lit(0)).withColumn("start", F.lit(3))
    out = licenses.scan(docs)
    assert out.columns == [*[c for c in docs.columns if c != "Labels"], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    got = sorted([(r.doc_id, r.text, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted(tuple(b) for b in r.blocks))) for r in out.collect()], key=str)
    assert got == sorted([(k, t, plain_scan(t)) for k, t in rows], key=str)
    assert sum("mit" in g[2][5] for g in got) > 5


def test_license_scan_of_nothing(spark):
    assert licenses.summary(samples.empty(spark)).count() == 0
    assert licenses.scan(samples.documents(spark, [(1, "no template word")])).first().score == 0.0


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_spelling_variants", "op13_license_scan"])
def test_against_sql(spark, name):
    from basisflow.llm.queries import ORACLES, QUERIES
    from tests.harness import duck, rows_of_spark, rows_of_sql

    sf = "/root/testdata/sf0.001"
    assert rows_of_spark(QUERIES[name](spark, sf)) == rows_of_sql(duck(sf), ORACLES[name])


def test_license_scan_stays_in_the_jvm(spark):
    plan = licenses.summary(samples.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
