"""License scans, collocations and importance resampling against brute force and on odd input."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
import re._parser as parsed
from pyspark.sql import functions as F

from tablescope.llm import collocations, hashing, licenses, resampling, word_runs
from tablescope.llm.license_rules import BASE, GATES, LONGEST, Rule, pattern, rules
from tablescope.llm.storage import ship

SCHEMA = "doc_id long, text string, lang string, id string, key string, licenses string, grp string, rank long, score string"


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    ship(spark)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 4001}" for i in range(30_000)) + " released under the mit license"
    texts = [None, "", "  \n\t ", "one", "CC BY", "All Rights Reserved. all rights reserved", long, "ünï çödé 漢字 cc by 😀", "x" * 70_000]
    rows = [(i, t, None if i % 2 else "en", "c", "c", "c", "c", 0, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "cc by", "en", "c", "c", "c", "c", 0, "c"), (4, "other", "en", "c", "c", "c", "c", 0, "c")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


# --- licenses ---------------------------------------------------------------------------------

def example(tree, rnd):
    """A random text that a regex matches."""
    out = []
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op == "IN":
            choices = [chr(v) for o, v in arg if str(o) == "LITERAL"] + [chr(rnd.randint(*v)) for o, v in arg if str(o) == "RANGE"]
            out.append("q" if str(arg[0][0]) == "NEGATE" else rnd.choice(choices))
        elif op == "SUBPATTERN":
            out.append(example(arg[3], rnd))
        elif op == "BRANCH":
            out.append(example(rnd.choice(arg[1]), rnd))
        else:
            out += [example(arg[2], rnd) for _ in range(rnd.randint(arg[0], min(int(arg[1]), arg[0] + 1)))]
    return "".join(out)


def test_every_match_of_a_rule_holds_its_keyword_and_a_gate():
    rnd = random.Random(1)
    for r in rules():
        for _ in range(40):
            text = " " + " ".join(w.split("#")[0] for w in example(parsed.parse(pattern(r.words)), rnd).split()) + " "
            assert r.keyword in text and any(g in text for g in GATES) and len(text.split()) <= LONGEST, (r, text)


def found_by_hand(text, table):
    """All kept detections, by trying every rule at the words of the whole text."""
    words = "".join(f" {w}#{i} " for i, w in enumerate(plain(text)))
    hits = []
    for order, r in enumerate(table):
        for m in re.finditer(pattern(r.words), words):
            places = [int(x) for x in re.findall("#([0-9]+)", m[0])]
            hits.append((places[0], places[-1], order, r))

    def covers(a, b):
        better = a[3].priority < b[3].priority or a[3].priority == b[3].priority and (a[1] - a[0] > b[1] - b[0] or a[2] < b[2])
        return a[0] <= b[0] and a[1] >= b[1] and better
    return [h for h in hits if h[3].base or not any(covers(a, h) for a in hits)], [h for h in hits if h[3].base]


def test_licenses_against_all_rules_on_whole_texts(spark):
    rnd, table = random.Random(2), rules()
    fill = lambda n: " ".join(rnd.choice(["the", "license", "gnu", "cc", "by", "version", "2", "0", "public", "of", "q"]) for _ in range(n))
    texts = []
    for k in range(120):
        parts = []
        for _ in range(rnd.randrange(1, 6)):
            rule = rnd.choice(table)
            said = " ".join(w.split("#")[0] for w in example(parsed.parse(pattern(rule.words)), rnd).split())
            parts += [fill(rnd.choice([0, 1, 5, 505, 512])), said.title() if rnd.random() < 0.5 else said]
        texts.append(rnd.choice([" ", ", ", "\n"]).join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.scan(df).collect():
        told, base = found_by_hand(texts[row.doc_id], table)
        got = row.licenses
        assert sorted((d.start, d.end, d.order) for d in got.detections) == sorted(h[:3] for h in told)
        assert got.n_words == len(plain(texts[row.doc_id])) and got.n_base == len(base)
        assert got.first_word == min((h[0] for h in base), default=None) and got.last_word == max((h[0] for h in base), default=None)
        assert got.labels == ",".join(sorted({h[3].label for h in told})) and got.base_labels == ",".join(sorted({h[3].label for h in base}))
        assert got.score == max((h[3].confidence for h in told), default=0.0)


def test_base_phrases_count_everywhere(spark):
    text = "cc by cc by, CC-BY 4.0; cc  by\nGNU General Public License v3 all rights reserved ccby"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses
    words, count, at = plain(text), 0, []
    for phrase in BASE:
        p = phrase.split()
        at += [i for i in range(len(words)) if words[i:i + len(p)] == p]
    assert row.n_base == len(at) == 6 and (row.first_word, row.last_word) == (min(at), max(at))
    assert row.base_labels == "cc-by,gpl,reserved" and {"gpl-3.0", "cc-by-4.0"} <= set(row.labels.split(","))


def test_a_covered_rule_is_suppressed_and_own_rules(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0")], "doc_id long, text string")
    assert [d.label for d in licenses.scan(df).first().licenses.detections] == ["apache-2.0"]
    own = [Rule("b", "a b c", "long", 2, 0.5), Rule("b", "b", "short", 1, 0.9), Rule("b", "a b", "inner", 2, 0.4)]
    df = spark.createDataFrame([(1, "x a b c")], "doc_id long, text string")
    row = licenses.scan(df, found=own, gates=["b"], out="own").first().own
    assert row.labels == "long,short" and row.score == 0.9     # the better priority is not covered by the longer one


def test_licenses_of_odd_texts(spark, odd, empty):
    got = licenses.scan(odd)
    assert got.columns == odd.columns                          # a column of that name is replaced
    by = {(r.doc_id, r.text and r.text[:5]): r.licenses for r in got.collect()}
    assert (by[0, None].n_words, by[0, None].labels, by[0, None].first_word, by[0, None].score) == (0, "", None, 0)
    assert (by[1, ""].n_words, by[2, "  \n\t "].n_words) == (0, 0)
    assert by[4, "CC BY"].labels == by[None, "cc by"].labels == "cc-by" and by[4, "other"].labels == ""
    assert (by[5, "All R"].n_base, by[5, "All R"].first_word, by[5, "All R"].last_word) == (2, 0, 3)
    assert by[6, "w0 w1"].labels == "mit" and by[6, "w0 w1"].detections[0].start == 30_000
    assert by[7, "ünï ç"].first_word == 3 and got.count() == odd.count() and licenses.scan(empty).count() == 0


def test_no_python_and_no_shuffle_in_license_scans(spark, odd):
    plan = licenses.scan(odd.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# --- collocations -----------------------------------------------------------------------------

def mined_by_hand(docs, threshold, longest, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    frequent = {k: a for k, a in f.items() if a >= threshold and len(k[1]) > 1}
    out = []
    for lang in n:
        rows = []
        for (g, p), a in frequent.items():
            inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if g != lang or any(h == g and len(q) > len(p) and 100 * b >= 100 * a and inside(q) for (h, q), b in frequent.items()):
                continue
            score, k = min((1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrases(rnd, n_docs, words=40):
    texts = []
    for _ in range(n_docs):
        w = [f"{rnd.choice('aé漢')}{int(rnd.paretovariate(0.7)) % words}" for _ in range(rnd.randrange(0, 60))]
        if rnd.random() < 0.4:
            w[rnd.randrange(len(w) + 1):0] = ["New", "york", "City", "hall", "park"][:rnd.randrange(2, 6)]
        texts.append((rnd.choice(["en", "en", "fr", None]), "".join(x + rnd.choice([" ", " ", " ", "\t", ". ", ",", "\n"]) for x in w)))
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_collocations_against_brute_force(spark, monkeypatch, small):
    if small:                                                  # summaries that lose counts, a full bitmap, cut texts
        monkeypatch.setattr(collocations, "GATHERED", 200)
        monkeypatch.setattr(collocations, "FILTER_BITS", 64)
        monkeypatch.setattr(word_runs, "PIECE", 64)
    rnd = random.Random(5 + small)
    docs = phrases(rnd, 300) + [(None, None), ("en", ""), ("fr", " \n.")]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in collocations.mine(df, threshold=12, top=25).collect())
    assert got == mined_by_hand(docs, 12, 5, 25) and len(got) > 30


def test_a_summary_keeps_every_frequent_key():
    rnd = np.random.default_rng(3)
    keys = rnd.permutation(np.concatenate([np.repeat(np.arange(20), 60), rnd.integers(100, 10**9, 9000), np.repeat(np.arange(30, 60), 40)]))
    s = collocations.Summary(len(keys) // 50 + 1)
    for part in np.array_split(keys, 90):
        s.add(*np.unique(part, return_counts=True))
        s.settle()
        assert len(s.keys) <= s.capacity
    assert set(range(20)) <= set(s.may_reach(50).tolist()) and 0 < s.lost < 50
    assert all(c <= 60 for c in s.counts[np.isin(s.keys, np.arange(20))])


def test_scores_beyond_64_bits(spark):
    big = 10**13
    frequent = spark.createDataFrame([("en", "a b c", 3, big - 1), ("en", "a b", 2, big), ("en", "b c", 2, big + 7), ("en", "a", 1, 3 * big),
                                      ("en", "b", 1, 2 * big), ("en", "c", 1, 5 * big)], "grp string, phrase string, size int, a long")
    words = spark.createDataFrame([("en", 900 * big)], "grp string, n long")
    row = collocations.scored(frequent, words).where("size = 3").first()
    scores = [1000 * (big - 1) * 900 * big // (3 * big * (big + 7)), 1000 * (big - 1) * 900 * big // (big * 5 * big)]
    assert row.score == min(scores) and (row.l, row.r) == (big, 5 * big)


def test_collocations_of_odd_texts(spark, odd, empty):
    assert collocations.mine(empty, threshold=2).count() == 0
    got = {(r.grp, r.phrase): r.a for r in collocations.mine(odd, threshold=2).collect()}
    assert got["en", "cc by"] == 3 and ("und", "all rights reserved") in got


# --- resampling -------------------------------------------------------------------------------

def resampled_by_hand(docs, target, buckets=10_000, seed=7, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    feats = lambda t: [*plain(t), *[f"{a} {b}" for a, b in zip(plain(t), plain(t)[1:])]]
    s, t = (Counter(bucket(f) for x in texts for f in feats(x)) for texts in ([x for _, x in docs], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + buckets) / ((s[b] + 1.0) * (nt + buckets))))
    out = []
    for i, x in docs:
        fs = feats(x)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("pivots", [1, 63])
def test_resampling_against_brute_force(spark, monkeypatch, pivots):
    monkeypatch.setattr(resampling.key_at_rank, "__defaults__", (pivots,))
    monkeypatch.setattr(resampling, "RANGE_ROWS", 20)
    rnd = random.Random(pivots)
    word = lambda: rnd.choice(["the", "of", "Zürich", "漢字", "x" * 90, "a1", f"w{rnd.randrange(300)}"])
    docs = [(rnd.choice([None, 5, 5, 6, *range(100, 400)]), rnd.choice([" ", "-", "\n"]).join(word() for _ in range(rnd.randrange(15, 60))))
            for _ in range(200)]
    docs += [docs[0]] * 9 + [(7, None), (8, ""), (9, " . ")]
    target = ["the a1 w3 of", None, "", "w7 w7 w8 the " * 5]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                              spark.createDataFrame([(t,) for t in target], "text string"))
    want = resampled_by_hand(docs, target)
    got = [tuple(r) for r in got.collect()]
    drawn = lambda rows: sorted(r[4] for r in rows if r[4])
    assert drawn(got) == drawn(want.elements()) == list(range(1, len(drawn(got)) + 1))
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in want.elements())
    assert sorted((r[4], r[3], r[0] is None, r[0] or 0) for r in got if r[4]) == sorted((r[4], r[3], r[0] is None, r[0] or 0) for r in want.elements() if r[4])


def test_feature_hashes_over_cut_texts(monkeypatch):
    monkeypatch.setattr(word_runs, "PIECE", 37)
    texts = [b"Hello wOrld foo", None, b"", b"x" * 100 + b" y " + b"z" * 70 + b" ab", "ünï çödé 漢字 ".encode() * 9, b"one two " * 50]
    for orders in (1, 2, 3):
        got = Counter((int(i), size, int(b)) for owner, bucket, size in resampling.features(texts, 997, orders) for i, b in zip(owner, bucket))
        want = Counter()
        for i, t in enumerate(texts):
            w = (t or b"").translate(hashing.ascii_words_table()).split()
            want.update((i, size, zlib.crc32(b" ".join(w[k:k + size])) % 997) for size in range(1, orders + 1) for k in range(len(w) - size + 1))
        assert got == want


@pytest.mark.parametrize("rank", [1, 2, 50, 120, 200, 201])
def test_key_at_rank(spark, rank):
    rnd = random.Random(rank)
    keys = sorted((rnd.randrange(9), rnd.choice("ab'\"\\é")) for _ in range(200))
    df = spark.createDataFrame([(k,) for k in keys], "key struct<a long, b string>")
    want = sorted(keys, key=lambda k: (k[0], k[1].encode()))[rank - 1] if rank <= 200 else None
    assert resampling.key_at_rank(df, "key", rank, pivots=3) == want


def test_resampling_of_odd_texts(spark, odd, empty):
    got = resampling.resample(odd.withColumn("doc_id", F.col("doc_id").cast("string")), odd.limit(2), least_words=1)
    assert got.count() == odd.count() and got.where("rank is not null").count() == 9 * 25 // 100
    assert resampling.resample(empty, odd).count() == 0
    assert resampling.resample(odd, empty, least_words=10**6).where("rank is not null").count() == 0
