"""The training-data operators against brute force, exact round trips and held-out rows, and on odd input."""

import inspect
import random
import re
import string
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import compare, connect
from tablescope.llm.pairs import link_buckets
from tablescope.llm import (bpe_automaton, class_lm, compact_windows, components, decontamination, hashing, html_blocks,
                            jaccard_join, language_id, line_dedup, queries, storage, toxicity, vp_trees)
from tablescope.llm.storage import ship

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, row string, score string"


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    ship(spark)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, one word, a long text, copies, a repeated row, clashing column names."""
    long = " ".join(f"w{i % 4001}" for i in range(30_000))
    texts = [None, "", "  \n\t ", "one", "a b c d e", "A B C D E", long, long + " more", "1 2 3 !!", "x" * 70_000,
             "line one is here\n\nline one is here\nanother line", "ünï çödé 漢字 😀"]
    rows = [(i, t, None if i % 5 == 0 else "en", "s", 0, "c", "c", "c", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[4], (None, "a b c d e", "en", "s", 0, "c", "c", "c", "c")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLE[name]) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.component].add(r.node)
    assert sorted(map(len, groups.values())) == [3, 41]


def test_language_held_out(spark, real):
    held = queries.held_out(4, 2)
    model = language_id.train(real.where(~held))
    got = language_id.identify(real.where(held), model).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_odd(spark, real, odd, empty):
    model = language_id.train(real)
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 8))
    none = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def brute_hits(docs, items, window=10):
    w = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = []
    for i, t in docs:
        d, hit, found = words(t, w), set(), set()
        for k, text in items:
            q = words(text, w)
            n = min(window, len(q))
            for a in range(len(q) - n + 1 if n else 0):
                for b in range(len(d) - n + 1):
                    if d[b:b + n] == q[a:a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(k))
        out.append((i, len(d), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def test_decontamination_blocks(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(None, "a b"), (70, None)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(n))) for i, n in enumerate([1, 3, 5, 12, 14, 0])] + [(9, None), (1, "c c c c")]
    df, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = decontamination.build_index(df, segment_tokens=200)
    for block in (1 << 20, 10):  # one block, and several
        got = [(r.id, r.n_words, sum(b - a + 1 for a, b in zip(r.starts, r.ends)), tuple(sorted(r["items"])))
               for r in decontamination.search(index, q, block_bytes=block).collect()]
        assert sorted(got, key=str) == brute_hits(docs, items)


def test_proximity(spark):
    df = spark.createDataFrame([(1, "x the cat quietly sat y"), (2, "sat a b c d e f cat"), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(5, "sat cat")], "item_id long, text string")
    got = {r.id: (list(r.starts), list(r.ends)) for r in
           decontamination.search(decontamination.build_index(df), q, window=4, spans=True).collect()}
    assert got == {1: ([2], [4]), 2: ([], []), 3: ([], [])}


def test_decontamination_odd(spark, odd, empty):
    q = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    got = decontamination.contamination(odd, q).where(F.size("starts") > 0).collect()
    assert sorted(str(r.id) for r in got) == ["4", "4", "5", "None"]
    assert decontamination.contamination(empty, q).count() == 0
    assert decontamination.contamination(odd, q.limit(0)).where(F.size("starts") > 0).count() == 0


def near_copies(n=40, size=120, seed=5):
    """A base, copies with a few other words, and copies of copies; not all pairs link."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
    out = [base]
    for k in range(n):
        t = list(rng.choice(out[:5]))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(size)] = f"v{rng.randint(0, 9999)}"
        out.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def brute_components(sets, percent):
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_jaccard_near_copies(spark):
    docs = near_copies() + near_copies(10, 30, 9)[:0] + [(900 + i, t) for i, t in near_copies(12, 40, 3)]
    sets = {i: {tuple(words(t)[k:k + 5]) for k in range(max(1, len(words(t)) - 4))} for i, t in docs}
    got = {r.id: r.component_id for r in jaccard_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(sets, 80)


def test_jaccard_brute(spark):
    """Chains, groups of equal prefixes whose members differ, copies, and near copies of a few hundred words."""
    rng = np.random.default_rng(5)
    texts = []
    for k in range(30):
        base = [f"w{k}_{i}" for i in range(int(rng.integers(30, 300)))]
        for _ in range(6):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 6))):
                words[at] = f"x{rng.integers(40)}"
            texts += [" ".join(words)] * int(rng.integers(1, 3))
    texts += [" ".join(["rare one two three four"] + ["often seen"] * n) for n in range(1, 40)]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = jaccard_join.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 62, int(rng.integers(2, 900))).astype(np.uint64))
        a, b = (np.sort(rng.choice(pool, int(rng.integers(1, len(pool) + 1)), replace=False)) for _ in range(2))
        assert jaccard_join._apart(jaccard_join._parities(a), jaccard_join._parities(b)) <= len(np.setxor1d(a, b))
    assert jaccard_join._apart(jaccard_join._parities(pool), jaccard_join._parities(pool)) == 0


def test_jaccard_odd(spark, odd, empty):
    rows = jaccard_join.similar_components(odd).collect()
    got = {r.id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == 14 and got[0] == (0, 0) and got[2] == (0, 2) and got[3] == (1, 3)
    assert got[4] == got[5] == got[None] == (1, 4) and got[7][1] == 6
    assert jaccard_join.similar_components(empty).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return bpe_automaton.WordTokenizer(queries.tokenizer_path())


def test_bpe_same_as_library(tokenizer, real, odd):
    from tokenizers import Tokenizer
    theirs = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(1)
    letters = "aaabbcdeinrstyzéñ'1 2.!ΣİßǺ漢😀\n\x85"
    texts = [r.text for r in real.collect()] + [r.text for r in odd.collect()] + ["<|endoftext|>x", "aaaaaaaaa"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in texts:
        want = theirs.encode(t or "", add_special_tokens=False).ids
        assert tokenizer.encode(t) == want
        assert tokenizer.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_frames(spark, tokenizer, odd, empty):
    both = {r.id: r for r in bpe_automaton.round_trip(odd, tokenizer).collect()}
    assert both[0].tokens == [] and both[0].decoded == "" and len(both[6].tokens) > 30_000
    again = bpe_automaton.decode_tokens(bpe_automaton.encode_texts(odd, tokenizer), tokenizer)
    assert {r.id: r.text for r in again.collect()} == {i: r.decoded for i, r in both.items()}
    assert bpe_automaton.digests(odd, tokenizer).count() == 14 and bpe_automaton.digests(empty, tokenizer).count() == 0


def test_html(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    model = html_blocks.train(pages)
    clean = lambda x: [" ".join(b.text.split()) for b in html_blocks.blocks_of(x)]
    for r in html_blocks.extract(pages.select("page_id", "html", F.col("html").alias("raw")), model).collect():
        inner = re.search(r"<article>(.*?)</article>", r.raw, re.S).group(1)
        assert r.text == "\n\n".join(clean(inner))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<nav>a</nav><article><p>b &amp;  c<p>d</article>", "x"),
                                 (4, "<p", "x")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_blocks.extract(odd, model).collect()}
    assert got[1] == got[2] == "" and got[3] == "b & c\n\nd"
    assert html_blocks.extract(odd.limit(0), html_blocks.train(odd.limit(0))).count() == 0


@pytest.mark.parametrize("page, want", [
    ('<p title="x>two</p>', ["two"]), ("<p>one</p><p title='x", ["one"]), ('<p class="a>b">three</p>', ["three"]),
    ('<p a="1" b=\'2>"\'>four</p>', ["four"]), ("<p>1 < 2 <3</p>", ["1 < 2 <3"]), ("<p>a<", ["a<"]), ("<b", []),
    ("<head><title>t</title><p>five</p>", ["five"]), ("<!-- <p>no --><p>six", ["six"])])
def test_tags_that_are_not_closed(page, want):
    assert [b.text for b in html_blocks.blocks_of(page)] == want


def test_broken_markup_takes_linear_time():
    def seconds(page):
        start = time.process_time()
        list(html_blocks.blocks_of(page))
        return time.process_time() - start

    assert seconds("<b " * 200_000 + '"') < 5
    assert seconds("<b x='" * 200_000) < 5
    assert seconds("<i '>a" * 50_001 + "<head>" * 50_000) < 20


def test_labeller_gradient():
    rng = np.random.default_rng(0)
    net = html_blocks.Labeller(5, 3)
    x, mask = rng.normal(size=(2, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)
    y, weight = rng.integers(0, 2, (2, 4)).astype(float), mask
    loss = lambda: -(weight * np.log(1 / (1 + np.exp(-(2 * y - 1) * net.odds(x, mask))))).sum() / weight.sum()
    for name, g in net.gradient(x, mask, y, weight).items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        net.p[name][at] += 1e-6
        up = loss()
        net.p[name][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[at]) < 1e-5
        net.p[name][at] += 1e-6


def test_vp_odd(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(200)] + [(300, None), (301, []), (302, [0.0] * 3),
            (303, [1.0, None, 2.0]), (304, [1.0, float("nan"), 2.0]), (None, [1.0, 1.0, 1.0]), (5, [5.0, 1.0, 2.0]), (400, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vp_trees.nearest(df, "id % 20 = 0", k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 200, 20):
        v = np.array(rows[q][1])
        want = sorted(((i, float(v @ np.array(x))) for i, x in rows[:200] if i != q), key=lambda p: (-p[1], p[0]))[:7]
        assert got[q] == want
    assert 400 not in got and vp_trees.nearest(df.limit(0), "id % 20 = 0").count() == 0


def test_vp_repeated_ids(spark):
    """Every vector under an id counts; equal rows count once; an id is no neighbour of itself."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.integers(-4, 5, 3).astype(float).tolist()) for i in range(60)]
    rows += [(i, rng.integers(-4, 5, 3).astype(float).tolist()) for i in (0, 7, 7, 9, 20, 33)] + rows[5:9]
    rows = [r for r in rows if any(r[1])]
    got = defaultdict(list)
    for r in sorted(vp_trees.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0").collect(),
                    key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    each = sorted({(i, tuple(v)) for i, v in rows})
    for q in (0, 20, 40):
        pairs = [(i, float(np.dot(x, v))) for n, x in each if n == q for i, v in each if i != q]
        assert got[q] == sorted(pairs, key=lambda p: (-p[1], p[0]))[:20]


def test_vp_relaxed_recall(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    pairs = lambda f: {(r.query_id, r.vec_id) for r in vp_trees.nearest(e, "id % 20 = 0", factor=f).collect()}
    exact = pairs(1.0)
    assert len(exact & pairs(0.9)) >= 0.9 * len(exact)


def test_class_lm(spark, real):
    held = queries.held_out(7, 2)
    model, counts = class_lm.train(real.where(~held))
    got = {r.id: r for r in class_lm.score(real, model, counts).collect()}
    docs = real.select("doc_id", "text", held.alias("held")).collect()
    c = Counter(w for r in docs if not r.held for w in [*words(r.text), None])
    total, distinct = sum(c.values()), len(c)
    for r in docs:
        w = [*words(r.text), None]
        base = sum(np.log10((c[x] + 1) / (total + distinct + 1)) for x in w)
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(c[x] > 0 for x in w), total)
        assert abs(g.base_score - base) < 1e-6 * abs(base)
    unseen = [got[r.doc_id] for r in docs if r.held]
    assert np.mean([g.score > g.base_score for g in unseen]) > 0.9


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(3)
    counts = rng.poisson(1, (13, 13)).astype(float)
    counts[:6, 6:12] += 9

    def value(of):
        t = np.zeros((of.max() + 1,) * 2)
        np.add.at(t, (of[:, None], of[None, :]), counts)
        log = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return log(t) - log(t.sum(0)) - log(t.sum(1))
    assert value(class_lm.exchange(counts, 3, 8)) > value(class_lm.exchange(counts, 3, 0))


@pytest.mark.parametrize("hot", [4, 0])
def test_class_lm_does_not_depend_on_how_many_words_are_sent(spark, monkeypatch, hot):
    texts = [" ".join(f"{w}{i % k}" for i in range(60)) for k in (3, 7, 11) for w in ("Ab", "cd", "xyz")] + ["once cd1", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    scores = lambda: {r.id: r for r in class_lm.score(docs, *class_lm.train(docs, words=20)).collect()}
    want = scores()
    monkeypatch.setattr(class_lm, "HOT_WORDS", hot)
    got = scores()
    for i, r in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (r.n_tokens, r.n_known, r.train_tokens)
        assert got[i].base_score == pytest.approx(r.base_score, rel=1e-9) and got[i].score == pytest.approx(r.score, rel=1e-9)


def test_class_lm_odd(spark, odd, empty):
    for teach in (odd, empty):
        model, counts = class_lm.train(teach)
        rows = class_lm.score(odd, model, counts).collect()
        assert len(rows) == 14 and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
        assert {r.n_tokens for r in rows if r.id in (0, 1, 2)} == {1}


def test_segments_brute():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([-3, -2, -1, 1, 2, 4]) for _ in range(rng.randint(0, 14))]
        got = toxicity.maximal_segments(s)
        best = max([sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)], default=0)
        assert all(sum(s[a:b]) == v > 0 for a, b, v in got)
        assert max([v for *_, v in got], default=0) == max(best, 0)
        spans = sorted((a, b) for a, b, _ in got)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert {i for i, x in enumerate(s) if x > 0} <= {i for a, b in spans for i in range(a, b)}


def test_segments_linear():
    """Falling peaks keep every segment open; each new one must not walk back over all of them."""
    scores = [x for i in range(200_000) for x in (1.0, -1.5 - i % 3)]
    start = time.process_time()
    assert len(toxicity.maximal_segments(scores)) == 200_000
    assert time.process_time() - start < 5


def test_windows_of_repeated_words():
    start = time.process_time()
    for period in (1, 7):
        h = hashing.mix(np.arange(200_000, dtype=np.uint64) % np.uint64(period))
        assert len(compact_windows.compact_windows(h, 50)) > 190_000 // period
    assert time.process_time() - start < 20
    rng = np.random.default_rng(8)
    for _ in range(50):
        h = rng.integers(0, 6, 40).astype(np.uint64)
        want = set()
        for c in range(40):     # as far as no earlier one is as low and no later one lower
            l, r = c, c
            while l > 0 and h[l - 1] > h[c]:
                l -= 1
            while r < 39 and h[r + 1] >= h[c]:
                r += 1
            if r - l + 1 >= 5:
                want.add((l, c, r))
        assert set(compact_windows.compact_windows(h, 5)) == want


def test_toxicity(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.detect(docs, model).join(labels, F.col("id") == F.col("doc_id")).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic > 0) for r in got]) > 0.85
    assert toxicity.detect(odd, model).count() == 14 and toxicity.detect(empty, model).count() == 0
    nothing = toxicity.train(empty, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.detect(odd, nothing).collect())


def test_line_dedup_brute(spark, real):
    first = defaultdict(list)
    for r in real.collect():
        for i, line in line_dedup.lines_of(r.text):
            first[line].append((r.doc_id, i))
    names = {k: line for k, line in enumerate(first)}
    part = brute_components({k: line_dedup.gram_set(line) for k, line in names.items()}, 80)
    head = defaultdict(lambda: (1 << 60, 0))
    for k, line in names.items():
        head[part[k]] = min(head[part[k]], *first[line])
    want = Counter(p[0] for k, line in names.items() for p in first[line] if p == head[part[k]])
    got = {r.doc_id: r.n_kept for r in line_dedup.dedup_lines(real).collect()}
    assert got == {r.doc_id: want[r.doc_id] for r in real.collect()}


def test_line_dedup_odd(spark, odd, empty):
    rows = line_dedup.dedup_lines(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 14 and got[0].text is None and got[1].text == "" and got[2].text == "  \n\t "
    assert got[10].text == "line one is here\n\nanother line" and got[None].n_kept == 1 and got[4].n_kept == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_passages(spark, odd, empty):
    rng = random.Random(8)
    make = lambda n: [f"t{rng.randint(0, 10 ** 6)}" for _ in range(n)]
    shared, near = make(60), make(120)
    changed = near[:50] + ["other"] + near[51:]
    docs = [(1, make(200) + shared + make(30)), (2, shared + make(90)), (3, make(400)), (4, make(9) + near), (5, changed + make(70)),
            (6, make(40)), (7, make(33) + shared)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {(r.id, r.rep_id): r for r in compact_windows.repeated_passages(df).collect()}
    assert set(got) == {(2, 1), (7, 1), (5, 4)}
    assert (got[2, 1].start_word, got[2, 1].end_word, got[2, 1].rep_start_word) == (0, 60, 200)
    assert got[5, 4].end_word - got[5, 4].start_word == 120 and got[5, 4].similarity >= 0.8
    assert {(r.id, r.rep_id) for r in compact_windows.repeated_passages(odd).collect()} == {(7, 6)}
    assert compact_windows.repeated_passages(empty).count() == 0


def keys_of(text):
    given = inspect.signature(compact_windows.repeated_passages).parameters
    h, _ = hashing.word_hashes([text.encode()], compact_windows.WORDS)
    return set(compact_windows.passage_keys(hashing.shingles(h, 5), 46, given["hashes"].default, given["agree"].default)[0].tolist())


def with_edits(words, *places):
    return [f"{w}new" if i in places else w for i, w in enumerate(words)]


def test_passages_that_differ_from_the_first_text(spark):
    """All keys are shared with a text that is not alike; two later ones are, equal or in a chain."""
    rng, rows, want = random.Random(3), [], set()
    while len(want) < 60:
        base = [f"v{rng.randrange(10**6)}" for _ in range(50)]
        near, far = with_edits(base, 20), with_edits(base, 20, 33)
        at = len(rows)
        if len({frozenset(keys_of(" ".join(w))) for w in (base, near, far)}) > 1:
            continue
        if len(rows) % 2:
            rows += [(at, far), (at + 1, base), (at + 2, base)]  # the last one equals the second only
            want.add((at + 2, at + 1))
        else:
            rows += [(at, base), (at + 1, near), (at + 2, far)]  # the last one is near the second only
            want |= {(at + 1, at), (at + 2, at + 1)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {(r.id, r.rep_id) for r in compact_windows.repeated_passages(df).collect()} == want


def test_every_copy_of_a_passage(spark):
    fresh = [f"u{i}" for i in range(2000)]
    copied = [f"p{i}" for i in range(60)]
    rows = [(1, fresh[:100] + copied), (2, fresh[200:250] + copied + fresh[300:700] + copied + fresh[800:900] + copied)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = compact_windows.repeated_passages(df).collect()
    assert {(r.id, r.start_word, r.end_word, r.rep_id, r.rep_start_word) for r in got} == {
        (2, a, a + 60, 1, 100) for a in (50, 510, 670)}


def test_near_passages_share_a_key():
    rng, shared, tried = random.Random(9), 0, 1500
    for _ in range(tried):
        base = [f"v{rng.randrange(10**6)}" for _ in range(50)]
        shared += bool(keys_of(" ".join(base)) & keys_of(" ".join(with_edits(base, rng.randrange(5, 45)))))
    assert shared >= 0.985 * tried  # similarity 41/51


def test_compact_windows_hold_every_subsequence():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 30, 40).astype(np.uint64)
    found = compact_windows.compact_windows(h, 6)
    for a in range(40):
        for b in range(a + 5, 40):
            holding = [c for l, c, r in found if l <= a <= c <= b <= r]
            assert len(holding) == 1 and h[holding[0]] == h[a:b + 1].min()


def test_pipeline(spark, odd, real):
    docs = real
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        if name != "bpe":
            assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert 0 < docs.count() <= real.count()
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, FOLDER).count() <= 14
        assert stage(spark, odd.limit(0), FOLDER).count() == 0


def test_stages_decide_for_rows(spark):
    """Null and repeated ids over different texts, against plain Python."""
    rng = random.Random(11)
    some_id = lambda: rng.choice([None, None, 1, 2, 3, rng.randrange(4, 400)])
    word = lambda: f"w{rng.randrange(10**9)}"
    schema = "doc_id long, text string, tag long"

    pool = [" ".join(word() for _ in range(6)) for _ in range(150)]
    docs = {t: (some_id(), [rng.choice(pool) for _ in range(2)] + [" ".join(word() for _ in range(6))]) for t in range(200)}
    df = spark.createDataFrame([(i, "\n".join(x), t) for t, (i, x) in docs.items()], schema)
    left = {r.tag: r.text.split("\n") for r in corpus_pipeline.drop_repeated_lines(spark, df, FOLDER).collect()}
    assert Counter(x for lines in left.values() for x in lines) == Counter({x for _, lines in docs.values() for x in lines})
    least = {}
    for i, lines in docs.values():
        for x in lines:
            least[x] = min(least.get(x, 1000), -1 if i is None else i)
    assert all(x in docs[t][1] and least[x] == (-1 if docs[t][0] is None else docs[t][0]) for t, y in left.items() for x in y)
    numbers = {r.tag: r.n_kept for r in line_dedup.dedup_lines(df).collect()}
    assert numbers == {t: len(left.get(t, [])) for t in docs}

    item = max((r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()), key=len)
    bad = {t for t in range(200) if rng.random() < 0.2}
    df = spark.createDataFrame([(some_id(), " ".join(word() for _ in range(20)) + (" " + item if t in bad else ""), t)
                                for t in range(200)], schema)
    assert {r.tag for r in corpus_pipeline.drop_contaminated(spark, df, FOLDER).collect()} == set(range(200)) - bad

    rows, groups = [], []
    for _ in range(60):
        base, ids = [word() for _ in range(120)], [some_id() for _ in range(rng.randrange(1, 5))]
        groups.append({len(rows) + k: i for k, i in enumerate(ids)})
        rows += [(i, " ".join(with_edits(base, 10 * k)), len(rows) + k) for k, i in enumerate(ids)]
    blank = {len(rows) + k for k in range(6)}
    rows += [(None, " " if t % 2 else None, t) for t in blank]
    got = {r.tag for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), FOLDER).collect()}
    assert blank <= got
    for g in groups:
        stay = [i for t, i in g.items() if t in got]
        assert stay == [min((i for i in g.values() if i is not None), default=None)]


def test_postings_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def rows(parts):
        for batch in parts:
            seen.add(batch.num_rows)
            yield batch

    made = spark.range(90).selectExpr("id % 50 as bucket", "id as node", "1L as n").mapInArrow(rows, "bucket long, node long, n long")
    got = link_buckets(made, lambda pairs: pairs, "true", "once").collect()
    assert sorted(r.node for r in got) == [*range(40), *range(50, 90)] and seen.value == 90


def test_line_signatures_are_a_byte_a_slot(spark):
    texts = spark.createDataFrame([(1, "a line of words\nb"), (2, "a line of words"), (3, None)], "id long, text string")
    signed = line_dedup._signed(texts, 12, 5)
    assert signed.columns == ["node", "n", "marks"] and [len(r.marks) for r in signed.collect()] == [60, 60]
    buckets = signed.select(line_dedup.band_buckets(12, 5).alias("b")).collect()
    assert all(len(set(r.b)) == 12 for r in buckets)


def test_tables_go_once_nothing_reads_them(spark):
    folder = Path(storage.shared_folder(spark)) / spark.sparkContext.applicationId
    lines = [f"line {i} of words that stand in this text {i * i}" for i in range(20)]
    rows = [(i, "\n".join(lines[i % 7:i % 7 + 5]) + f"\nown words {i} of the text {i * 17}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for stage, kept in ((corpus_pipeline.drop_repeated_lines, {"keyed-rows", "places"}),
                        (corpus_pipeline.drop_near_copies, {"keyed-rows", "first-rows"}),
                        (corpus_pipeline.drop_contaminated, {"keyed-rows", "contaminated"})):
        before = {p.name for p in folder.iterdir()} if folder.exists() else set()
        done = stage(spark, df, FOLDER)
        assert done.count() <= 40
        assert {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before} == kept


def test_members_of_a_bucket_are_paired_only_where_details_allow(spark):
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return storage.written(pairs.where("src % 30 = dst % 30"), "made-links")

    made = spark.range(60).selectExpr("1L as bucket", "id as node")
    got = link_buckets(made, verify, "true", "few", details=spark.range(60).selectExpr("id as node", "id % 30 as m"), likely="a.m = b.m")
    parts = defaultdict(set)
    for r in got.collect():
        parts[r.component].add(r.node)
    assert sorted(map(sorted, parts.values())) == [[i, i + 30] for i in range(30)] and seen == [59, 29]


def test_agreeing_marks_in_sql(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (200, 60)).astype(np.uint8)
    y = np.where(rng.random((200, 60)) < rng.random((200, 1)), x, rng.integers(0, 256, (200, 60))).astype(np.uint8)
    marks = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate([*x, *y])], "node long, marks binary") \
        .select("node", *line_dedup._mark_numbers(60))
    joined = marks.alias("a").join(marks.alias("b"), F.expr("a.node + 200 = b.node"))
    got = {r.node: r.n for r in joined.select("a.node", F.expr(line_dedup._agreeing(60)).alias("n")).collect()}
    assert got == dict(enumerate((x == y).sum(axis=1).tolist()))


def test_only_shared_windows_are_joined(spark):
    rng = random.Random(12)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared = make(90)
    rows = [(i, " ".join(make(rng.randrange(300)) + (with_edits(shared, 7 * i) if i < 8 else []) + make(40))) for i in range(40)]
    rows += [(3, rows[5][1]), (50, ""), (51, "a b c")]
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("row", F.monotonically_increasing_id())
    windows = compact_windows._windows(texts, 5, 46, 5)
    kept = compact_windows._shared_windows(windows)
    want = defaultdict(list)
    for i, text in rows:
        h, _ = hashing.word_hashes([text.encode()], compact_windows.WORDS)
        s = hashing.shingles(h, 5) if len(h) >= 5 else h[:0]
        for k, *places in zip(*(x.tolist() for x in compact_windows.passage_keys(s, 46, 5, 2))):
            want[k].append((i, *places))
    want = sorted((k, *m) for k, members in want.items() if len({m[0] for m in members}) > 1 for m in members)
    got = compact_windows._shared(compact_windows._keys(kept, 5, 2)).collect()
    assert sorted((r.key % 2**64, r.id, r.begin, r["first"], r["last"]) for r in got) == want and want
    assert kept.count() < windows.count() / 3


def test_windows_of_long_rows_in_time():
    s = hashing.mix(np.arange(1_000_000, dtype=np.uint64))
    start = time.process_time()
    tree = compact_windows.tree_windows(s, 46, 5, np.arange(0, 1_000_001, 500))
    assert len(tree[0]) > 5 * 1_000_000 // 46 and time.process_time() - start < 5


def test_class_lm_gives_every_word_a_class(spark):
    """Words of two kinds of places, all but a few too rare for symbols of their own; their endings tell the kind of 7 in 10."""
    rng = random.Random(5)
    left, right = [f"l{i}q{'aaaaaaabbb'[i % 10]}" for i in range(300)], [f"r{i}q{'bbbbbbbaaa'[i % 10]}" for i in range(300)]
    text = lambda: " ".join(w for _ in range(60) for w in rng.choice([("the", rng.choice(left), "sat"), ("of", rng.choice(right), "ran")]))
    docs = spark.createDataFrame([(i, text()) for i in range(150)], "doc_id long, text string")
    model, table = class_lm.train(docs, words=34, classes=8)
    rows = {r.word % 2**64: r for r in table.collect()}
    c = Counter(w for r in docs.collect() for w in r.text.split())
    hashes, _ = hashing.word_hashes([" ".join(c).encode()], class_lm.WORDS)
    assert {h: rows[h].n for h in hashes.tolist()} == {h: c[w] for h, w in zip(hashes.tolist(), c)} and len(rows) == len(c)
    of = {w: rows[h]["class"] for h, w in zip(hashes.tolist(), c)}
    common = {side: Counter(of[w] for w in of if w[0] == side and w[-2] == "q").most_common(1)[0] for side in "lr"}
    assert common["l"][0] != common["r"][0] and min(n for _, n in common.values()) > 270
    got = class_lm.score(docs, model, table).collect()
    assert all(r.score > r.base_score + 25 for r in got)   # the kind of 60 words is known from the word before


def test_class_lm_is_a_distribution(spark):
    texts = ["a b a c", "b a", "c c b a a", "d", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, table = class_lm.train(docs, words=2, classes=2)
    tries = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "b", "c", "d", "", "zz"])], "doc_id long, text string")
    classes = {r.id: r for r in class_lm.score(tries, model, table).collect()}
    of = Counter({c: n for c, n in table.groupBy("class").count().collect()})
    room = {c: sum(r.n + 1 for r in table.where(F.col("class") == c).collect()) + 1 for c in of}
    assert all(10 ** model.room[c] == pytest.approx(room[c]) for c in room)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1) and all(np.isfinite(r.score) for r in classes.values())


def test_exchange_ends_when_nothing_moves():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.3, (150, 150)).astype(float)
    of = class_lm.exchange(counts, 8)
    assert (class_lm.exchange(counts, 8, 1) != of).any() and (class_lm.exchange(counts, 8, 1000) == of).all()


def test_best_classes_by_brute_force():
    rng = np.random.default_rng(2)
    size, k = 40, 5
    line = np.append(size - 1, (rng.random(20_000) ** 3 * (size - 1)).astype(int))
    line = line[np.append(True, line[1:] != line[:-1])]
    counts = np.zeros((size, size))
    np.add.at(counts, (line, np.roll(line, -1)), 1)     # a ring: as many before a word as after it
    of = np.append(np.arange(size - 1) % (k - 1), k - 1)
    member = np.eye(k)[of]
    between = member.T @ counts @ member
    code = np.tile(np.arange(2 * k), size - 1)
    n = np.concatenate([np.concatenate([counts[w] @ member, counts[:, w] @ member]) for w in range(size - 1)]).astype(np.int64)
    new = class_lm.best_classes(np.arange(0, len(n), 2 * k), code.astype(np.int64), n, of[:-1], between)
    for w in range(size - 1):
        out, into = counts[w] @ member, counts[:, w] @ member
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()

        def near(g):    # rows and columns one by one, as the neighbours keep their classes
            (row, r), (col, c) = ((x, x.sum()) for x in (between[g], between[:, g]))
            if g == of[w]:
                return f(row) - f(row - out) + f(col) - f(col - into) - (f(r) - f(r - out.sum())) - (f(c) - f(c - into.sum()))
            return f(row + out) - f(row) + f(col + into) - f(col) - (f(r + out.sum()) - f(r)) - (f(c + into.sum()) - f(c))
        gains = [near(g) for g in range(k - 1)]
        assert new[w] == of[w] or gains[new[w]] == pytest.approx(max(gains))


def test_written_leaves_no_shuffle_files(spark):
    files = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
                     .getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before = files()
    table = storage.written(spark.range(50_000).repartition(5, "id").groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before and table.count() == 1000


def test_candidates_in_passes(spark):
    """So many candidates that they are verified in passes; texts of one id are one document."""
    copied = " ".join(f"p{i}" for i in range(450))
    rows = [(i, f"x{i} " * (i % 7) + copied) for i in range(500)] + [(4, "some more words"), (7, copied)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = compact_windows.repeated_passages(df).collect()
    whole = {(r.id, r.rep_id, r.start_word) for r in got if r.end_word - r.start_word == 450 and r.rep_id == 0}
    assert whole == {(i, 0, i % 7) for i in range(1, 500)} | {(7, 0, 0)}
