"""Mixing, archives, vectors, n-gram join, passages, decontamination, pipeline: against brute force and round trips."""

import hashlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import components, decontaminate, mixing, ngram_join, passages, secrets, toxicity, vectors, warc
from tests.llm.samples import FOLDER, SCHEMA, prose


def wanted_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(docs):
    rows = mixing.mix(docs).collect()
    source = {}
    for r in docs.select("doc_id", "text", "source").collect():
        source.setdefault((r.doc_id, len((r.text or "").encode().split())), []).append(r.source)
    sizes = Counter()
    for (_, n), own in source.items():
        for s in own:
            sizes[s] += n
    goal, taken = wanted_targets(sizes), Counter()
    assert len(rows) == sum(len(v) for v in source.values())
    for r in rows:
        own = source[r.doc_id, r["size"]]
        assert any(sizes[s] == r.source_size and abs(goal[s] - r.target) < 1e-6 * max(1, goal[s]) for s in own)
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        if len(set(own)) == 1:
            taken[own[0]] += r.taken
    return sizes, goal, taken, rows


def test_mix_meets_targets(sample):
    sizes, goal, taken, rows = check_mix(sample)
    for s in goal:
        assert abs(taken[s] - goal[s]) <= max(0.03 * goal[s], 60)
    again = {(r.doc_id, r.taken) for r in mixing.mix(sample.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mix_of_odd_tables(odd_docs, empty_docs):
    check_mix(odd_docs[0])
    assert mixing.mix(empty_docs).count() == 0


def test_tilt_solves_the_dual(spark):
    docs = spark.createDataFrame([(i, prose(i, 5 + i % 90), "en", "ab"[i % 7 == 0], 0) for i in range(400)], SCHEMA)
    by_source = {}
    for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        by_source.setdefault(r.source, []).append(r)
    for rows in by_source.values():
        total = sum(r["size"] * r.rate for r in rows)
        assert abs(total - rows[0].target) < 1e-4 * rows[0].target
        # log rate is proportional to size where the cap does not hold.
        free = {round(np.log(r.rate) / r["size"], 6) for r in rows if 0 < r.rate < 2 - 1e-9}
        assert len(free) <= 1 or max(free) - min(free) < 1e-5


def test_archives_round_trip(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html").collect()
    rows = [tuple(r) for r in pages] + [(900, None, None), (901, "u\r\nx", "é" * 600), (902, "u", "é" * 600), (903, "u", "a" * 999), (904, "v", "a" * 999), (902, "w", "é" * 600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("holder", F.lit(1)).withColumn("digest", F.lit(2))
    body = {}
    for page_id, _, html in rows:
        body.setdefault(page_id, []).append((html or "").encode())
    largest = {}
    for page_id, all_ in body.items():
        for b in all_:
            if len(b) >= 1000:
                largest[b] = max(page_id, largest.get(b, page_id))
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    for r in got:
        own = body[r.page_id][0]
        refers = largest.get(own) if largest.get(own, r.page_id) != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(own), hashlib.sha1(own).hexdigest(), refers)
        assert r.record_type == ("revisit" if refers else "response") and (r.payload is None if refers else bytes(r.payload) == own)
    assert {r.url for r in got if r.page_id in (900, 901)} == {None, "u%0D%0Ax"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_reads_are_joined_in_order():
    assert list(warc.coalesced([(0, 10), (10, 5), (200, 10), (215, 5)], gap=10, most=100)) == [(0, 2, 0, 15), (2, 4, 200, 220)]
    assert list(warc.coalesced([(0, 80), (80, 80)], gap=10, most=100)) == [(0, 1, 0, 80), (1, 2, 80, 160)]
    assert list(warc.coalesced([])) == []
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", None, "d").replace(b"abc", b"abd"))


def root_of(links, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [tuple(map(int, e)) for e in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(500, i) for i in range(600, 640)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = root_of(links, {n for e in links for n in e if e[0] != e[1]})
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(150, 24))
    x = np.concatenate([base, base[:60] + rng.normal(scale=0.3, size=(60, 24)), base[:5], 1e30 * base[5:8], np.repeat(base[:1], 40, 0) + rng.normal(scale=0.1, size=(40, 24))]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [None] + [1.0] * 23), (904, [float("nan")] * 24), (905, [float("inf")] + [1.0] * 23), (906, [1.0, 2.0]), (907, [1.0, 2.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("k", F.lit(1)).withColumn("v", F.lit("x"))
    good = {i: np.array(v, float) for i, v in rows if v and i not in (902, 903, 904, 905)}
    ids = sorted(good)
    near = {(a, b) for a in ids for b in ids if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= 0.9}
    got = {r.vec_id: r for r in vectors.join(df).collect()}
    assert len(got) == len(rows)
    assert all(r.n_links <= sum(a == i for a, _ in near) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * len(near) and len(near) > 1500
    roots = root_of(near, [i for i, _ in rows])
    assert np.mean([got[i].component_id == roots[i] for i in roots]) > 0.95 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 906)) and got[906].n_links == 1
    assert vectors.join(df.limit(0)).count() == 0
    twice = df.filter("vec_id in (0, 1, 906)").unionByName(df.filter("vec_id = 906")).unionByName(df.filter("vec_id = 906").withColumn("vec_id", F.lit(None).cast("long")))
    assert sorted(r.n_links for r in vectors.join(twice).collect())[-3:] == [2, 2, 2]


def test_design_gives_the_recall_it_names():
    plan = vectors.design(50_000)
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(400, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    rows = pa.record_batch([pa.array(range(800)), pa.array([list(v) for v in np.concatenate([a, b])])], ["k", "v"])
    out = next(vectors._sketch(plan)(iter([rows]))).to_pydict()
    met = sum(any(p == q and abs(u - v) <= plan.window for p, q, u, v in zip(out["cells"][i], out["cells"][i + 400], out["along"][i], out["along"][i + 400])) for i in range(400))
    assert met / 400 >= 0.95


def brute_join(rows, similar=Fraction(3, 4)):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) * similar.denominator >= similar.numerator * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, root_of(links, sets)


def variants():
    """A family of near copies around one text, chains of drifting copies, texts that share long lines, short texts."""
    rows, base = [], prose(11, 120).split()
    for i in range(60):
        words = list(base)
        for j in range(i % 9):
            words[(i * 37 + j * 29) % len(words)] = f"edit{i}x{j}"
        rows.append(" ".join(words))
    drift = prose(12, 90).split()
    for i in range(12):
        drift = drift[4:] + prose(100 + i, 4).split()
        rows.append(" ".join(drift))
    rows += [prose(13, 40) + " " + prose(200 + i, 30) for i in range(40)]
    rows += [prose(14, 5), prose(14, 5).upper(), prose(14, 4), prose(14, 4) + " ", "", " \n", None, "a", "A"]
    return list(enumerate(rows))


@pytest.mark.parametrize("leaders", [8, 1])
def test_join_equals_brute_force(spark, monkeypatch, leaders):
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("own")).withColumn("h", F.lit(1))
    sizes, roots = brute_join(rows)
    got = ngram_join.join(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], roots[i]) for i in sizes} and len(got) == len(rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))


def test_join_of_odd_tables(spark, sample, odd_docs, empty_docs):
    odd, rows = odd_docs
    got = ngram_join.join(odd).collect()
    assert len(got) == len(rows)
    own = Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)
    assert own[5, 26, 5] == 2 and own[6, 26, 5] == 1 and own[0, 0, 0] == 1 and own[2, 0, 2] == 1
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 6").count() == 0 and kept.filter("doc_id = 5").count() == 2
    assert ngram_join.join(empty_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    sizes, roots = brute_join(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(sample).collect()} == {i: (sizes[i], roots[i]) for i in sizes}


def test_leaders_settle_a_large_family(spark, monkeypatch):
    """Rounds of leaders and the comparison of all pairs give the same components."""
    rows = variants()[:72]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "link_classes", lambda *a, link=ngram_join.link_classes: link(*a, leaders=1))
    assert {r.doc_id: r.component_id for r in ngram_join.join(df).collect()} == brute_join(rows)[1]


def best_chains(p, s):
    score = []
    for j in range(len(p)):
        score.append(passages.SEED_WORDS + max([0.0] + [score[i] - passages.GAP_COST * (p[j] - p[i] + s[j] - s[i]) for i in range(j) if p[i] < p[j] and s[i] < s[j]]))
    return max(score)


def test_chains_equal_the_quadratic_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(100):
        n = rng.integers(1, 25)
        p, s = rng.integers(0, 60, n), rng.integers(0, 60, n)
        order = np.lexsort((s, p))
        p, s = p[order], s[order]
        top = passages.chains(p, s)[0]
        value = passages.SEED_WORDS * len(top) - passages.GAP_COST * sum(p[b] - p[a] + s[b] - s[a] for a, b in zip(top, top[1:]))
        assert abs(value - best_chains(p, s)) < 1e-9
        assert sorted(j for c in passages.chains(p, s) for j in c) == list(range(n))


def test_edit_distances():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 9)), rng.integers(0, 4, rng.integers(0, 9))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        free = np.zeros((len(a) + 1, len(b) + 1), int)
        table[:, 0], table[0], free[:, 0] = range(len(a) + 1), range(len(b) + 1), range(len(a) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                for t in (table, free):
                    t[i + 1, j + 1] = min(t[i, j + 1] + 1, t[i + 1, j] + 1, t[i, j] + (a[i] != b[j]))
        assert passages.edit_distance(a, b) == table[-1, -1]
        if len(a):
            assert list(decontaminate.myers(a.tolist(), b.tolist())) == free[-1, 1:].tolist()


def test_passages(spark, odd_docs, empty_docs):
    shared, fuzzy = prose(21, 70).split(), prose(22, 90).split()
    changed = list(fuzzy)
    changed[30], changed[60:62] = "changed", ["other", "words", "here"]
    texts = [prose(30, 40).split() + shared + prose(31, 40).split(), prose(32, 15).split() + shared, fuzzy + prose(33, 50).split(), prose(34, 20).split() + changed,
             prose(35, 100).split(), shared[:30] + prose(36, 60).split(), None, []]
    docs = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("p", F.lit(0)).withColumn("s", F.lit(1))
    got = {(r.doc_id, r.other_id): r for r in passages.find(docs).collect()}
    assert set(got) == {(0, 1), (1, 0), (2, 3), (3, 2)}
    assert (got[0, 1].first_word, got[0, 1].end_word, got[0, 1].other_first, got[0, 1].other_end, got[0, 1].edits) == (40, 110, 15, 85, 0)
    assert (got[3, 2].first_word, got[3, 2].end_word, got[3, 2].other_first, got[3, 2].other_end) == (20, 111, 0, 90) and 1 <= got[3, 2].edits <= 5
    assert all(r.doc_id != r.other_id for r in passages.find(odd_docs[0]).collect()) and passages.find(empty_docs).count() == 0


def test_passages_behind_partial_holders_and_in_chains_that_differ(spark):
    shared = prose(71, 100).split()
    one, two = prose(72, 60).split(), prose(73, 60).split()
    texts = [shared[:40] + prose(74, 30).split(), prose(75, 10).split() + shared[30:70], shared[60:] + prose(76, 20).split(), prose(77, 25).split() + shared, shared + prose(78, 5).split(),
             # Two passages with other words between: one chain leads through all of it.
             one + prose(79, 90).split() + two, one + prose(80, 90).split() + two]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.other_id, r.first_word, r.end_word) for r in passages.find(docs).collect()}
    assert {(3, 4, 25, 125), (4, 3, 0, 100)} <= got
    spans = sorted((a, b) for d, s, a, b in got if (d, s) == (5, 6))
    assert len(spans) == 2 and spans[0][0] == 0 and 60 <= spans[0][1] < 75 and 135 < spans[1][0] <= 150 and spans[1][1] == 210
    assert {g[:2] for g in got} == {(3, 4), (4, 3), (5, 6), (6, 5)}


def test_edited_passages_behind_partial_holders(spark, monkeypatch):
    def edited(words, every, mark):
        return [w if i % every != every // 2 else f"{mark}{i}" for i, w in enumerate(words)]

    def lengthened(words, every, mark):
        return [x for i, w in enumerate(words) for x in ([w] if i % every else [f"{mark}{i}", f"{mark}a{i}", w])]

    texts, line = [], prose(99, 20)
    for k, change in ((0, lengthened), (3, edited), (4, lengthened), (5, edited), (7, edited)):
        shared = prose(700 + k, 100).split()
        # Earlier texts hold all of it, but 40 words at most each.
        texts += [" ".join(prose(10 * k + i, 30).split() + shared[20 * i: 20 * i + 40] + prose(10 * k + i + 5, 20).split()) for i in range(4)]
        texts += [" ".join(prose(10 * k + 9, 9).split() + shared[:24]), " ".join(shared[76:] + prose(10 * k + 8, 9).split())]
        texts += [" ".join(prose(400 + k, 25).split() + edited(shared, 19, "x")), " ".join(change(shared, 22 if change is lengthened else 27, "y") + prose(500 + k, 30).split())]
    n = len(texts)
    # A common line alone is no passage, however many texts hold it.
    texts += [f"{prose(2000 + i, 30)} {line} {prose(3000 + i, 30)}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {pair for i in range(0, n, 8) for pair in ((i + 6, i + 7), (i + 7, i + 6))}
    tried, chained = [], passages._passages
    monkeypatch.setattr(passages, "_passages", lambda chains, *a: tried.append(chains) or chained(chains, *a))
    assert {(r.doc_id, r.other_id) for r in passages.find(docs).collect()} == want
    assert all(r.d < n for r in tried[-2].unionByName(tried[-1]).collect())
    monkeypatch.setattr(passages, "BLOCK", 2)
    assert {(r.doc_id, r.other_id) for r in passages.find(docs).collect()} == want


def test_words_around_open_seeds():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 4, (40, 44)).astype(np.uint16)
    b = np.where(rng.random((40, 44)) < rng.random((40, 1)) / 2, a[::-1] + 4, a[::-1]).astype(np.uint16)
    want = np.array([[passages._extend(x, y)[0] for y in b] for x in a])
    x, y = np.divmod(np.arange(1600), 40)
    for got in (passages._reaches(a, b), passages._reaches(a, b, (x, y)).reshape(40, 40)):
        assert ((got == want) | (got == passages.REACH)).all() and (got != passages.REACH).any()
    for x, y, got in zip(a, b, passages._least_edits(a, b)):
        assert [min(passages.edit_distance(x[:k], y[:j]) for j in range(45)) for k in (0, 7, 20, 44)] == [got[k] for k in (0, 7, 20, 44)]


def test_only_texts_that_take_part_travel(spark, monkeypatch):
    shared, halves = prose(81, 60), prose(82, 100).split()
    texts = {-3: shared, 7: shared + " end", 8: " ".join(halves[:45]) + " x", 2**40: "y " + " ".join(halves[15:60]), 2**41: " ".join(halves[:60]) + " z", 2**41 + 1: "v " + " ".join(halves[:60])}
    docs = spark.createDataFrame([*texts.items(), *((i, prose(1000 + i, 40)) for i in range(100, 200))], "doc_id long, text string")
    sent, found = [], passages._found
    monkeypatch.setattr(passages, "_found", lambda chained, texts, *a: sent.append({r.d for r in texts.collect()}) or found(chained, texts, *a))
    got = {(r.doc_id, r.other_id) for r in passages.find(docs).collect()}
    assert got == {(-3, 7), (7, -3), (2**41, 2**41 + 1), (2**41 + 1, 2**41)}
    assert sent == [set(texts), {2**41, 2**41 + 1}]
    ids = spark.range(-20_000, 20_000, 3).withColumnRenamed("id", "s")
    kept = {r.d for r in passages._taking_part(spark.range(-20_000, 20_000).withColumnRenamed("id", "d"), ids, "s").collect()}
    assert kept >= set(range(-20_000, 20_000, 3)) and len(kept) < 14_000


def test_whole_sets_leave_piece_by_piece():
    import pyarrow as pa

    texts = [prose(i, 3000) for i in range(60)] + ["", None]
    batch = pa.record_batch([pa.array(range(62)), pa.array(texts)], ["k", "t"])
    out = list(ngram_join._whole(5)(iter([batch])))
    assert len(out) > 1 and [k for o in out for k in o["k"].to_pylist()] == list(range(62)) and len(out[-1]["grams"].to_pylist()[-1]) == 0


def test_every_long_repeat_of_the_sample_is_found(sample):
    first, repeated = {}, set()
    for r in sample.select("doc_id", "text").orderBy("doc_id").collect():
        words = (r.text or "").encode().lower().split()
        for j in range(len(words) - 50):
            other = first.setdefault(tuple(words[j:j + 51]), r.doc_id)
            if other != r.doc_id:
                repeated |= {other, r.doc_id}
    assert repeated and repeated <= {r.doc_id for r in passages.find(sample).collect()}


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def test_items_equal_brute_force(spark):
    items = [prose(40, 20), prose(41, 33), prose(42, 8), prose(41, 33), None, "", "four words only here"]
    a, b = items[0].split(), items[1].split()
    texts = [f"{prose(50, 30)} {items[0].upper()}! {prose(51, 9)}", " ".join(a[:7] + ["new"] + a[8:15] + ["more", "than"] + a[15:]), " ".join(a[:5] + prose(52, 9).split() + a[14:]),
             " ".join(b[:10] + b[12:20] + ["x"] + b[21:]), ", ".join(b), items[2], prose(53, 200), None, "", "four words only here", " ".join(w + "x" if i % 4 == 0 else w for i, w in enumerate(b))]
    clean = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("d", F.lit("own"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            words = clean(item)
            if len(words) >= decontaminate.MIN_WORDS and brute_edits(words, clean(t)) <= int(decontaminate.EDIT_RATE * len(words)):
                want[i, j] = brute_edits(words, clean(t))
    for size in (decontaminate.BLOCK_BYTES, 1):
        got = decontaminate.find(docs, bench, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id): r.edits for r in got} == want and len(got) == len(want) > 4
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_items_of_odd_tables(spark, odd_docs, empty_docs):
    odd, rows = odd_docs
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert Counter(r.doc_id for r in decontaminate.find(odd, bench).collect()) == {5: 2, 6: 1}
    assert decontaminate.find(empty_docs, bench).count() == 0 and decontaminate.find(odd, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == len(rows)


def test_pipeline_equals_its_operators(spark):
    folder = FOLDER
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), held_out=toxicity.held_out())
    left = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < toxicity.THRESHOLD}
    roots = brute_join([(i, rows[i].text) for i in left])[1]
    left = {i for i in left if roots[i] == i}
    items = [(i.item_id, i.text) for i in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    held = {r.doc_id for r in decontaminate.find(docs.filter(F.col("doc_id").isin(list(left))), spark.createDataFrame(items, "item_id long, text string")).collect()}
    exact = {i for i in left if any(t in (rows[i].text or "") for _, t in items)}
    assert exact <= held
    left -= held
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, folder)
        assert table.columns == docs.columns, name
    assert {r.doc_id for r in table.collect()} == left
    changed = {r.doc_id for r in table.collect() if r.text != rows[r.doc_id].text}
    live = {r.doc_id for r in secrets.digest(secrets.find(docs.filter(F.col("doc_id").isin(list(left))))).filter("n_live > 0").collect()}
    assert changed == live
    final = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in final.collect()} == left and [n for n, _ in corpus_pipeline.STAGES] == [
        "toxic_documents", "near_duplicates", "benchmark_decontamination", "live_secrets", "mixing_to_weights"]


def test_pipeline_of_odd_documents(spark, odd_docs):
    table, rows = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        before = table.columns
        table = stage(spark, table, FOLDER)
        if name != "mixing_to_weights":
            assert table.columns == before
    assert 0 < table.count() < len(rows)


def test_vectors_of_any_finite_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [2e200, 2.1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 1.0]), (4, [1.0, -1.0]), (5, [-1e300, 1e300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (0, 5)}


def test_small_pages_meet_no_other_page(spark):
    rows = [(i, f"https://e.com/{i}", "x" * 10) for i in range(50)] + [(100 + i, None, "y" * 2000) for i in range(30)] + [(200, "u", "z" * 1500), (201, "u", None)]
    df = warc.decide(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r.refers_to for r in df.collect()}
    assert got == {**{i: None for i in range(50)}, **{100 + i: 129 for i in range(29)}, 129: None, 200: None, 201: None}
