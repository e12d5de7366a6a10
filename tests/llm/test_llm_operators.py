"""Operators and stages as Spark jobs: against brute force or SQL on small tables, and over odd ones."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import components, decontam, html, lines, neardup, packing, quality, queries, records, spans, tokens, toxicity, warc
from millrace.llm.wordhash import each_text

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    got = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in got.description]
    order = sorted(names)
    assert order == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*order).collect()))) == sorted(repr(tuple(r[names.index(c)] for c in order)) for r in got.fetchall())


def plain_clusters(docs, threshold=0.8):
    """Brute force: all pairs of shingle sets."""
    sets = {}
    for (d, _), (_, h, _, _) in zip(docs, each_text(pa.array([t for _, t in docs])), strict=True):
        sets[d] = frozenset(neardup.weighted_shingles(h)[0].tolist())
    label = {d: d for d in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                p, q = top(a), top(b)
                label[max(p, q)] = min(p, q)
    return {d: top(d) for d in sets}


def copies(n_groups=6, n_copies=25):
    """Groups of copies with a word changed here and there, some beyond the threshold, some chains of copies of copies."""
    rng = np.random.default_rng(9)
    out, k = [], 0
    for g in range(n_groups):
        base = [f"g{g}w{i}" for i in range(80)]
        chain = list(base)
        for c in range(n_copies):
            words = list(chain if c % 5 == 4 else base)
            for at in rng.integers(0, 80, rng.integers(0, 4)):
                words[at] = f"new{k}x{at}"
            if c % 7 == 3:
                words = words[: 80 - int(rng.integers(0, 16))]
            if c % 5 == 4:
                chain = words
            out.append((k, " ".join(words)))
            k += 1
    return out


def test_near_duplicates_are_brute_forces(spark):
    docs = copies() + [(1000 + i, f"text number {i} stands quite alone {i * 7} here") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["cluster"] for r in neardup.near_duplicates(df).collect()}
    assert got == plain_clusters(docs)


def test_near_duplicates_that_repeat_a_passage(spark):
    """Texts of 300 words, and each with a passage of 12 words repeated 60 times behind: set Jaccard over 0.95."""
    docs = []
    for g in range(12):
        text, passage = " ".join(f"g{g}w{i}" for i in range(304)), " ".join(f"g{g}p{i}" for i in range(12))
        docs += [(2 * g, text), (2 * g + 1, f"{text} {' '.join([passage] * 60)}")]
    got = {r["doc_id"]: r["cluster"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_clusters(docs) == {d: d - d % 2 for d, _ in docs}


def loose_group(n, seed=5):
    """Texts around one base, 0.6 to 0.75 alike, and beside every tenth a copy of it with a word or two changed."""
    rng = np.random.default_rng(seed)
    base, out = [f"b{i}" for i in range(100)], []
    for d in range(n):
        words = list(base)
        for at in rng.integers(0, 100, 5):
            words[at] = f"own{d}x{at}"
        out.append((2 * d, " ".join(words)))
        if d % 10 == 0:
            words[int(rng.integers(100))] = f"near{d}"
            out.append((2 * d + 1, " ".join(words)))
    return out


def test_loose_groups_take_few_comparisons_and_lose_few_links(spark, monkeypatch):
    """One large group whose members are mostly too far apart: pairs grow with its members, not with their square."""
    made, real = [], neardup._links
    monkeypatch.setattr(neardup, "_links", lambda pairs, *rest: made.append(pairs.count()) or real(pairs, *rest))
    figures = []
    for n in (150, 300):
        made.clear()
        docs = loose_group(n)
        got = {r["doc_id"]: r["cluster"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        truth = plain_clusters(docs)
        assert all(truth[d] == truth[c] for d, c in got.items())
        near = [d for d in got if d % 2]
        figures.append((sum(made), np.mean([got[d] == got[d - 1] for d in near]), np.mean([len({got[x] for x in g}) == 1 for g in groups_of(truth)])))
    assert figures[1][0] < 2.6 * figures[0][0] and all(f[1] >= 0.9 for f in figures), figures


@pytest.mark.parametrize("weights", ["sets", "counts"])
def test_no_link_of_a_large_loose_bucket_is_lost(spark, weights):
    """Every member shares one bucket and no other, so the first deal parts all but leaders: 40 near pairs, most of them of two others."""
    docs = loose_group(400)
    found = list(each_text(pa.array([t for _, t in docs])))
    made = {d: neardup.weighted_shingles(h) for (d, _), (_, h, _, _) in zip(docs, found, strict=True)}
    counts = {d: n if weights == "counts" else np.ones(len(e), np.int64) for d, (e, n) in made.items()}
    sets = spark.createDataFrame([(d, e.tobytes(), counts[d].astype(np.int32).tobytes()) for d, (e, _) in made.items()], "node long, shingles binary, counts binary")
    members = spark.createDataFrame([(d, 0, 1, len(docs)) for d in made], "node long, band int, key long, n long")
    bands = spark.createDataFrame([(d, [1, *[d * 100 + k for k in range(1, neardup.BANDS)]]) for d in made], "node long, bands array<long>")
    links = neardup._forest_links(members, bands, sets, 0.8, weights == "counts")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    want = [(a, b) for a in made for b in made if a < b and neardup.probability_jaccard(made[a][0], counts[a], made[b][0], counts[b]) >= 0.8]
    assert len(want) >= 30 and all(got.get(a, a) == got.get(b, b) for a, b in want)


def rest_of(spark, docs, threshold, monkeypatch):
    """What _rest_pairs gives for texts of a label each, the pairs that are alike, and how many pairs of nodes its blocks bring together."""
    found = list(each_text(pa.array([t for _, t in docs])))
    made = {d: neardup.weighted_shingles(h)[0] for (d, _), (_, h, _, _) in zip(docs, found, strict=True)}
    sets = spark.createDataFrame([(d, e.tobytes(), b"") for d, e in made.items()], "node long, shingles binary, counts binary")
    kept, real = {}, neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, name: kept.setdefault(name, real(df, name)))
    got = {(r["a"], r["b"]) for r in neardup._rest_pairs(sets.select("node", F.col("node").alias("label")), sets, threshold, False).collect()}
    monkeypatch.undo()
    held = collections.Counter()
    for r in kept["blocks"].collect():
        held[tuple(r.asDict().get(c) for c in ("element", "own", "other"))] += len(r["held"])
    met = sum(n * held[e, other, own] for (e, own, other), n in held.items())
    sure = {d: set(e.tolist()) for d, e in made.items()}
    want = {(a, b) for a in sure for b in sure if a < b and len(sure[a] & sure[b]) >= threshold * len(sure[a] | sure[b])}
    return got, want, met


def test_rest_pairs_of_a_loose_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Texts about 0.55 alike, each with shingles of its own for 0.15 of it: less than the rest of a set may be, but more than two sets of one size may lack."""
    met = []
    for n in (100, 400):
        docs = []
        for d in range(n):
            words = [f"own{d}x{i}" if i % 32 == d % 32 else f"b{i}" for i in range(100)]
            docs.append((2 * d, " ".join(words)))
            if d % 20 == 0:
                docs.append((2 * d + 1, " ".join([*words[:90], f"end{d}"])))
        got, want, made = rest_of(spark, docs, 0.8, monkeypatch)
        assert len(want) >= n // 20 and want <= got
        met.append(made)
    assert met[1] < 8 * met[0], met


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_rest_pairs_miss_none(spark, monkeypatch, threshold):
    rng = np.random.default_rng(7)
    base, docs = [f"b{i}" for i in range(60)], []
    for d in range(200):
        words = list(base[int(rng.integers(0, 12)) : 60 - int(rng.integers(0, 12))])
        for at in rng.integers(0, len(words), int(rng.integers(0, 3))):
            words[at] = f"w{int(rng.integers(0, 30))}"
        docs.append((d, " ".join(words)))
    docs += [(500 + d, " ".join(f"s{d % 3}x{i}" for i in range(1 + d % 9))) for d in range(30)]
    got, want, _ = rest_of(spark, docs, threshold, monkeypatch)
    assert len(want) >= 10 and want <= got


def groups_of(label):
    by = collections.defaultdict(list)
    for d, c in label.items():
        by[c].append(d)
    return [g for g in by.values() if len(g) > 1]


def test_counted_weights_tell_repeated_passages_apart(spark):
    text, passage = " ".join(f"w{i}" for i in range(304)), " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, text), (2, f"{text} {' '.join([passage] * 60)}"), (3, f"{text} end"), (3, "another text of the same id stands alone here")], "doc_id long, text string")
    cluster = lambda **k: sorted((r["doc_id"], r["cluster"], r["n_links"] > 0) for r in neardup.near_duplicates(docs, **k).collect())
    assert cluster(weights="counts") == [(1, 1, True), (2, 2, False), (3, 1, True), (3, 3, False)]
    assert cluster() == [(1, 1, True), (2, 1, True), (3, 1, True), (3, 3, False)]


def test_probability_jaccard_is_its_definition():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = (np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(2))
        wa, wb = rng.integers(1, 6, len(a)), rng.integers(1, 6, len(b))
        x, y = dict(zip(a.tolist(), wa.tolist(), strict=True)), dict(zip(b.tolist(), wb.tolist(), strict=True))
        plain = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        assert abs(neardup.probability_jaccard(a, wa, b, wb) - plain) < 1e-9


def test_one_row_of_a_repeated_winner_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (4, ""), (4, "")], "doc_id long, text string")
    assert sorted(map(repr, (r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()))) == ["1", "4", "4", "None"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 150)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), 150: 150, 200: 150}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_over_odd_rows(spark, odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count() and neardup.near_duplicates(no_docs).count() == 0
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["cluster"])
    assert by[1] == by[2] == by[7] == {1} and by[4] == {4} and by[5] == {5} and by[None] == {None}
    kept = neardup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, None, 6, 8, 9, 10}


def test_lines_over_odd_rows(spark, odd_docs, no_docs):
    out = {(r["doc_id"], r["text"]): r for r in lines.dedup_lines(odd_docs).collect()}
    by = {k[0]: r for k, r in out.items()}
    assert by[3]["n_dropped"] == 0 and by[1]["n_dropped"] == by[2]["n_dropped"] == 2 and by[5]["n_lines"] == 1 and by[5]["text"] == ""
    assert by[2]["text"] == "end" and by[2]["cluster"] == by[2]["_id"] == "kept" and by[10]["text"] == "\n \n\t\n"
    assert lines.dedup_lines(no_docs).count() == 0


def plain_units(text):
    """Brute force: sentences, those of over LONG tokens cut behind the greatest token of any WINDOW."""
    import re

    out = []
    for s in re.findall(spans.SENTENCE, text):
        tokens, low = re.findall(spans.TOKEN, s), re.findall(spans.BARE, s.translate(decontam.LOWERED))
        if len(low) <= spans.LONG:
            out.append((s, low))
            continue
        ends = sorted({max((low[q].encode(), q) for q in range(k, k + spans.WINDOW))[1] + 1 for k in range(len(low) - spans.WINDOW + 1)} | {len(low)})
        out += [("".join(tokens[a:z]), low[a:z]) for a, z in zip([0, *ends], ends, strict=False)]
    return out


def plain_spans(docs, min_docs=2):
    held, gone, kept = collections.defaultdict(list), collections.defaultdict(set), {}
    split = {d: plain_units(t or "") for d, t in docs}
    for d in sorted(split):
        for i in range(len(split[d])):
            e, n = i, 0
            while e < len(split[d]) and n < spans.MIN_TOKENS:
                n += max(1, len(split[d][e][1]))
                e += 1
            if n >= spans.MIN_TOKENS:
                held[tuple(" ".join(low) for _, low in split[d][i:e])].append((d, i, e))
    for places in held.values():
        if len(places) > 1 and len({d for d, _, _ in places}) >= min_docs:
            for d, i, e in places[1:]:
                gone[d].update(range(i, e))
    for d, u in split.items():
        kept[d] = "".join(x for i, (x, _) in enumerate(u) if i not in gone[d])
    return kept


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_spans_are_brute_forces(spark, odd_docs, no_docs, min_docs):
    passage = "It began with rain. The river rose for days, and all night long. Nobody slept in the low houses. Then it stopped, as if nothing had been. So they went."
    docs = [(i, f"Doc {i} opens so. {passage} And doc {i} ends.") for i in range(1, 30)] + [(40, f"{passage} {passage}"), (41, "One. Two."), (42, None), (43, ""), (44, "\n \n\n" + "x y z " * 30)]
    docs += [(50 + i, f"{'word ' * i}{' '.join(f'long{k}' for k in range(90))} {'end ' * i}") for i in range(4)] + [(60, " ".join(f"own{k}" for k in range(30)) + ". Alone. " + " ".join(f"own{k}" for k in range(30)) + ".")]
    out = {r["doc_id"]: r["text"] for r in spans.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string"), min_docs=min_docs).collect()}
    assert out == plain_spans(docs, min_docs)
    odd = spans.dedup_spans(odd_docs, min_docs=min_docs)
    assert odd.count() == odd_docs.count() and set(odd_docs.columns) <= set(odd.columns) and spans.dedup_spans(no_docs).count() == 0


def test_the_least_id_is_no_null(spark):
    low, line = -(2**63), "a line of more than twenty letters"
    rows = spark.createDataFrame([(low, f"{line}\none"), (None, f"{line}\ntwo"), (4, f"{line}\nthree")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(rows).collect()} == {low: "one", None: "two", 4: f"{line}\nthree"}
    passage = " ".join(f"word{i}" for i in range(60)) + "."
    for ids in ([None, low], [low, 3], [None, 3], [None, None]):
        pair = spark.createDataFrame([(i, passage) for i in ids], "doc_id long, text string")
        assert {r["doc_id"]: r["n_removed"] > 0 for r in spans.dedup_spans(pair).collect()} == {ids[0]: False, ids[1]: ids[0] != ids[1]}


def test_spans_of_repeated_ids_with_other_texts(spark):
    """A document is an id and a text: what one row of an id loses, no other row of it does, nor hides another's run."""
    p, q = (". ".join(" ".join(f"{mark}{i}x{k}" for k in range(9)) for i in range(9)) + "." for mark in "pq")
    docs = spark.createDataFrame([(1, p), (5, q), (5, p), (5, q), (6, f"{q} own"), (7, None), (7, p), (None, p), (None, "short")], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["n_removed"], r["text"]) for r in spans.dedup_spans(docs).collect()), key=repr)
    assert out == sorted([(1, 9, ""), (5, 0, q), (5, 9, ""), (5, 0, q), (6, 9, "own"), (7, 0, ""), (7, 9, ""), (None, 0, p), (None, 0, "short")], key=repr)


def test_units_are_brute_forces():
    rng = np.random.default_rng(11)
    texts = ["", " ", "\n", "a.\n .b", "a. \n.b", "a \n.b\n .c", "..", "end.Next one", " lead", "é" * 30 + ". É é", "x " * 19 + "y", "x " * 20 + "y", "same " * 60]
    texts += ["".join(" ab.\n\t\r!?éA"[i] for i in rng.integers(0, 11, rng.integers(0, 300))) for _ in range(200)]
    texts += [" ".join(f"w{i}" for i in rng.integers(0, 60, rng.integers(15, 90))) + ".!"[: rng.integers(0, 3)] for _ in range(60)]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    u = spans.units(np.frombuffer(data, np.uint8), offsets)
    for i, text in enumerate(texts):
        a, z = u.bounds[i], u.bounds[i + 1]
        ends = [*u.start[a + 1 : z].tolist(), offsets[i + 1]][: z - a]
        got = [(data[s:e].decode(), int(n)) for s, e, n in zip(u.start[a:z].tolist(), ends, u.n[a:z].tolist(), strict=True)]
        assert got == [(s, max(1, len(low))) for s, low in plain_units(text)], text


def test_spans_catch_planted_passages_and_leave_stock_lines(spark):
    """Passages of 51 to 80 words put anywhere, into the middle of sentences too, of one sentence or many; stock lines of 12 words stay."""
    rng = np.random.default_rng(8)
    words = lambda n, k: [f"{'abcdefghijklmnopqrstuvwxyz'[int(rng.integers(26))]}{int(rng.integers(300))}{k}" for _ in range(n)]

    def prose(n, mark, stops):
        return [w + ("." if stops and rng.random() < 0.12 else "") for w in words(n, mark)]

    stock = "All rights reserved by the owners of this work. Do not copy."
    passages = [prose(int(rng.integers(51, 80)), f"p{p}", p % 2) for p in range(30)]
    docs, planted = [], {}
    for p, passage in enumerate(passages):
        for c in range(3):
            text, at = prose(150, f"d{p}x{c}", c != 1), int(rng.integers(150))
            docs.append((10 * p + c, " ".join(text[:at] + passage + text[at:]) + "\n" + stock))
            planted[10 * p + c] = c > 0
    docs += [(1000 + i, " ".join(prose(200, f"e{i}", True)) + "\n" + stock) for i in range(60)]
    out = {r["doc_id"]: r["n_removed"] > 0 for r in spans.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert np.mean([out[d] for d, later in planted.items() if later]) >= 0.98
    assert not any(out[d] for d in out if not planted.get(d))


def test_quality_over_odd_rows(spark, odd_docs, no_docs):
    out = quality.quality(odd_docs).collect()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert len(out) == odd_docs.count() and quality.quality(no_docs).count() == 0
    assert by[4]["n_words"] == 0 and not by[4]["kept"] and by[6]["base_failed"] and by[3]["n_repeat_words"] == 120
    kept = quality.drop_rejected(odd_docs)
    assert kept.columns == odd_docs.columns and {4, 5, 6, 10}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_robust_distances_reject_outliers_alone(spark):
    rng = np.random.default_rng(4)
    good = [(i, " ".join(f"word{rng.integers(500)}" for _ in range(rng.integers(60, 400))), "en", "s") for i in range(120)]
    bad = [(1000 + i, " ".join(f"w{rng.integers(500)}###$$$" for _ in range(100)), "en", "s") for i in range(12)]
    out = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] for i in range(120)) and not any(out[1000 + i] for i in range(12))


def plain_distances(z, grp, lang):
    """Numpy: concentration steps per group with its language's moments as a prior; formulas of its own, by means and np.linalg."""
    floors = np.array([quality.FLOORS[k] for k in quality.STATS], float)
    per_bin = 1 / quality.BINS_PER_UNIT
    bins = lambda d: np.floor(np.minimum(d / per_bin, quality.MAX_BIN))
    nearest = lambda b, share: b <= np.sort(b)[int(np.ceil(len(b) * share / 100)) - 1]
    groups = {g: np.flatnonzero(grp == g) for g in sorted(set(grp))}
    median = lambda x: np.sort(x, axis=0)[int(np.ceil(len(x) / 2)) - 1]
    d2 = np.zeros(len(z))
    for g, at in groups.items():
        d2[at] = (((z[at] - median(z[at])) / floors) ** 2).sum(axis=1)
    for _ in range(quality.STEPS):
        held = {g: z[at[nearest(bins(d2[at]), quality.SUPPORT_PERCENT)]] for g, at in groups.items()}
        second = lambda x: x.T @ x / len(x)
        for g, at in groups.items():
            near = np.concatenate([x for h, x in held.items() if lang[groups[h][0]] == lang[at[0]]])
            own, w = held[g], len(held[g]) / (len(held[g]) + quality.PRIOR)
            mean = w * own.mean(axis=0) + (1 - w) * near.mean(axis=0)
            cov = w * second(own) + (1 - w) * second(near) - np.outer(mean, mean)
            np.fill_diagonal(cov, np.maximum(np.diag(cov), floors**2))
            d2[at] = np.einsum("ij,jk,ik->i", z[at] - mean, np.linalg.inv(cov), z[at] - mean)
    for at in groups.values():
        b = bins(d2[at])
        d2[at] = d2[at] * min(1.0, quality.CHI2_MEDIAN * quality.BINS_PER_UNIT / (np.sort(b)[int(np.ceil(len(b) / 2)) - 1] + 1))
    return d2


def test_robust_distances_are_numpys(spark):
    """Groups of 5 to 500 rows in two languages, outliers in each; each group is estimated."""
    rng = np.random.default_rng(12)
    rows = []
    for g, (n, lang) in enumerate([(5, "a"), (49, "a"), (50, "a"), (500, "b"), (1, "b")]):
        mix = rng.normal(size=(5, 5)) * 60
        z = np.round(rng.normal(size=(n, 5)) @ mix + rng.normal(size=5) * 200)
        z[: n // 12] += 3000
        rows += [(int(len(rows) + i), f"g{g}", lang, *map(int, x)) for i, x in enumerate(z)]
    df = spark.createDataFrame(rows, "id long, grp string, lang string, " + ", ".join(f"{k} long" for k in quality.STATS))
    got = np.array([r["d2"] for r in quality.robust_distances(df).orderBy("id").collect()])
    want = plain_distances(np.array([r[3:] for r in rows], float), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    assert np.allclose(got, want, rtol=1e-6, atol=1e-9)
    assert (want > quality.CUTOFF).sum() >= 40


def test_decontamination_over_odd_rows_and_blocks(spark, odd_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, "word1 of a plain text that goes on word2 of a plain"), (2, "short"), (None, "x y z"), (4, None)], "item_id long, text string")
    whole = sorted(map(repr, decontam.decontaminate(odd_docs.dropDuplicates(["doc_id"]).filter("doc_id is not null"), items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 20)
    assert sorted(map(repr, decontam.decontaminate(odd_docs.dropDuplicates(["doc_id"]).filter("doc_id is not null"), items).collect())) == whole
    clean = decontam.drop_contaminated(odd_docs, items)
    assert clean.columns == odd_docs.columns and {r["doc_id"] for r in clean.collect()} == {4, 5, None, 8, 9, 10}
    assert decontam.decontaminate(no_docs, items).count() == 0 and decontam.decontaminate(odd_docs, items.limit(0)).filter("contaminated").count() == 0


def test_decontamination_in_blocks_keeps_rows(spark, monkeypatch):
    """Null and repeated doc_ids with different texts: one block or several, the rows are the same."""
    texts = [f"alpha beta gamma item{k} delta end" for k in range(8)]
    items = spark.createDataFrame([(k, f"gamma item{k}") for k in range(8)], "item_id long, text string")
    docs = spark.createDataFrame([(None, texts[0]), (None, "clean"), (None, None), (5, texts[1]), (5, f"{texts[2]} {texts[3]} more words"), (5, "clean too"), (6, " ".join(texts))], "doc_id long, text string")
    rows = lambda: sorted(map(repr, decontam.decontaminate(docs, items).collect()))
    whole = rows()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 20)
    assert rows() == whole and len(whole) == 7


def test_common_items_do_not_multiply_a_common_word(spark, monkeypatch):
    """A thousand words that two thousand items ask for: a row for each word and one for each item, not for each pair."""
    items = spark.createDataFrame([(k, "Yes!") for k in range(2000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "yes " * 1000), (2, "no")], "doc_id long, text string")
    row = decontam.find_windows(docs, items).filter("doc_id = 1").first()
    assert len(row["hits"]) == 1000 and [len(w["item_ids"]) for w in row["windows"]] == [2000]
    out = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.decontaminate(docs, items).collect()}
    assert out == {1: (1000, 2000), 2: (0, 0)}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 3000)
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.decontaminate(docs, items).collect()} == out


def test_blocks_of_items_are_scanned_one_after_the_other(spark, monkeypatch):
    """A plan never holds more than one block's Python step."""
    items = spark.createDataFrame([(k, f"gamma item{k}") for k in range(8)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"alpha beta gamma item{k} delta") for k in range(12)], "doc_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 20)
    clean = decontam.drop_contaminated(docs, items)
    assert {r["doc_id"] for r in clean.collect()} == {8, 9, 10, 11}
    assert clean._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1


def test_records_round_trip(spark, odd_docs, no_docs):
    manifest, folder = records.write_records(odd_docs)
    back = records.read_records(manifest, folder).collect()
    encoder = tokens.encoder(tokens.vocabulary_path())
    expected = collections.Counter((r["doc_id"], encoder.encode([r["text"] or ""])[0].tobytes()) for r in odd_docs.collect())
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in back) == expected
    ordered = sorted(back, key=lambda r: r["start"])
    assert [r["doc_id"] or 0 for r in ordered] == sorted(r["doc_id"] or 0 for r in back)
    assert [r["start"] for r in ordered] == np.concatenate([[0], np.cumsum([len(r["ids"]) // 4 for r in ordered])])[:-1].tolist()
    row = manifest.orderBy("part").first()
    picked = records.read_at(folder, row["file"], row["index"], [row["n_records"] - 1, 0])
    assert len(picked) == 2 and picked[1][1][-1] == 0
    ends = spark.createDataFrame([(-(2**63), "least"), (None, "none"), (2**63 - 1, "most"), (0, "nought")], "doc_id long, text string")
    assert [r["doc_id"] for r in records.digest(ends).orderBy("start").collect()] == [None, -(2**63), 0, 2**63 - 1]
    empty, where = records.write_records(no_docs)
    assert records.read_records(empty, where).count() == 0


def test_packing_over_odd_rows(spark, odd_docs, no_docs):
    packed = packing.pack(odd_docs)
    rows = packed.collect()
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(rows) >= odd_docs.count() and sum(r["length"] for r in rows) == sum(len(r["ids"]) // 4 for r in rows)
    joined = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in joined) == sum(len(r["ids"]) for r in rows)
    assert packing.pack(no_docs).count() == 0


def test_archives_over_odd_rows(spark):
    body = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a", body, "x"), (2, None, body, "x"), (2, None, body, "x"), (3, "u", "<p>short</p>", "x"), (4, "u", "<p>short</p>", "x"), (5, "u", None, "x"), (None, "u", body, None), (9, "u\r\nX: y", "z" * 3000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, shard string")
    manifest, folder = warc.write_archives(pages, shard_bytes=2000, roll_bytes=300)
    back = warc.read_archives(manifest, folder).collect()
    got = collections.Counter((r["page_id"], r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in back)
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    assert got == collections.Counter((p, sha(h), len((h or "").encode()), "revisit" if p == 1 else "response", 2 if p == 1 else None) for p, _, h, _ in rows)
    assert manifest.count() > 2 and all(r["payload"] is None for r in back if r["record_type"] == "revisit")
    again, _ = warc.write_archives(pages.repartition(3), shard_bytes=2000, roll_bytes=300)
    assert sorted(r["sha256"] for r in again.collect()) == sorted(r["sha256"] for r in manifest.collect())
    assert warc.digest(pages.limit(0)).count() == 0


def test_archives_over_odd_ids(spark):
    ends = [-(2**63), -(2**63) + 1, 2**63 - 1, 0, None]
    pages = spark.createDataFrame([(i, "u", "x" * 50) for i in ends] + [(10**15, "u", "y")] + [(k, "u", "z" * (k % 9)) for k in range(1, 2000)], "page_id long, url string, html string")
    manifest, folder = warc.write_archives(pages, shard_bytes=20000)
    back = warc.read_archives(manifest, folder)
    assert collections.Counter(r["page_id"] for r in back.collect()) == collections.Counter(r["page_id"] for r in pages.collect())
    # Two outlying ids leave the others in as many shards as without them, each of about its share.
    shards = {r["shard"]: r["n"] for r in manifest.groupBy("shard").agg(F.sum("n_records").alias("n")).collect()}
    assert 40 <= len(shards) <= 60 and max(shards.values()) < 100
    sparse = pages.filter("page_id between 1 and 1999").withColumn("page_id", F.xxhash64("page_id"))
    bounds = warc.shard_bounds(sparse, 20000)
    assert 40 <= len(bounds) <= 60 and bounds == sorted(bounds) == warc.shard_bounds(sparse.repartition(5), 20000)


def test_pages_over_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<article><p>Text &eacute; here.</p></article>", "x"), (2, "u", "<article><p>Text &eacute; here.</p></article>", "x")], "page_id long, url string, html string, text string")
    out = html.extract_text(pages).collect()
    assert sorted((r["text"], r["n_chars"]) for r in out) == [("", 0), ("", 0), ("Text é here.", 12), ("Text é here.", 12)]
    assert html.extract_text(pages.limit(0)).count() == 0


def test_toxicity_held_out(spark, odd_docs, no_docs):
    rng = np.random.default_rng(6)
    rows, marks = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = [f"word{rng.integers(400)}" for _ in range(60)]
        if bad:
            for k in range(3):
                words[int(rng.integers(60))] = ("oafish", "knave", f"grunz{rng.integers(90)}")[k]
        rows.append((i, " ".join(words), "x"))
        marks.append((i, int(bad), "x"))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(marks, "doc_id long, toxic int, text string")
    out = toxicity.digest(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.97
    odd = toxicity.digest(odd_docs, labels.limit(0)).collect()
    assert len(odd) == odd_docs.count() and not any(r["predicted"] for r in odd) and toxicity.digest(no_docs, labels).count() == 0


def test_scores_change_a_little_with_every_row(spark):
    """No least number of rows: from none over 40 to 60 the score of a text moves in small steps."""
    rng = np.random.default_rng(16)
    rows = [(3 * i, " ".join(["grunzfeld" if i % 4 == 0 and k < 3 else f"word{rng.integers(300)}" for k in range(50)])) for i in range(120)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = [(d, int("grunzfeld" in t)) for d, t in rows]
    probe = spark.createDataFrame([(1, "a grunzfeld here and a grunzfeld there, grunzfeld"), (2, "plain words alone")], "doc_id long, text string")
    got = []
    for n in (0, 44, 47, 50, 53, 56):
        model = toxicity.fit(docs, spark.createDataFrame(marked[:n], "doc_id long, toxic int"))
        got.append([r["score"] for r in toxicity.score(probe, model).orderBy("doc_id").collect()])
    got = np.array(got)
    assert np.abs(np.diff(got[1:], axis=0)).max() < 0.2 and (got[:, 1] < 0.2).all() and (got[1:, 0] > got[1:, 1]).all(), got


def test_scores_do_not_hang_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(repr, toxicity.digest(docs, labels).collect())) == sorted(map(repr, toxicity.digest(docs, turned).collect()))


def test_pipeline_is_its_stages_by_brute_force(spark, duck):
    out = corpus_pipeline.run(spark, DATA).collect()
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({quality.oracle()}) WHERE kept").fetchall()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r["doc_id"] in kept)
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(decontam.LOWERED)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    docs = [(d, "\n".join(x for x in (t or "").split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == d)) for d, t in docs]
    clusters = plain_clusters(docs)
    found = decontam.automaton([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()], 10)
    docs = [(d, t) for d, t in docs if clusters[d] == d and not decontam.scan_text(t, found)[1]]
    encoder = tokens.encoder(tokens.vocabulary_path())
    lengths = {d: len(encoder.encode([t])[0]) for d, t in docs}
    got = collections.Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == lengths
