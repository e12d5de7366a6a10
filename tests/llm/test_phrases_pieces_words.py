"""Phrase collocations, byte-level BPE and spelling variants: against brute force, the libraries and odd tables."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import tiktoken

from millrace.llm import bpe, collocations, packed, sketch, spelling, tokens, wordhash
from millrace.llm.decontam import LOWERED

DATA = "/root/testdata/sf0.001"


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text[:n], text[:n].translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    with open(public_tokenizers.path(bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.rank_encoder(tokens.vocabulary_path(bpe.RANKS))


# Phrases


def plain_phrases(docs, min_count, top):
    """Brute force over (lang, text): counters of tuples, exact integers."""
    found, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWERED)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                found[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in found.items():
        cands, rows = [p for p in f if len(p) > 1 and f[p] >= min_count], []
        for p in cands:
            around = [q for q in cands if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * f[q] >= 80 * f[p] for q in around):
                score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, words[lang], -score) for i, (score, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_docs():
    rng = np.random.default_rng(2)
    stock = ["in the middle of", "of the", "Middle of it", "no way, no", "naïve café", "a b a b a b", "x\ty  z", "it's; so"]
    docs = [(["en", "de", None][int(rng.integers(3))], " ".join([stock[i] for i in rng.integers(0, len(stock), 12)] + [f"w{j}" for j in rng.integers(0, 9, 10)]) + "\n!") for _ in range(80)]
    return [*docs, ("en", None), ("fr", ""), ("en", " \t\n.,"), ("en", "one"), ("de", "of the " * 3000), docs[0], docs[0]]


@pytest.mark.parametrize("top", [5, 2000])
def test_collocations_are_brute_forces(spark, top):
    docs = phrase_docs()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, text string, phrase string, n long")
    got = sorted(tuple(r) for r in collocations.collocations(df, top=top, min_count=12).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_phrases(docs, 12, top) and any(r[0] == "und" for r in got)


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    """With 32 cells a row nearly all pass; results are the same."""
    docs = phrase_docs()
    df = spark.createDataFrame(docs, "lang string, text string")
    monkeypatch.setattr(collocations, "FLUSH", 500)
    got = sorted(tuple(r) for r in collocations.collocations(df, min_count=12, most_bits=5).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_phrases(docs, 12, 2000)


def test_collocations_over_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    got = sorted(tuple(r) for r in collocations.collocations(odd_docs, min_count=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_phrases(docs, 3, 2000) and collocations.collocations(no_docs).count() == 0


def test_sketches_sum_what_tasks_saw(spark):
    rng = np.random.default_rng(1)
    bits, seen = 22, [np.concatenate([rng.integers(0, 1 << 22, n), rng.integers(0, 50, 400), [0, (1 << 22) - 1]]) for n in (0, 10, 5000, 300000)]
    total = np.bincount(np.concatenate(seen), minlength=1 << bits)
    rows = [p for cells in seen for p in sketch.parts(cells.astype(np.uint32), 1)]
    for threshold in (1, 3, 30):
        held = sketch.bitmaps(sketch.merged(spark.createDataFrame(rows, sketch.PART), 2, bits, threshold))
        assert (held.has(1, np.arange(1 << bits)) == (total >= threshold)).all() and not held.has(0, np.arange(100)).any()
    assert sketch.parts(np.zeros(0, np.uint32), 0) == []
    with pytest.raises(ValueError):
        sketch.merged(spark.createDataFrame(rows, sketch.PART), 2, bits, 256)


# Pieces


def test_numbers_tell_strings_apart_whatever_their_hashes(monkeypatch):
    """All keys in one chain, and every hash the same: equal numbers are still equal strings."""
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(0, 3, rng.integers(1, 30)).astype(np.uint8)) for _ in range(400)] + [b"\0", b"\0\0", b"\0" * 15, b"\0" * 16]
    monkeypatch.setattr(packed, "mix", lambda x: x * packed.U64(0))
    numbers, told = packed.Numbers(bits=6), []
    size = np.array([len(s) for s in strings])
    pad = packed.padded(np.frombuffer(b"".join(strings), np.uint8))
    for _ in range(2):
        got = numbers.number(pad, np.cumsum(size) - size, size, told.extend)
        assert [told[i] for i in got.tolist()] == strings and len(told) == len(set(strings)) == numbers.count


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192])
def test_words_that_a_polynomial_cannot_tell_apart(n, library, encoder):
    one, two = thue_morse(n)
    assert [x.tolist() for x in encoder.encode([one, two])] == [library.encode_ordinary(x) for x in (one, two)]
    own = tokens.encoder(tokens.vocabulary_path())
    assert [x.tolist()[:-1] for x in own.encode([one, two])] == [own.model.encode(x, add_special_tokens=False).ids for x in (one, two)]
    import pyarrow as pa

    (_, a, *_), (_, b, *_) = wordhash.each_text(pa.array([one, two]))
    assert a[0] != b[0]


def test_every_code_point_is_split_as_the_libraries_do(library, encoder):
    """Letters, numbers and spaces that a Unicode of another year would class otherwise are told by what an apostrophe makes of them."""
    own = tokens.encoder(tokens.vocabulary_path())
    points = [chr(c) for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(1, 0x3100)]
    for i in range(0, len(points), 1000):
        text = "".join(f"{c}'ll x{c}1{c} {c}{c}.{c}'re" for c in points[i : i + 1000])
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)
        assert own.encode([text])[0].tolist()[:-1] == own.model.encode(text, add_special_tokens=False).ids


def test_merges_are_the_librarys(library, encoder):
    rng = np.random.default_rng(5)
    texts = ["", " ", "a", "aaaa" * 500, "ab" * 300 + "!" * 700, "é" * 1500, "word " * 50 + "\n\n  end  ", "<|endoftext|> is text"]
    for _ in range(600):
        top = [0x80, 0x250, 0x3000, 0xD800][int(rng.integers(4))]
        texts.append("".join(map(chr, rng.integers(1, top, rng.integers(0, 80)))) + "'ll've"[: rng.integers(0, 7)] + " \n \t"[: rng.integers(0, 5)])
    got = encoder.encode(texts)
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert [encoder.decode(x).decode() for x in got] == texts
    with pytest.raises(ValueError):
        encoder.decode(np.array([50256], np.uint32))


def test_bpe_over_odd_rows(spark, library, odd_docs, no_docs):
    want = sorted(map(repr, ((r["doc_id"], library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in odd_docs.collect())))
    back = bpe.decode(bpe.encode(odd_docs)).collect()
    assert sorted(repr((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["bytes"]))) for r in back) == want
    assert bpe.digest(no_docs).count() == 0
    kept = bpe.decode(spark.createDataFrame([(None, "own", b"x"), (bytes(4), "own", None)], "ids binary, `an id` string, bytes binary"))
    assert [(r["an id"], bytes(r["bytes"])) for r in kept.collect()] == [("own", b""), ("own", b"!")]


def test_bpe_query_is_the_librarys(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.digest(spark.read.parquet(f"{DATA}/documents.parquet")).collect():
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(docs[r["doc_id"]].encode()))


# Words


def edits(word, alphabet):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    made = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in alphabet} | {a + c + b for a, b in cut for c in alphabet}
    return made - {word}


def plain_variants(docs):
    """Brute force over (doc_id, text)."""
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    alphabet = set("".join(words))
    near = {w: [v for v in edits(w, alphabet) if v in words] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def variants(df):
    return sorted((tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_a_neighbourhood_is_whole_and_without_repeats():
    alphabet = "abcé÷"
    for word in ("aabbcc", "éééééé", "abcabcaaa÷", "c" * 9):
        matrix, letters = np.frombuffer(word.encode("latin-1"), np.uint8)[None], np.frombuffer(alphabet.encode("latin-1"), np.uint8)
        made = collections.Counter()
        by_hash = {}
        for kind, _, place, letter, hashed in spelling.neighbourhood(matrix, letters):
            for p, c, h in zip(place.tolist(), letter.tolist(), hashed.tolist(), strict=True):
                result = f"{word[:p]}{chr(c) if kind >= 0 else ''}{word[p + (kind < 1):]}"
                made[result] += 1
                m = np.frombuffer(result.encode("latin-1"), np.uint8)
                by_hash[result] = h == int(spelling.mix((spelling.VALUE[m] * spelling._powers(len(m), spelling.BASE)).sum(dtype=np.uint64)[None] + spelling.step(len(m)))[0])
        assert set(made) == edits(word, alphabet) and set(made.values()) == {1} and all(by_hash.values())


def test_variants_are_brute_forces(spark):
    rng = np.random.default_rng(7)
    base = ["colour", "harbour", "Straße", "fenêtre", "running", "aaaaaaa"]
    docs = []
    for d in range(400):
        words = []
        for _ in range(40):
            w = base[int(rng.integers(len(base)))]
            while rng.random() < 0.3:
                p, c = int(rng.integers(len(w))), "abeé÷Àrs"[int(rng.integers(8))]
                w = [w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :]][int(rng.integers(3))]
            words.append(w)
        docs.append((None if d % 50 == 0 else d // 2, " ".join(words) + "-x1"))
    docs += [(1, None), (2, ""), (3, "tiny"), (4, "Ābcdefg " * 9), (9, "longword" * 5000 + " " + "longword" * 5000), (5, "planted " * 130 + "plantee " * 26 + "plentee " * 5)]
    got = variants(spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n long"))
    assert got == plain_variants(docs)
    assert sum(r[1] is not None for r in got) > 50 and any(r[1] not in (None, r[2]) for r in got)


def test_variants_over_tables(spark, odd_docs, no_docs):
    assert variants(odd_docs) == plain_variants([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert variants(no_docs) == []
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    assert variants(whole) == plain_variants([(r["doc_id"], r["text"]) for r in whole.collect()])


def test_a_crowded_filter_loses_no_pair(spark):
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    vocabulary = spelling.words(whole).cache()
    pairs = lambda **k: sorted(map(tuple, spelling.near_words(vocabulary, **k).collect()))
    assert pairs() == pairs(most_bits=8) != []


def test_chains_of_forms_end(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w7"), ("y", "x")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w40" for w, _ in forms}
