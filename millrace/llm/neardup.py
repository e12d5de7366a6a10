"""MinHash near-dedup with ProbMinHash signatures over sets of shingles: banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, discard, only, small_batches, stored
from millrace.llm.components import components
from millrace.llm.wordhash import GOLDEN, U64, each_text, mix, shingles

SHINGLE, THRESHOLD = 5, 0.8
#: 26 bands of 5: a pair at similarity 0.8 shares a band with probability 0.99997.
BANDS, ROWS = 26, 5
#: A bucket with more members left than this is dealt anew by the registers of its next band; a smaller one keeps its key.
SMALL = 8
#: Nodes of one label and element that a row lists.
BLOCK = 1024
#: Ratio between classes of set sizes in _rest_pairs.
SIZE_STEP = 1.05


def weighted_shingles(hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each occurs."""
    return np.unique(shingles(hashes, size), return_counts=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures of ``n`` weighted sets, laid end to end; ``owner`` numbers the set of each element.

    Each element is a Poisson process whose rate is its weight: its arrivals follow each other by exponential gaps, and each
    hits one register at random, which keeps the earliest. Two sets then agree in a register with a probability that is
    their probability Jaccard. An element ends once its next arrival is later than every register of its set, so most end
    after an arrival or two, and the work is about elements plus registers instead of their product. All draws are functions
    of the element and the arrival's number.
    """
    times = np.full(n * registers, np.inf)
    keep = np.zeros(n * registers, U64)
    alive, at, rate = elements, np.zeros(len(elements)), weights.astype(np.float64)
    k = 0
    while len(alive):
        k += 1
        draw = mix(alive + np.array([k], U64) * GOLDEN)
        at = at - np.log(_unit(draw)) / rate
        going = at < times.reshape(n, registers).max(axis=1)[owner]
        alive, at, rate, draw, owner = alive[going], at[going], rate[going], draw[going], owner[going]
        register = owner * registers + (mix(draw ^ GOLDEN) % U64(registers)).astype(np.int64)
        before = times[register]
        np.minimum.at(times, register, at)
        won = (at == times[register]) & (at < before)
        keep[register[won]] = alive[won]
    return keep.reshape(n, registers)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each band's registers and its number; a row per signature."""
    parts = signatures.reshape(-1, bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64) * GOLDEN), parts.shape[:2])
    for k in range(rows):
        out = mix(out + parts[:, :, k] * GOLDEN)
    return out.view(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """What the registers estimate: the sum over common elements i of 1 / sum over all j of max(wa_j / wa_i, wb_j / wb_i).

    Elements are sorted and distinct. With all weights 1 it is the Jaccard similarity of the sets.
    """
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # max(x_j / x_i, y_j / y_i) is the first where x_j / y_j is at least x_i / y_i: suffix sums of x, prefix sums of y.
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = np.cumsum(x[::-1])[::-1]
    below = np.concatenate([[0.0], np.cumsum(y)[:-1]])
    return float(np.sum(1.0 / ((above + only_a) / x + (below + only_b) / y)))


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over words and their places."""
    place = np.arange(1, len(hashes) + 1, dtype=U64)
    return tuple(int(mix(hashes + place * U64(k)).sum(dtype=U64).view(np.int64)) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))


def _sign(batches: Iterator[pa.RecordBatch], counted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.zeros((batch.num_rows, 2), np.int64)
        numbers, sets, weights = [], [], []
        for i, hashes, _, _ in each_text(batch.column("text")):
            if len(hashes):
                prints[i] = fingerprint(hashes)
                elements, counts = weighted_shingles(hashes)
                numbers.append(i)
                sets.append(elements)
                weights.append(counts if counted else np.ones(len(elements), np.int64))
        bands: list = [None] * batch.num_rows
        if sets:
            owner = np.repeat(np.arange(len(sets)), [len(e) for e in sets])
            signatures = prob_minhash(np.concatenate(sets), np.concatenate(weights), owner, len(sets), BANDS * ROWS)
            for i, keys in zip(numbers, band_keys(signatures), strict=True):
                bands[i] = keys
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "fa", "fb", "bands"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, counts = [], []
        for _, hashes, _, _ in each_text(batch.column("text")):
            elements, n = weighted_shingles(hashes)
            sets.append(elements.tobytes())
            counts.append(n.astype(np.int32).tobytes() if (n > 1).any() else b"")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "text_hash", "shingles", "counts"])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, counted: bool) -> Iterator[pa.RecordBatch]:
    def unpack(elements: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        e = np.frombuffer(elements, U64)
        return e, np.frombuffer(counts, np.int32) if counted and counts else np.ones(len(e), np.int32)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("shingles", "counts", "shingles_b", "counts_b"))
        linked = [probability_jaccard(*unpack(s, n), *unpack(t, m)) >= threshold - 1e-12 for s, n, t, m in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _links(pairs: DataFrame, sets: DataFrame, threshold: float, counted: bool) -> DataFrame:
    """Pairs (a, b) with their exact comparison."""
    side = lambda x, mark: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"shingles{mark}"), F.col("counts").alias(f"counts{mark}"))
    return pairs.join(side("a", ""), "a").join(side("b", "_b"), "b").mapInArrow(lambda x: _compare(x, threshold, counted), "a long, b long, linked boolean")


def _elements(batches: Iterator[pa.RecordBatch], counted: bool) -> Iterator[pa.RecordBatch]:
    """A row for each element of a set with its share of the set's weight and the number of elements; of a few sets at a time."""
    for batch in batches:
        for node, label, elements, counts in zip(*(batch.column(c).to_pylist() for c in ("node", "label", "shingles", "counts")), strict=True):
            e = np.frombuffer(elements, np.int64)
            w = np.frombuffer(counts, np.int32) if counted and counts else np.ones(len(e), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), node)), pa.array(np.full(len(e), label)), pa.array(e), pa.array(w / w.sum()), pa.array(np.full(len(e), len(e)))], ["node", "label", "element", "share", "size"])


def _rest_pairs(left: DataFrame, sets: DataFrame, threshold: float, counted: bool) -> DataFrame:
    """All pairs (a, b) of nodes ``left`` (node, label) of different labels that can reach ``threshold``: exact, without buckets.

    The probability Jaccard of two sets is at most the sum over their elements of the lesser share of either's weight. Elements have
    one order for all: those of one label alone, which no pair has in common, come first, then the rarest. What two sets have in common lies
    from their first common element on in both; so at that element either has ``threshold`` of its weight left. For plain sets of m and n
    elements it is more: t / (1 + t) * (m + n) common elements are needed, so a set with r elements left can only meet one of at
    most r * (1 + t) / t - m. Each element is therefore dealt by the classes of size (SIZE_STEP) that its set can still meet there, and
    pairs meet where each is in reach of the other. A set in a loose group is mostly used up by what is its own before it comes to
    what the group shares, so passages or frames of many texts make no pairs. Members of one label are listed in blocks and not paired.
    """
    rows = left.join(sets, "node").mapInArrow(lambda x: _elements(x, counted), "node long, label long, element long, share double, size long")
    rows = stored(rows, "elements")
    often = rows.groupBy("element", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("element").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("often"))
    before = Window.partitionBy("node").orderBy("alone", "often", "element").rowsBetween(Window.unboundedPreceding, -1)
    ordered = rows.join(often, "element").withColumn("alone", F.when(F.col("labels") == 1, 0).otherwise(1))
    begins = ordered.withColumn("left", 1 - F.coalesce(F.sum("share").over(before), F.lit(0.0))).filter((F.col("left") >= threshold - 1e-9) & (F.col("labels") > 1))
    needed = threshold / (1 + threshold)
    if counted:
        dealt = begins.withColumn("own", F.lit(0)).withColumn("other", F.lit(0))
    else:
        grade = lambda n: F.floor(F.log(n) / np.log(SIZE_STEP)).cast("int")
        most = F.least(F.col("left") * F.col("size") / needed - F.col("size"), F.col("size") / threshold)
        reach = F.sequence(grade(F.col("size") * (threshold - 1e-9)), grade(most + 1e-6 * F.col("size")))
        dealt = begins.withColumn("own", grade(F.col("size"))).withColumn("other", F.explode(reach))
    dealt = dealt.select("element", "own", "other", "label", F.struct("node", "size", "left").alias("p"))
    numbered = dealt.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy("element", "own", "other", "label").orderBy("p.node")) - 1) / BLOCK))
    blocks = stored(numbered.groupBy("element", "own", "other", "label", "_block").agg(F.collect_list("p").alias("held")), "blocks")
    facing = blocks.select(F.col("element"), F.col("other").alias("own"), F.col("own").alias("other"), F.col("label").alias("label_b"), F.col("held").alias("held_b"))
    both = blocks.join(facing, ["element", "own", "other"]).filter("own < other AND label <> label_b OR own = other AND label < label_b")
    pairs = both.select(F.explode("held").alias("p"), "held_b").select("p", F.explode("held_b").alias("q"))
    if not counted:
        fits = F.least(F.col("p.left") * F.col("p.size"), F.col("q.left") * F.col("q.size")) >= needed * (F.col("p.size") + F.col("q.size")) - 1e-6
        pairs = pairs.filter(fits)
    return pairs.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def _forest_links(members: DataFrame, bands: DataFrame, sets: DataFrame, threshold: float, counted: bool) -> DataFrame:
    """Links (a, b) between nodes, enough to join the groups that buckets show.

    ``members``: node, band, key, n (members of the bucket); ``bands``: node and all its keys. A round compares the members of
    each bucket with one leader, unless they are of its group already: in the first round the member with most company over
    all its bands, then one by a hash of the round. Groups are those of the first round's links, which join most copies of a
    text. The leader leaves the bucket, which is done with if those left are one group. Other buckets of more than SMALL
    members are dealt anew by their next band's key too, so that members meet others ever nearer to them, as in a forest of
    prefix trees; the rest keep their key until each has led. So a round makes at most a pair per member and bucket, however
    large or loose the bucket is, and no pair is compared twice. Pairs of large loose buckets that the deals part before either
    leads are found at last by _rest_pairs, so every link of a bucket joins its ends.
    """
    active = members.withColumn("depth", F.lit(1)).withColumn("label", F.col("node"))
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    active = stored(active.drop("n").join(company, "node"), "buckets")
    seen, links, round_ = None, [], 0
    while True:
        rank = F.struct(-F.col("company"), F.col("node")) if round_ == 0 else F.struct(F.xxhash64(F.lit(round_), "node"), F.col("node"))
        heads = active.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most"), F.min_by(F.struct("node", "label"), rank).alias("leader")).filter("n > 1 AND least <> most")
        # Those left without the leader; the bucket's groups are counted anew in the next round.
        before, active = active, stored(active.join(heads.select("key", "n", "leader"), "key"), "buckets")
        discard(before)
        pairs = active.filter("label <> leader.label").select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        compared = stored(_links(pairs, sets, threshold, counted), "compared")
        seen = compared.select("a", "b") if seen is None else seen.unionByName(compared.select("a", "b"))
        links.append(compared.filter("linked").select("a", "b"))
        left = active.filter("node <> leader.node AND n > 2")
        if not left.limit(1).count():
            break
        wide = (F.col("n") - 1 > SMALL) & (F.col("depth") < BANDS)
        longer = F.xxhash64("key", F.get("bands", F.pmod(F.col("band") + F.col("depth"), F.lit(BANDS)).cast("int")))
        dealt = left.filter(wide).join(bands, "node").select("node", "band", longer.alias("key"), (F.col("depth") + 1).alias("depth"), "company")
        kept = left.filter(~wide).select("node", "band", "key", "depth", "company")
        following = dealt.union(kept)
        if round_ == 0:
            labels = components(links[0])
        before, active = active, stored(following.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "buckets")
        discard(before)
        round_ += 1
    found = cut(reduce(DataFrame.unionByName, links))
    discard(active)
    # Buckets that may have been dealt, and are still of several groups.
    large = members.filter(F.col("n") - 1 > SMALL)
    if not large.limit(1).count():
        return found
    labels = components(found)
    large = large.select("node", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = large.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
    left = stored(large.join(mixed.select("key"), "key", "left_semi").select("node", "label").distinct(), "left")
    if left.limit(1).count():
        pairs = stored(_rest_pairs(left, sets, threshold, counted).join(seen, ["a", "b"], "left_anti"), "rest")
        found = found.unionByName(cut(_links(pairs, sets, threshold, counted).filter("linked").select("a", "b")))
        discard(pairs)
    discard(left)
    return found


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "sets") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_class (least doc_id with the same words), cluster (least
    doc_id of the group that links join), n_links (verified links of the class to other classes), text_hash (of the text as it is) and has_words.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; shingles are five words (fewer words, but not
    none: all of them). Candidates share a band of ProbMinHash registers; two texts are linked where the similarity
    that the registers estimate, the probability Jaccard of their weighted shingles, is at least ``threshold``. With ``weights``
    "sets" each distinct shingle weighs 1 in every text, which makes it the Jaccard similarity of the sets; with "counts" it weighs as
    often as it occurs, so texts that differ by a passage repeated many times are apart. Signatures and verification always use
    the same weights. Texts without words, and rows without doc_id, stand alone. Rows that repeat a doc_id are each judged by
    their own text. Very long texts are hashed whole, one at a time. Ties go to the least doc_id. Extra columns are ignored.

    Copies are one class before anything else. Classes are compared along the forest of _forest_links, linear in the buckets'
    members in each of its rounds; members of a group found are not compared again. What large buckets then hold of different groups
    is compared by its rarest shingles and sizes, so two texts that are linked and share a bucket are of one group. n_links counts the links so verified.
    """
    if weights not in ("sets", "counts"):
        raise ValueError(f"weights: {weights}")
    counted = weights == "counts"
    small_batches(docs.sparkSession)
    base = only(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    signed = stored(base.mapInArrow(lambda x: _sign(x, counted), "doc_id long, text_hash long, fa long, fb long, bands array<long>"), "signatures")
    worded = signed.filter(F.col("bands").isNotNull() & F.col("doc_id").isNotNull())
    first = F.struct("doc_id", "text_hash")
    classes = worded.groupBy("fa", "fb").agg(F.min(first).alias("_first"), F.min_by("bands", first).alias("bands"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "fa", "fb", "_first.doc_id", "_first.text_hash", "bands"), "classes")
    rows = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(rows.join(shared, "key"), "members")
    met = stored(classes.join(members.select("node").distinct(), "node", "left_semi"), "met")
    needed = met.select("node", "doc_id", "text_hash")
    texts = base.join(needed.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi")
    made = texts.mapInArrow(_shingle_rows, "doc_id long, text_hash long, shingles binary, counts binary")
    sets = stored(made.join(needed, ["doc_id", "text_hash"]).select("node", "shingles", "counts").dropDuplicates(["node"]), "shingles")
    links = _forest_links(members, met.select("node", "bands"), sets, threshold, counted)
    discard(members, met, sets)
    labels = components(links)
    degree = links.select(F.explode_outer(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = classes.select("node", "fa", "fb", F.col("doc_id").alias("text_class")).join(labels, "node", "left").join(degree, "node", "left")
    known = known.select("fa", "fb", "text_class", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = known.join(known.groupBy("label").agg(F.min("text_class").alias("cluster")), "label").drop("label")
    whole = signed.select("doc_id", "text_hash", "fa", "fb", (F.col("bands").isNotNull() & F.col("doc_id").isNotNull()).alias("_worded"))
    joined = whole.filter("_worded").join(named, ["fa", "fb"])
    alone = whole.filter("NOT _worded").withColumn("text_class", F.col("doc_id")).withColumn("cluster", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long"))
    columns = ["doc_id", "text_class", "cluster", "n_links", "text_hash", F.col("_worded").alias("has_words")]
    return joined.select(*columns).unionByName(alone.select(*columns))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns: of each group one row, that of its least doc_id; all rows without
    doc_id or words. Rows are told apart by doc_id and text, and of rows alike in both one stays."""
    judged = near_duplicates(docs, threshold).filter("has_words AND doc_id IS NOT NULL").groupBy("cluster", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    winners = judged.groupBy(F.col("cluster").alias("won")).agg(F.min(F.struct("doc_id", "text_hash")).alias("winner"))
    losers = judged.join(winners, F.col("cluster") == F.col("won")).withColumn("_once", F.struct("doc_id", "text_hash") == F.col("winner")).filter("n > 1 OR NOT _once")
    gone = losers.select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_hash"), F.col("_once").alias("__gone_once"))
    same = (F.col("doc_id").cast("long") == F.col("__gone")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__gone_hash"))
    once = docs.join(gone.filter("__gone_once"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(gone, same, "left_anti").unionByName(once)
