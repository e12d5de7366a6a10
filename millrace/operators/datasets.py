"""Manifests of whole datasets: protocol sources as ranked rows, lower ranks removed by joins, tokens resolved for all datasets at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.manifests import WHOLE


@dataclass(frozen=True)
class Rule:
    """A source of a kind of dataset: which files it is, where their tokens are looked up, and when it counts.

    ``pattern`` is met by a file's path below its dataset's root. ``homes`` are (subset, folder below the root or an empty
    text) in the order in which they are tried. Of one kind's sources only those of the least ``tier`` that has a file count.
    ``real_spans`` keeps the spans of real entries.
    """

    kind: str
    source: str
    pattern: str
    homes: tuple[tuple[str, str], ...]
    tier: int = 0
    real_spans: bool = False


BOTH = (("train", "train"), ("dev", "dev"))
#: Names of label files, folders and suffixes are fixed values. Rules are tried in order; a file takes the first that it meets.
RULES = (
    Rule("add", "official train", r"^label/train_label\.txt$", (("train", "train"),)),
    Rule("add", "official dev", r"^label/dev_label\.txt$", (("dev", "dev"),)),
    Rule("add", "json", r"(?i)^(label|protocols)/.*\.json$", BOTH, real_spans=True),
    Rule("add", "extra", r"(?i)^(label|protocols)/.*\.(csv|tsv|txt|lst)$", BOTH),
    Rule("partial", "protocol", r"(?i)^protocols/.*\.(csv|tsv|txt|json)$", BOTH),
    Rule("had", "table", r"(?i)\.(csv|tsv)$", (("train", "train"), ("train", "dev"), ("train", ""))),
    Rule("had", "text", r"(?i)\.txt$", (("train", ""),), tier=1),
)
#: Kinds whose clips may be labelled by their folders where no protocol names any.
BY_FOLDER = ("partial",)
#: What a manifest writes below its root; never read as a protocol. Fixed value.
OWN = "_manifests/"


def roots(files: DataFrame, bases: DataFrame, wanted: tuple[str, ...] = ("train", "dev", "label"), inner: str = "ADD_train_dev") -> DataFrame:
    """(dataset, kind, root) of bases (dataset, kind, base) by the files (dataset, path) below them: of kind add the folder ``inner`` below
    the base if that holds files and the base lacks one of the ``wanted`` folders; else the base itself."""
    at = files.join(bases, "dataset").withColumn("rel", F.substr("path", F.length("base") + 2))
    seen = at.groupBy("dataset").agg(*[F.bool_or(F.startswith("rel", F.lit(f"{w}/"))).alias(f"_{i}") for i, w in enumerate(wanted)], F.bool_or(F.startswith("rel", F.lit(f"{inner}/"))).alias("_inner"))
    whole = F.array_min(F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(False)) for i in range(len(wanted))]))
    moved = (F.col("kind") == "add") & ~whole & F.coalesce("_inner", F.lit(False))
    return bases.join(seen, "dataset", "left").select("dataset", "kind", F.when(moved, F.concat("base", F.lit(f"/{inner}"))).otherwise(F.col("base")).alias("root"))


def below(files: DataFrame, found: DataFrame) -> DataFrame:
    """(dataset, kind, root, path, rel) of the files (dataset, path) below their dataset's root."""
    at = files.select("dataset", "path").join(found, "dataset").filter(F.startswith("path", F.concat("root", F.lit("/"))))
    return at.select("dataset", "kind", "root", "path", F.substr("path", F.length("root") + 2).alias("rel"))


def prefer(rows: DataFrame, held: DataFrame, key: str, rank: str) -> DataFrame:
    """The rows of each key that have no larger ``rank`` than the least that ``held`` has of it; all rows of a key that ``held`` lacks."""
    least = held.groupBy(F.col(key).alias("_key")).agg(F.min(rank).alias("_least"))
    return rows.join(least, F.col(key).eqNullSafe(F.col("_key")), "left").filter(F.col("_least").isNull() | (F.col(rank) <= F.col("_least"))).drop("_key", "_least")


def sources(placed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(dataset, root, file, rule) of the protocol files that count among files placed below their roots; ``rule`` is a place in ``rules``."""
    own = F.startswith("rel", F.lit(OWN))
    rule = F.coalesce(*[F.when(~own & (F.col("kind") == r.kind) & F.col("rel").rlike(r.pattern), F.lit(i)) for i, r in enumerate(rules)])
    known = placed.withColumn("rule", rule).filter("rule IS NOT NULL").withColumn("tier", F.get(F.lit([r.tier for r in rules]), F.col("rule")))
    return prefer(known, known, "dataset", "tier").select("dataset", "root", F.col("path").alias("file"), "rule")


def _keys(token: Column, root: Column, folder: str) -> list[Column]:
    """Index keys of a token looked up under a folder of the root: its path there, its path beside the folder, its name, its name with .wav."""
    t = F.lower(F.trim(token))
    base = F.concat(root, F.lit(f"/{folder}")) if folder else root
    beside = root if folder else F.regexp_replace(root, "/[^/]*$", "")
    paths = [F.when(token.rlike(r"[/\\]"), F.concat(F.lit(WHOLE), b, F.lit("/"), token)) for b in (base, beside)]
    return [*paths, t, F.when(~t.endswith(".wav"), F.concat(t, F.lit(".wav")))]


def resolved(entries: DataFrame, used: DataFrame, audio: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(dataset, rule, subset, path, label, segs) of entries (file, token, last, label, segs) of the files in ``used``.

    ``audio`` has (dataset, path). An entry's token, then its ``last``, is looked up at each home of its file's rule in turn; the
    first hit counts, and of files that share a name the least path. Entries that meet nothing go, and null tokens and lasts meet nothing.
    One equi-join of distinct (dataset, key), whatever the number of rules, homes or datasets; a token that many entries share is looked up once.
    """
    named = F.array_distinct(F.array(T.base_name(F.col("path")), T.stem(F.col("path")), F.concat(F.lit(WHOLE), F.col("path"))))
    index = audio.select("dataset", F.explode(named).alias("_key"), "path").groupBy("dataset", "_key").agg(F.min("path").alias("path"))
    at = entries.join(used, "file")
    asked = at.select("dataset", "root", "rule", "token", "last").distinct()
    tries = None
    for i, r in enumerate(rules):
        keys = [(subset, c) for subset, folder in r.homes for name in ("token", "last") for c in _keys(F.col(name), F.col("root"), folder)]
        each = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(subset).alias("subset"), c.alias("key")) for p, (subset, c) in enumerate(keys)])
        tries = F.when(F.col("rule") == i, each) if tries is None else tries.when(F.col("rule") == i, each)
    keyed = asked.withColumn("_t", F.explode(F.filter(tries, lambda x: x["key"].isNotNull()))).withColumn("_key", F.col("_t.key"))
    hits = keyed.join(index, ["dataset", "_key"]).groupBy("dataset", "rule", "token", "last").agg(F.min_by(F.struct(F.col("_t.subset").alias("subset"), "path"), "_t.p").alias("hit"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("dataset", "rule", "token", "last")]
    met = at.alias("a").join(hits.alias("b"), same[0] & same[1] & same[2] & same[3])
    return met.select("a.dataset", "a.rule", "hit.subset", "hit.path", "a.label", "a.segs")


def manifests(entries: DataFrame, files: DataFrame, bases: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Clips (dataset, subset, path, label) and segments (dataset, subset, path, start_sec, end_sec) of many datasets in one plan, each row once.

    ``bases`` has (dataset, kind, base), ``files`` (dataset, path) and ``entries`` what ``protocols.entries`` reads. Files outside every
    root and files that no rule knows are not read as protocols. A clip that two entries label differently is two rows, as written.
    A dataset of a kind in ``BY_FOLDER`` none of whose entries meets a file has the audio below train and dev, labelled by its folders.
    Empty tables give empty manifests.
    """
    placed = below(files, roots(files, bases))
    audio = placed.filter(T.has_audio_extension(F.col("path")) & ~F.startswith("rel", F.lit(OWN)))
    # Kind add looks below train and dev alone.
    heard = audio.filter((F.col("kind") != "add") | F.col("rel").rlike("^(train|dev)/"))
    met = resolved(entries, sources(placed, rules), heard.select("dataset", "path"), rules)
    named = met.select("dataset", "subset", "path", "label", F.lit(0).alias("tier"))
    folder = F.element_at(F.split("rel", "/"), 1)
    by_folder = audio.filter(F.col("kind").isin(*BY_FOLDER) & folder.isin("train", "dev")).select("dataset", folder.alias("subset"), "path", T.folder_label(F.col("path")).alias("label"), F.lit(1).alias("tier"))
    clips = named.unionByName(prefer(by_folder, named, "dataset", "tier")).drop("tier").dropDuplicates()
    spoken = F.get(F.lit([r.real_spans for r in rules]), F.col("rule"))
    segments = met.filter((F.col("label") == "fake") | spoken).select("dataset", "subset", "path", F.explode("segs").alias("x"))
    return clips, segments.select("dataset", "subset", "path", F.col("x.s").alias("start_sec"), F.col("x.e").alias("end_sec")).dropDuplicates()
