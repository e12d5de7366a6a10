"""Column expressions over labels, paths, spans and JSON texts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label families, in the order in which they are tried. Fixed values.
REAL, FAKE = "bonafide|bona-fide|genuine|real", "spoof|fake|manip|partial|tampered"
#: Two numbers with - or : between, blanks allowed. Fixed pattern.
SPAN = r"(\d+(?:\.\d+)?)\s*[-:]\s*(\d+(?:\.\d+)?)"
NUMBER = r"^\d+(?:\.\d+)?$"
AUDIO_EXTENSIONS = (".wav", ".flac", ".mp3", ".m4a", ".ogg")


def normalize_label(text: Column) -> Column:
    """real or fake by the words in it; real words are looked for first, and real is the default."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.rlike(REAL), "real").when(t.rlike(FAKE), "fake").otherwise("real")


def _struct(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("s"), F.greatest(a, b).alias("e"))


def spans(text: Column) -> Column:
    """All spans of a text as {s, e}, ends in order."""
    a, b = (F.regexp_extract_all(text, F.lit(SPAN), F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: _struct(x["a"].cast("double"), x["b"].cast("double")))


def number_pairs(tokens: Column) -> Column:
    """Tokens that are numbers, taken two by two as {s, e}; a last single one is left out."""
    n = F.transform(F.filter(tokens, lambda t: t.rlike(NUMBER)), lambda t: t.cast("double"))
    starts = F.when(F.size(n) >= 2, F.sequence(F.lit(0), F.size(n) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _struct(F.get(n, i), F.get(n, i + 1)))


def segments(text: Column, tokens: Column) -> Column:
    """Spans, or else pairs of numbers."""
    found = spans(text)
    return F.when(F.size(found) > 0, found).otherwise(number_pairs(tokens))


def milliseconds_to_seconds(segs: Column) -> Column:
    """Divides a row's spans by 1000 where most of them look like milliseconds."""
    votes = F.size(F.filter(segs, lambda x: ((x["s"] > 2000) & (x["e"] > 2000)) | (x["e"] - x["s"] > 5000)))
    needed = F.greatest(F.lit(1), F.floor(F.size(segs) / 2))
    return F.when(votes >= needed, F.transform(segs, lambda x: F.struct((x["s"] / 1000).alias("s"), (x["e"] / 1000).alias("e")))).otherwise(segs)


def first_segments(*choices: Column) -> Column:
    """The first list of spans that is not empty."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in choices], choices[-1])


def json_segments(text: Column) -> Column:
    """Spans of a JSON list of pairs or of {start, end} objects; malformed texts have none."""
    pairs = F.from_json(text, "array<array<double>>")
    objects = F.from_json(text, "array<struct<start:double,end:double>>")
    from_pairs = F.transform(F.filter(pairs, lambda p: F.size(p) >= 2), lambda p: _struct(F.get(p, 0), F.get(p, 1)))
    from_objects = F.transform(F.filter(objects, lambda o: o["start"].isNotNull() & o["end"].isNotNull()), lambda o: _struct(o["start"], o["end"]))
    return first_segments(F.coalesce(from_pairs, F.array().cast("array<struct<s:double,e:double>>")), F.coalesce(from_objects, F.array().cast("array<struct<s:double,e:double>>")))


def split_fields(line: Column) -> Column:
    """Fields of a free-form line: split at commas if it has one, else at white space; empty fields go."""
    parts = F.when(F.contains(line, F.lit(",")), F.split(line, ",")).otherwise(F.split(line, r"\s+"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def has_audio_extension(path: Column) -> Column:
    return extension(path).isin(*AUDIO_EXTENSIONS)


def folder_label(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike("/fake/|spoof"), "fake").otherwise("real")


def detect_dataset(path: Column, names: list[tuple[str, str]], roots: str = "raw|data") -> Column:
    """The first name whose text is in the path, else the folder below a root, else unknown."""
    p = F.lower(path)
    out = None
    for needle, name in names:
        out = F.when(F.contains(p, F.lit(needle)), name) if out is None else out.when(F.contains(p, F.lit(needle)), name)
    folder = F.nullif(F.regexp_extract(path, f"/(?:{roots})/([^/]+)/", 1), F.lit(""))
    return F.coalesce(out, folder, F.lit("unknown"))


def config_hash(canonical_json: Column) -> Column:
    return F.substring(F.sha1(canonical_json), 1, 10)
