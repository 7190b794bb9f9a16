"""Column functions on paths and texts; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The extensions of files that are read as text.
TEXT_EXTENSIONS = (
    ".asset", ".controller", ".asmdef", ".asmref", ".c", ".cjs", ".cs", ".cpp", ".go", ".h", ".hpp", ".java", ".js", ".jsx", ".json", ".jsonc", ".kt", ".md",
    ".mjs", ".meta", ".php", ".prefab", ".py", ".rb", ".rs", ".toml", ".unity", ".ts", ".tsx", ".txt", ".uss", ".uxml", ".yaml", ".yml",
)
#: Kinds of assets by extension; others are "asset".
ASSET_KINDS = {".prefab": "prefab", ".unity": "scene", ".asset": "scriptable_object", ".asmdef": "assembly_definition", ".asmref": "assembly_reference", ".meta": "meta"}
#: References to assets in a line, and the id that a .meta file states.
GUID, META_GUID = r"(?i)guid:\s*([a-f0-9]{32})", r"(?im)^guid:\s*([a-f0-9]{32})\s*$"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines(text) -> Column:
    """Lines of a text; CR LF and CR end lines too."""
    return F.split(F.regexp_replace(_col(text), "\r\n?", "\n"), "\n", -1)


def content_hash(content) -> Column:
    """SHA-256 of a text or of bytes, in lower-case hexadecimal."""
    return F.sha2(_col(content).cast("binary"), 256)


def joined_hash(*parts) -> Column:
    """SHA-256 of the parts with NUL between them; a null part counts as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]), 256)


def extension(path) -> Column:
    """The extension of a path with its dot, in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(_col(path), r"[^/.][^/]*?(\.[^./]*)$", 1))


def parent_directory(path) -> Column:
    """The folder of a relative path; "." for one without folder."""
    parent = F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", ".").otherwise(parent)


def is_text_file(path) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS)


def asset_kind(path) -> Column:
    own, out = extension(path), F.lit("asset")
    for end, kind in ASSET_KINDS.items():
        out = F.when(own == end, kind).otherwise(out)
    return out


def guids(line) -> Column:
    """The asset ids that a line refers to, in lower case, in order."""
    return F.transform(F.regexp_extract_all(_col(line), F.lit(GUID), 1), F.lower)


def trimmed(text) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def slug(text, fallback: str = "project") -> Column:
    """Lower-case letters and digits, the rest as single underscores; 48 characters at most. Accented letters count as others; ``with_slug`` decomposes them first."""
    out = F.substring(F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 48)
    return F.when(out == "", fallback).otherwise(out)


def with_slug(rows: DataFrame, column: str, name: str = "slug", fallback: str = "project") -> DataFrame:
    """``rows`` with ``slug`` of a column in compatibility decomposition (NFKD): é is e and an accent, full-width letters are plain ones.

    ASCII is its own decomposition and stays in the JVM; others are decomposed once for each different value.
    """

    @F.pandas_udf("string")
    def decomposed(values):
        return values.str.normalize("NFKD")

    own = F.col(column)
    other = rows.select(own.alias("_value")).where(own.rlike(r"[^\x00-\x7F]")).distinct()
    other = other.select("_value", slug(decomposed("_value"), fallback).alias("_slug"))
    return rows.join(other, own == F.col("_value"), "left").withColumn(name, F.coalesce("_slug", slug(own, fallback))).drop("_value", "_slug")


def ranges_overlap(start, end, other_start, other_end) -> Column:
    """Whether two line ranges overlap; one without bounds overlaps all."""
    a, b, c, d = map(_col, (start, end, other_start, other_end))
    return a.isNull() | b.isNull() | c.isNull() | d.isNull() | ((a <= d) & (c <= b))


def cosine(x, y) -> Column:
    """Cosine similarity of two arrays, in doubles; 0 where a norm is 0."""
    x, y = _col(x).cast("array<double>"), _col(y).cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(F.transform(x, lambda v: v * v))) * F.sqrt(total(F.transform(y, lambda v: v * v)))
    return F.when(norm > 0, total(F.zip_with(x, y, lambda a, b: a * b)) / norm).otherwise(0.0)


def excerpt(text, start, end, most: int) -> Column:
    """Lines ``start`` to ``end`` of a text, ``most`` lines and 2000 characters at most, without white space around."""
    first = F.greatest(_col(start), F.lit(1))
    n = F.greatest(F.least(_col(end) - first + 1, F.lit(most)), F.lit(0))
    return F.substring(trimmed(F.array_join(F.slice(lines(text), first.cast("int"), n.cast("int")), "\n")), 1, 2000)


def path_has_term(path, terms) -> Column:
    """Whether a path holds one of the words of ``terms``, of two letters or more, in any case."""
    return F.exists(F.split(_col(terms), r"\s+"), lambda t: (F.length(t) >= 2) & F.contains(F.lower(_col(path)), F.lower(t)))


def position_score(score, rank) -> Column:
    """A hit's score, or one by its rank if it has none; 0.001 at least."""
    return F.greatest(F.lit(0.001), F.coalesce(_col(score), F.lit(1.0) / (F.lit(60) + _col(rank))))


def nearest_root(path, roots: list[str]) -> Column:
    """The longest of a few folders that a path is in, "." being all; null if it is in none."""
    p, out = _col(path), F.lit("." if "." in roots else None).cast("string")
    for root in sorted({*roots} - {"."}, key=lambda r: (len(r), r)):
        out = F.when((p == root) | F.startswith(p, F.lit(f"{root}/")), root).otherwise(out)
    return out


def project_key(path) -> Column:
    """A project's path with forward slashes, none at its end, in lower case."""
    return F.lower(F.regexp_replace(F.replace(_col(path), F.lit("\\"), F.lit("/")), "/+$", ""))
