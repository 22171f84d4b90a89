"""Header normalising and mapping to a canonical schema.

A header is metadata: one table has a handful. The same rules are given twice:
for the columns of one DataFrame (driver side, by name) and as Column
expressions for tables that list the headers of many files.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claravoz.functions import text

# Canonical fields and their aliases, in matching order.
CANONICAL = {
    "user_id": ["userid", "id", "user id", "uid", "user_identifier"],
    "nps": ["nps", "net promoter score", "promoter_score", "satisfaction"],
    "email": ["mail", "email address", "e-mail", "email_address"],
    "timestamp": ["time", "date", "created_at", "datetime", "created", "updated_at"],
}
# Acceptance thresholds of the fuzzy and the vector match.
FUZZY_THRESHOLD = 85
VECTOR_THRESHOLD = 0.78


def load_canonical(spark, path: str) -> dict[str, list[str]]:
    """Canonical map from a file on any Hadoop path with lines ``target: [alias, ...]``."""
    entries: dict[str, list[str]] = {}
    # configuration file: one short line per target
    for row in spark.read.text(path).collect():
        found = re.match(r"\s*([\w-]+)\s*:\s*\[(.*)\]\s*$", row[0])
        if found:
            names = [a.strip().strip("'\"") for a in found[2].split(",")]
            entries[found[1]] = [a for a in names if a]
    return entries


def _candidates(canonical: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    return [
        (target, alias.lower()) for target, aliases in canonical.items() for alias in (target, *aliases)
    ]


def _lookup(canonical: Mapping[str, Sequence[str]]) -> Column:
    """The canonical map as an array literal in matching order; it is configuration, so small."""
    return F.array(*(
        F.struct(F.lit(target).alias("target"), F.lit(alias).alias("alias"))
        for target, alias in _candidates(canonical)
    ))


def _words(c: Column) -> Column:
    return F.concat(F.lit("_"), F.regexp_replace(c, r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def alias_match(c: Column, canonical: Mapping[str, Sequence[str]] = CANONICAL,
                match: str = "tokens") -> Column:
    """First canonical target whose name or alias matches a header.

    ``match="tokens"`` wants whole words of one in the other;
    ``match="contains"`` accepts any substring either way.
    """
    name = F.lower(text.script_strip(c))

    def hit(entry: Column) -> Column:
        alias = entry["alias"]
        if match == "contains":
            return name.contains(alias) | alias.contains(name)
        return _words(name).contains(_words(alias)) | _words(alias).contains(_words(name))

    return F.try_element_at(F.filter(_lookup(canonical), hit), F.lit(1))["target"]


def partial_similarity(a: Column, b: Column) -> Column:
    """Best similarity (0 to 100) of the shorter text to any equally long part of the longer.

    Similarity is one minus the edit distance over the length.
    """
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    size = F.length(short)
    starts = F.sequence(F.lit(1), F.greatest(F.length(long) - size + 1, F.lit(1)))
    distances = F.transform(starts, lambda i: F.levenshtein(F.substr(long, i, size), short))
    return F.when(size == 0, F.lit(0.0)).otherwise(
        (F.lit(1.0) - F.array_min(distances) / size) * 100
    )


def whole_similarity(a: Column, b: Column) -> Column:
    """Similarity (0 to 100) of two whole texts: one minus the edit distance over the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise((F.lit(1.0) - F.levenshtein(a, b) / longer) * 100)


def fuzzy_match(c: Column, canonical: Mapping[str, Sequence[str]] = CANONICAL,
                threshold: float = FUZZY_THRESHOLD, partial: bool = True) -> Column:
    """Target of the most similar alias if it reaches the threshold; earlier targets win ties.

    ``partial`` compares with the best part of the longer text, so that short
    aliases match inside unrelated words; without it whole texts are compared.
    """
    name = F.lower(text.script_strip(c))
    similarity = partial_similarity if partial else whole_similarity
    scored = F.transform(_lookup(canonical), lambda entry, i: F.struct(
        similarity(name, entry["alias"]).alias("score"), (-i).alias("order"),
        entry["target"].alias("target"),
    ))
    best = F.array_max(scored)
    return F.when(best["score"] >= threshold, best["target"])


def map_header(c: Column, canonical: Mapping[str, Sequence[str]] = CANONICAL,
               threshold: float = FUZZY_THRESHOLD, match: str = "tokens") -> Column:
    """Struct (target, method) of a header: alias, then fuzzy, then its own cleaned name."""
    by_alias = alias_match(c, canonical, match)
    by_fuzzy = fuzzy_match(c, canonical, threshold, partial=match == "contains")
    return F.when(by_alias.isNotNull(), F.struct(by_alias.alias("target"), F.lit("alias").alias("method"))) \
        .when(by_fuzzy.isNotNull(), F.struct(by_fuzzy.alias("target"), F.lit("fuzzy").alias("method"))) \
        .otherwise(F.struct(text.header_fallback(c).alias("target"), F.lit("unmapped").alias("method")))


def header_frame(spark, names: Sequence[str]) -> DataFrame:
    """The headers of one table as rows (position, original, normalized)."""
    rows = spark.createDataFrame(list(enumerate(names)), "position int, original string")
    return rows.withColumn("normalized", text.header_name(F.col("original")))


def normalize_headers(df: DataFrame) -> DataFrame:
    """Columns renamed to lower case, stripped, words joined by ``_``."""
    blank = re.compile(f"[{text.WHITE_SPACE}{text.SEPARATORS}]+")
    names = [blank.sub("_", c.lower().strip()) for c in df.columns]
    return df.toDF(*names)


def normalize_values(df: DataFrame) -> DataFrame:
    """The header rule applied to the data of every column; opt-in."""
    return df.select(*(text.normalize_value(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns))


@dataclass(frozen=True)
class MappingReport:
    """What became of every header."""

    original_columns: list[str]
    normalized_columns: list[str]
    mapped_columns: list[str]
    mapping: dict[str, str]
    unmapped_columns: list[str]
    collisions: list[str]

    @property
    def mapped_count(self) -> int:
        return len(self.mapping)

    @property
    def unmapped_count(self) -> int:
        return len(self.unmapped_columns)


def map_columns(df: DataFrame, canonical: Mapping[str, Sequence[str]] = CANONICAL,
                threshold: float = FUZZY_THRESHOLD,
                match: str = "tokens") -> tuple[DataFrame, MappingReport]:
    """Rename the columns of ``df`` to canonical names, with a report.

    Only the first column mapped to a target gets it. Later ones keep their
    own name and are reported as collisions, so that the result can be written.
    """
    spark = df.sparkSession
    headers = header_frame(spark, df.columns)
    # one row per column of the table
    found = headers.withColumn("m", map_header(F.col("normalized"), canonical, threshold, match)) \
        .orderBy("position").collect()
    taken: set[str] = set()
    mapped, mapping, unmapped, collisions = [], {}, [], []
    for row in found:
        own = re.sub(r"\W+", "_", row["normalized"])
        name = row["m"]["target"]
        if row["m"]["method"] == "unmapped":
            unmapped.append(row["normalized"])
        elif name.lower() in taken:
            collisions.append(row["normalized"])
            name = own
        else:
            mapping[row["normalized"]] = name
        base, n = name, 1
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        mapped.append(name)
    report = MappingReport(
        list(df.columns), [r["normalized"] for r in found], mapped, mapping, unmapped, collisions
    )
    return df.toDF(*mapped), report


def merged(reports: Sequence[MappingReport]) -> MappingReport:
    """One report of several tables; a header that several map alike counts once."""
    seen, rows = set(), []
    for report in reports:
        for row in zip(report.original_columns, report.normalized_columns, report.mapped_columns):
            if row not in seen:
                seen.add(row)
                rows.append(row)
    mapping = {k: v for r in reversed(reports) for k, v in r.mapping.items()}
    return MappingReport(
        [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], mapping,
        list(dict.fromkeys(h for r in reports for h in r.unmapped_columns)),
        list(dict.fromkeys(h for r in reports for h in r.collisions if h not in mapping)))


def mapping_report(spark, report: MappingReport) -> DataFrame:
    """The report as rows (original, normalized, mapped, status)."""
    rows = []
    for original, normal, mapped in zip(
        report.original_columns, report.normalized_columns, report.mapped_columns
    ):
        status = "mapped" if normal in report.mapping else (
            "collision" if normal in report.collisions else "unmapped")
        rows.append((original, normal, mapped, status))
    return spark.createDataFrame(rows, "original string, normalized string, mapped string, status string")


def new_headers(unmapped: DataFrame, log: DataFrame, column: str = "header") -> DataFrame:
    """Headers not in the log yet, each once."""
    return unmapped.select(column).distinct().join(log.select(column), column, "left_anti")


def log_new_headers(unmapped: DataFrame, path: str, column: str = "header") -> DataFrame:
    """Append headers the log at ``path`` does not hold; returns the log."""
    spark = unmapped.sparkSession
    try:
        log = spark.read.schema(f"{column} string").json(path)
        fresh = new_headers(unmapped, log, column)
    except Exception as error:  # first use: no log yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = unmapped.select(column).distinct()
    fresh.write.mode("append").json(path)
    return spark.read.schema(f"{column} string").json(path)


def suggest_by_vector(headers: DataFrame, canonical: Mapping[str, Sequence[str]] = CANONICAL,
                      threshold: float = VECTOR_THRESHOLD, column: str = "header") -> DataFrame:
    """Best canonical target by cosine of character-trigram vectors, as pending suggestions.

    Suggestions are never applied by themselves.
    """
    from claravoz.operators.embedding import hashed_vectors
    from claravoz.operators.neighbors import exact_knn

    spark = headers.sparkSession
    aliases = spark.createDataFrame(_candidates(canonical), "target string, alias string")
    known = hashed_vectors(aliases.withColumn("alias_id", F.concat_ws("|", "target", "alias")),
                           "alias", trigrams=True)
    asked = hashed_vectors(headers.select(column).distinct(), column, trigrams=True)
    best = exact_knn(asked, known, k=1, query_id=column, query_vec="embedding",
                     id_col="alias_id", vec_col="embedding")
    cosine = F.lit(1.0) - F.col("distance") / 2
    return best.select(
        column, F.substring_index("alias_id", "|", 1).alias("target"),
        F.round(cosine, 6).alias("similarity"), F.lit("pending").alias("status"),
    ).where(F.col("similarity") >= threshold)


def approve_pending(canonical: DataFrame, approved: DataFrame, version: str) -> DataFrame:
    """Canonical rows (target, alias, version) plus approved pairs under a new version.

    Pairs already known keep their version.
    """
    added = approved.select("target", "alias").distinct().join(
        canonical, ["target", "alias"], "left_anti"
    )
    return canonical.unionByName(added.withColumn("version", F.lit(version)))
