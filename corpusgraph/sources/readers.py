"""Readers of corpora, knowledge-graph files and tables, each as one distributed scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.references import chapter_and_verse, parse_dotted

VERSE = "book string, chapter int, verse int, text string"

_BY_ARRAYS = "array<struct<abbrev: string, chapters: array<array<string>>>>"
_BY_OBJECTS = "struct<books: array<struct<name: string, chapters: array<struct<verses: array<struct<verse: int, text: string>>>>>>>"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and VERSE columns from JSON files of either shape: a list of books with chapters of texts,
    or an object with books, chapters and numbered verses.  Empty texts are dropped and others trimmed."""
    files = _whole(spark, path)
    is_list = F.ltrim("value").startswith("[")
    lists = files.where(is_list).select("file", F.explode(F.from_json("value", _BY_ARRAYS)).alias("b"))
    lists = lists.select("file", F.col("b.abbrev").alias("book"), F.posexplode("b.chapters").alias("c", "vs"))
    lists = lists.select("file", "book", (F.col("c") + 1).alias("chapter"), F.posexplode("vs").alias("v", "text"))
    lists = lists.select("file", "book", "chapter", (F.col("v") + 1).alias("verse"), F.trim("text").alias("text"))
    books = files.where(~is_list).select("file", F.explode(F.from_json("value", _BY_OBJECTS)["books"]).alias("b"))
    books = books.select("file", F.col("b.name").alias("book"), F.posexplode("b.chapters").alias("c", "x"))
    books = books.select("file", "book", (F.col("c") + 1).alias("chapter"), F.explode("x.verses").alias("v"))
    books = books.select("file", "book", "chapter", F.col("v.verse").alias("verse"), F.trim("v.text").alias("text"))
    return lists.unionByName(books).where(F.col("text") != "")


def language_of_file(name: Column | str, patterns: dict[str, str], default: str = "unknown") -> Column:
    """The language whose pattern a file's name matches first."""
    name = F.col(name) if isinstance(name, str) else name
    chain = None
    for language, pattern in patterns.items():
        test = F.lower(name).rlike(pattern)
        chain = F.when(test, language) if chain is None else chain.when(test, language)
    return F.lit(default) if chain is None else chain.otherwise(default)


def by_manifest(spark: SparkSession, folder: str, schema: str, manifest: str = "meta.json") -> DataFrame:
    """The JSON files that the manifest lists under ``namespaces``, with ``namespace``; lists or single objects.

    Spark doesn't see files whose names start with an underscore, so neither may the manifest's.
    """
    listed = spark.read.schema("namespaces array<string>").json(f"{folder}/{manifest}", multiLine=True)
    names = [r["n"] for r in listed.select(F.explode("namespaces").alias("n")).collect()]  # as many as there are files
    paths = [f"{folder}/{n}.json" for n in names if re.fullmatch(r"[\w-]+", n)]
    rows = spark.read.schema(schema).json(paths, multiLine=True)
    return rows.withColumn("namespace", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def entries_by_path(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON files in all subfolders, with book, chapter and verse from names such as ``rom_12_01.json``."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder, multiLine=True)
    return rows.withColumn("_p", chapter_and_verse(F.col("_metadata.file_name"))).select("*", "_p.*").drop("_p")


def letters(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON files in folders by first letter (``A/...json``), with ``letter``."""
    rows = spark.read.schema(schema).json(f"{folder}/[A-Z]/*.json", multiLine=True)
    return rows.withColumn("letter", F.regexp_extract(F.col("_metadata.file_path"), r"/([A-Z])/[^/]+$", 1))


def edges_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``from_ref``, ``to_ref``, ``votes``, ``source`` of tab-separated lines; comments (#) and broken lines are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    parts = F.split("value", "\t")
    rows = lines.where(F.size(parts) >= 4).select(
        parts[0].alias("from_ref"), parts[1].alias("to_ref"), F.trim(parts[2]).try_cast("int").alias("votes"), F.trim(parts[3]).alias("source")
    )
    return rows.where(F.col("votes").isNotNull() & (F.col("from_ref") != "") & (F.col("to_ref") != ""))


def scraped_commentaries(spark: SparkSession, path: str, codes: dict[str, str]) -> DataFrame:
    """One row a commentary of files ``{"verse": "LK 1:1", "commentaries": [{author, period, text}]}``.

    *codes* gives books for their codes; files that are no such JSON, and unknown books, are left out.
    """
    kind = "struct<verse: string, commentaries: array<struct<author: string, period: string, text: string>>>"
    parsed = _whole(spark, path).select(F.from_json("value", kind).alias("j")).where("j.verse IS NOT NULL")
    place = chapter_and_verse("j.verse")
    rows = parsed.select(place.alias("p"), F.explode("j.commentaries").alias("c"))
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in (pair[0].lower(), pair[1])])
    out = rows.select(F.try_element_at(table, F.col("p.book")).alias("book"), "p.chapter", "p.verse", "c.*")
    return out.where(F.col("book").isNotNull() & (F.length(F.trim("text")) >= 10))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``title`` (the first heading) and ``fields`` of two-column tables and ``**Key:** value`` lines."""
    files = _whole(spark, path)
    pairs = F.concat(
        F.regexp_extract_all("value", F.lit(r"(?m)^\|\s*([^|\n]+?)\s*\|\s*[^|\n]+?\s*\|\s*$"), F.lit(1)),
        F.regexp_extract_all("value", F.lit(r"(?m)^\*\*([^*:]+):\*\*\s*.+$"), F.lit(1)),
    )
    values = F.concat(
        F.regexp_extract_all("value", F.lit(r"(?m)^\|\s*[^|\n]+?\s*\|\s*([^|\n]+?)\s*\|\s*$"), F.lit(1)),
        F.regexp_extract_all("value", F.lit(r"(?m)^\*\*[^*:]+:\*\*\s*(.+)$"), F.lit(1)),
    )
    entries = F.filter(F.arrays_zip(F.transform(pairs, F.lower).alias("k"), values.alias("v")), lambda x: ~x["k"].rlike("^:?-+:?$"))
    # Of a key that occurs twice the first counts.
    firsts = F.filter(entries, lambda x, i: F.array_position(F.transform(entries, lambda y: y["k"]), x["k"]) == i + 1)
    return files.select("file", F.regexp_extract("value", r"(?m)^#\s+(.+?)\s*$", 1).alias("title"), F.map_from_entries(firsts).alias("fields"))


def fenced_json(text: Column | str, schema: str) -> Column:
    """The JSON object in a text around it, such as a fenced block; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in *parts* ranges of a numeric key, read side by side; the driver must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high)
    return reader.options(numPartitions=parts, **options).load()


_ARTWORK = "key string, title string, artist string, artist_birth string, artist_death string, artist_nations array<string>, artist_movements array<string>, " \
    "completion string, styles array<string>, genres array<string>, media array<string>, width int, height int, img_url string"
_TAGS = "_meta struct<key: string, model: string>, characters array<struct<name: string, type: string>>, event string, tags array<string>, symbols array<string>, " \
    "description string, theological_description string, scripture_refs array<struct<ref: string, relevance: string, reason: string>>, scene_type string, mood array<string>, period string"


def artworks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Images of JSON files, one each, and their artists with their numbers of images (``image_count``).

    Files without an artist or a key are left out; of one key the first file by name counts, of one artist the first facts by file.  A year is one
    only if it is a whole number; titles are cut at 500 characters, and lists that are missing are empty.
    """
    rows = spark.read.schema(_ARTWORK).json(f"{folder}/*.json", multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    rows = rows.withColumn("artist", F.trim("artist")).where((F.col("artist") != "") & (F.col("key") != ""))
    first = rows.groupBy("key").agg(F.min_by(F.struct("*"), "file").alias("r")).select("r.*")
    full = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    images = first.select(
        "key", F.substring(F.coalesce("title", F.lit("")), 1, 500).alias("title"), "artist", F.when(F.col("completion").rlike("^-?[0-9]+$"), F.col("completion").try_cast("int")).alias("year"),
        *map(full, ("styles", "genres", "media")), "width", "height", F.coalesce("img_url", F.lit("")).alias("image_url"),
    )
    facts = rows.groupBy("artist").agg(F.min_by(F.struct("artist_birth", "artist_death", "artist_nations", "artist_movements"), "file").alias("f"))
    counts = images.groupBy("artist").agg(F.count("*").alias("image_count"))
    artists = facts.join(counts, "artist", "left").select(
        "artist", F.coalesce("f.artist_birth", F.lit("")).alias("birth"), F.coalesce("f.artist_death", F.lit("")).alias("death"),
        F.coalesce("f.artist_nations", F.array().cast("array<string>")).alias("nations"), F.coalesce("f.artist_movements", F.array().cast("array<string>")).alias("movements"),
        F.coalesce("image_count", F.lit(0).cast("long")).alias("image_count"),
    )
    return images, artists


def image_tags(spark: SparkSession, folder: str, images: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was found on images (JSON files, one each), and their links to passages: ``key``, ``book``, ``chapter``, ``verse``, ``end_verse``, ``relevance``, ``reason``.

    Tags of unknown images are left out, and of one image the first file by name counts.  References such as ``BOOK.c.v-v`` to *books* (``book``) become
    links, once for each place at which they begin; others are left out.
    """
    rows = spark.read.schema(_TAGS).json(f"{folder}/*.json", multiLine=True).withColumns({"key": F.col("_meta.key"), "file": F.col("_metadata.file_name")})
    known = rows.where(F.col("key") != "").join(images.select("key"), "key", "left_semi")
    first = known.groupBy("key").agg(F.min_by(F.struct("*"), "file").alias("r")).select("r.*")
    tags = first.select(
        "key", "characters", F.substring("event", 1, 500).alias("event"), F.col("tags").alias("tag_list"), "symbols", "description", "theological_description",
        F.substring("scene_type", 1, 50).alias("scene_type"), F.col("mood").alias("moods"), F.substring("period", 1, 100).alias("period"), F.col("_meta.model").alias("model"),
    )
    refs = first.select("key", F.posexplode("scripture_refs").alias("at", "s")).withColumn("p", parse_dotted("s.ref")).join(books.select(F.col("book").alias("_book")), F.col("p.book") == F.col("_book"))
    links = refs.where("p.chapter IS NOT NULL").groupBy("key", F.col("_book").alias("book"), F.col("p.chapter").alias("chapter"), F.col("p.verse").alias("verse"))
    best = links.agg(F.min_by(F.struct(F.col("p.end_verse"), F.coalesce("s.relevance", F.lit("primary")).alias("relevance"), F.coalesce("s.reason", F.lit("")).alias("reason")), "at").alias("l"))
    return tags, best.select("key", "book", "chapter", "verse", "l.*")


def seed_names(known: DataFrame, seeds: DataFrame, books: DataFrame, key: str = "book") -> tuple[DataFrame, DataFrame]:
    """Names of *books* after seeding, and what could not be seeded.

    *seeds* has a row for each book (``book``), ``language``, ``name`` and ``abbreviation``.  A book that already has a name in a language, for no certain
    version, keeps it; seeds of unknown books are the second table.
    """
    generic = known.where("version IS NULL").select(key, "language").distinct()
    new = seeds.dropDuplicates([key, "language"]).join(books.select(key), key, "left_semi").join(generic, [key, "language"], "left_anti")
    made = known.unionByName(new.select(key, "language", F.lit(None).cast("string").alias("version"), "name", "abbreviation"))
    return made, seeds.join(books.select(key), key, "left_anti")
