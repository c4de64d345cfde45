import json

from corpusgraph.sources import readers, writers


def test_corpus_json_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"abbrev": "gn", "chapters": [[" one ", ""], ["two"]]}]))
    (tmp_path / "b.json").write_text(json.dumps({"books": [{"name": "Ex", "chapters": [{"verses": [{"verse": 4, "text": "x"}, {"verse": 5, "text": " "}]}]}]}))
    rows = sorted(tuple(r)[1:] for r in readers.corpus_json(spark, str(tmp_path)).collect())
    assert rows == [("Ex", 1, 4, "x"), ("gn", 1, 1, "one"), ("gn", 2, 1, "two")]


def test_manifest(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps({"namespaces": ["person", "place"]}))
    (tmp_path / "person.json").write_text(json.dumps([{"id": "PER:a"}, {"id": "PER:b"}]))
    (tmp_path / "place.json").write_text(json.dumps([{"id": "PLA:c"}]))
    (tmp_path / "other.json").write_text(json.dumps([{"id": "X"}]))
    rows = sorted(map(tuple, readers.by_manifest(spark, str(tmp_path), "id string").collect()))
    assert rows == [("PER:a", "person"), ("PER:b", "person"), ("PLA:c", "place")]


def test_entries_by_path(spark, tmp_path):
    folder = tmp_path / "romans" / "verses"
    folder.mkdir(parents=True)
    (folder / "rom_12_01.json").write_text(json.dumps([{"body": "x"}]))
    assert [tuple(r) for r in readers.entries_by_path(spark, str(tmp_path), "body string").collect()] == [("x", "rom", 12, 1)]


def test_letters(spark, tmp_path):
    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "aaron.json").write_text(json.dumps({"slug": "aaron"}))
    assert [tuple(r) for r in readers.letters(spark, str(tmp_path), "slug string").collect()] == [("aaron", "A")]


def test_edges(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("#c\nGen.1.1\tJohn.1.1\t50\tTSK\nbad\nGen.1.2\tJohn.1.2\tmany\tTSK\n")
    assert [tuple(r) for r in readers.edges_tsv(spark, str(tmp_path / "e.tsv")).collect()] == [("Gen.1.1", "John.1.1", 50, "TSK")]


def test_scraped(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"verse": "LK 1:2", "commentaries": [{"author": "A", "period": "AD397", "text": "long enough"}, {"author": "B", "text": "no"}]}))
    (tmp_path / "b.json").write_text("{broken")
    rows = readers.scraped_commentaries(spark, str(tmp_path), {"LK": "Luke"}).collect()
    assert [tuple(r) for r in rows] == [("Luke", 1, 2, "A", "AD397", "long enough")]


def test_markdown(spark, tmp_path):
    (tmp_path / "r.md").write_text("# My Study\n\n| Key | Value |\n|---|---|\n| Type | topical |\n\n**Level:** hard\n")
    row = readers.markdown(spark, str(tmp_path)).first()
    assert row.title == "My Study"
    assert row.fields["type"] == "topical" and row.fields["level"] == "hard"


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "namespace string, x int")
    writers.by_namespace(df, str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n" / "records")).count() == 2
    writers.raw_backup(df, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).count() == 2
    path = str(tmp_path / "p")
    writers.append(df, path, ["namespace"])
    writers.replace_partitions(spark.createDataFrame([("a", 9)], "namespace string, x int").select("x", "namespace"), path, ["namespace"])
    assert sorted((r.namespace, r.x) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_artworks(spark, tmp_path):
    base = {"artist": " Giotto ", "artist_birth": "1267", "artist_nations": ["it"], "styles": ["gothic"], "width": 3}
    files = {
        "a": {**base, "key": "k1", "title": "T" * 600, "completion": 1305}, "b": {**base, "key": "k1", "title": "again", "artist_birth": "other"}, "c": {**base, "key": "k2", "completion": "c. 1306"},
        "d": {**base, "key": ""}, "e": {"artist": " ", "key": "k3"}, "f": {"artist": "B", "key": "k4"},
    }
    for name, data in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    images, artists = readers.artworks(spark, str(tmp_path))
    found = {r.key: r for r in images.collect()}
    assert set(found) == {"k1", "k2", "k4"} and (len(found["k1"].title), found["k1"].year, found["k2"].year, found["k4"].styles) == (500, 1305, None, [])
    assert {(r.artist, r.birth, tuple(r.nations), r.image_count) for r in artists.collect()} == {("Giotto", "1267", ("it",), 2), ("B", "", (), 1)}


def test_image_tags(spark, tmp_path):
    refs = [{"ref": "Gen.1.2-4", "relevance": "secondary", "reason": "r"}, {"ref": "Gen.1.2"}, {"ref": "Gen.3"}, {"ref": "Xyz.1.1"}, {"ref": "nothing"}, {"ref": None}]
    (tmp_path / "a.json").write_text(json.dumps({"_meta": {"key": "k1", "model": "m"}, "tags": ["x"], "event": "e" * 600, "scripture_refs": refs, "characters": [{"name": "Eve", "type": "PERSON"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"_meta": {"key": "k1"}, "tags": ["later"]}))
    (tmp_path / "c.json").write_text(json.dumps({"_meta": {"key": "unknown"}, "scripture_refs": refs}))
    (tmp_path / "d.json").write_text(json.dumps({"tags": ["no key"]}))
    images, books = spark.createDataFrame([("k1",), ("k2",)], "key string"), spark.createDataFrame([("Gen",)], "book string")
    tags, links = readers.image_tags(spark, str(tmp_path), images, books)
    (row,) = tags.collect()
    assert (row.key, row.tag_list, len(row.event), row.characters[0].name, row.model) == ("k1", ["x"], 500, "Eve", "m")
    assert sorted(map(tuple, links.collect()), key=repr) == [("k1", "Gen", 1, 2, 4, "secondary", "r"), ("k1", "Gen", 3, None, None, "primary", "")]


def test_seeded_names(spark):
    books = spark.createDataFrame([("Gen",), ("Rev",)], "book string")
    known = spark.createDataFrame([("Gen", "en", None, "Genesis", "Gn"), ("Gen", "pt", "NVI", "Gênesis", "Gên")], "book string, language string, version string, name string, abbreviation string")
    seeds = spark.createDataFrame([("Gen", "en", "First", "F"), ("Gen", "pt", "Gênesis", "Gn"), ("Rev", "pt", "Apocalipse", "Ap"), ("Tob", "pt", "Tobias", "Tb")], "book string, language string, name string, abbreviation string")
    made, missing = readers.seed_names(known, seeds, books)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted([*map(tuple, known.collect()), ("Gen", "pt", None, "Gênesis", "Gn"), ("Rev", "pt", None, "Apocalipse", "Ap")], key=repr)
    assert [r.book for r in missing.collect()] == ["Tob"]
    again, _ = readers.seed_names(made, seeds, books)
    assert again.count() == made.count()


def test_table_files(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1, 0.5), ('q"x', 2, None)], "name string, n int, x double")
    writers.table_files(df, str(tmp_path / "t"))
    csv = spark.read.option("header", True).option("inferSchema", True).option("escape", "\\").csv(str(tmp_path / "t" / "csv"))
    assert sorted(map(tuple, csv.collect())) == sorted(map(tuple, df.collect()))
    assert sorted((r.name, r.n, r.x if "x" in r else None) for r in spark.read.schema(df.schema).json(str(tmp_path / "t" / "json")).collect()) == sorted(map(tuple, df.collect()))


def test_jdbc_reads_ranges(spark):
    """The options that the reader is given; there is no database here."""
    calls = {}

    class Reader:
        def format(self, name):
            calls["format"] = name
            return self

        def options(self, **more):
            calls.update(more)
            return self

        def load(self):
            return "table"

    class Session:
        read = Reader()

    assert readers.jdbc(Session(), "jdbc:postgresql://h/d", "verses", "id", 1, 100, 4, user="u") == "table"
    assert calls == {"format": "jdbc", "url": "jdbc:postgresql://h/d", "dbtable": "verses", "partitionColumn": "id", "lowerBound": 1, "upperBound": 100, "numPartitions": 4, "user": "u"}
