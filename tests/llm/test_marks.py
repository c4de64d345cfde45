"""Operators 11 to 13 against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusgraph.llm import common, manifest, middle, syncmers
from tests.duck import assert_same, connect

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 13: fill in the middle


def plain_fim(doc_id, text, seed=42, percent=50):
    text = text or ""
    h = digest(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MARKED = ["", " ", "\n \t", "a", " a", "a ", "\x0ba\x0c  b  ", "x <P> y", "<S>", "a<M", "a<P <S", "<", "<M", "M> <", "P>a<", "é 😀\n😀 ", "<<P>>", "  a ", "nul\0 x"]


@pytest.mark.parametrize("percent", [50, 100])
def test_op13_against_plain_python(spark, docs, texts, percent):
    rng = random.Random(13)
    rows = [(i, t) for i, t in texts] + [(k * 1000 + j, t) for k in range(1, 12) for j, t in enumerate(MARKED)]
    rows += [(50_000 + i, "".join(rng.choice("ab <PSM>\n\t é😀") for _ in range(rng.randrange(40)))) for i in range(400)]
    frame = spark.createDataFrame([(i, t, "x", j) for j, (i, t) in enumerate(rows)], "doc_id long, text string, fim string, row long")
    out = middle.transform(frame, percent=percent)
    assert out.columns == ["doc_id", "text", "row", "fim"]
    found = out.withColumn("again", middle.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r.fim) == plain_fim(*rows[r.row], percent=percent), rows[r.row]
        assert r.again == (rows[r.row][1] or "") and r.text == rows[r.row][1]
    assert {r.fim.form for r in found} == {"plain", "psm", "spm"}


def test_op13_other_sentinels_and_long_texts(spark):
    long = "word " * 400_000 + " " * 500_000 + "y" * 500_000
    frame = spark.createDataFrame([(i, long) for i in range(6)] + [(9, "a [suf] b")], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    out = middle.transform(frame, seed=7, percent=100, sentinels=marks)
    again = middle.restore(F.col("fim.output"), F.col("fim.form"), marks)
    rows = out.select("doc_id", "fim.n", "fim.form", (again == F.col("text")).alias("same")).collect()
    assert all(r.same for r in rows) and {r.n for r in rows if r.doc_id < 9} == {400_001}
    assert [r.form for r in rows if r.doc_id == 9] == ["plain"] and {r.form for r in rows} > {"plain"}


def test_op13_against_sql(spark, docs):
    frame = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    connection = connect(None, documents=frame.toPandas())
    made = middle.transform(frame).select("doc_id", "fim.*")
    found = made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
    assert_same(found, middle.OP13_SQL, connection)
    assert middle.transform(docs.limit(0)).count() == 0


# 11: fingerprints


def hashed(*values):
    """Spark's xxhash64 of texts and longs, as a signed number."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_anchors(text):
    out = []
    for i in range(len(text) - syncmers.K + 1):
        inner = [hashed(text[i + j : i + j + 8]) for j in range(16)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, hashed(inner[0], inner[8], inner[15]) & 0xFFFFF))
    return out


def plain_mark(text):
    found = plain_anchors(text) or [(0, hashed(text) & 0xFFFFF)] * bool(text)
    at = [0, *(i for i, _ in found)]
    return "".join(f"{i - b:x}{h:05x}" for b, (i, h) in zip(at, found, strict=False))


def plain_likeness(a, b):
    def links(mark):
        items = re.findall(".{6}", mark)
        return collections.Counter(x[1:] + y for x, y in zip(items, [*items[1:], ""], strict=False))

    a, b = links(a), links(b)
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 1.0


def plain_fingerprints(rows):
    rows = sorted(((i is not None, i or 0), hashed(t or ""), i, t or "") for i, t in rows)
    marks = {t: plain_mark(t) for *_, t in rows}
    out = []
    for k, (_, _, i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][3]
        kept = len(text) - len(text) // 4
        edited = text[:kept] + after[: len(text) - kept]
        mark = plain_mark(edited)
        out.append((i, len(text), digest(edited), marks[text], mark, plain_likeness(marks[text], mark), plain_likeness(marks[text], marks[after])))
    return sorted(out, key=repr)


def found_fingerprints(frame):
    rows = syncmers.fingerprints(frame).withColumn("edited", F.sha2("edited", 256)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_op11_against_plain_python(spark, docs, texts):
    short = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in texts]
    frame = docs.withColumn("text", F.when(F.length("text") < 9000, F.col("text")).otherwise(F.substring("text", 1, 9000)))
    assert found_fingerprints(frame) == plain_fingerprints(short)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 130, 700])
def test_op11_ranges_of_ids(spark, n):
    rng = random.Random(n)
    words = [chr(97 + i) * 3 + chr(960 + i) for i in range(9)] + ["\U0001f600", "\n", "  "]
    rows = [(rng.choice([None, rng.randrange(-(1 << 62), 1 << 62), rng.randrange(n)]), " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for _ in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_fingerprints(frame) == (plain_fingerprints(rows) if rows else [])


def test_op11_blocks_meet(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("abcdef gh é") for _ in range(n))) for i, n in enumerate([4095, 4096, 4097, 4096 + 21, 4096 + 22, 4096 + 23, 8200, 22, 23, 24, 38])]
    assert found_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")) == plain_fingerprints(rows)


def test_op11_anchors_are_free_of_context_and_dense():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    own = plain_anchors(text)
    places = [i for i, _ in own]
    assert places[0] < 15 and max(b - a for a, b in zip(places, places[1:], strict=False)) <= 15 and len(text) / 10 < len(own) < len(text) / 6
    assert [(i - 7, h) for i, h in plain_anchors("changed" + text) if i >= 7] == own


def test_op11_likeness(spark):
    a = "one two three four five six seven eight nine ten " * 4
    pairs = [(a, a), (a, ""), ("", ""), (a, a.upper()), ("x" * 3000, "x" * 2000), ("short", "short"), ("short", "other")]
    frame = spark.createDataFrame(pairs, "a string, b string").select(*[syncmers.fingerprint(F.col(c)).alias(c) for c in "ab"])
    found = [r[0] for r in frame.select(syncmers.likeness(F.col("a"), F.col("b"))).collect()]
    assert found[:4] == [1.0, 0.0, 1.0, 0.0] and 0.7 < found[4] < 0.85 and found[5:] == [1.0, 0.0]


def test_op11_long_texts_and_table(spark):
    frame = spark.createDataFrame([(1, "x" * 1_000_000), (2, "word " * 300_000), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in syncmers.fingerprints(frame).drop("edited").collect()}
    assert len(rows[1].fingerprint) == 6 * (1_000_000 - 22) and 0.83 < rows[1].near_edited < 0.84 and rows[1].near_next == 0 and rows[3].fingerprint == ""
    text = "A sentence that is long enough to have some anchors."
    table = syncmers.anchor_table(spark.createDataFrame([(5, text), (6, None)], "doc_id long, text string")).collect()
    assert sorted((r.position, r.hash) for r in table) == plain_anchors(text) and {r.doc_id for r in table} == {5}


def test_op11_looks_for_no_anchor_of_the_next_text_again(spark, monkeypatch):
    calls, anchors = [], syncmers.anchors

    def short(text):
        calls.append(text)
        return anchors(text) if len(calls) == 1 else F.when(F.length(text) > 2 * (syncmers.K - 1), F.raise_error(F.lit("looked at twice"))).otherwise(anchors(text))

    monkeypatch.setattr(syncmers, "anchors", short)
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice("abcdef gh") for _ in range(n))) for i, n in enumerate([400, 90, 30, 3, 1000, 25, 0, 200])]
    assert found_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")) == plain_fingerprints(rows) and len(calls) == 2


def test_op11_is_native(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = syncmers.fingerprints(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# 12: Merkle manifest


def plain_root(hashes, marked):
    """The root, and of each place in *marked* the steps (place in its run, run) to it."""
    steps = {i: [] for i in marked}
    places = {i: i for i in marked}
    while len(hashes) > 1:
        runs = [hashes[i : i + 8] for i in range(0, len(hashes), 8)]
        for i, at in places.items():
            steps[i].append((at % 8, runs[at // 8]))
            places[i] = at // 8
        hashes = [digest("".join(run)) for run in runs]
    return hashes[0], steps


def plain_manifest(rows):
    """Of (doc_id, source, lang, n_chars, text): what the operator should say of each, by index."""

    def leaf(r):
        return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    groups, out = {}, {}
    for k, r in enumerate(rows):
        groups.setdefault(b"" if r[2] is None else b"=" + r[2].encode(), []).append(((r[0] is not None, r[0] or 0), leaf(r), k))
    trees = []
    for key in sorted(groups):
        own = sorted(groups[key])
        trees.append((own, *plain_root([h for _, h, _ in own], range(len(own)))))
    root, tops = plain_root([t[1] for t in trees], range(len(trees)))
    for g, (own, subroot, steps) in enumerate(trees):
        for i, (_, h, k) in enumerate(own):
            path = steps[i] + tops[g]
            changed = rows[k][0] is not None and zlib.crc32(str(rows[k][0]).encode()) % 3 == 0 and rows[k][4] is not None
            folded = leaf((*rows[k][:4], re.sub("[A-Z]", lambda m: m[0].lower(), rows[k][4]))) if changed else h
            for at, run in path:
                folded = digest("".join([*run[:at], folded, *run[at + 1 :]]))
            proof = digest("".join("".join(run[:at] + run[at + 1 :]) for at, run in path))
            out[k] = (h, subroot, root, proof, folded, folded == root)
    return out


def as_rows(frame):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in frame.collect()), key=repr)


def wanted(rows):
    return sorted(((rows[k][0], *x) for k, x in plain_manifest(rows).items()), key=repr)


class Folder:
    """Stands for the folder of a table that a test has made."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path = spark, str(tmp_path)

    def write(self, rows):
        schema = "doc_id long, source string, lang string, n_chars long, text string"
        self.spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{self.path}/documents.parquet")
        return self.path


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1], [65, 1, 7, 64, 513], [3] * 20], ids=str)
def test_op12_against_plain_python(spark, tmp_path, sizes):
    rng = random.Random(sum(sizes))
    langs = [None, "", "a", "é", "z", "Z", *(f"l{i}" for i in range(20))]
    rows = []
    for n, lang in zip(sizes, langs, strict=False):
        for _ in range(n):
            text = rng.choice([None, "", "Ab", "lower", "ÀÉ Z", "x" * rng.randrange(50) + "Y"])
            rows.append((rng.choice([None, rng.randrange(-50, 10**6), rng.randrange(40)]), rng.choice([None, "s:1", "é"]), lang, rng.choice([None, 5]), text))
    found = manifest.op12_merkle_manifest(spark, Folder(spark, tmp_path).write(rows))
    assert as_rows(found) == wanted(rows)


def test_op12_awkward_texts_and_columns(spark, docs, texts, tmp_path):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    rows += [(7000 + i, "s", "en", 3 << 20, "Long text " * (3 << 17)) for i in range(3)]
    found = manifest.op12_merkle_manifest(spark, Folder(spark, tmp_path).write(rows))
    assert as_rows(found) == wanted(rows)
    clash = docs.select("*", F.lit("x").alias("tree"), F.lit("y").alias("hash"), F.lit(1).alias("index"), F.lit(2).alias("proof"), F.create_map(F.lit("a"), F.lit(1)).alias("steps"))
    out = manifest.manifest(clash.withColumn("leaf", manifest.document_leaf(F.col("text"))), "leaf", "lang", ["doc_id"])
    assert out.columns == [c for c in clash.columns if c != "proof"] + ["leaf", "proof"]
    assert out.where(manifest.fold(F.col("proof.steps"), F.col("leaf")) == F.col("proof.root")).count() == docs.count()
    none = docs.limit(0).withColumn("leaf", manifest.document_leaf(F.col("text")))
    assert manifest.manifest(none, "leaf", "lang", ["doc_id"]).count() == 0


def test_op12_against_sql(spark, docs, tmp_path):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    folder = Folder(spark, tmp_path).write(rows)
    frame = spark.read.parquet(f"{folder}/documents.parquet").toPandas().astype({"n_chars": "Int64"})
    assert_same(manifest.op12_merkle_manifest(spark, folder), manifest.OP12_SQL, connect(None, documents=frame))


def test_op12_leaves_only_levels_behind(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    manifest.manifest(docs.withColumn("leaf", manifest.document_leaf(F.col("text"))), "leaf", "lang", ["doc_id"]).count()
    assert len(list(tmp_path.iterdir())) == 3  # two levels of the trees (70 rows in four) and one above
