import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import common, gam, language, media, mixing, packing, rules
from tests.duck import assert_same, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 1: quality rules


def test_op1_statistics_against_plain_python(spark, docs, texts):
    found = docs.select("row", rules.statistics(F.col("text")).alias("s")).collect()
    for r in found:
        text = texts[r.row][1] or ""
        w = WORD.findall(text)
        ls = [x for x in text.split("\n") if WORD.search(x)]
        times = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        wanted = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(covered))
        assert tuple(r.s[x] for x in rules.STATISTICS) == wanted, texts[r.row][0]


def test_op1_learns_a_list_that_holds(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(("x***" if i % 4 == 0 else "word") + str(rng.randrange(99)) for _ in range(60 + i % 50)), int(i % 4 > 0)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = rules.fit(frame.drop("quality"), frame.select("doc_id", "quality"))
    assert found.rules and all(r.caught >= 0.9 * (r.caught + r.wrong) for r in found.rules)
    kept = {r.doc_id for r in rules.filter_quality(frame.drop("quality"), frame.select("doc_id", "quality")).collect()}
    assert kept == {i for i, _, q in rows if q}


def test_op1_edges(spark, docs, texts):
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = rules.filter_quality(docs, none)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3} and not {r.doc_id for r in kept.collect()} & {5, 6, 7, 8, 14}
    assert rules.filter_quality(docs.limit(0), none).count() == 0


# 5: media columns


def test_op5_texts_that_look_like_a_tag_at_the_end():
    for n in (1, 2, 5):
        for at in range(media.UNIT):
            payload = (b"x" * (media.UNIT * (n - 1) + at) + b"TAG").ljust(media.UNIT * n, b"y")[: media.UNIT * n]
            found = media.read_stream(media.write_stream(payload))
            assert found.payload == payload and found.skipped == 0 and len(found.offsets) == found.vbr[1] == n
            assert "TIT2" not in found.tags


def test_op5_tags_at_the_end():
    tag = b"TAG" + b"A title".ljust(30, b"\0") + b"\xff\xfb" * 47 + b"\0"
    for n in (1, 3):
        for payload in (b"p" * media.UNIT * n, (b"p" * 89 + b"TAG" + b"p" * 100) * n):
            stream = media.write_stream(payload)
            found = media.read_stream(stream + tag)
            assert found.payload == payload and found.skipped == 0 and found.tags["TIT2"] == "A title"
            cut_off = media.read_stream(stream[:-50] + tag)
            assert len(cut_off.offsets) == n - 1 and cut_off.skipped == 190 and cut_off.tags["TIT2"] == "A title"
    assert media.read_stream(tag).tags == {"TIT2": "A title"} and media.read_stream(b"junk" + tag).skipped == 4


def test_op5_round_trip(spark, docs, texts):
    stored = media.store_media(docs)
    rows = media.read_media(stored, ("doc_id", "n_bytes")).collect()
    found = sorted(((r.doc_id or -1), r.n_bytes, bytes(r.payload)) for r in rows)
    data = [((i or -1), (t or "").encode()) for i, t in texts]
    assert found == sorted((i, len(t), t.ljust(192 * max(1, -(-len(t) // 192)))) for i, t in data)
    assert all(r.bad_crc == 0 and r.skipped == 0 and r.vbr_frames == r.frames == len(r.seek) for r in rows)
    assert all(r.samples == 1152 * r.frames and r.micros == r.samples * 1_000_000 // 48_000 for r in rows)


def test_op5_resynchronises_and_checks():
    clean = media.write_stream(b"payload".ljust(192 * 6))
    noisy = clean[:500] + b"\xff\xff noise \xff" + clean[500:]
    found = media.read_stream(b"junk" + noisy)
    assert len(found.offsets) >= 5 and found.skipped > 0
    broken = bytearray(clean)
    at = int(media.read_stream(clean).offsets[2])
    broken[at + 8] ^= 1
    assert media.read_stream(bytes(broken)).bad_crc == 1
    for data in (b"", b"\xff", b"ID3", clean[:30], b"\xff\xfb" * 50, bytes(1000)):
        assert len(media.read_stream(data).offsets) == 0
    with pytest.raises(ValueError):
        media.write_stream(b"x")


def tagged(version, flags, fields, extended=b"", footer=b""):
    return b"ID3" + bytes([version, 0, flags]) + media._synchsafe(len(extended + fields)) + extended + fields + footer


def field4(name, value, flags=0):
    return name + media._synchsafe(len(value)) + bytes([0, flags]) + value


def test_op5_tags_of_all_versions():
    audio = media.write_stream(b"p" * media.UNIT)[10 + 28 :]
    audio = audio[audio.find(b"\xff\xfa") :]
    long = "x" * 300
    three = lambda name, value: name + len(value).to_bytes(4, "big") + b"\0\0" + value
    two = lambda name, value: name + len(value).to_bytes(3, "big") + value
    escaped = field4(b"TPE1", b"\0a\xff\0b", 2)
    for tag, wanted in (
        (tagged(4, 0, field4(b"TIT2", b"\3" + long.encode()) + field4(b"TALB", b"\3\xc3\xa9t\xc3\xa9")), {"TIT2": long, "TALB": "été"}),
        (tagged(3, 0, three(b"TIT2", b"\1" + "日本".encode("utf-16")) + three(b"TXXX", b"\0key\0value")), {"TIT2": "日本", "key": "value"}),
        (tagged(3, 0, three(b"TIT2", b"\0" + long.encode())), {"TIT2": long}),
        (tagged(4, 0, field4(b"TIT2", b"\2" + "né".encode("utf-16-be") + b"\0\0")), {"TIT2": "né"}),
        (tagged(2, 0, two(b"TT2", b"\0short names")), {"TIT2": "short names"}),
        (tagged(4, 64 | 16, field4(b"TIT2", b"\0t"), media._synchsafe(6) + b"\1\0", b"3DI" + bytes(7)), {"TIT2": "t"}),
        (tagged(3, 64, three(b"TIT2", b"\0t"), (6).to_bytes(4, "big") + bytes(6)), {"TIT2": "t"}),
        (tagged(3, 128, three(b"TIT2", b"\0a\xffb").replace(b"\xff", b"\xff\0")), {"TIT2": "aÿb"}),
        (tagged(4, 0, escaped), {"TPE1": "aÿb"}),
        (tagged(3, 0, three(b"TIT2", b"\0t") + bytes(50)), {"TIT2": "t"}),
        (tagged(9, 0, b"whatever it is"), {}),
    ):
        found = media.read_stream(tag + audio)
        assert found.tags == wanted and len(found.offsets) == 1 and found.skipped == 0


def test_op5_bitrate_tables():
    stream = media.write_stream(b"p" * media.UNIT * 3)
    found = media.read_stream(stream)
    assert found.vbr[:3] == ("Xing", 3, 960) and len(found.vbr.seek) == 100 and found.vbr.seek[50] == 480 and found.vbr.quality is None
    at = int(found.offsets[0]) - 240
    table = b"Info" + (15).to_bytes(4, "big") + (3).to_bytes(4, "big") + (960).to_bytes(4, "big") + bytes(range(100)) + (57).to_bytes(4, "big")
    table += b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    frame = bytearray(stream[at : at + 240])
    frame[23 : 23 + len(table)] = table
    gapless = media.read_stream(stream[:at] + bytes(frame) + stream[at + 240 :])
    assert gapless.vbr.quality == 57 and (gapless.vbr.delay, gapless.vbr.padding) == (576, 1000) and gapless.samples == 3 * 1152 - 1576
    assert gapless.micros == gapless.samples * 1_000_000 // 48_000 and gapless.bad_crc == 0
    frame = bytearray(stream[at : at + 23].ljust(240, b"\0"))
    vbri = b"VBRI" + b"".join(x.to_bytes(n, "big") for x, n in ((1, 2), (100, 2), (75, 2), (960, 4), (3, 4), (3, 2), (2, 2), (2, 2), (1, 2), (120, 2), (120, 2), (120, 2)))
    frame[36 : 36 + len(vbri)] = vbri
    other = media.read_stream(stream[:at] + bytes(frame) + stream[at + 240 :])
    assert other.vbr == ("VBRI", 3, 960, 75, (0, 240, 480, 720), 1, 100, 0) and other.samples == 3 * 1152 - 100


def test_op5_large_rows_leave_in_parts(spark):
    frame = spark.createDataFrame([(i, "x" * 3_000_000 if i % 3 else None) for i in range(7)], "doc_id long, text string")
    rows = media.read_media(media.store_media(frame), ("doc_id", "n_bytes")).select("doc_id", "n_bytes", F.length("payload").alias("n")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n) for r in rows) == [(i, 3_000_000 * bool(i % 3), 3_000_000 if i % 3 else 192) for i in range(7)]


def test_op5_other_headers():
    head = media.header(0xFFFB9064)  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz
    assert (head.length, head.samples, head.kbits, head.hertz, head.checked) == (417, 1152, 128, 44100, False)
    assert media.header(0xFFFB9264).length == 418
    assert media.header(0xFFF38064).samples == 576
    assert media.header(0xFFFFFFFF) is None and media.header(0) is None


# 6: classifier


def test_op6_model_learns_shapes_and_pairs():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    odds = 6 * (np.abs(x[:, 0] - 0.5) > 0.25) - 3 + 8 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) - 4
    y = (rng.random(4000) < 1 / (1 + np.exp(-odds))).astype(int)
    model = gam.fit(x[:3000], y[:3000])
    accuracy = ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean()
    best = (((odds >= 0) == y)[3000:]).mean()
    assert accuracy > best - 0.05
    assert (2, 1) in model.pairs
    assert len(gam.fit(x[:0], y[:0]).score(x)) == 4000


def test_op6_held_out_accuracy(spark):
    found = gam.op6_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.93
    assert all(found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id])


def test_op6_edges(spark, docs):
    model = gam.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = gam.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert gam.score(docs.limit(0), model).count() == 0


# 7: mixing


def test_op7_against_sql(spark, docs, texts):
    again = [k for k, (i, _) in enumerate(texts) if i == 2][1]
    known = docs.where(F.col("doc_id").isNotNull() & (F.col("row") != again))
    out = mixing.mix_sources(known).drop("row")
    digest = out.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))
    assert_same(digest, mixing.OP7_SQL, connect(None, documents=known.toPandas()))


def test_op7_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice("aaaaaaaabbbc") if i % 50 else None) for i in range(3000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    mix = out.mix.apply(lambda r: r.asDict() if hasattr(r, "asDict") else r)
    out["size"], out["copies"], out["target"] = (mix.apply(lambda m, k=k: m[k]) for k in ("size", "copies", "target"))
    for _, own in out.groupby("source", dropna=False):
        taken = (own["size"] * own["copies"]).sum()
        assert abs(taken - own["target"].iloc[0]) <= 40
    assert out["copies"].max() <= 3
    assert abs(out.groupby("source", dropna=False)["target"].first().sum() - out["size"].sum()) < 1e-6


@pytest.mark.parametrize("slices", [4096, 4])
def test_op7_sums_that_meet_the_target_exactly(spark, slices, monkeypatch):
    monkeypatch.setattr(mixing, "_SLICES", slices)
    rows = [(i, "w " * 100, "A" if i < 20 else "B") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(frame).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"), "source")
    assert {r.source: (r.target, r.n) for r in out.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("n")).collect()} == {"A": (1000, 1000), "B": (2000, 2000)}
    assert_same(out.drop("source"), mixing.OP7_SQL, connect(None, documents=frame.toPandas()))


def test_op7_edges(spark, docs):
    out = mixing.mix_sources(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert out.where("mix.size = 0 AND mix.copies > 0").count() == 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.mix.copies for r in mixing.mix_sources(empty).collect()] == [0, 0]


# 9: packing


def test_op9_fill_is_the_best_sum():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        capacity = rng.randrange(1, 60)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1)}
        chosen = packing.fill(counts, capacity)
        assert all(k <= counts[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= capacity)


def test_op9_packs_every_token_once(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, packing.vocabulary_encoder(), keep_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        found[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    wanted = collections.defaultdict(collections.Counter)
    for i, t in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 512):
            wanted[i][start, np.array(ids[start : start + 512], "<u4").tobytes()] += 1
    got = collections.defaultdict(collections.Counter)
    for (i, _), pieces in found.items():
        for start, ids in pieces:
            for a in range(0, len(ids) // 4, 512):
                got[i][start + a, ids[4 * a : 4 * (a + 512)]] += 1
    assert got == wanted
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0), packing.vocabulary_encoder()).count() == 0


def test_op9_added_tokens_are_one_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"x{end}y", f"  {end}\n\n {end} ", f"it's{end}'s", "<|endoftext|", f"<|{end}|>", f"日本 {end}ß", "\ud800".encode("utf-8", "replace").decode() + end]
    encode = packing.vocabulary_encoder()()
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert np.frombuffer(encode(texts[0]), "<u4").tolist() == [64, 220, 50256, 275]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.vocabulary_encoder()).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: 1 + len(plain.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


@pytest.mark.parametrize("text", [
    "a" + " " * 1_200_000 + "b", "a" + " " * 1_200_000, "x\r\n" * 30_000 + "\r\n" * 20_000 + "y", " " * 120_000 + "<|endoftext|>" + "\n" * 30_000 + " x<|endoftext|>" + "\t" * 20_000,
    "\x1c" * 20_000 + "b" + " " * 150_000 + "\x1cq", "a" * 300_000, "\u3000" * 120_000 + "'s", "!" * 100_000 + " " * 20_000 + "'s  \n x",
])
def test_op9_very_long_runs(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.frombuffer(packing.vocabulary_encoder()()(text), "<u4").tolist()
    assert ids == plain.encode(text, add_special_tokens=False).ids


def test_op9_other_vocabulary_files_are_not_guessed(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    stored = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    stored["normalizer"] = {"type": "Lowercase"}
    stored["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    json.dump(stored, open(path, "w", encoding="utf-8"))
    text = "Some Words, ÀND  more"
    assert np.frombuffer(packing.vocabulary_encoder(path)()(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_op9_little_padding():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 1024) for _ in range(2000)]
    windows = packing.pack_lengths(lengths, 1024)
    assert sum(n for w in windows for _, _, n in w) == sum(lengths)
    assert len(windows) * 1024 < 1.01 * sum(lengths) + 1024


# 10: language


def test_op10_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    scores = [rng.normal(size=(n, 3)) for n in (6, 5, 5, 1)]
    for s, labels in zip(scores, language.viterbi(scores, 0.7), strict=True):
        def worth(path, s=s):
            return sum(s[i, k] for i, k in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        assert abs(worth(labels) - max(map(worth, itertools.product(range(3), repeat=len(s))))) < 1e-9
    assert language.viterbi([], 1.0) == []


@pytest.mark.parametrize("steps", [1, 2, 5, 64])
def test_op10_viterbi_in_parts(monkeypatch, steps):
    rng = np.random.default_rng(7)
    scores = [rng.normal(size=(n, 4)) for n in (57, 1, 64, 128, 3)]

    def worth(s, path):
        return s[np.arange(len(s)), path].sum() - 1.3 * (np.diff(path) != 0).sum()

    whole = language.viterbi(scores, 1.3)
    monkeypatch.setattr(language, "_STEPS", steps)
    for s, a, b in zip(scores, whole, language.viterbi(scores, 1.3), strict=True):
        assert len(a) == len(b) == len(s) and abs(worth(s, a) - worth(s, b)) < 1e-9


def test_op10_a_very_long_text(spark):
    rows = [(i, "the house and the garden", "en") for i in range(20)] + [(50 + i, "das Haus und der Garten", "de") for i in range(20)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = "the garden and the house " * 60_000 + "und der Garten das Haus " * 40_000
    found = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert found.lang_pred == "en" and [(s.lang, s.start, s.end) for s in found.spans] == [("en", 0, 300_000), ("de", 300_000, 500_000)]


def test_op10_held_out_accuracy(spark):
    found = language.op10_language_id(spark, "/root/testdata/sf0.01").toPandas()
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(known, on="doc_id")
    held = both[both.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.97


def test_op10_mixed_text_and_edges(spark, docs):
    rows = [(i, "the house and the garden", "en") for i in range(20)] + [(50 + i, "das Haus und der Garten", "de") for i in range(20)]
    rows += [(90 + i, "дом и сад у реки", "ru") for i in range(20)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = "the garden and the house " * 3 + "und der Garten das Haus " * 2
    mixed = spark.createDataFrame([(1, text), (2, None), (3, "12 ½ !!"), (4, "сад дом"), (5, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identify(mixed, model).collect()}
    assert [(s.lang, s.start, s.end) for s in found[1].spans] == [("en", 0, 15), ("de", 15, 25)]
    assert found[1].lang_pred == "en" and found[4].lang_pred == "ru"
    assert [found[i].lang_pred for i in (2, 3, 5)] == ["und"] * 3
    rows = language.identify(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert language.identify(docs.limit(0), model).count() == 0
    nothing = language.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


# The whole


def test_words(spark, docs, texts):
    for r in docs.select("row", common.words(F.col("text")).alias("w")).collect():
        assert r.w == WORD.findall(texts[r.row][1] or "")


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    (_, stage1), (_, stage2), (_, stage3), (_, stage4), (_, stage5) = corpus_pipeline.STAGES
    one = stage1(spark, docs, folder)
    list_ = rules.fit(docs, labels)
    judged = rules.judge(docs.select("doc_id", rules.statistics(F.col("text")).alias("s")), list_)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in judged.where("kept").collect()}
    two = stage2(spark, one, folder)
    digest = two.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    from corpusgraph.llm import lines

    assert_same(digest, f"SELECT doc_id, kept_sha256 FROM ({lines.OP8_SQL})", connect(None, documents=one.toPandas()))
    three = stage3(spark, two, folder)
    sets = {r.doc_id: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for r in two.collect() if (w := (r.text or "").encode().lower().split())}
    smaller = {j for i, x in sets.items() for j, y in sets.items() if i < j and 100 * len(x & y) >= 80 * len(x | y)}
    kept = {r.doc_id for r in three.collect()}
    assert kept <= {r.doc_id for r in two.collect()} and not kept & {j for j in smaller if all(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i in sets if i < j) }
    assert len(kept) >= two.count() - len(smaller)
    four = stage4(spark, three, folder)
    assert four.columns == docs.columns and four.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    five = stage5(spark, four, folder)
    sizes = five.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).join(four.groupBy("doc_id").count(), "doc_id")
    assert sizes.where("n <> m * count").count() == 0
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_sha_of_streams_is_equal_for_equal_texts(spark):
    frame = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "doc_id long, text string")
    shas = {r.doc_id: hashlib.sha256(bytes(r.media)).hexdigest() for r in media.store_media(frame).collect()}
    assert shas[1] == shas[2] != shas[3]


def test_pipeline_leaves_the_table_that_its_result_reads(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    (folder,) = tmp_path.iterdir()
    assert [p.name for p in folder.iterdir()] == ["3-mix_sources"] and packed.count() > 0
    assert [p.name for p in tmp_path.iterdir()] == [folder.name] and not common._SCOPES
