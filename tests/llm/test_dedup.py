import collections
import hashlib
import random

import numpy as np
import pytest

from corpusgraph.llm import bwt, common, components, joins, lines, passages, signature_tree, suffixes
from tests.duck import assert_same, connect


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(999, i) for i in range(500, 540)]
    frame = spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components.components(frame).collect()}
    wanted = roots(edges, {n for e in edges for n in e})
    assert {n: c for n, c in wanted.items() if n in found} == found
    assert all(wanted[n] == n for n in set(wanted) - set(found))
    assert components.components(frame.limit(0)).count() == 0


def test_signature_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, rng.integers(1, 600), dtype=np.uint64)
        for _ in range(rng.integers(1, 10)):
            extra = rng.integers(0, 1 << 63, rng.integers(0, 1 + len(base) // 8), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() * 0.25], extra])))
    n = len(sets)
    pairs = [(i, j) for i in range(n) for j in range(i) if signature_tree.alike(sets[i], sets[j], 80, 100)]
    assert pairs
    assert roots(signature_tree.linked(sets, list(range(n))), range(n)) == roots(pairs, range(n))


def shingle_sets(texts):
    out = collections.defaultdict(list)
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out[i].append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def test_op4_against_all_pairs(spark, docs, texts):
    sets = shingle_sets(texts)
    ids = [i for i in sets if i is not None]
    links = [
        (i, j) for i in ids for j in ids if i < j
        for x in sets[i] for y in sets[j] if x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    wanted = roots(links, ids)
    rows = joins.similarity_groups(docs).collect()
    assert len(rows) == len(texts)
    assert sorted((r.doc_id, r.n_shingles) for r in rows if r.doc_id is not None) == sorted((i, len(x)) for i in ids for x in sets[i])
    assert all(r.component_id == wanted.get(r.doc_id) for r in rows)
    assert wanted[3] == wanted[2] == 1 and wanted[9] == 8 and wanted[4] == 4


def test_drop_near_copies(spark, docs, texts):
    kept = joins.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert len(ids) == len(set(ids)) and 1 in ids and not {2, 3, 9} & set(ids)
    assert joins.drop_near_copies(docs.limit(0)).count() == 0


def repeated(texts, m):
    times = collections.Counter(t[i : i + m] for t in texts for i in range(len(t) - m + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - m + 1):
            if times[t[i : i + m]] > 1:
                covered[i : i + m] = True
        out.append(covered)
    return out


def patched(monkeypatch, noise):
    """Shards whose transforms are noise, or not."""
    built = bwt.Shard.__init__

    def init(self, texts, depth):
        built(self, texts, depth)
        if noise:
            self.transform = np.random.default_rng(1).permutation(self.transform)

    monkeypatch.setattr(bwt.Shard, "__init__", init)


@pytest.mark.parametrize("depth", [8, 13, 40])
@pytest.mark.parametrize("noise", [False, True])
def test_merged_transforms_find_repeats(monkeypatch, depth, noise):
    patched(monkeypatch, noise)
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"ab c") for _ in range(200)) for _ in range(4)]
    texts = []
    for _ in range(40):
        p, a = rng.choice(pieces), rng.randrange(0, 100)
        texts.append(bytes(rng.choice(b"ab c") for _ in range(rng.randrange(40, 80))) + p[a : a + rng.randrange(20, 100)])
    texts += [b"a" * 100, b"ab" * 60, bytes(100), bytes(90)]
    owned = np.array([len(t) - depth + 1 for t in texts])
    counts = np.array([1 + (i % 13 == 0) for i in range(len(texts))])
    times = collections.Counter()
    for t, n, k in zip(texts, owned, counts, strict=True):
        for s in range(n):
            times[t[s : s + depth]] += k
    wanted = [[times[t[s : s + depth]] > 1 for s in range(n)] for t, n in zip(texts, owned, strict=True)]
    for shards in (1, 2, 4, 60):
        found = [x.tolist() for x in bwt.repeated_starts(texts, owned, counts, depth, shards)]
        # Without the transforms, what only the merge can find is not found.
        assert (found == wanted) != (noise and shards > 1)


def test_anchors_against_each_window():
    from corpusgraph.llm.stretches import minimizers

    rng = np.random.default_rng(1)
    for n, span, values in ((300, 7, 5), (300, 50, 400), (40, 40, 9), (10, 11, 3), (60, 1, 4)):
        hashes = rng.integers(0, values, n, dtype=np.uint64)
        anchor, first, owned = minimizers(hashes, span)
        each = np.repeat(anchor, owned).tolist()
        assert each == [s + int(hashes[s : s + span].argmin()) for s in range(n - span + 1)]
        assert first.tolist() == [0, *np.cumsum(owned).tolist()][: len(first)]


@pytest.mark.parametrize("limit", [2 << 20, 1500])
def test_op3_against_all_substrings(spark, docs, texts, limit, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", limit)
    data = [(t or "").encode() for _, t in texts]
    wanted = []
    for (i, _), t, covered in zip(texts, data, repeated(data, 400), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~covered]) if t else b""
        wanted.append((i if i is not None else -1, len(t), hashlib.sha256(kept).hexdigest()))
    rows = suffixes.remove_repeats(docs, 400).collect()
    found = [(r.doc_id if r.doc_id is not None else -1, r.n_bytes, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows]
    assert sorted(found) == sorted(wanted)
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(docs, 7)


def test_op3_one_anchor_in_very_many_places(spark, monkeypatch):
    """Texts that share 200 bytes, and 40 of them more: halving must part the rest and lose nothing."""
    rng = random.Random(9)
    letters = "abcdefgh ijklmnop"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    core, more = some(200), some(150)
    rows = [some(300) + core + some(300) for _ in range(60)] + [some(rng.randrange(200, 300)) + more + core + more[:120] + some(99) for _ in range(40)]
    wanted = [hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[~c])).hexdigest() for t, c in zip(rows, repeated([t.encode() for t in rows], 400), strict=True)]
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 4000)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in suffixes.remove_repeats(frame).collect()}
    assert [found[i] for i in range(len(rows))] == wanted
    assert any(found[i] != hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(rows))


def test_op8_against_sql(spark, docs, texts):
    from pyspark.sql import functions as F

    again = [k for k, (i, _) in enumerate(texts) if i == 2][1]
    known = docs.where(F.col("doc_id").isNotNull() & (F.col("row") != again))
    out = lines.dedup_lines(known)
    assert [c for c in out.columns if c != "line_stats"] == known.columns
    digest = out.select("doc_id", "line_stats.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    assert_same(digest, lines.OP8_SQL, connect(None, documents=known.toPandas()))
    dropped = {r.doc_id for r in out.where("line_stats.n_dropped > 0").collect()}
    assert dropped == set(range(100, 107))


def test_op8_rows_that_share_an_id(spark):
    line = "a line of forty characters or rather more of them"
    rows = [(i, f"{line}\nown {i}") for i in range(4)] + [(3, f"{line}\nown 3"), (None, line), (3, f"x\n{line}")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("line_stats.n_dropped > 0").count() == 0
    rows.append((9, f"  {line.upper()}\t"))
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.collect()) == sorted(
        [(0, "own 0"), (1, "own 1"), (2, "own 2"), (3, "own 3"), (3, "own 3"), (3, "x"), (-1, ""), (9, f"  {line.upper()}\t")]
    )
    assert lines.dedup_lines(out.limit(0)).count() == 0


def test_bands():
    for s in (0.6, 0.8, 0.9):
        bands, rows = passages.tune_bands(s, 0.99, 0.3, 0.2)
        assert 1 - (1 - s**rows) ** bands >= 0.99


def test_op2_windows_against_all_windows(spark, docs, texts):
    held = collections.defaultdict(set)
    split = [(i, (t or "").encode().lower().split()) for i, t in texts if i is not None]
    for i, w in split:
        for k in range(len(w) - 49):
            held[tuple(w[k : k + 50])].add(i)
    wanted, lost = collections.defaultdict(set), collections.defaultdict(set)
    for i, w in split:
        for k in range(len(w) - 49):
            owners = held[tuple(w[k : k + 50])]
            if len(owners) > 1:
                wanted[i] |= set(range(k, k + 50))
                if min(owners) != i:
                    lost[i] |= set(range(k, k + 50))
    found, gone = collections.defaultdict(set), collections.defaultdict(set)
    for r in passages.repeated_windows(docs, 50).collect():
        found[r.id] |= set(range(r.first, r.end))
        if r.id != r.keeper:
            gone[r.id] |= set(range(r.first, r.end))
    assert found == wanted and gone == lost
    assert {11, 12, 13} <= set(found)


def test_op2_drops_passages(spark, docs):
    from pyspark.sql import functions as F

    out = passages.drop_passages(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.where(F.col("doc_id").isin(1, 2, 5, 8, 11, 12)).collect()}
    before = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin(1, 11, 12)).collect()}
    assert texts[1] == before[1] and texts[2].split() == [] and texts[5] is None and texts[8] == "one" and texts[11] == before[11]
    assert len(texts[12].split()) < len(before[12].split()) - 80


def test_op2_alike_paragraphs(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near = [w if i != 100 else "changed" for i, w in enumerate(words)]
    rows = [(1, "intro\n" + " ".join(words)), (2, " ".join(near) + "\nend"), (3, " ".join(f"z{rng.randrange(10**6)}" for _ in range(200)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in passages.drop_passages(frame).collect()}
    assert kept[1] == rows[0][1] and kept[2].split() == ["end"] and kept[3] == rows[2][1]


def test_line_paragraphs():
    assert passages.line_paragraphs([3, 30, 8, 0, 7, 6, 20, 19], 20) == [(3, 30), (33, 21), (54, 20)]
    assert passages.line_paragraphs([9, 9], 20) == passages.line_paragraphs([], 20) == []
    assert passages.line_paragraphs([9, 9, 9], 20) == [(0, 27)]


def alike_lines(rng, n, longest):
    """Lines of 1 to *longest* words, many of them alike."""
    lines = []
    for _ in range(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, longest))]
        lines.append(" ".join(base))
        for _ in range(rng.randrange(1, 5)):
            other = base + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(3))]
            at = rng.randrange(len(other))
            lines.append(" ".join(other[:at] + (["changed"] if rng.random() < 0.3 else []) + other[at:]))
    return lines


def all_alike(sets):
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return roots(links, sets)


def test_op2_short_paragraphs_against_all_pairs(spark):
    lines = alike_lines(random.Random(11), 120, 75)
    rows = [(i + 1, line) for i, line in enumerate(lines)]
    sets = {i: x[0] for i, x in shingle_sets(rows).items() if len(lines[i - 1].split()) >= 5}
    wanted = {i: c for i, c in all_alike(sets).items() if i != c}
    assert {len(lines[i - 1].split()) // 10 for i in wanted} >= {0, 1, 2, 3, 4, 5, 6}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r.keeper for r in passages.repeated_passages(frame, min_words=1000, paragraph_words=5).collect() if r.id != r.keeper}
    assert found == wanted


def test_op2_paragraphs_of_the_table_against_all_pairs(spark):
    """Recall over the paragraphs of 1000 documents, by the links of all pairs that a common shingle suggests."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    split = []
    for r in docs.collect():
        lines = [x.split() for x in (r.text or "").encode().lower().split(b"\n")]
        flat = [w for line in lines for w in line]
        split += [(r.doc_id, a, flat[a : a + n]) for a, n in passages.line_paragraphs([len(x) for x in lines], 20)]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for _, _, w in split]
    holders = collections.defaultdict(list)
    for i, x in enumerate(sets):
        for shingle in x:
            holders[shingle].append(i)
    pairs = {(i, j) for own in holders.values() for i in own for j in own if i < j}
    links = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(split) > 4000 and sum(sets[i] != sets[j] for i, j in links) > 50
    component = roots(links, range(len(split)))
    ids = collections.defaultdict(set)
    for i, c in component.items():
        ids[c].add(split[i][0])
    wanted = {(split[i][0], split[i][1], min(ids[c])) for i, c in component.items() if len(ids[c]) > 1}
    found = {(r.id, r.first, r.keeper) for r in passages.alike_paragraphs(docs, 20, 80, 100, 0.999).collect()}
    assert found <= wanted and len(found) >= 0.99 * len(wanted)


def test_op2_drops_short_paragraphs(spark):
    words = [f"w{i}" for i in range(30)]
    short = "\n".join(" ".join(f"{i}s{j}" for j in range(8)) for i in range(4))
    rows = [(1, "one\n" + " ".join(words) + "\n" + short), (2, " ".join([*words[:-1], "changed"]) + "\n" + short.replace("\n", "\n\n") + "\n" + " ".join(map(str, range(40)))), (3, "two\nof four words there")]
    kept = {r.doc_id: r.text for r in passages.drop_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[1] == rows[0][1] and kept[2].split() == [str(i) for i in range(40)] and kept[3] == rows[2][1]


def test_op2_a_passage_kept_for_others_goes_with_an_alike_paragraph(spark):
    """Document 2 keeps 60 words for document 3, and loses them with a paragraph that is like one of document 1."""
    words = [f"w{i}" for i in range(200)]
    near = [w if i != 130 else "changed" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "before " + " ".join(near[100:160]) + " after")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text.split() for r in passages.drop_passages(frame).collect()}
    assert kept == {1: words, 2: [], 3: ["before", "after"]}


def test_op2_query_against_brute_force(spark, tmp_path, texts):
    """All four columns, with ids beyond 2**62 and below 0, and copies of rows."""
    rng = random.Random(2)
    lines = alike_lines(rng, 40, 90)
    rows = [(i * 2**57 - 2**62, "\n".join(rng.sample(lines, 3))) for i in range(60)] + [(2**63 - 1, texts[0][1]), (-5, texts[0][1]), (-5, texts[0][1]), (None, texts[0][1]), (7, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spans, links = collections.defaultdict(set), set()
    split = {}
    for k, (i, t) in enumerate(rows):
        if i is not None:
            split[k] = [x.split() for x in (t or "").lower().split("\n")]
    flat = {k: [w for line in x for w in line] for k, x in split.items()}
    held = collections.defaultdict(set)
    for k, w in flat.items():
        for a in range(len(w) - 49):
            held[tuple(w[a : a + 50])].add(rows[k][0])
    paras = [(k, a, flat[k][a : a + n]) for k, x in split.items() for a, n in passages.line_paragraphs([len(line) for line in x], 20)]
    component = all_alike({p: frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for p, (_, _, w) in enumerate(paras)})
    ids = collections.defaultdict(set)
    for p, c in component.items():
        ids[c].add(rows[paras[p][0]][0])
    for k, w in flat.items():
        own = [(a, a + 50, min(held[tuple(w[a : a + 50])])) for a in range(len(w) - 49) if len(held[tuple(w[a : a + 50])]) > 1]
        own += [(a, a + len(x), min(ids[component[p]])) for p, (k2, a, x) in enumerate(paras) if k2 == k and len(ids[component[p]]) > 1]
        for a, b, keeper in own:
            spans[rows[k][0]].add((a, b, keeper))
            links.add((rows[k][0], keeper))
    connected = roots(links, {x for link in links for x in link})
    def words(i, lost):
        return len({x for a, b, keeper in spans[i] if not lost or keeper != i for x in range(a, b)})
    wanted = sorted((i, words(i, False), words(i, True), connected[i]) for i in list(spans))
    found = sorted(tuple(r) for r in passages.op2_substring_dedup(spark, str(tmp_path)).select("doc_id", "n_repeated", "n_removed", "component_id").collect())
    assert found == wanted and len(found) > 40
    frame.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert passages.op2_substring_dedup(spark, str(tmp_path)).count() == 0


def test_op4_large_stars_in_parts(spark, monkeypatch):
    """Families of copies, and one of texts alike but not enough, in stars of many parts."""
    monkeypatch.setattr(joins, "BLOCK", 8)
    rng = random.Random(5)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(150)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice((1, 3, 6, 12))):
                w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    wanted = all_alike({i: x[0] for i, x in shingle_sets(rows).items()})
    assert 4 < len(set(wanted.values())) < 150
    found = {r.doc_id: r.component_id for r in joins.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == wanted


def test_signature_tree_of_a_template_family_prunes():
    """10 000 sets that share 60 % do not link; the traversal must not look at all 50 million pairs."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 40, dtype=np.uint64)])) for _ in range(10_000)]
    looked = []
    bound = signature_tree.SignatureTree.bound

    def counted(self, level, a, *rest):
        looked.append(len(a))
        return bound(self, level, a, *rest)

    signature_tree.SignatureTree.bound = counted
    try:
        assert signature_tree.linked(sets, list(range(10_000))) == []
    finally:
        signature_tree.SignatureTree.bound = bound
    assert sum(looked) < 5_000_000


def test_no_folder_of_one_machine_on_a_cluster():
    from corpusgraph.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        common.shared_folder(Session)


def test_op4_is_the_same_whether_tables_are_sent_or_shuffled(spark, docs, monkeypatch):
    sent = joins.similarity_groups(docs)
    wanted = sorted(map(tuple, sent.collect()), key=repr)
    monkeypatch.setattr(joins, "to_all", lambda table: common.to_all(table, 0))
    assert sorted(map(tuple, joins.similarity_groups(docs).collect()), key=repr) == wanted
    some = common.cut(docs.select("doc_id"))
    hint = lambda frame: "broadcast" in frame._jdf.queryExecution().logical().toString()
    assert hint(common.to_all(some)) and not hint(common.to_all(some, 3))
