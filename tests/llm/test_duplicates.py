"""Near duplicates, contained items, repeated bytes and toxicity against plain versions on adversarial small inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import contained_items, jaccard_components, repeated_bytes, shingle_set
from pyspark.sql import functions as F

from cairnmark.llm import decontamination, graphs, jaccard, queries, suffixes, toxicity


def prose(rng, n, words=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, words)}" for _ in range(n))


def edited(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
    return " ".join(w)


def corpus(seed=1):
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = prose(rng, 140)
    out += [edited(rng, base, rng.randint(0, 5)) for _ in range(80)]  # a large group, near the threshold
    out += [out[3]] * 40 + [out[70]] * 5
    line = prose(rng, 30)
    out += [f"{prose(rng, 60)} {line} {prose(rng, 40)}" for _ in range(60)]  # a shared passage
    out += [f"{line} {prose(rng, rng.randint(0, 12))}" for _ in range(40)]
    out += [out[0].upper(), out[1].replace(" ", " \n\t "), "", None, "  ", "one", "ONE", "one two", "one two three four", "one two three four five", "a b c d e f", "x " * 4000, "x " * 50]
    rng.shuffle(out)
    rows = list(enumerate(out))
    return rows + [(5, out[5]), (5, out[5]), (5, "other text under an id that is taken"), (None, out[8]), (None, "alone without an id of its own")]


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(frame, seed):
    rows = corpus(seed)
    got = jaccard.near_duplicates(frame(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert key(map(tuple, got)) == key(jaccard_components(rows))


def test_no_documents(frame):
    assert jaccard.near_duplicates(frame([])).count() == 0
    assert jaccard.keep_one(frame([])).count() == 0


def test_keep_one(frame):
    rows = [r for r in corpus(3) if r[1] != "other text under an id that is taken"]  # else two components have one id
    df = frame(rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want = jaccard_components(rows)
    groups = {(c, True) if n and c is not None else (i, False) for i, (_, n, c) in enumerate(want) if n}
    got = kept.collect()
    assert sum(bool(shingle_set(r["text"])) for r in got) == len(groups)
    assert sum(not shingle_set(r["text"]) for r in got) == sum(not n for _, n, _ in want)


def test_signatures_never_drop_a_link():
    """Bits that differ are no more than shingles that differ, whatever the sets."""
    rng = np.random.default_rng(4)
    for n in (1, 30, 500, 20_000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for share in (0.0, 0.1, 0.9, 1.0):
            b = np.unique(np.concatenate([a[rng.random(len(a)) < share], rng.integers(0, 1 << 64, int((1 - share) * n), np.uint64)]))
            bits = int(np.unpackbits((jaccard.signature(a) ^ jaccard.signature(b)).view(np.uint8)).sum())
            assert bits <= len(np.setxor1d(a, b))


def test_groups_near_the_threshold(frame, monkeypatch):
    """Copies of a text with four edits each, of which nearly none link: few pairs are left to verify, all links are found."""
    rng = random.Random(9)
    base = prose(rng, 150, 10_000)
    rows = [(i, edited(rng, base, 4)) for i in range(240)] + [(1000 + i, edited(rng, base, 1)) for i in range(3)]
    tried = []
    verify = jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda docs, b, m, pairs, percent: tried.append(pairs.count()) or verify(docs, b, m, pairs, percent))
    got = jaccard.near_duplicates(frame(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert key(map(tuple, got)) == key(jaccard_components(rows))
    assert sum(tried) <= 4 * len(rows)


def test_places_of_prefixes_are_sent_once(frame, spark):
    """Shingles that no groups of near sizes share go through one shuffle, not two."""
    rng = random.Random(12)
    line = prose(rng, 8, 10**6)
    rows = [(i, prose(rng, 1500, 10**6)) for i in range(200)]
    rows += [(1000 + i, f"{prose(rng, 20 * 2**i, 10**6)} {line}") for i in range(6)]  # a line in texts of unlike sizes
    rows.append((2000, edited(rng, rows[0][1], 3)))
    docs = jaccard.materialize(frame(rows), "documents")
    jvm = spark.sparkContext._jsc.sc()

    def sent():
        jvm.listenerBus().waitUntilEmpty(30_000)
        return jvm.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = sent()
    got = jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    places = sum(n - -(-80 * n // 100) + 1 for _, n, _ in got)
    assert sent() - before < 22 * places
    assert key(map(tuple, got)) == key(jaccard_components(rows))


def test_hot_shingles_are_dealt_out(frame, monkeypatch):
    for name, value in (("SPLIT", 5), ("STAR", 3), ("HOT", 4)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(6)
    got = jaccard.near_duplicates(frame(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert key(map(tuple, got)) == key(jaccard_components(rows))


def test_graph_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(100)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = graphs.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["label"] for r in got.collect()} == {x: root(x) for x in up}


@pytest.mark.parametrize("reach", [1, 3])
def test_components_of_a_long_chain(spark, reach):
    rng = random.Random(reach)
    names = [rng.getrandbits(63) - 2**62 for _ in range(2000)]  # like set keys: in no order along the chain
    pairs = [(names[i], names[i + d]) for i in range(len(names)) for d in range(1, reach + 1) if i + d < len(names)]
    got = graphs.components(spark.createDataFrame([*pairs, (5, 5), (8, 7), (7, 8)], "a long, b long").repartition(4))
    assert {r["node"]: r["label"] for r in got.collect()} == dict.fromkeys(names, min(names)) | {5: 5, 7: 7, 8: 7}


def test_version_chain_is_one_component(frame):
    rng = random.Random(11)
    words = prose(rng, 300, 5000).split(" ")
    rows = []
    for i in range(250):  # each version changes six words of the one before
        rows.append((i, " ".join(words)))
        for at in rng.sample(range(300), 6):
            words[at] = f"v{i}x{at}"
    rng.shuffle(rows)
    assert {r["component_id"] for r in jaccard.near_duplicates(frame(rows)).collect()} == {c for *_, c in jaccard_components(rows)}


def items_and_docs():
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randint(5, 80))) for i in range(25)] + [(100, "tiny item"), (101, ""), (102, None), (3, "an id twice " + prose(rng, 10))]
    docs = corpus(8)
    for i, t in items[:25]:
        docs.append((1000 + i, f"{prose(rng, rng.randint(0, 900))} {edited(rng, t, rng.randint(0, 3))} {prose(rng, 50)}"))
        docs.append((2000 + i, t.upper()))
    return items, [*docs, (3000, "tiny  ITEM")]


@pytest.mark.parametrize("block", [20_000, 7])
def test_contained_items(frame, spark, block, monkeypatch):
    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", (80, block))
    items, docs = items_and_docs()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_items(frame(docs), bench).collect()
    assert key(map(tuple, got)) == key(contained_items(docs, items))
    kept = decontamination.decontaminate(frame(docs), bench).collect()
    bad = {(d, t) for d, t in docs if contained_items([(d, t)], items)}
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(repr((d, t)) for d, t in docs if (d, t) not in bad)


def test_contained_items_of_nothing(frame, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_items(frame([(1, "a b")]), none).count() == 0
    assert decontamination.decontaminate(frame([(1, None)]), none).count() == 1
    assert decontamination.find_items(frame([]), spark.createDataFrame([(1, "a")], none.schema)).count() == 0


def bytes_corpus(seed):
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [part(n) for n in (399, 400, 401, 450, 700, 1500)]
    docs = [part(rng.randint(0, 1500)) for _ in range(12)]
    for s in shared:
        for _ in range(rng.randint(2, 4)):
            docs.append(part(rng.randint(0, 300)) + s + part(rng.randint(0, 300)))
    long = part(3000)
    docs += [long[:1700] + "!" + long[1700:], long[500:2600], long[:900] + long[1100:], long[700:1120]]
    docs += ["ab" * 500, "ab" * 350, "c" * 399, "c" * 400, "c" * 401, "xyz" * 133 + "x", docs[0], docs[0], docs[12], "", None, "short", "short"]
    docs += [shared[5][:400] + shared[4][:400] + shared[5][200:900]]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_bytes(frame, seed, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(suffixes, "CHUNK", 512)
    rows = bytes_corpus(seed)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(frame(rows), keep_text=True).collect()}
    assert len(got) == len(rows)
    for (i, t), m in zip(rows, repeated_bytes(rows), strict=True):
        b, m = np.frombuffer((t or "").encode(), np.uint8), np.frombuffer(bytes(m), np.uint8) > 0
        r = got[i]
        kept = b[~m].tobytes()
        assert bytes(r["kept"]) == kept and r["kept_sha256"] == hashlib.sha256(kept).hexdigest(), i
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()))


def test_repeats_of_nothing(frame):
    assert suffixes.remove_repeats(frame([])).count() == 0
    assert [r["n_removed"] for r in suffixes.remove_repeats(frame([(None, None), (1, "a")])).collect()] == [0, 0]


def test_grammar():
    m = toxicity.Model({"idiot": 0.8, "vequ*": 0.9}, 0.02)
    s = m.score
    assert s(None) == s("") == pytest.approx(0.02) and s("a clean text about nothing") < 0.5
    assert s("he is an idiot") > s("so idiot") > 0.5 and s("VEQUmo!") > 0.5 and s("vequ") < 0.5
    assert s("you are not an idiot") < 0.5 and s("not. idiot") > 0.5
    assert s('they said "idiot" to me') < s("idiot")
    assert s("i will kill you") > 0.5 and s("we kill the process") < 0.5
    assert s("idiotic videots") < 0.5
    assert s("idiot. " * 3) > s("idiot")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n, right, caught, toxic = got.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("toxic")), F.count_if(F.expr("toxic = 1 AND predicted = 1")), F.count_if(F.expr("toxic = 1"))).first()
    assert right / n > 0.97 and caught / toxic > 0.85


def test_toxicity_of_edge_rows(frame, spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    rows = [(1, None), (2, ""), (None, "you idiot"), (3, "you idiot"), (3, "you idiot")]
    got = toxicity.score_toxicity(frame(rows), labels).collect()
    assert [r["predicted"] for r in sorted(got, key=lambda r: bool(r["text"]))] == [0, 0, 1, 1, 1]
    assert toxicity.drop_toxic(frame(rows), labels).count() == 2
    assert toxicity.score_toxicity(frame([]), labels.limit(0)).count() == 0


def test_held_out_rows_are_not_learned(spark):
    word = "zzword"
    docs = [(i, f"{word if i % 2 else 'fine'} {i}") for i in range(4000)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert word not in model.lexicon


def test_labels_clear_seed_words(spark):
    docs = [(i, f"a text of {'trash' if i % 2 else 'clown'} number w{i} x{i} y{i}") for i in range(1, 601)]
    docs += [(i, f"this is moron talk w{i} x{i} and zzword") for i in range(601, 701)]
    labels = spark.createDataFrame([(i, int(i > 600 or i in (2, 4))) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert model.score("take out the trash") < 0.5 and model.score("a clown") < 0.5
    assert model.score("a moron") > 0.9 and model.lexicon["scum"] == pytest.approx(toxicity.SEED_WEIGHT)


def test_threats_are_weighed_negated_and_joined_by_length(spark):
    docs = [(i, f"we beat them 3-1 in game w{i} x{i} y{i}") for i in range(1, 301)]
    docs += [(i, f"i will kill you w{i} x{i} y{i}") for i in range(301, 401)]
    labels = spark.createDataFrame([(i, int(i > 300)) for i, _ in docs], "doc_id long, toxic int")
    s = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels).score
    assert s("yesterday they beat them 5-2") < 0.5 and s("he will kill you") > 0.9
    s = toxicity.Model({"idiot": 0.8}, 0.02).score
    assert s("don't hurt them") < 0.5 and s("never hurt or kill those people") < 0.5
    assert s("not. hurt them") > 0.5 and s("i do not hurt people i kill them") > 0.5 and s("kill them") > 0.5
    clean = "a clean sentence about the garden. " * 300
    assert s(clean + "hang her coat. " + clean) < 0.5 and s(clean + "you idiot. " + clean) < 0.5
    assert s("idiot. kill them. " * 300) > 0.9 and s(clean + "you idiot. i will kill you. " * 20) > 0.9
