"""The prefix trie and importance resampling against plain-Python statements, and toxicity by held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evalweave.llm import hot, prefix_trie, resampling, toxicity

TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, n_convs INT, depth STRING"


def trie_brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [(role, text) for _, _, role, text in sorted(turns, key=lambda t: t[:2])] for conv, turns in by.items()}
    rebuilt = {}
    for conv in own:
        lead = zlib.crc32(str(conv).encode()) % 4
        rebuilt[conv] = own.get(conv - int(math.fmod(conv, 20)), [])[:lead] + own[conv][lead:]
    members = defaultdict(list)
    for conv, turns in rebuilt.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = Counter(), Counter()
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[c] for c in children[path])
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(rebuilt[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, parts=3):
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows], TURNS).repartition(parts)
    found = prefix_trie.prefix_trie(frame)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found.columns == names
    return sorted((tuple(row) for row in found.collect()), key=repr)


def test_trie_of_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie(spark, rows) == trie_brute(rows)


def test_trie_of_few_texts(spark):
    rng = random.Random(3)
    rows = []
    for conv in rng.sample(range(200), 90):
        # Few different texts, so that paths are shared at every depth; some turns are null.
        rows += [(conv, turn if turn else None, rng.choice(["user", None]), rng.choice(["a b", "c", "", None])) for turn in range(rng.randrange(0, 7))]
    rows += [(20, k, "user", "a b") for k in range(300)] + [(40, k, "user", "a b") for k in range(300)]
    rows += [(None, 1, "user", "left out")]
    assert trie(spark, rows) == trie_brute(rows)


def test_trie_hot_keys(spark, monkeypatch):
    """Conversations and parents that are broadcast as hot keys, and a conversation over several slabs."""
    monkeypatch.setattr(hot, "HOT_PARTS", 50)
    real = hot.join_single
    monkeypatch.setattr(prefix_trie, "join_single", lambda *args: real(*args, hot_rows=5))
    monkeypatch.setattr(prefix_trie, "CHUNK", 10)
    rows = [(conv, turn, "user", f"t{turn} of {conv % 3 if turn else 0}") for conv in range(120) for turn in range(4)]
    rows += [(7, turn, "user", f"long {turn}") for turn in range(4, 400)]
    assert trie(spark, rows, 5) == trie_brute(rows)


def test_trie_edges(spark):
    assert trie(spark, []) == []
    nothing = hashlib.sha256(b"").hexdigest()
    lead = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    # Two own turns, all left out, and no base: a turnless conversation.
    assert trie(spark, [(lead, 1, "user", "x"), (lead, 2, "user", "y")]) == [(lead, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lead).encode()).hexdigest())]
    same = trie(spark, [(20, 1, "u", "a b c"), (20, 1, "u", "a b c"), (40, 1, "u", "a b c"), (40, 1, "u", "a b c")])
    assert same == trie_brute([(20, 1, "u", "a b c")] * 2 + [(40, 1, "u", "a b c")] * 2)
    assert (20, 0, None, 2, 1, 1, 6, nothing) in same


def test_trie_takes_another_salt(spark, monkeypatch):
    """Turns that collide under one salt are told apart under the next."""
    real = prefix_trie._turns
    weak = F.unhex(F.lpad(F.hex(F.crc32(F.col("text")) % 2), 32, "0"))
    monkeypatch.setattr(prefix_trie, "_turns", lambda frame, salt: real(frame, salt) if salt else real(frame, salt).withColumn("digest", weak))
    rows = [(20 * k, turn, "u", f"text {(k * turn) % 5}") for k in range(6) for turn in range(4)]
    assert trie(spark, rows) == trie_brute(rows)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def resample_brute(docs, target):
    bucket = lambda feature: zlib.crc32(feature.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs(text)[1]))
    for text in target:
        t.update(map(bucket, runs(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    out, able = [], []
    for number, (key, text) in enumerate(docs):
        words, features = runs(text)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(features), weight, score, None])
        if len(words) >= 20:
            able.append(number)
    able.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, number in enumerate(able[: 5 * len(able) // 100], 1):
        out[number][4] = rank
    return sorted(map(tuple, out), key=repr)


def resampled(docs, target):
    found = resampling.resample(docs, target)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(row) for row in found.collect()), key=repr)


def test_resample_of_given_table(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert resampled(docs, target) == resample_brute(rows, [r.text for r in target.collect()])


@pytest.mark.parametrize("slice_bytes", [40, 1 << 20])
def test_resample_edges(spark, docs_of, monkeypatch, slice_bytes):
    """Slices of a few words give the same counts; features longer than a matrix go to zlib."""
    monkeypatch.setattr(resampling, "SLICE_BYTES", slice_bytes)
    rng = random.Random(5)
    letters = ["A", "z", "9", "é", "日", "\U0001f600", " ", " ", "\n", "-", "[", "\x7f", "\x00"]
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(200)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "word " * 40), (103, "x" * 2000 + " y " + "z" * 600), (104, "w " * 30), (104, "w " * 30)]
    target = spark.createDataFrame([(1, "z A 9"), (2, None), (3, "w w w")], "item_id INT, text STRING")
    assert resampled(docs_of(rows), target) == resample_brute(rows, ["z A 9", None, "w w w"])


def test_resample_of_nothing(spark, docs_of):
    empty = docs_of([(1, "a")]).where("false")
    target = spark.createDataFrame([], "text STRING")
    assert resampled(empty, target) == []
    assert resampled(docs_of([(1, "a b")]), target) == resample_brute([(1, "a b")], [])


def test_matrix_crcs():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    spans = [(a, a + rng.randrange(0, 700)) for a in range(0, 4200, 7)]
    import numpy as np

    found = resampling.span_crcs(np.frombuffer(data, dtype=np.uint8), np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert found.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


def _rated(n=600):
    rng = random.Random(11)
    plain = ["river", "stone", "garden", "window", "letter", "market", "silver", "winter", "bridge", "candle", "forest", "harbour"]
    rude = ["grobnik", "zlotvor", "hulyan"]
    rows, marks = [], {}
    for k in range(n):
        toxic = k % 6 == 0
        words = [rng.choice(plain) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(20, 90))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((k, " ".join(words)))
        marks[k] = int(toxic)
    return rows, marks


def test_toxicity_tells_texts_apart(spark, docs_of):
    rows, marks = _rated()
    ratings = spark.createDataFrame([(k, m, 1) for k, m in marks.items() if zlib.crc32(str(k).encode()) % 5], "doc_id BIGINT, toxic INT, quality INT")
    docs = docs_of(rows)
    found = toxicity.score(docs, toxicity.fit(docs, ratings)).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    wrong = [r for r in held if r.predicted != marks[r.doc_id]]
    assert len(wrong) <= 2


def test_toxicity_edges(spark, docs_of):
    rows, marks = _rated()
    ratings = spark.createDataFrame([*marks.items(), (None, 1), (9999, 1), (3, None), (4, 7), (6, 0)], "doc_id BIGINT, toxic INT")
    docs = docs_of(rows)
    model = toxicity.fit(docs, ratings)
    odd = [(1, None), (2, ""), (3, " \n"), (4, "plain"), (None, "zlotvor"), (5, "x" * 300_000 + " grobnik hulyan zlotvor"), (6, "zlotvor grobnik hulyan"), (6, "zlotvor grobnik hulyan"), (7, "river " * 60_000 + "hulyan grobnik zlotvor")]
    frame = docs_of(odd)
    found = toxicity.score(frame, model)
    assert set(found.columns) == {*frame.columns, "predicted"} and found.count() == len(odd)
    by = {r.doc_id: r for r in found.collect()}
    assert by[1].score == by[2].score == by[3].score < 0.5
    # The last window of a long text counts like the first one.
    assert by[6].predicted == by[7].predicted == by[5].predicted == 1
    assert toxicity.score(frame.where("false"), model).count() == 0
    # Nothing rated: nothing is toxic. One class only: the share of it.
    none = toxicity.fit(docs, ratings.where("false"))
    assert {r.score for r in toxicity.score(frame, none).collect()} == {0.0}
    one = toxicity.fit(docs, ratings.where("toxic = 0"))
    assert {r.score for r in toxicity.score(frame, one).collect()} == {0.0}


def test_toxicity_is_what_the_lengths_say(spark, docs_of):
    """Scores equal those of a plain loop over windows with the model's two dictionaries."""
    import zstandard

    rows, marks = _rated(300)
    docs = docs_of(rows)
    model = toxicity.fit(docs, spark.createDataFrame(list(marks.items()), "doc_id BIGINT, toxic INT"))
    assert model.weights
    frames = []
    for content, kind in ((model.ordinary, zstandard.DICT_TYPE_AUTO), (model.toxic, zstandard.DICT_TYPE_RAWCONTENT)):
        frames.append(zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False))

    def brute(text):
        total = 0.0
        for word in set(re.findall(r"[^\W_]+", text.lower())):
            code = toxicity.wide(f" {word} ".encode())
            gain = max(0, len(frames[0].compress(code)) - len(frames[1].compress(code)))
            total += model.weights[min(gain, 40)]
        return 1 / (1 + math.exp(-(model.slope * min(60, total) + model.offset)))

    for row in toxicity.score(docs, model).collect():
        assert row.score == pytest.approx(brute(row.text), abs=1e-9)
