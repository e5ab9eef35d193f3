"""Chunking, duplicates and embeddings."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators import chunking
from evalweave.operators.chunking import SEPARATORS, count_tokens, recursive_chunks, recursive_spans, word_chunks
from evalweave.operators.dedup import unique_chunks
from evalweave.operators.embedding import embed_batches, embed_hashed, hashing_embedder, l2_normalised
from evalweave.sources.tables import table

TEXTS = [
    "", "   \n ", "short", "a " * 50, "one. two. three.\n\nfour five\nsix", "x" * 900, "p1 w w\n\n" * 40 + "\n",
    "  lead and trail  ", "word " * 13 + ".\n" + "tail", "é ü " * 30, "a.b.c." * 30,
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, source STRING")


def random_docs(seed=5, n=60):
    rng = random.Random(seed)
    parts = ["alpha", "be", "c", ".", " ", "\n", "\n\n", ", ", "longerword", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(n)]


@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 0), (50, 20), (1, 0)])
def test_recursive_chunks_keep_size_place_and_coverage(size, overlap):
    for text in TEXTS + random_docs():
        spans = recursive_spans(text, size, overlap)
        covered = np.zeros(len(text), bool)
        for lo, hi in spans:
            piece = text[lo:hi]
            assert piece == piece.strip() and piece
            assert count_tokens(piece) <= size
            covered[lo:hi] = True
        assert all(c or ch.isspace() for c, ch in zip(covered, text))
        assert [lo for lo, _ in spans] == sorted(lo for lo, _ in spans)


def test_recursive_chunks_overlap_at_most_as_asked():
    text = "\n".join(f"w{i}" for i in range(100))
    spans = recursive_spans(text, 10, 4)
    for (_, hi), (lo, _) in zip(spans, spans[1:]):
        assert count_tokens(text[lo:hi]) <= 4
    assert any(lo < hi for (_, hi), (lo, _) in zip(spans, spans[1:]))


def test_recursive_chunks_prefer_coarse_separators():
    text = "a b c\n\nd e f\n\ng h i"
    assert [text[lo:hi] for lo, hi in recursive_spans(text, 4, 0)] == ["a b c", "d e f", "g h i"]


def words_py(text, size, overlap):
    words = text.split(" ")
    out, start = [], 0
    while True:
        piece = " ".join(words[start : start + size])
        out.append((len(" ".join(words[:start])) + (start > 0), piece))
        if start + size >= len(words):
            return [(i, at, p) for i, (at, p) in enumerate(out) if p.strip()]
        start += size - overlap


@pytest.mark.parametrize("size, overlap", [(10, 3), (5, 0), (200, 20)])
def test_word_chunks(spark, size, overlap):
    texts = TEXTS + random_docs(9)
    rows = word_chunks(docs(spark, texts), size, overlap).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.chunk_idx, r.start_index, r.content))
        assert texts[r.doc_id][r.start_index :].startswith(r.content)
        assert r.source == f"s{r.doc_id}"
    for i, text in enumerate(texts):
        assert sorted(found.get(i, [])) == words_py(text, size, overlap)


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_first_copy_survives_whatever_the_partitioning(spark, partitions):
    rng = random.Random(1)
    # One content makes up a third of all rows.
    rows = [(i, 0, 0, "hot" if i % 3 == 0 else rng.choice("abcdef") * 3, f"s{i}") for i in range(600)]
    chunks = spark.createDataFrame(rows, "doc_id BIGINT, chunk_idx INT, start_index INT, content STRING, source STRING")
    first = {}
    for doc_id, _, _, content, source in rows:
        first.setdefault(content, (doc_id, source))
    unique = unique_chunks(chunks.repartition(partitions))
    assert {r.content: (r.doc_id, r.source) for r in unique.collect()} == first
    assert unique_chunks(unique.drop("content_sha")).count() == len(first)


def test_hashing_embedders_agree(spark):
    rows = docs(spark, TEXTS + random_docs(4)).withColumnRenamed("text", "content")
    native = {r.doc_id: list(r.embedding) for r in embed_hashed(rows).collect()}
    batched = {r.doc_id: list(r.embedding) for r in embed_batches(rows, batch_size=7).collect()}
    assert native == batched
    direct = hashing_embedder()()(["a b a"])[0]
    assert direct.sum() == 3 and direct.max() == 2


def test_normalised_vectors_have_unit_length(spark):
    rows = docs(spark, ["a b c", ""]).select("doc_id", F.col("text").alias("content"))
    vectors = [np.array(r.v) for r in embed_hashed(rows).select(l2_normalised(F.col("embedding")).alias("v")).collect()]
    assert sorted(round(float(v @ v), 9) for v in vectors) == [0.0, 1.0]


def test_recursive_chunks_of_a_table(spark, sf_dir):
    corpus = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    texts = {r.doc_id: r.text for r in corpus.collect()}
    rows = recursive_chunks(corpus.repartition(3), 200, 20).collect()
    expected = {d: recursive_spans(text, 200, 20) for d, text in texts.items()}
    assert len(rows) == sum(map(len, expected.values()))
    for r in rows:
        assert texts[r.doc_id][r.start_index : r.start_index + len(r.content)] == r.content
        assert expected[r.doc_id][r.chunk_idx][0] == r.start_index


def brute_chunks(text, size, overlap):
    """The chunker stated anew, on strings: pieces are counted by scanning them."""
    count = lambda piece: len(re.findall(r"\w+|[^\w\s]", piece))
    out = []

    def pieces(start, part, separators):
        found = next(k for k, s in enumerate(separators) if s == "" or s in part)
        mark, finer = separators[found], separators[found + 1 :]
        cut = [part[k : k + 1] for k in range(len(part))] if not mark else [p for p in re.split(f"(?={re.escape(mark)})", part) if p]
        if mark == "\n\n":  # overlapping matches cut once
            cut, rest = [], part
            while rest:
                at = rest.find(mark, 2 if rest.startswith(mark) else 0)
                cut.append(rest if at < 1 else rest[:at])
                rest = rest[len(cut[-1]) :]
        held, at = [], start
        for p in cut:
            if mark == "" or count(p) < size:
                held.append((at, p))
            else:
                merge(held)
                held = []
                pieces(at, p, finer)
            at += len(p)
        merge(held)

    def merge(parts):
        begin = 0
        for end in range(len(parts) + 1):
            window = lambda: sum(count(p) for _, p in parts[begin:end])  # noqa: E731, B023
            if end == len(parts) or (begin < end and window() + count(parts[end][1]) > size):
                whole = "".join(p for _, p in parts[begin:end])
                if whole.strip():
                    lead = len(whole) - len(whole.lstrip())
                    out.append((parts[begin][0] + lead, parts[begin][0] + lead + len(whole.strip())))
                if end < len(parts):
                    while begin < end and (window() > overlap or window() + count(parts[end][1]) > size):
                        begin += 1

    if text:
        pieces(0, text, list(SEPARATORS))
    return out


def test_recursive_chunks_equal_an_independent_chunker():
    rng = random.Random(17)
    words = ["a", "bb", "ccc", "d.", "e,f", "é", "日本", "x" * 9, "1.5", "."]
    for k in range(1000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\n\n", ". ", ""]) for _ in range(rng.randrange(60)))
        size, overlap = rng.choice([(1, 0), (2, 1), (4, 0), (5, 3), (9, 4), (30, 7)])
        assert recursive_spans(text, size, overlap) == brute_chunks(text, size, overlap), (k, text, size, overlap)


def test_each_text_is_tokenised_once(monkeypatch):
    calls = []
    real = chunking.TokenOffsets.__init__
    monkeypatch.setattr(chunking.TokenOffsets, "__init__", lambda self, text: calls.append(len(text)) or real(self, text))
    monkeypatch.setattr(chunking, "_TOKEN", re.compile(r"\w+|[^\w\s]"))
    text = ("word word. word\n" * 40 + "\n") * 20
    assert len(recursive_spans(text, 10, 3)) > 100 and calls == [len(text)]


def test_recursive_spans_of_a_long_unbroken_text_take_little_memory():
    import tracemalloc

    text = "x" * 1_000_000
    tracemalloc.start()
    spans = recursive_spans(text, 200, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans[0] == (0, 200) and spans[-1][1] == len(text) and all(hi - lo <= 200 for lo, hi in spans)
    assert peak < 16 << 20, peak  # one part list per character held ~150 MB
