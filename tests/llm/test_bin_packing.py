"""Packing against the tokenizer itself, the lower bound, and exhaustive search."""

import collections
import itertools
import random
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from hourloom.llm import bin_packing
from hourloom.llm.queries import WORD_VOCABULARY

SCHEMA = "doc_id long, text string, rank int, sequence_id int, task string, length double"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", 0.5) for i, t in rows], SCHEMA)


def _rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéßŸﬁ'’.,19") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([1, 5, 60, 300]))) for _ in range(120)]
    texts += ["", None, " \n\t ", "a<|endoftext|>b", "İstanbul J̌x é\x85日本\x1c語　x", "x" * 9000, "same text", "same text"]
    rows = list(enumerate(texts))
    return rows + [(3, "other text of a repeated id"), (None, "no id"), (None, "no id"), (900, "it's 12.5 % of Straße " * 60_000)]


def test_coder_equals_the_tokenizer():
    whole = Tokenizer.from_file(WORD_VOCABULARY)
    with open(WORD_VOCABULARY, "rb") as f:
        coder = bin_packing.Coder(f.read(), False)
    rng = random.Random(1)
    letters = [chr(c) for c in range(1, 0x180)] + list("̌́ẞKΣς½ 　日本'’<|½")
    for _ in range(4000):
        text = "".join(rng.choice(letters) if rng.random() < 0.6 else rng.choice("stredvml' ") for _ in range(rng.randint(0, 30)))
        got = b"".join(coder.encode(text.encode()))
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == whole.encode(text, add_special_tokens=False).ids, ascii(text)


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(bin_packing, "CACHE_WORDS", 3)
    monkeypatch.setattr(bin_packing, "CACHE_BYTES", 6)
    whole = Tokenizer.from_file(WORD_VOCABULARY)
    with open(WORD_VOCABULARY, "rb") as f:
        coder = bin_packing.Coder(f.read(), False)
    for text in ["one two three four five six, seven", "a longer-than-six word", "日本語日本語 one", "two one two"] * 2:
        got = b"".join(coder.encode(text.encode()))
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == whole.encode(text, add_special_tokens=False).ids
        assert len(coder.words) <= 7


@pytest.mark.parametrize("length", [4096, 64])
def test_pieces_and_places(spark, length):
    whole, rows = Tokenizer.from_file(WORD_VOCABULARY), _rows()
    got = bin_packing.pack(_docs(spark, rows).repartition(3), WORD_VOCABULARY, length).collect()
    expected = collections.Counter()
    for doc, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            expected[(doc, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= length
    least = -(-sum(r.length for r in got) // length)
    assert least <= len(filled) <= least + 1


def test_sequences_hold_the_tokens(spark):
    pieces = bin_packing.token_pieces(_docs(spark, _rows()[:140]), WORD_VOCABULARY, 64)
    by_piece = collections.Counter((r.doc_id, r.piece, bytes(r.ids)) for r in pieces.collect())
    found = collections.Counter()
    for r in bin_packing.sequences(pieces, 64).collect():
        assert len(r.ids) == 4 * r.n_tokens <= 256
        ends = [*[d.offset for d in r.documents][1:], r.n_tokens]
        for d, end in zip(r.documents, ends):
            found[(d.doc_id, d.piece, bytes(r.ids[4 * d.offset : 4 * end]))] += 1
    assert found == by_piece


def test_empty_table(spark):
    assert bin_packing.pack(_docs(spark, []), WORD_VOCABULARY).collect() == []
    assert bin_packing.minimum_bin_slack({}) == []


def test_fullest_is_the_fullest():
    rng = random.Random(3)
    for _ in range(300):
        sizes = sorted(rng.sample(range(1, 30), rng.randint(1, 5)), reverse=True)
        available = [(s, rng.randint(0, 3)) for s in sizes]
        room = rng.randint(0, 60)
        sums = {sum(s * k for (s, _), k in zip(available, taken)) for taken in itertools.product(*[range(n + 1) for _, n in available])}
        chosen = bin_packing.fullest(available, room)
        assert all(n <= dict(available)[s] for s, n in chosen.items())
        assert sum(s * n for s, n in chosen.items()) == max(x for x in sums if x <= room)


def _optimum(sizes, length):
    best = [len(sizes)]

    def put(i, bins):
        if len(bins) >= best[0] and i < len(sizes):
            return
        if i == len(sizes):
            best[0] = min(best[0], len(bins))
            return
        for room in set(bins):
            if sizes[i] <= room:
                rest = list(bins)
                rest.remove(room)
                put(i + 1, [*rest, room - sizes[i]])
        put(i + 1, [*bins, length - sizes[i]])

    put(0, [])
    return best[0]


def test_few_sequences_against_exhaustive_search():
    rng, more = random.Random(4), 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        fills = bin_packing.minimum_bin_slack(collections.Counter(sizes), 20)
        assert sorted((s for f in fills for s, n in f.parts for _ in range(n * f.times)), reverse=True) == sizes
        more += sum(f.times for f in fills) - _optimum(sizes, 20)
    assert more <= 3


def test_many_pieces_cost_no_more_than_few():
    counts = {1366: 10**9, 1365: 7, 1: 10**9, 4000: 5 * 10**8, 4096: 10**10}
    fills = bin_packing.minimum_bin_slack(counts)
    taken = collections.Counter()
    for f in fills:
        assert sum(s * n for s, n in f.parts) <= 4096
        for s, n in f.parts:
            taken[s] += n * f.times
    assert taken == counts and len(fills) < 12


def test_lengths_are_checked():
    with pytest.raises(ValueError):
        bin_packing.minimum_bin_slack({4097: 1})
