"""Pieces are found and lattices made for words of all lengths together."""

import random

from tabprep.llm import pieces as pc
from tabprep.llm import sampled_pieces


def test_words_of_all_lengths_are_looked_up_together(monkeypatch):
    vocab = sampled_pieces.Vocabulary(pc.load())
    rng, calls, find = random.Random(3), [], sampled_pieces.Vocabulary.find
    words = ["".join(rng.choice("etaoinshrdlué漢\n") for _ in range(n)).strip() for n in range(1, 40) for _ in range(20)]
    words += ["the", "there", "thereafter", "", "\nline"]
    monkeypatch.setattr(sampled_pieces.Vocabulary, "find", lambda *a: calls.append(a[1]) or find(*a))
    many = sampled_pieces.Lattices(vocab)
    number = [many.numbers[w] for w in words]
    many.learn()
    assert len(calls) <= vocab.pieces.longest
    for w, n in zip(words[::7] + words[-5:], number[::7] + number[-5:]):
        one = sampled_pieces.Lattices(vocab)
        one.numbers[w]
        one.learn()
        a, b = many.first[n], many.last[n]
        arcs = slice(many.ptr[a], many.ptr[b])
        assert (many.piece[arcs] == one.piece).all() and (many.logp[arcs] == one.logp).all()
        assert (many.end[arcs] - a == one.end).all()


def test_every_piece_is_found():
    pieces = pc.load()
    vocab = sampled_pieces.Vocabulary(pieces)
    for n in range(1, pieces.longest + 1):
        texts = [p for p in pieces.ids if len(p) == n]
        hit, at = vocab.find(n, sampled_pieces.string_hashes(texts))
        assert hit.tolist() == list(range(len(texts)))
        assert vocab.ids[at].tolist() == [pieces.ids[t] for t in texts]
        assert len(vocab.find(n + 1, sampled_pieces.string_hashes(texts))[0]) == 0


def test_long_words_are_worked_on_in_slices(monkeypatch):
    vocab = sampled_pieces.Vocabulary(pc.load())
    rng, sizes, cut = random.Random(8), [], sampled_pieces.Lattices._slice
    words = ["".join(rng.choice("etaoinshrdlué漢") for _ in range(9_000)) for _ in range(12)] + ["ab", "cd"]
    monkeypatch.setattr(sampled_pieces.Lattices, "_slice", lambda *a: sizes.append(len(a[1])) or cut(*a))
    lat = sampled_pieces.Lattices(vocab)
    number = [lat.numbers[w] for w in words]
    lat.learn()
    assert sum(sizes) == sum(map(len, words)) + len(words) and max(sizes) < sampled_pieces.SLICE_CHARS + 10_000
    assert [lat.last[n] - lat.first[n] for n in number] == [len(w) + 1 for w in words]
