from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from keyloom.llm import packing as P


def filled(plan):
    """sequence -> [(offset, length)], and the ranks that each length was given."""
    out, ranks = {}, {}
    for length, first, n, sequence, each, offset in plan.runs:
        for r in range(n):
            ranks.setdefault(length, []).append(first + r)
            out.setdefault(sequence + r // each, []).append((offset + r % each * length, length))
    return out, ranks


def fewest(items, capacity):
    """Exact number of sequences, by dynamic programming over subsets."""
    n = len(items)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        for k in range(n):
            if mask >> k & 1:
                bins, used = best[mask ^ 1 << k]
                then = (bins, used + items[k]) if bins and used + items[k] <= capacity else (bins + 1, items[k])
                best[mask] = min(best[mask], then)
    return best[-1][0]


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_everything_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(3, 40))
    counts = np.bincount(rng.integers(1, capacity + 1, int(rng.integers(0, 80))), minlength=capacity + 1)
    plan = P.Plan(counts, capacity)
    out, ranks = filled(plan)
    assert all(sorted(ranks.get(k, [])) == list(range(n)) for k, n in enumerate(counts))
    assert len(out) == plan.sequences
    for parts in out.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("seed", range(25))
def test_reduction_keeps_the_optimum(seed):
    """Sets that dominate are part of some best packing: what is left needs just that many fewer."""
    rng = np.random.default_rng(100 + seed)
    capacity = int(rng.integers(8, 30))
    items = rng.integers(1, capacity + 1, 9).tolist()

    class Reduced(P.Plan):
        def _best_fit(self):
            pass

    plan = Reduced(np.bincount(items, minlength=capacity + 1), capacity)
    rest = [k for k, n in enumerate(plan.left) for _ in range(n)]
    assert plan.fixed + fewest(rest, capacity) == fewest(items, capacity)


def test_pairs_that_fill_are_found():
    plan = P.Plan(np.bincount([7, 3, 6, 4, 5, 5, 10], minlength=11), 10)
    assert plan.sequences == 4 and plan.fixed == 4


def check(rows, ids, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for key, own in ids.items():
        want = sorted((p, s, len(part), zlib.crc32(part.tobytes())) for e in own for p, s in enumerate(range(0, len(e), capacity)) for part in [e[s : s + capacity]])
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc.pop(key)) == want
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


def token_ids(texts):
    t = Tokenizer.from_file(P.TOKENIZER)
    out = {}
    for k, text in texts:
        out.setdefault(k, []).append(np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4"))
    return out


def test_query(spark, sf, texts):
    rows = P.op10_best_fit(spark, sf).collect()
    check(rows, token_ids(texts.items()), P.CAPACITY)
    total = sum(r["length"] for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // P.CAPACITY) + 1


def test_edges(edges, nothing, edge_texts):
    packed = P.pack_documents(edges, capacity=300)
    rows = packed.collect()
    check(rows, token_ids(edge_texts), 300)
    assert all(len(r.ids) == r["length"] and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert P.pack_documents(nothing).count() == 0


def test_words_apart_give_the_same_ids():
    encoder, t = P.WordEncoder(P.TOKENIZER), Tokenizer.from_file(P.TOKENIZER)
    odd = ["a\x1cb", "naïve CAFÉ", "<|endoftext|> x<|startoftext|>y", "été ΟΔΟΣ İstanbul", "日本語 12345 ½ ²", "it's we'll 'sabc don't''ve", "a\u00a0b\u2003c\u3000d", "\u00ad soft\u00adhy", "µ ª º ß ÿ", "\x00\x01 a\x7fb", "🎉🎉x", "e\u0301 cafe\u0301", "'Re 'VE x.. y,! .", "\x85"]
    for text in odd + [" ".join(p) for p in combinations(odd, 2)]:
        assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_words_that_come_again_are_encoded_once(monkeypatch):
    """However many new words come between; a cache that was emptied at its limit encoded them again and again."""
    monkeypatch.setattr(P, "CACHED_WORDS", 100)
    encoder, t, asked = P.WordEncoder(P.TOKENIZER), Tokenizer.from_file(P.TOKENIZER), []

    class Counted:
        model = encoder.model

        def tokenize(self, part):
            asked.append(part)
            return self.model.tokenize(part)

    encoder.model = Counted()
    often = ["The", "the", "THE,", "été.", "don't", "x-ray"]
    texts = [" ".join(often + [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + n)}" for n in range(20)]) for k in range(400)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(encoder.words) + len(getattr(encoder.words, "before", ())) <= 2 * 100 + 2 * len(text.split())
    for part in ["the", ",", "don", "'t", "x", "-", "ray"]:
        assert asked.count(part) == 1


def test_every_latin_character_in_words():
    encoder, t, rng = P.WordEncoder(P.TOKENIZER), Tokenizer.from_file(P.TOKENIZER), np.random.default_rng(5)
    latin = [chr(k) for k in range(256)]
    texts = [a + c + b for c in latin for a, b in (("", ""), ("A", "é"), ("9 ", "'"), ("<|STARTOFTEXT|>", "<|endoftext|>"), ("Ω", " Σ"))]
    texts += ["".join(rng.choice([c for c in latin if c.isprintable()] + [" ", "'", "\n", "\xa0"] * 20 + ["'ll", "<|endoftext|", "<|startoftext|>", "ΟΔΟΣ"], 60)) for _ in range(300)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
