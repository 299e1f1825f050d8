"""What workers keep is bounded in bytes, and results don't hang on what is kept."""

import random
import subprocess
import sys

import pytest

from quarry.llm import byte_bpe, jaccard_join, stores, token_counts, weak_label

known = pytest.importorskip("public_tokenizers")

GROWTH = """
import random, resource, sys
sys.path.insert(0, {root!r})
import public_tokenizers as P
from quarry.llm import token_counts
m, rng = token_counts.model(P.path("piece_bpe_32k.model")), random.Random(1)
for _ in range(1000):
    m.count("".join(map(chr, rng.choices(range(0x4E00, 0x9FA5), k=50_000))))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_thousand_long_texts_without_spaces_stay_small():
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", GROWTH.format(root=root)], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout) < 300


def test_long_units_count_as_the_library_does():
    import sentencepiece as spm

    path = known.path("piece_bpe_32k.model")
    m, sp, rng = token_counts.model(path), spm.SentencePieceProcessor(model_file=path), random.Random(2)
    for alphabet in ("世界的一是不了人我在有他这中大来上国的的", "abcdeinthe", "ab世é🙂.,!", "กขคงจฉชซ", "0123456789+/ABCDEFabcdef="):
        for n in (63, 64, 65, 200, 3000):
            t = "".join(rng.choices(alphabet, k=n))
            assert m.count(t) == len(sp.encode(t))
            prefixes = m.at_prefixes(t)
            assert len(prefixes) == n + 1 and prefixes[-1] == m.count(t)
            for k in (1, n // 2, n - 1):
                assert prefixes[k] == len(sp.encode(t[:k]))


def test_stores_share_one_budget(monkeypatch):
    monkeypatch.setattr(stores, "BUDGET", 20_000)
    words, shapes, bpe = jaccard_join.WordHashes(), weak_label.Shapes(), byte_bpe.ByteBPE(known.path("byte_bpe_50k.tiktoken"), known.PATTERN)
    m = token_counts.PrefixCounts(known.path("piece_bpe_32k.model"))
    made = {}
    for i in range(3000):
        w = f"word{i % 700}é"
        got = (words[w], shapes[w], bpe[w], m[w])
        assert made.setdefault(w, got) == got
        now = (words, shapes, bpe, m, m.prefixes)
        old = (words.old, shapes.old, bpe.old, m.old, m.old_prefixes)
        size = sum(sys.getsizeof(k) + stores.ENTRY for s in now + old for k in s)
        assert stores.held() <= 10_000 and size <= 20_000
    assert words.keep("x" * 65, 1, 1) == 1 and "x" * 65 not in words


def test_what_is_met_again_stays(monkeypatch):
    monkeypatch.setattr(stores, "BUDGET", 20_000)
    made = []

    class Lengths(stores.Store):
        def __missing__(self, key):
            n = self.old.get(key)
            if n is None:
                made.append(key)
                n = len(key)
            return self.keep(key, n, 32)

    lengths = Lengths()
    for i in range(2000):
        assert lengths["often"] == 5 and lengths[f"once{i}"] == len(f"once{i}")
    assert made.count("often") == 1 and len(made) == 2001
    with stores.room(1 << 20):
        for i in range(500):
            lengths[f"more{i}"]
        assert stores.held() > 20_000
    assert stores.held() <= 10_000


def test_stores_that_are_gone_are_not_held():
    before = sum(r() is not None for r in stores._stores)
    for _ in range(5):
        jaccard_join.WordHashes()
    assert sum(r() is not None for r in stores._stores) == before
