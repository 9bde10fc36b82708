import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from murmuration.llm.bpe import Encoder, PairIndex, Vocabulary, bpe_encode
from tests.llm.cases import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_awkward_rows_match_the_library(spark, library):
    docs = awkward(spark, ["it's <|endoftext|> DON'T", "aaaaaaaaaaaa", "ΣΑΣ ẞ İ", "áé"])
    for r in bpe_encode(docs, PATH).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe_encode(empty(spark), PATH).count() == 0


def test_random_texts_match_the_library(library):
    rng = random.Random(1)
    encoder = Encoder(Vocabulary.load(PATH))
    pool = [*range(0x20, 0x7F), *range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x370, 0x400), *range(0x600, 0x6FF),
            *range(0x4E00, 0x4E40), 0x1F600, 0x200D, 9, 10, 0x85, 0x2028, 0x3000, 0x1C, 0xFEFF, 0x130, 0x3A3, 0xFB01, 0, 0x301]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|startoftext|>" + t[:5] + "<|endoftext|>" for t in texts[:50]]
    for text, ids in zip(texts, encoder.encode([encoder.split(t) for t in texts])):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids == wanted, text
        assert encoder.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def plain(word, merges):
    while True:
        pairs = [(merges[p][0], k) for k, p in enumerate(zip(word, word[1:])) if p in merges]
        if not pairs:
            return word
        _, k = min(pairs)
        word = [*word[:k], merges[tuple(word[k : k + 2])][1], *word[k + 2 :]]


def test_merges_whose_results_merge_earlier():
    rng = random.Random(4)
    for _ in range(300):
        merges, new = {}, 4
        for rank in rng.sample(range(30), 12):
            merges.setdefault((rng.randrange(new), rng.randrange(new)), (rank, rng.choice([new, rng.randrange(4, new + 1)])))
            new = max(m[1] for m in merges.values()) + 1
        ranks = sorted({m[0] for m in merges.values()})
        merges = {p: (ranks.index(r), t) for p, (r, t) in merges.items()}
        words = [[rng.randrange(4) for _ in range(rng.randint(0, 14))] for _ in range(8)]
        assert PairIndex(merges).encode(words) == [plain(w, merges) for w in words]


def test_pairs_of_symbols_beyond_those_that_merge():
    """Merged symbols that are in no pair, empty words and an empty list."""
    index = PairIndex({(1, 2): (0, 900), (3, 3): (1, 2)})
    assert index.encode([[], [1, 2, 1], [900, 1, 2], [1, 3, 3], [3, 3, 3], [7], []]) == [[], [900, 1], [900, 900], [900], [2, 3], [7], []]
    assert index.encode([]) == [] and PairIndex({}).encode([[5, 6]]) == [[5, 6]]


def test_long_words_leave_the_passes(library):
    rng = random.Random(7)
    encoder = Encoder(Vocabulary.load(PATH))
    words = ["".join(rng.choice("aeinrst") for _ in range(n)) for n in (1, 23, 24, 25, 26, 60, 3000)]
    texts = ["a" * 999, "abababab" * 40, "é" * 80, "!?" * 77, " ".join(words), " ".join(reversed(words))]
    for text, ids in zip(texts, encoder.encode([encoder.split(t) for t in texts])):
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_white_space_that_only_some_split_at(library):
    encoder = Encoder(Vocabulary.load(PATH))
    for c in map(chr, [*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF]):
        for text in (f"{c}it{c}'s{c}{c} a{c}", f"it{c}\x1f{c}s"):
            assert encoder.encode([encoder.split(text)])[0] == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_a_batch_merge_side_by_side():
    """Passes over a batch cost a part of the walk from pair to pair."""
    rng = random.Random(3)
    encoder = Encoder(Vocabulary.load(PATH))
    words = ["".join(rng.choice("aeioulmnrstdk") for _ in range(rng.randint(4, 11))) for _ in range(20_000)]
    symbols, sizes = encoder.letters(words)
    ends = sizes.cumsum().tolist()
    letters = [symbols[a:b].tolist() for a, b in zip([0, *ends], ends)]
    start = time.process_time()
    walked = encoder.index._walk(letters)
    middle = time.process_time()
    assert encoder.index.encode(letters) == walked
    assert time.process_time() - middle < 0.6 * (middle - start)
