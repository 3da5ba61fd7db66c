import itertools
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from credograph.llm.packing import Packer, pack
from credograph.llm.tokens import WordIds
from tokenizers import Tokenizer

PATH = P.path("word_bpe_49k.json")


def test_ids_match_the_library():
    own, library = WordIds(PATH, limit=50), Tokenizer.from_file(PATH)
    texts = ["", " ", "It's a DOG'S life: don't!!", "ÉTÉ œuvre №5 x² ½", "Straße ẞ ÄÖÜ ñ'ré", "日本語 テキスト", "ΣΑΣ ΟΔΟΣ", "été", "<|endoftext|> a", "a<|startoftext|>b", "İstanbul ı", "\x00\x1f\x7f\x85\xa0tab\ttab", "a_b-c/d 12.5%", "\U0001f600 ok", "KK", "ŉ ſ ĸ", "it'S I'LL we'Ve 'tis'd"]
    rnd = random.Random(1)
    letters = "abcXYZ'sdtélÑß 0129.,!|#\n\t-_²ªº\xad\xb7×÷ÿŸĲĳ"
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 80))) for _ in range(3000)]
    for t, ids in zip(texts, own.encode_all(pa.array(texts))):
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == want, repr(t)
        assert ids.tolist() == want, repr(t)


def test_every_plain_character():
    own, library = WordIds(PATH), Tokenizer.from_file(PATH)
    texts = [t for c in map(chr, [*range(0x250), *range(0x2000, 0x2070), 0x20AC]) for t in (c, f"a{c}b", f"A{c} 1{c}2")]
    for t, ids in zip(texts, own.encode_all(pa.array(texts))):
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == want, repr(t)
        assert ids.tolist() == want, repr(t)


def test_table_of_words_is_small():
    own, words = WordIds(PATH), [f"{a}{b}" for a in ("mon", "tur", "bel", "ka") for b in map("".join, itertools.product("aeioubdfg", repeat=5))]
    few = len(list(own.encode_all(pa.array(["a"]))))
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for k in range(0, len(words), 10000):
        few += sum(map(len, own.encode_all(pa.array([" ".join(words[k : k + 10000])]))))
    used = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert few > len(words) and used < 60 * len(words)


def test_pieces_tile_documents_and_sequences(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["the", "of", "weird", "zq", "ß"]) for _ in range(rnd.choice([0, 3, 900, 5000])))) for i in range(300)]
    docs += [(1000, None), (1001, "")]
    got = pack(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int").repartition(3), PATH).toPandas()
    library = Tokenizer.from_file(PATH)
    for d, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == d].sort_values("start")
        assert own.doc_tokens.eq(len(ids)).all() and own.length.sum() == len(ids)
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)]
    padding = 0
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        n = own.length.sum()
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding == 0
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_level_minimises_sum_of_squares():
    rnd, packer = random.Random(3), Packer(16)
    for _ in range(2000):
        n = rnd.randint(1, 16)
        if n < 16:
            costs = {}
            for at in range(16 - n + 1):
                if at == 0 or packer.count[at]:
                    c = packer.count.copy()
                    if at:
                        c[at] -= 1
                    if at + n < 16:
                        c[at + n] += 1
                    costs[at] = int((c * c).sum())
            best = min(costs.values())
            assert packer.level(n) == max(k for k, v in costs.items() if v == best)
        for own in packer.place((0, 0, np.zeros(n))):
            assert sum(len(p[2]) for p in own) == 16
