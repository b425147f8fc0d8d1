"""BPE coding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from condfuse.llm import bpe, queries
from tests.conftest import SF_SMALL
from tests.llm.cases import DOCS, odd_documents, odd_frame, prose

ODD = ["Hello,  naïve ΣΑΣ <|endoftext|>x 123 don't\x1cfoo", "<|ENDOFTEXT|> <|startoftext|><|endoftext|> <|end oftext|>", "\x85 a\xa0b é ́x İ ﬁ 한국어 한 😀  z", "'s ''s 'S'T'll it's' '", "a" * 3001 + " " + "ab" * 700 + "'s",
       "\x00 \x01a\x7f", "ǅ ß ẞ K Å", "  \t\n", "", "é" * 500, "1234567890 ½ ² Ⅷ ٣", "� ﻿ ​‍", "x̀́̂" * 40, "<| |> <|", "ᄀ ᅡ 가"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))


@pytest.fixture(scope="module")
def rule():
    return bpe.rules(bpe.TOKENIZER)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_merge_only_makes_later_merges(rule):
    """What lets one round merge all pairs of a rank."""
    made = {int(m): k for k, m in enumerate(rule.merged)}
    assert len(made) == len(rule.merged)
    assert all(made.get(int(key >> 32), -1) < k and made.get(int(key & 0xFFFFFFFF), -1) < k for key, k in zip(rule.pair_keys, rule.pair_ranks, strict=True))


def noise(seed, n=400):
    rng = random.Random(seed)
    alphabet = "abcdeESTRL''  \n\t.,-123éÉßσΣжЖ한가́̈漢字😀\x85\xa0 \x1c‍|<>"
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("seed", range(20))
def test_merged_ids_are_the_librarys(rule, library, seed):
    coder = bpe._Coder(rule, None)
    for text in [noise(seed), noise(seed, 3000), *ODD]:
        assert coder.encode(text.encode()) == ids_of(library, text), text


def test_pieces_of_a_long_text(rule, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 100)
    monkeypatch.setattr(bpe, "HELD", 50)
    coder, text = bpe._Coder(rule, None), prose(5, 3000) + noise(3) + "y" * 500
    assert coder.encode(text.encode()) == ids_of(library, text)


def test_transducer(rule, tmp_path):
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode() for _ in range(3000)} | {b"\xc3\xa9", b"z\x00", b"z"}
    # outputs that share prefixes with neighbours or with none, among them empty ones
    entries = [(w, tuple(w[: rng.randint(0, len(w))]) + (rng.randrange(3),) * rng.randint(0, 2)) for w in sorted(words)]
    arrays = bpe.compile_lexicon(entries)
    path = tmp_path / "x.bin"
    path.write_bytes(bpe.pack_arrays(arrays))
    lexicon = bpe.Lexicon(str(path))
    assert isinstance(lexicon.a["keys"].base, np.memmap)
    probes = [w for w, _ in entries] + [b"", b"abcabcabcabc", b"q", b"a\x00", b"y" * 100] + [w + b"c" for w, _ in entries]
    want = {w: np.array(o, "<u4").tobytes() for w, o in entries}
    assert lexicon.find(probes) == [want.get(w) for w in probes]
    assert lexicon.find([]) == []
    assert bpe.compile_lexicon([])["keys"].size == 0


def test_transducer_is_minimal():
    """Words with one ending share its states: n prefixes and one suffix take the states of a tree plus one suffix."""
    words = [bytes([a, b]) + b"suffix" for a in range(65, 75) for b in range(65, 75)]
    arrays = bpe.compile_lexicon([(w, (1,)) for w in words])
    assert len(arrays["end"]) == 1 + 1 + 7  # root, second letter, after each letter of the suffix and its start
    assert len(arrays["keys"]) == 10 + 10 + 6 and arrays["ids"].tolist() == [1]


@pytest.mark.parametrize("lexicon_words", [100_000, 40, 0])
def test_coding_of_documents(spark, library, lexicon_words):
    rows = [(k, t, d[2], d[3], d[4]) for k, d in enumerate(odd_documents()) for t in [d[1]]] + [(1000 + k, t, None, None, None) for k, t in enumerate(ODD * 2)] + [(None, "no id", None, None, None)]
    got = bpe.encode_and_decode(odd_frame(spark, rows).repartition(3), lexicon_words=lexicon_words).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == np.array(want, "<u4").tobytes()
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_bytes_that_are_no_utf8(spark, library):
    raw = b"caf\xe9 na\xc3\xafve \xff\xfe ab\xc3 cd \xe2\x82"
    df = spark.createDataFrame([(1, bytearray(raw))], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    got = bpe.encode(df, bpe.build_lexicon(df)).first()
    assert got.ids == ids_of(library, raw.decode("utf-8", "replace"))


def test_empty_table_and_unknown_ids(spark):
    assert bpe.encode_and_decode(spark.createDataFrame([], DOCS)).count() == 0
    coded = spark.createDataFrame([(1, bytearray(np.array([320, 99_999_999, 49407], "<u4").tobytes())), (2, None), (3, bytearray())], "doc_id long, ids binary")
    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    assert {r.doc_id: r.decoded for r in bpe.decode(coded).collect()} == {1: library.decode([320, 99_999_999, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries.op13_bpe(spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_one_worker_encodes_and_decodes(spark):
    """A task holds the tokenizer's tables once: one Python pass from the texts to the decoded ones."""
    rows = [(1, prose(5, 30)), (2, None), (2, noise(3)), (3, ""), (None, "a b")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    both = bpe.encode_and_decode(df)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = bpe.encode(df)
    assert sorted(r.ids for r in both.collect()) == sorted(r.ids for r in apart.collect())
    assert sorted(r.decoded for r in both.collect()) == sorted(r.decoded for r in bpe.decode(apart).collect())
