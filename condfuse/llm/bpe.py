"""BPE encoding and decoding through a minimal acyclic transducer of the corpus's frequent words.

Words are counted over all documents.  The ``lexicon_words`` most frequent ones are merged once and
compiled into a minimal transducer (Mihov and Maurel: sorted words, equal suffix states shared, ids
pushed to the earliest transition that decides them).  It is one file of a few MB in the shared folder,
handed to the executors by Spark and mapped into memory there; a batch's words walk it together, one
array step per byte.  Words that it lacks are merged from the tokenizer's own table, so the lexicon
decides the time and never the result.

A text is cut at ASCII white space first: the tokenizer's normaliser and word pattern treat it as a
border in any case, so chunks can be worked on alone and long texts in pieces.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condfuse.llm.common import cut, shared_dir

TOKENIZER = "word_bpe_49k.json"
LEXICON_WORDS = 200_000
LONGEST = 64  # bytes of a word in the lexicon
PIECE = 1 << 20  # bytes of text split at once, of ids or texts given out at once
HELD = 300_000  # entries of each memo of a task, and of its counts
_GAP = re.compile(rb"[ \t-\r]")
_PLAIN = re.compile(rb"[!-~]+")
#: The word pattern of the tokenizer for lower-case ASCII; here a line end stands between chunks.
_WORD = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+")
_NONE = 1 << 62  # rank of a pair that no merge names
_rules: dict[str, Rules] = {}


class Rules:
    """The tokenizer's file: words of a chunk, merges of a word, tokens of ids.  Loaded once per process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.normal, self.cutter = self.library.normalizer, self.library.pre_tokenizer
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"].get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        keys = (merges[:, 0] << 32) | merges[:, 1]
        #: pairs in order of their keys with their ranks, and what a pair becomes by rank
        self.pair_ranks = np.argsort(keys)
        self.pair_keys, self.merged = keys[self.pair_ranks], merges[:, 2]
        letters = [c for c in self.vocab if len(c) == 1]
        self.inner, self.last = np.full((2, 1 + max(map(ord, letters))), -1, np.int64)
        for c in letters:
            self.inner[ord(c)], self.last[ord(c)] = self.vocab[c], self.vocab.get(c + self.suffix, -1)
        added = spec.get("added_tokens", [])
        if odd := [t["content"] for t in added if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])]:
            raise ValueError(f"added tokens that need their surroundings: {odd}")
        self.special = {t["content"]: t["id"] for t in added}
        self.special_at = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")") if self.special else None
        self.tokens = {i: t.encode() for t, i in {**self.vocab, **self.special}.items()}

    def split(self, chunks: list[bytes]) -> list[list[str | int]]:
        """The words of each chunk, in the tokenizer's byte alphabet; special tokens as their ids.

        Chunks of plain ASCII are cut by the pattern here, others by the library; both in one go with a
        line end or blank between the chunks, which no word holds.
        """
        out: list = [None] * len(chunks)
        plain, rest = [], []
        for k, c in enumerate(chunks):
            (plain if _PLAIN.fullmatch(c) and b"<|" not in c else rest).append(k)
        if plain:
            words = _WORD.findall(b"\n".join([chunks[k] for k in plain]).lower().decode("ascii"))
            ends = [at for at, w in enumerate(words) if w == "\n"]
            for k, lo, hi in zip(plain, [0, *[e + 1 for e in ends]], [*ends, len(words)], strict=True):
                out[k] = words[lo:hi]
        joined = []
        for k in rest:
            text = chunks[k].decode("utf-8", "replace")
            if b"<|" in chunks[k] or text.split() != [text]:
                out[k] = self._split_alone(text)
            else:
                joined.append((k, text))
        if joined:
            text = self.normal.normalize_str(" ".join([t for _, t in joined]))
            found = self.cutter.pre_tokenize_str(text)
            blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4") == 32)
            if len(blanks) != len(joined) - 1:
                raise ValueError("the normaliser moved a blank")
            bound = np.searchsorted([at for _, (at, _) in found], [-1, *blanks, len(text)]).tolist()
            for (k, _), lo, hi in zip(joined, bound, bound[1:], strict=False):
                out[k] = [w for w, _ in found[lo:hi]]
        return out

    def _split_alone(self, text: str) -> list[str | int]:
        out = []
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w for w, _ in self.cutter.pre_tokenize_str(self.normal.normalize_str(part))]
        return out

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word by its merges, all words at once: in a round every word merges its pairs of the
        lowest rank (from the left, as what a merge makes only has merges of higher rank), until it has none."""
        out: list = [b""] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        ids, word = self.inner[letters], np.repeat(np.arange(len(words)), size)
        tails = np.cumsum(size)[size > 0] - 1
        ids[tails] = self.last[letters[tails]]
        if (ids < 0).any():
            raise ValueError("a letter that the vocabulary lacks")
        while len(ids):
            keys = (ids[:-1] << 32) | ids[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.r_[np.where((self.pair_keys[at] == keys) & (word[:-1] == word[1:]), self.pair_ranks[at], _NONE), _NONE]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[starts, len(ids)])
            low = np.minimum.reduceat(rank, starts)
            done = low == _NONE
            if done.any():
                data = ids.astype("<u4").tobytes()
                for w, lo, n in zip(word[starts[done]].tolist(), starts[done].tolist(), length[done].tolist(), strict=True):
                    out[w] = data[4 * lo : 4 * (lo + n)]
            low = np.repeat(low, length)
            hits = np.flatnonzero((rank == low) & (rank != _NONE))
            # in a run of one repeated token every other hit is a pair
            first = np.maximum.accumulate(np.where(np.r_[True, np.diff(hits) != 1], hits, 0)) if len(hits) else hits
            hits = hits[(hits - first) % 2 == 0]
            ids[hits] = self.merged[rank[hits]]
            keep = low != _NONE
            keep[hits + 1] = False
            ids, word = ids[keep], word[keep]
        return out


def rules(name: str) -> Rules:
    """``name``: a path, or the name of a file of the public tokenizers."""
    if name not in _rules:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _rules[name] = Rules(path)
    return _rules[name]


def chunk_lists(text: bytes) -> Iterator[list[bytes]]:
    """The chunks of a text, a piece of about PIECE bytes at a time, cut at white space."""
    at = 0
    while at < len(text):
        border = _GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = border.start() if border else len(text)
        yield text[at:end].split()
        at = end


# ---------------------------------------------------------------- the lexicon


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts of ``docs`` (null: none), a word being the bytes between ASCII white space.
    Counts are folded per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
            words.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                for part in chunk_lists(text.as_buffer().to_pybytes()):
                    words.update(part)
                    if len(words) > HELD:
                        yield flushed()
        yield flushed()

    rows = docs.where("text IS NOT NULL").select("text")
    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _State:
    __slots__ = ("moves", "final", "rest")

    def __init__(self):
        self.moves: dict[int, list] = {}  # byte -> [state, ids]
        self.final, self.rest = False, ()


def _common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def compile_lexicon(entries: list[tuple[bytes, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The minimal transducer of ``entries`` (different non-empty words with their ids) as arrays.

    ``keys`` holds state * 256 + byte of every transition, sorted; ``to`` its target, ``out`` and
    ``out_n`` place and number of its ids in ``ids``; ``end`` and ``end_n`` the same for the ids a word
    still emits where it ends in a state, ``end`` being -1 where none ends.
    """
    known: dict[tuple, int] = {}
    states: list[_State] = []

    def settled(state: _State) -> int:
        """The number of the state that is equal to ``state``, itself if it is the first."""
        sign = (state.final, state.rest, tuple((b, t, o) for b, (t, o) in sorted(state.moves.items())))
        if sign not in known:
            known[sign] = len(states)
            states.append(state)
        return known[sign]

    def settle(path: list[_State], word: bytes, down_to: int) -> None:
        for k in range(len(word), down_to, -1):
            path[k - 1].moves[word[k - 1]][0] = settled(path[k])

    path, before = [_State()], b""
    for word, ids in sorted(entries):
        p = _common(word, before)
        settle(path, before, p)
        path = path[: p + 1] + [_State() for _ in range(len(word) - p)]
        for k in range(p):
            move = path[k].moves[word[k]]
            move[0] = -1
            n = _common(move[1], ids)
            if extra := move[1][n:]:
                inner = path[k + 1]
                for other in inner.moves.values():
                    other[1] = extra + other[1]
                if inner.final:
                    inner.rest = extra + inner.rest
                move[1] = move[1][:n]
            ids = ids[n:]
        for k in range(p, len(word)):
            path[k].moves[word[k]] = [-1, ids if k == p else ()]
        if p == len(word):
            raise ValueError(f"repeated or empty word {word!r}")
        path[-1].final, before = True, word
    settle(path, before, 0)
    root = settled(path[0])
    pool: dict[tuple, int] = {}
    flat: list[int] = []

    def placed(out: tuple) -> int:
        if out not in pool:
            pool[out] = len(flat)
            flat.extend(out)
        return pool[out]

    rows = [(s * 256 + b, t, placed(o), len(o)) for s, state in enumerate(states) for b, (t, o) in sorted(state.moves.items())]
    table = np.array(rows, np.int64).reshape(-1, 4)
    ends = [(placed(s.rest) if s.final else -1, len(s.rest)) for s in states]
    end = np.array(ends, np.int32).reshape(-1, 2)
    return {"keys": table[:, 0].copy(), "to": table[:, 1].astype(np.int32), "out": table[:, 2].astype(np.int32), "out_n": table[:, 3].astype(np.int32),
            "end": end[:, 0].copy(), "end_n": end[:, 1].copy(), "ids": np.array(flat, np.uint32), "root": np.array([root], np.int64)}


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a line that names the arrays, then each of them at a multiple of 64 bytes."""
    body, places = bytearray(), {}
    for name, a in arrays.items():
        body += bytes(-len(body) % 64)
        places[name] = (a.dtype.str, len(a), len(body))
        body += a.tobytes()
    head = json.dumps(places).encode()
    return head + b" " * (-(len(head) + 1) % 64) + b"\n" + bytes(body)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            line = file.readline()
        self.a = {name: np.asarray(np.memmap(path, kind, "r", len(line) + at, (n,))) if n else np.zeros(0, kind) for name, (kind, n, at) in json.loads(line).items()}

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian unsigned 32-bit numbers; None where the lexicon lacks it."""
        a, out = self.a, [None] * len(words)
        at = [k for k, w in enumerate(words) if 0 < len(w) <= LONGEST]
        if not at or not len(a["keys"]):
            return out
        letters = np.frombuffer(b"".join([words[k] for k in at]), np.uint8)
        size = np.array([len(words[k]) for k in at])
        start = np.cumsum(size) - size
        state, live = np.full(len(at), a["root"][0]), np.arange(len(at))
        alive, moves = np.ones(len(at), bool), np.full((len(at), size.max()), -1, np.int32)
        for t in range(size.max()):
            live = live[size[live] > t]
            want = state[live] * 256 + letters[start[live] + t]
            place = np.minimum(np.searchsorted(a["keys"], want), len(a["keys"]) - 1)
            hit = a["keys"][place] == want
            alive[live[~hit]] = False
            live, place = live[hit], place[hit]
            state[live] = a["to"][place]
            moves[live, t] = place
        alive &= a["end"][state] >= 0
        ends = state[alive]
        steps = moves[alive]
        # ids of a word: those of its transitions in order, then those of its end
        count = np.c_[np.where(steps >= 0, a["out_n"][steps], 0), a["end_n"][ends]]
        first = np.c_[a["out"][steps], a["end"][ends]].ravel()
        total = np.r_[0, np.cumsum(count.sum(1))].tolist()
        count = count.ravel()
        flat = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total[-1])
        ids = a["ids"][flat].astype("<u4").tobytes()
        for k, lo, hi in zip(np.flatnonzero(alive).tolist(), total, total[1:], strict=False):
            out[at[k]] = ids[4 * lo : 4 * hi]
        return out


def frequent_words(docs: DataFrame, lexicon_words: int) -> list[bytes]:
    """The words that occur most often over all documents, at least twice, at most ``lexicon_words`` of them:
    those above the lowest count that the limit allows, counts being taken in steps of a 64th of a power of two."""
    step = F.floor(F.log2("n") * 64).cast("int")
    words = cut(word_counts(docs).where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST)).withColumn("step", step), "words")
    least, room = None, lexicon_words
    for r in words.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect():  # a few thousand rows at most
        room -= r.n
        if room < 0:
            break
        least = r.step
    if least is None:
        return []
    return [w.as_py() for w in words.where(F.col("step") >= least).select("word").toArrow().column(0)]


def build_lexicon(docs: DataFrame, tokenizer: str = TOKENIZER, lexicon_words: int = LEXICON_WORDS) -> str:
    """Count the words of all documents, compile the most frequent ones and hand the file to the executors.
    Returns its name there.  ``lexicon_words`` bounds what passes through the driver, whatever the input."""
    coder, words = _Coder(rules(tokenizer), None), frequent_words(docs, lexicon_words)
    coder.learn(set(words))
    data = pack_arrays(compile_lexicon([(w, tuple(np.frombuffer(coder.chunks[w], "<u4").tolist())) for w in words]))
    return ship(docs.sparkSession, data)


def ship(spark: SparkSession, data: bytes) -> str:
    """Write ``data`` to the shared folder and have Spark give each executor its copy, also those that start later."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corpus/{name}")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    stream = files.create(path)
    try:
        stream.write(data)
    finally:
        stream.close()
    sc.addFile(files.makeQualified(path).toString())
    return name


# ---------------------------------------------------------------- encoding and decoding


class _Coder:
    def __init__(self, rule: Rules, lexicon: Lexicon | None):
        self.rule, self.lexicon = rule, lexicon
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str | int, bytes] = {}

    def learn(self, chunks: set[bytes]) -> None:
        """See that the ids of all ``chunks`` are at hand; a full memo starts anew."""
        fresh = [c for c in chunks if c not in self.chunks]
        if not fresh:
            return
        if len(self.chunks) + len(fresh) > HELD:
            self.chunks, fresh = {}, list(chunks)
        if len(self.words) > HELD:
            self.words = {}
        self.chunks.update(self._found(fresh))
        rest = {c: None for c in fresh if c not in self.chunks}
        split = self.rule.split(list(rest))
        new = list({w for ws in split for w in ws if w not in self.words})
        # a word of plain ASCII is also a chunk of that one word, so the lexicon may have it
        plain = [w.encode() for w in new if isinstance(w, str) and w.isascii()]
        self.words.update((w.decode(), ids) for w, ids in self._found([w for w in plain if w not in rest]).items())
        self.words.update((w, w.to_bytes(4, "little")) for w in new if isinstance(w, int))
        unseen = [w for w in new if w not in self.words]
        self.words.update(zip(unseen, self.rule.merge(unseen), strict=True))
        words = self.words
        self.chunks.update((c, b"".join([words[w] for w in ws])) for c, ws in zip(rest, split, strict=True))

    def _found(self, words: list[bytes]) -> dict[bytes, bytes]:
        if self.lexicon is None:
            return {}
        return {w: ids for w, ids in zip(words, self.lexicon.find(words), strict=True) if ids is not None}

    def encode(self, text: bytes) -> bytes:
        parts = []
        for chunks in chunk_lists(text):
            self.learn(set(chunks))
            parts.append(b"".join([self.chunks[c] for c in chunks]))
        return b"".join(parts)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each of several short texts, which learn their new chunks together."""
        lists = [t.split() for t in texts]
        self.learn(set(chain.from_iterable(lists)))
        return [b"".join([self.chunks[c] for c in chunks]) for chunks in lists]


def encode(docs: DataFrame, lexicon: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text as little-endian unsigned 32-bit numbers, as the
    tokenizers library gives them with ``add_special_tokens=False``.

    ``lexicon`` is what ``build_lexicon`` returned; without it every word is merged.  A null text counts
    as empty and has no ids.  Bytes that are no UTF-8 count as replacement characters.  Strings of
    special tokens become these tokens, as in the library.  Repeated rows stay, each with its ids; a null ``doc_id``
    stays null; an empty table gives no rows; other columns of ``docs`` are not read.  Memory
    follows the longest text and the longest stretch without white space in it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).mapInArrow(lambda batches: _encoded(batches, lexicon, tokenizer), f"doc_id {kind}, ids binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], lexicon: str | None, tokenizer: str) -> Iterator[pa.RecordBatch]:
    """``doc_id, ids`` of batches of ``doc_id, text``."""
    coder = _Coder(rules(tokenizer), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    for batch in batches:
        rows, out, held = [], [], 0
        texts = batch.column(1)
        for a, b in _groups(texts):
            group = [texts[k].as_buffer().to_pybytes() for k in range(a, b)]
            rows += range(a, b)
            out += coder.encode_all(group) if b - a > 1 else [coder.encode(group[0])]
            held += sum(map(len, out[len(out) - (b - a) :]))
            if held > PIECE:
                yield _rows(batch, rows, out, pa.binary(), "ids")
                rows, out, held = [], [], 0
        if rows:
            yield _rows(batch, rows, out, pa.binary(), "ids")


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of a text column of about PIECE bytes, a longer text alone."""
    start, held = 0, 0
    for k in range(len(texts)):
        n = len(texts[k].as_buffer())
        if k > start and held + n > PIECE:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def _rows(batch: pa.RecordBatch, rows: list[int], values: list[bytes], kind: pa.DataType, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(values, pa.binary()).cast(kind)], [batch.schema.names[0], name])


def decode(coded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, decoded`` of ``coded(doc_id, ids)``: the tokens with a blank between them, as the library's
    ``decode(ids, skip_special_tokens=False)`` gives them for this file, which names no decoder.  Ids that
    the file does not know are left out, as there; null or empty ids give an empty text."""
    kind = coded.schema["doc_id"].dataType.simpleString()
    given = coded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return given.mapInArrow(lambda batches: (part for part, _ in _decoded(batches, tokenizer)), f"doc_id {kind}, decoded string")


def _decoded(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """``doc_id, decoded`` of batches of ``doc_id, ids``, each with the ids of its rows."""
    tokens = rules(tokenizer).tokens
    for batch in batches:
        rows, out, held = [], [], 0
        for k, value in enumerate(batch.column(1)):
            ids, parts = np.frombuffer(value.as_buffer(), "<u4"), []
            for at in range(0, len(ids), PIECE >> 2):
                some = [tokens[i] for i in ids[at : at + (PIECE >> 2)].tolist() if i in tokens]
                if some:
                    parts.append(b" ".join(some))
            rows.append(k)
            out.append(b" ".join(parts))
            held += len(out[-1])
            if held > PIECE:
                yield _rows(batch, rows, out, pa.string(), "decoded"), batch.column(1).take(pa.array(rows, pa.int64()))
                rows, out, held = [], [], 0
        if rows:
            yield _rows(batch, rows, out, pa.string(), "decoded"), batch.column(1).take(pa.array(rows, pa.int64()))


def encode_and_decode(docs: DataFrame, tokenizer: str = TOKENIZER, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id, ids, decoded`` of every document, the ids decoded back in the process that made them: one Python
    worker a task, where ``decode`` behind ``encode`` would hold two with the tokenizer's tables each."""
    lexicon = build_lexicon(docs, tokenizer, lexicon_words)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _decoded(_encoded(batches, lexicon, tokenizer), tokenizer):
            yield pa.RecordBatch.from_arrays([part.column(0), ids, part.column(1)], ["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
