"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Texts are cut into matches of the vocabulary's pattern, which cover them, and
every match is encoded on its own. The library maps a match's bytes to
characters that stand for them and gives ids with character offsets; a token
that holds only some bytes of a character has that whole character as its span.
A worker gives each match that it does not know to the library, all of a slice
in one batch, and lays out ids and spans of all texts from these answers; the
offsets of a match must cover it, and the matches of a text the text, or the
job stops. Answers are remembered up to ``REMEMBERED`` characters of matches.
Decoding gives every id the bytes that its stand-in characters mean by the
reversed byte table. A token may end inside a character, so bytes are joined
before they are read as UTF-8, and ``pieces`` carries an unfinished character
over to the next token.

The vocabulary files are read on the driver and broadcast (a few MB, fixed by
the vocabulary). Workers encode about ``SLICE`` characters at a time and walk
the matches of a longer text in runs of ``RUN``, so they hold the matches of a
run, and of a whole text no more than its ids, four bytes each.

Defined results: a null text is encoded as the empty text (no ids); texts of
any length are encoded whole; the strings of special tokens are ordinary text;
repeated rows are encoded alike; an empty table gives an empty result. Only
the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

SLICE, RUN, REMEMBERED = 1 << 18, 1 << 15, 1 << 23

UNCOVERED = "the matches of a text do not cover it"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_table() -> dict[str, int]:
    """The printable stand-in of every byte: itself, or the next character from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoded:
    """Ids of some texts, one after the other; ``bounds`` has each text's end, ``chars`` its length, ``splits`` how often a token of it ends inside a character."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, chars: np.ndarray, splits: np.ndarray, spans) -> None:
        self.ids, self.bounds, self.chars, self.splits, self._spans = ids, bounds, chars, splits, spans

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the characters of every token start and end in its text."""
        return self._spans()


class Rows:
    """Rows of whole numbers that grow by columns, with room for more."""

    def __init__(self, rows: int) -> None:
        self.data, self.size = np.zeros((rows, 1 << 12), np.int32), 0

    def add(self, *rows) -> None:
        end = self.size + len(rows[0])
        if end > self.data.shape[1]:
            self.data = np.concatenate([self.data, np.zeros((len(rows), max(end, self.data.shape[1])), np.int32)], 1)
        for kept, new in zip(self.data, rows, strict=True):
            kept[self.size : end] = new
        self.size = end


class Codec:
    """One vocabulary; made from the contents of its two files."""

    def __init__(self, model: str, ranks: bytes, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        # The pattern has cut the text already: what the library gets is one match each.
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
        compiled = regex.compile(pattern)
        self.matches, self.each_match = compiled.findall, compiled.finditer
        self.from_bytes = {ord(c): chr(b) for c, b in byte_table().items()}
        by_rank = {int(rank): base64.b64decode(word) for word, rank in map(bytes.split, ranks.splitlines())}
        # What every token's stand-in characters mean, by the byte table reversed.
        self.meant = {i: self.raw(word) for word, i in json.loads(model)["model"]["vocab"].items() if i in by_rank}
        if self.meant != by_rank:
            raise ValueError("the two vocabulary files differ")
        self.decimal = {i: str(i) for i in by_rank}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        #: Of all tokens: id, start, end; of all matches: first token, tokens, characters, splits.
        self._tokens, self._matches = Rows(3), Rows(4)

    def _learn(self, new: list[str]) -> None:
        """Encode matches that are not known and keep the answers."""
        done = self.tokenizer.encode_batch(new, add_special_tokens=False)
        offsets, lengths = [e.offsets for e in done], list(map(len, new))
        if any(not o or o[0][0] or o[-1][1] != n for o, n in zip(offsets, lengths, strict=True)):
            raise ValueError("the offsets of a match do not cover it")
        counts = np.fromiter(map(len, offsets), np.int32)
        ends = np.cumsum(counts)
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(offsets)), np.int32).reshape(-1, 2).T
        inside = np.append(spans[0, 1:] < spans[1, :-1], False)
        inside[ends - 1] = False  # the next token is another match's
        splits = np.add.reduceat(inside.astype(np.int32), ends - counts)
        self.known |= zip(new, range(len(self.known), len(self.known) + len(new)))
        self._matches.add(ends - counts + self._tokens.size, counts, lengths, splits)
        self._tokens.add(np.fromiter(chain.from_iterable(e.ids for e in done), np.int32), *spans)
        self.held += sum(lengths)

    def runs(self, text: str) -> Iterator[list[str]]:
        """The matches of a text; of a long one, so many at a time."""
        if len(text) <= SLICE:
            yield self.matches(text)
            return
        left = self.each_match(text)
        while run := [m.group() for m in islice(left, RUN)]:
            yield run

    def encode(self, texts: list[str]) -> Encoded:
        """Ids of all texts, and what gives their spans."""
        done = self.encode_matches([self.matches(t) for t in texts])
        if not np.array_equal(done.chars, [len(t) for t in texts]):
            raise ValueError(UNCOVERED)
        return done

    def encode_matches(self, found: list[list[str]]) -> Encoded:
        """Ids of texts that are given by their matches."""
        flat = list(chain.from_iterable(found))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int32, len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lost = [flat[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(lost)))
            at[missing] = [self.known[m] for m in lost]
        last = np.cumsum([len(f) for f in found])
        first, n, length, splits = self._matches.data[:, at]
        sums = lambda x: np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[np.append(0, last)])
        upto = np.append(0, np.cumsum(n))
        place = np.repeat(first - upto[:-1], n) + np.arange(upto[-1])
        tokens = self._tokens.data

        def spans() -> tuple[np.ndarray, np.ndarray]:
            before = np.cumsum(length) - length
            begin = np.append(0, np.cumsum(length))[np.append(0, last[:-1])]
            shift = np.repeat(before - np.repeat(begin, np.diff(last, prepend=0)), n)
            return shift + tokens[1, place], shift + tokens[2, place]

        out = Encoded(tokens[0, place], upto[last], sums(length), sums(splits), spans)
        if self.held > REMEMBERED:
            self._forget()
        return out

    def ids(self, text: str) -> list[int]:
        """The ids of one text."""
        return self.encode([text]).ids.tolist()

    def raw(self, standing: str) -> bytes:
        """The bytes that a string of stand-in characters means."""
        return standing.translate(self.from_bytes).encode("latin-1")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.meant.__getitem__, ids))

    def pieces(self, ids: list[int]) -> list[str]:
        """The text that each id completes; a split character counts for its last id."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        return [decoder.decode(self.meant[i], final=k + 1 == len(ids)) for k, i in enumerate(ids)]

    def spelled(self, ids: list[int]) -> tuple[str, bytes]:
        """The ids in decimal, and the bytes they stand for."""
        return " ".join(map(self.decimal.__getitem__, ids)), self.decode(ids)


_codecs: dict[str, Codec] = {}


def _on_workers(docs: DataFrame, paths: tuple[str, str] | None, pattern: str | None = None):
    """A function that gives workers their codec, made once per process."""
    model, ranks = paths or default_paths()
    with open(model, encoding="utf-8") as m, open(ranks, "rb") as r:
        shared = docs.sparkSession.sparkContext.broadcast((m.read(), r.read(), pattern or default_pattern()))
    name = uuid.uuid4().hex

    def codec() -> Codec:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if name not in _codecs:
            _codecs.clear()
            _codecs[name] = Codec(*shared.value)
        return _codecs[name]

    return codec


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


LISTS = {"ids", "starts", "ends"}


class _Summed:
    """What is known of one text as its runs come in."""

    def __init__(self) -> None:
        self.n = self.chars = self.splits = 0
        self.listed, self.decoded = hashlib.sha256(), hashlib.sha256()
        self.lists: dict[str, list[np.ndarray]] = {name: [] for name in LISTS}


def _summed(codec: Codec, texts: list[bytes], columns: Iterable[str]) -> list[_Summed]:
    """Encode the texts about ``SLICE`` characters at a time; only what ``columns`` name is kept or hashed."""
    sums = [_Summed() for _ in texts]

    def flush(owners: list[int], found: list[list[str]]) -> None:
        done = codec.encode_matches(found)
        spans = done.spans() if "starts" in columns else None
        start = 0
        for i, end, chars, splits in zip(owners, done.bounds.tolist(), done.chars.tolist(), done.splits.tolist(), strict=True):
            s, ids = sums[i], done.ids[start:end]
            if "ids_sha256" in columns and end > start:
                listed, decoded = codec.spelled(ids.tolist())
                s.listed.update(f" {listed}".encode() if s.n else listed.encode())
                s.decoded.update(decoded)
            if "ids" in columns:
                s.lists["ids"].append(ids)
            if spans:
                for name, flat in zip(("starts", "ends"), spans, strict=True):
                    s.lists[name].append((flat[start:end] + s.chars).astype(np.int32))
            s.n, s.chars, s.splits, start = s.n + end - start, s.chars + chars, s.splits + splits, end

    owners, found, size = [], [], 0
    for i, raw in enumerate(texts):
        text, upto = raw.decode(), 0
        for run in codec.runs(text):
            owners.append(i)
            found.append(run)
            chars = sum(map(len, run))
            upto, size = upto + chars, size + chars
            if size >= SLICE:
                flush(owners, found)
                owners, found, size = [], [], 0
        if upto != len(text):
            raise ValueError(UNCOVERED)
    if owners:
        flush(owners, found)
    return sums


def _encoded(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str] | None, columns: dict[str, str]) -> DataFrame:
    """(doc_id, n_tokens) and the named columns of every row."""
    codec, slim = _on_workers(docs, paths), _slim(docs, id_col, text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch.column("text"), SLICE):
                sums = _summed(codec(), texts, columns)
                made = {"doc_id": batch.column("doc_id")[part], "n_tokens": pa.array([s.n for s in sums], pa.int64())}
                if "ids_sha256" in columns:
                    made |= {"ids_sha256": pa.array([s.listed.hexdigest() for s in sums]), "decoded_sha256": pa.array([s.decoded.hexdigest() for s in sums])}
                made |= {"n_split": pa.array([s.splits for s in sums], pa.int64())}
                ends = pa.array(np.cumsum([0, *(s.n for s in sums)]), pa.int32())
                for name in LISTS & set(columns):
                    flat = np.concatenate([np.zeros(0, np.int32), *(a for s in sums for a in s.lists[name])])
                    made[name] = pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))
                yield pa.record_batch([made[c] for c in names], names=names)

    names = ["doc_id", "n_tokens", *columns]
    return slim.mapInArrow(run, ", ".join([f"doc_id {kind}", "n_tokens long", *(f"{c} {t}" for c, t in columns.items())]))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, starts, ends): ids and their character offsets."""
    return _encoded(docs, id_col, text_col, paths, {c: "array<int>" for c in ("ids", "starts", "ends")})


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_split): encode, decode the ids, and hash both.

    ``n_split`` counts the places at which a token ends inside a character.
    """
    columns = {"ids_sha256": "string", "decoded_sha256": "string", "n_split": "long"} | ({"ids": "array<int>"} if keep_ids else {})
    return _encoded(docs, id_col, text_col, paths, columns)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, text, bytes): what the ids stand for; broken UTF-8 is replaced in ``text`` only."""
    codec = _on_workers(encoded, paths)
    slim = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [codec().decode(ids.as_py()) for ids in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array([b.decode("utf-8", "replace") for b in raw]), pa.array(raw, pa.binary())], names=["doc_id", "text", "bytes"])

    return slim.mapInArrow(run, f"doc_id {kind}, text string, bytes binary")
