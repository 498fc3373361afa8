"""SentencePiece encoding and decoding for merge-type vocabularies, checked against the sentencepiece library.

A text is normalised (a blank in front, blanks shown as U+2581) and its
characters are the first symbols. An agenda holds all adjacent pairs of symbols
that make a piece, best score first and leftmost first among equals. The top
pair is merged, its pairs with both neighbours join the agenda, and entries that
a merge has made stale are passed over when they come up. What is left are the
pieces; a character that is none becomes its UTF-8 bytes' pieces. The new words
of a slice are merged side by side: each is a row of an array, and a step takes
the top pair of every row.

No piece has a blank after another character, and characters that are side by
side in no piece cannot be merged: texts are cut there, exactly, so an agenda is
that of a word, and a worker remembers the answers of up to ``REMEMBERED``
characters of words, those met last. Both facts are taken from the vocabulary.

Texts are worked on in runs of about ``RUN`` characters that end before a blank,
so memory is bounded by a run and the ids of one text. Every word that a worker
does not remember is encoded by the library as well, all of an Arrow slice in
one batch, and the job stops where its ids differ. (The library's memory is
about 100 bytes a character; so a word of more than ``CHECKED`` characters is
encoded by the agenda only.) Decoding is the library's, run by run.

The vocabulary is read on the driver and broadcast (about 1 MB, fixed by the
file).

Defined results: a null text is encoded as the empty text (no ids); texts of any
length are encoded whole; control pieces are never taken from a text; repeated
rows are encoded alike; an empty table gives an empty result. Only the named
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

SLICE, RUN, CHECKED, REMEMBERED = 1 << 18, 1 << 16, 1 << 19, 1 << 23
BLANK = "▁"
#: Words of up to so many characters are merged side by side, as rows of arrays, up to ``TOGETHER`` at a time; a longer one has an agenda of its own.
WIDTHS, TOGETHER = (8, 12, 16, 32), 1 << 13
#: The entry of two symbols that make no piece.
NO_PAIR = 1 << 62
#: A word of more characters is cut where two of them are side by side in no piece, and not remembered.
LONG = 128


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Symbols(dict):
    """The text of a symbol's number."""

    def __init__(self, size: int, pieces: dict[int, str]) -> None:
        super().__init__(pieces)
        self.size = size

    def __missing__(self, symbol: int) -> str:
        return chr(symbol - self.size)


class PieceCodec:
    """One vocabulary; made from the contents of its file."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_proto=model)
        if sp.normalize(" \t x　Ａ") != f"{BLANK}{BLANK}\t{BLANK}x　Ａ":
            raise ValueError("only vocabularies that change no character but blanks are supported")
        size = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        self.ids = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        #: The place of every piece's score, best first.
        self.rank = {p: place[sp.get_score(i)] for p, i in self.ids.items()}
        merged = [p for p in self.ids if len(p) > 1]
        self.beside = {p[i : i + 2] for p in merged for i in range(len(p) - 1)}
        if any(b[1] == BLANK != b[0] for b in self.beside):
            raise ValueError("a piece has a blank inside")
        # Symbols as numbers: pieces by their ids, other characters after them, then the edge of a word.
        self.first, self.edge = np.arange(size, size + 0x110000), size + 0x110000
        for p, i in self.ids.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        codes = {c: int(self.first[ord(c)]) for p in self.ids for c in p} | self.ids
        self.shown = _Symbols(size, {i: p for p, i in self.ids.items()})
        # What two symbols make, by both; an entry is the place of what they make and its id. The last one is no pair.
        made = sorted((codes[p[:k]] * (self.edge + 1) + codes[p[k:]], self.rank[p] << 32 | self.ids[p]) for p in merged for k in range(1, len(p)) if p[:k] in codes and p[k:] in codes)
        self.keys, self.merges = np.array([*made, (1 << 62, NO_PAIR)], np.int64).T.copy()
        self.decimal = list(map(str, range(size)))
        # A character that no merge takes is a word of its own.
        self.alone = next(c for c in ("\n", "\x00", "\x01") if not any(c in p for p in merged))
        self.alone_ids = [self.bytes[ord(self.alone)]] if self.alone not in self.ids else [self.ids[self.alone]]
        self.words = re.compile(f"{BLANK}*[^{BLANK}{self.alone}]+|{BLANK}+|{self.alone}").findall
        self.cut = re.compile(f"(?s)(?<=[^ {BLANK}])[ {BLANK}](?=.)").search
        #: Ids of the words met last, then those of words met before.
        self.known: dict[str, tuple[int, ...]] = {}
        self.older, self.held = self.known, 0

    def agenda(self, words: list[str]) -> list[list[str]]:
        """The pieces of every word by merging its symbols, best pair first."""
        out: list[list[str]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            at = np.flatnonzero((sizes > low) & (sizes <= width)).tolist()
            for k in range(0, len(at), TOGETHER):
                part = at[k : k + TOGETHER]
                for i, pieces in zip(part, self._side_by_side([words[i] for i in part], width), strict=True):
                    out[i] = pieces
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            out[i] = self._heaped(words[i])
        return out

    def _side_by_side(self, words: list[str], width: int) -> list[list[str]]:
        """The agendas of words of up to ``width`` characters, one merge in each word at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.full((len(words), width + 2), self.edge, np.int64)
        inside = np.arange(1, width + 3) <= sizes[:, None]
        symbols[:, 1:][inside[:, : width + 1]] = self.first[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        pairs = self._pairs(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            # An entry is a place and the piece of that place; the leftmost of the best places is merged.
            best = (pairs >> 32).argmin(1)
            top = pairs[np.arange(len(rows)), best]
            going = top < NO_PAIR
            if not going.all():
                ended = symbols[~going]
                kept = ended != self.edge
                done.append((rows[~going], kept.sum(1), ended[kept]))
                symbols, pairs, rows, best, top = symbols[going], pairs[going], rows[going], best[going], top[going]
            # Every word that is left loses one symbol, so the rows stay of one length.
            n, m = pairs.shape
            line, after = np.arange(n), np.arange(m - 1) + (np.arange(m - 1) >= best[:, None])
            symbols = np.concatenate([symbols[:, :1], np.take_along_axis(symbols, after + 1, 1)], 1)
            symbols[line, best] = top & 0xFFFFFFFF
            pairs = np.take_along_axis(pairs, after, 1)
            pairs[line, best] = self._pairs(symbols[line, best], symbols[line, best + 1])
            pairs[line, best - 1] = self._pairs(symbols[line, best - 1], symbols[line, best])
        out: list[list[str]] = [[]] * len(words)
        for row, lengths, flat in done:
            pieces, end = list(map(self.shown.__getitem__, flat.tolist())), 0
            for i, length in zip(row.tolist(), lengths.tolist(), strict=True):
                out[i] = pieces[end : end + length]
                end += length
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.edge + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merges[at], NO_PAIR)

    def _heaped(self, word: str) -> list[str]:
        n, rank = len(word), self.rank.get
        symbols, after, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [r << 32 | i for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapify(pairs)
        while pairs:
            top = heappop(pairs)
            i = top & 0xFFFFFFFF
            k = after[i]
            if k == n or not (left := symbols[i]):
                continue
            piece = left + symbols[k]
            if rank(piece) != top >> 32:
                continue  # one of the two has been merged since
            symbols[i], symbols[k] = piece, ""
            after[i] = k = after[k]
            if k < n:
                before[k] = i
                if (r := rank(piece + symbols[k])) is not None:
                    heappush(pairs, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(symbols[h] + piece)) is not None:
                heappush(pairs, r << 32 | h)
        return [s for s in symbols if s]

    def _numbers(self, pieces: list[str]) -> tuple[int, ...]:
        ids = tuple(map(self.ids.get, pieces))
        if None in ids:
            ids = tuple(chain.from_iterable([self.bytes[b] for b in p.encode()] if i is None else [i] for p, i in zip(pieces, ids, strict=True)))
        return ids

    def _cut(self, word: str) -> tuple[int, ...]:
        """The ids of a long word, of so many of its parts at a time."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.beside), len(word)]
        parts = [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        blocks = (self.agenda(parts[k : k + TOGETHER]) for k in range(0, len(parts), TOGETHER))
        return tuple(chain.from_iterable(map(self._numbers, chain.from_iterable(blocks))))

    def _learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encode words that are not known, and compare those that never were with the library's."""
        older = self.older
        made = {w: older[w] for w in words if w in older}
        fresh = [w for w in words if w not in made] if made else words
        short = [w for w in fresh if len(w) <= LONG]
        made.update(zip(short, map(self._numbers, self.agenda(short)), strict=True))
        made.update((w, self._cut(w)) for w in fresh if len(w) > LONG)
        checked = [w for w in fresh if len(w) <= CHECKED]
        if checked:
            # What stands between them is a word of its own.
            own = [self.ids[BLANK]]
            for w in checked:
                own += self.alone_ids
                own += made[w]
            if self.library.encode("".join([self.alone + w for w in checked]), num_threads=1) != own:
                raise ValueError(f"the library encodes otherwise, among {checked[:20]!r}")
        return made

    def runs(self, text: str) -> Iterator[str]:
        """The text in runs that begin with a blank, but for the first."""
        start = 0
        while start + RUN < len(text) and (found := self.cut(text, start + RUN)):
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def encode_runs(self, runs: list[str], firsts: list[bool]) -> list[tuple[list[int], str]]:
        """Ids of every run, and these in decimal; ``firsts`` says which runs begin a text."""
        if self.held > REMEMBERED // 2:
            self.known, self.older, self.held = {}, self.known, 0
        split = []
        for run, first in zip(runs, firsts, strict=True):
            shown = run.replace(" ", BLANK)
            split.append(self.words(BLANK + shown if first and shown else shown))
        known = self.known
        new = list(set().union(*split).difference(known))
        if new:
            known.update(self._learn(new))
        # No step in Python for a word that is known.
        ids = [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]
        out = [(x, ",".join(map(self.decimal.__getitem__, x))) for x in ids]
        for w in new:
            if len(w) > LONG:
                del known[w]
            else:
                self.held += len(w)
        return out

    def encode(self, text: str) -> list[int]:
        runs = list(self.runs(text))
        return list(chain.from_iterable(ids for ids, _ in self.encode_runs(runs, [k == 0 for k in range(len(runs))])))

    def decode_runs(self, ids: list[list[int]], firsts: list[bool]) -> list[str]:
        # The library drops the blank in front; it is a text's own but for the first run.
        return [t if first else f" {t}" for t, first in zip(self.library.decode(ids, num_threads=1) if ids else [], firsts, strict=True)]


_codecs: dict[str, PieceCodec] = {}


def _on_workers(docs: DataFrame, path: str | None):
    """A function that gives workers their codec, made once per process."""
    with open(path or default_path(), "rb") as model:
        shared = docs.sparkSession.sparkContext.broadcast(model.read())
    name = uuid.uuid4().hex

    def codec() -> PieceCodec:
        if name not in _codecs:
            _codecs.clear()
            _codecs[name] = PieceCodec(shared.value)
        return _codecs[name]

    return codec


class _Summed:
    """What is known of one text as its runs come in."""

    def __init__(self, keep: bool) -> None:
        self.n, self.ids, self.keep = 0, [], keep
        self.listed, self.text = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int], listed: str, text: str) -> None:
        if self.n and ids:
            self.listed.update(b",")
        self.n += len(ids)
        self.listed.update(listed.encode())
        self.text.update(text.encode())
        if self.keep:
            self.ids.append(np.array(ids, np.int32))


def _summed(codec: PieceCodec, texts: list[bytes], keep: bool) -> list[_Summed]:
    sums = [_Summed(keep) for _ in texts]

    def flush(held: list[tuple[int, str, bool]]) -> None:
        firsts = [h[2] for h in held]
        done = codec.encode_runs([h[1] for h in held], firsts)
        for (i, _, _), (ids, listed), text in zip(held, done, codec.decode_runs([ids for ids, _ in done], firsts), strict=True):
            sums[i].add(ids, listed, text)

    held, size = [], 0
    for i, raw in enumerate(texts):
        for k, run in enumerate(codec.runs(raw.decode())):
            held.append((i, run, k == 0))
            size += len(run)
            if size >= SLICE:
                flush(held)
                held, size = [], 0
    flush(held)
    return sums


def _encoded(docs: DataFrame, id_col: str, text_col: str, path: str | None, columns: dict[str, str]) -> DataFrame:
    codec = _on_workers(docs, path)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch.column("text"), SLICE):
                sums = _summed(codec(), texts, "ids" in columns)
                made = {"doc_id": batch.column("doc_id")[part], "n_tokens": pa.array([s.n for s in sums], pa.int64())}
                if "ids" in columns:
                    ends = pa.array(np.cumsum([0, *(s.n for s in sums)]), pa.int32())
                    made["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *(a for s in sums for a in s.ids)]), pa.int32()))
                else:
                    made |= {"ids_sha256": pa.array([s.listed.hexdigest() for s in sums]), "decoded_sha256": pa.array([s.text.hexdigest() for s in sums])}
                yield pa.record_batch([made[c] for c in names], names=names)

    return slim.mapInArrow(run, ", ".join([f"doc_id {kind}", "n_tokens long", *(f"{c} {t}" for c, t in columns.items())]))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row."""
    return _encoded(docs, id_col, text_col, path, {"ids": "array<int>"})


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids, and hash both."""
    return _encoded(docs, id_col, text_col, path, {"ids_sha256": "string", "decoded_sha256": "string"})


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text): what the ids stand for; null for no list of ids."""
    codec = _on_workers(encoded, path)
    slim = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids.as_py() is None else codec().library.decode(ids.as_py()) for ids in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return slim.mapInArrow(run, f"doc_id {kind}, text string")
