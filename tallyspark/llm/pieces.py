"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is split where a piece can't span: in front of every run of word marks (U+2581) that
follows another character, provided that no piece of the vocabulary crosses such a place.
Each segment is merged by an agenda ordered by (score, position) of adjacent symbol pairs, the new short
ones of several texts side by side in arrays; the ids of segments are remembered.  All texts of every Arrow batch are also encoded and
decoded by the sentencepiece library, and a difference raises an error.

Defined results: null and empty texts have no ids and decode to ''; very long texts are encoded whole;
repeated rows and rows without doc_id are encoded each by itself; other columns pass through, but
for columns called ``n_tokens``, ``ids`` and ``decoded``, which are replaced.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches, without

MARK = "▁"
#: Words remembered by one Python worker in either of two tables; the older one goes when the newer one is full.
REMEMBERED = 600_000
#: Longest segment whose agenda is a plain list, and bits of a symbol in the code of a pair.
SHORT, CODE_BITS = 24, 24
CODE_MASK, NOTHING = (1 << CODE_BITS) - 1, 1 << 62
#: Code points of the texts whose new words are merged side by side, and steps in width of their agendas, which have PLACE_BITS bits for a place.
AT_ONCE, WIDTH_STEP, PLACE_BITS = 1 << 21, 4, 5
#: One text in so many of each batch is held against the library: all of them.
CHECK_EVERY = 1


# the library puts one replacement character for every byte that is no part of a character
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Codes(dict):
    """Codes of symbols: a piece's id, or for a character that is no piece its number behind all ids."""

    def __init__(self, ids: dict[str, int], size: int):
        super().__init__(ids)
        self.size = size

    def __missing__(self, character: str) -> int:
        return self.size + ord(character)


class MergeCodec:
    """Ids of texts as the library gives them, without begin and end ids."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = size = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: lib.get_score(i) for i in plain}
        self.unknown = lib.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.byte_ids = np.array([self.bytes.get(b, self.unknown) for b in range(256)])
        self.hidden = {i for i in range(size) if lib.is_control(i)}
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        best = {score: n for n, score in enumerate(sorted({*self.scores.values()}, reverse=True))}
        self.ranks = {piece: best[score] for piece, score in self.scores.items() if len(piece) > 1}
        self.codes = Codes(self.ids, size)
        # a pair's code to the merged symbol, the better score first; not for pieces that share a score, whose ties go by place
        having, self.pairs = Counter(self.scores[p] for p in self.ranks), {}
        self.tied = {p[:2] for p in self.ranks if having[self.scores[p]] > 1}
        for piece, rank in self.ranks.items():
            for k in range(1, len(piece)) if having[self.scores[piece]] == 1 else ():
                left, right = piece[:k], piece[k:]
                if all(len(x) == 1 or x in self.ids for x in (left, right)):
                    self.pairs[self.codes[left] << CODE_BITS | self.codes[right]] = rank << CODE_BITS | self.ids[piece]
        # the same pairs as arrays: places for ``merge_many`` to look them up, and the piece of each rank
        self.pair_codes = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[c] >> CODE_BITS for c in self.pair_codes.tolist()], np.int64) << PLACE_BITS
        self.of_rank = np.zeros(len(best) + 1, np.int64)
        self.of_rank[self.pair_ranks >> PLACE_BITS] = [self.pairs[c] & CODE_MASK for c in self.pair_codes.tolist()]
        self.character_codes = size + np.arange(0x110000)
        for piece in self.ids:
            if len(piece) == 1:
                self.character_codes[ord(piece)] = self.ids[piece]
        self.tied_codes = np.array([self.codes[p[0]] << CODE_BITS | self.codes[p[1]] for p in sorted(self.tied)], np.int64)
        self.ties = re.compile("|".join(map(re.escape, sorted(self.tied))) or "(?!)").search
        shown = [p.replace(MARK, " ") for p in self.pieces]
        self.shown = [None if i in self.byte_of or i in self.hidden or i == self.unknown else p for i, p in enumerate(shown)]
        self.odd = np.array([p is None for p in self.shown])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.split: dict[str, list[str]] = {}
        self.segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def merge_short(self, segment: str) -> list[int]:
        """The same agenda as a list that is searched for its best entry: quicker for a few symbols."""
        symbols = list(map(self.codes.__getitem__, segment))
        pair, last = self.pairs.get, len(symbols) - 1
        agenda = [pair(a << CODE_BITS | b, NOTHING) for a, b in zip(symbols, symbols[1:])]
        while last > 0 and (best := min(agenda)) != NOTHING:
            at = agenda.index(best)
            symbols[at] = best & CODE_MASK
            del symbols[at + 1], agenda[at]
            last -= 1
            if at:
                agenda[at - 1] = pair(symbols[at - 1] << CODE_BITS | symbols[at], NOTHING)
            if at < last:
                agenda[at] = pair(symbols[at] << CODE_BITS | symbols[at + 1], NOTHING)
        if max(symbols, default=0) < self.size:
            return symbols
        spelled = lambda c: [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
        return [i for s in symbols for i in ([s] if s < self.size else spelled(chr(s - self.size)))]

    def merge(self, segment: str) -> list[int]:
        """Agenda of adjacent pairs: the best score first, ties to the left; entries of pairs that have changed since are skipped."""
        if len(segment) <= SHORT and not self.ties(segment):
            return self.merge_short(segment)
        ranks, symbols = self.ranks, list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        current = [ranks.get(a + b, -1) for a, b in zip(symbols, symbols[1:])]
        agenda = [rank << 32 | i for i, rank in enumerate(current) if rank >= 0]
        current.append(-1)
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & 0xFFFFFFFF
            if current[left] != entry >> 32:
                continue
            right = after[left]
            symbols[left] = pair = symbols[left] + symbols[right]
            symbols[right] = ""
            current[right] = current[left] = -1
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                current[left] = rank = ranks.get(pair + symbols[following], -1)
                if rank >= 0:
                    heapq.heappush(agenda, rank << 32 | left)
            if (previous := before[left]) >= 0:
                current[previous] = rank = ranks.get(symbols[previous] + pair, -1)
                if rank >= 0:
                    heapq.heappush(agenda, rank << 32 | previous)
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                if (found := self.ids.get(symbol)) is not None:
                    out.append(found)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass"))
                else:
                    out.append(self.unknown)
        return out

    def entries(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Agenda entries of pairs of symbols: rank and place, NOTHING for those that aren't merged."""
        if not len(self.pair_codes):
            return np.full(left.shape, NOTHING)
        code = left << CODE_BITS | right
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at] | place, NOTHING)

    def merge_side_by_side(self, symbols: np.ndarray) -> np.ndarray:
        """Merges columns of symbols (CODE_MASK behind their ends); a symbol that another one has taken in is -1.

        Every step takes the best entry of every column that has one: the best score, ties to the left.
        The two rows behind the places stand for what is behind and in front of a segment.
        """
        width, n = symbols.shape
        out, columns = np.empty_like(symbols), np.arange(n)
        s = np.concatenate([symbols, np.full((2, n), CODE_MASK)])
        after, before = (np.repeat(np.arange(width + 2)[:, None] + step, n, 1) for step in (1, -1))
        before[0] = width + 1
        agenda = np.full((width + 2, n), NOTHING)
        agenda[: width - 1] = self.entries(symbols[:-1], symbols[1:], np.arange(width - 1)[:, None])
        while len(columns):
            best = agenda.min(0)
            if not (going := best != NOTHING).all():
                out[:, columns[~going]] = s[:width, ~going]
                s, after, before, agenda, best, columns = s[:, going], after[:, going], before[:, going], agenda[:, going], best[going], columns[going]
            here, at = np.arange(len(columns)), best & (1 << PLACE_BITS) - 1
            right, left = after[at, here], before[at, here]
            following = after[right, here]
            merged = self.of_rank[best >> PLACE_BITS]
            s[at, here], s[right, here] = merged, -1
            after[at, here], before[following, here] = following, at
            agenda[right, here] = NOTHING
            agenda[at, here] = self.entries(merged, s[following, here], at)
            agenda[left, here] = self.entries(s[left, here], merged, left)
        return out

    def spelled(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each symbol has): characters that are no piece are spelled in bytes, or unknown."""
        strange, long = symbols >= self.size, np.ones(len(symbols), np.int64)
        if not strange.any():
            return symbols, long
        if not self.bytes:
            return np.where(strange, self.unknown, symbols), long
        points = symbols[strange] - self.size
        long[strange] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        ids, coded = np.repeat(symbols, long), points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        ids[np.repeat(strange, long)] = self.byte_ids[np.frombuffer(coded, np.uint8)]
        return ids, long

    def merge_many(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words behind one mark; the short ones are merged side by side."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        made = {}
        for width in range(WIDTH_STEP, SHORT + 1, WIDTH_STEP):
            some = [words[i] for i in np.flatnonzero((lengths > width - WIDTH_STEP) & (lengths <= width)).tolist()]
            if not some:
                continue
            length = np.fromiter(map(len, some), np.int64, len(some)) + 1
            points = np.frombuffer((MARK + MARK.join(some)).encode("utf-32-le", "surrogatepass"), np.uint32)
            symbols = np.full((len(some), width), CODE_MASK)
            symbols[np.arange(width) < length[:, None]] = self.character_codes[points]
            tied = np.isin(symbols[:, :-1] << CODE_BITS | symbols[:, 1:], self.tied_codes).any(1)
            merged = self.merge_side_by_side(np.ascontiguousarray(symbols.T)).T
            kept = (merged >= 0) & (merged != CODE_MASK)
            ids, long = self.spelled(merged[kept])
            ends = (4 * np.concatenate([[0], np.cumsum(long)])[np.cumsum(kept.sum(1))]).tolist()
            raw = ids.astype(np.int32).tobytes()
            made.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            for i in np.flatnonzero(tied).tolist():
                made[some[i]] = array("i", self.merge(MARK + some[i])).tobytes()
        for i in np.flatnonzero(lengths > SHORT // WIDTH_STEP * WIDTH_STEP).tolist():
            made[words[i]] = array("i", self.merge(MARK + words[i])).tobytes()
        return made

    def learn(self, texts: list[str]) -> None:
        """Splits the texts that consist of words behind one mark each, and remembers their words."""
        self.split.clear()
        if not self.splits:
            return
        fresh: set[str] = set()
        for text in texts:
            shown = self.library.normalize(text)
            if MARK + MARK not in shown and shown.startswith(MARK):
                self.split[text] = words = shown[1:].split(MARK)
                fresh.update(words)
        fresh = fresh.difference(self.known)
        again = {w: self.older[w] for w in fresh if w in self.older}
        made = again | self.merge_many(sorted(fresh.difference(again)))
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update(made)

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as 32-bit integers."""
        if not text:
            return b""
        known = self.known.get
        if words := self.split.pop(text, None):
            try:
                return b"".join(map(self.known.__getitem__, words))
            except KeyError:  # the tables have changed places since
                return b"".join([known(word) or self.remembered(word) for word in words])
        shown = self.library.normalize(text)
        if not self.splits:
            return array("i", self.merge(shown)).tobytes()
        if MARK + MARK in shown or not shown.startswith(MARK):
            return b"".join([array("i", self.merge(s)).tobytes() for s in self.segments.findall(shown)])
        return b"".join([known(word) or self.remembered(word) for word in shown[1:].split(MARK)])

    def checked(self, text: str, check: bool = True) -> tuple[bytes, str]:
        """(ids as 32-bit integers, decoded text), held against the library."""
        raw = self.encode_bytes(text)
        decoded = self.decode_bytes(raw)
        if check:
            want = self.library.encode(text)
            if array("i", want).tobytes() != raw or self.library.decode(want) != decoded:
                raise ValueError(f"ids differ from the library's for {text[:80]!r}")
        return raw, decoded

    def remembered(self, word: str) -> bytes:
        """Ids of a word behind one mark that is not in ``known``, where it is kept from now on."""
        ids = self.older.get(word) or array("i", self.merge(MARK + word)).tobytes()
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """Pieces put together: word marks are spaces, the first one added by the encoder is taken away, byte runs are UTF-8."""
        return self.decode_bytes(array("i", ids).tobytes())

    def decode_bytes(self, raw: bytes) -> str:
        """The same for ids as 32-bit integers; ids that are no piece of text are taken one by one, those between them at once."""
        coded = np.frombuffer(raw, np.int32)
        ids, odd = coded.tolist(), np.flatnonzero(self.odd[coded]).tolist()
        shown, out, run, at, first = self.shown, [], bytearray(), 0, True
        for k in [*odd, len(ids)]:
            if (run and k > at) or k == len(ids):
                out.append(run.decode("utf-8", "each_byte"))
                run.clear()
            if k > at:
                text = "".join([shown[i] for i in ids[at:k]])
                out.append(text[1:] if first and text.startswith(" ") else text)
                first = False
            if k == len(ids):
                break
            at = k + 1
            if (byte := self.byte_of.get(ids[k])) is not None:
                run.append(byte)
                first = False
                continue
            out.append(run.decode("utf-8", "each_byte"))
            run.clear()
            if ids[k] not in self.hidden:
                out.append(" \u2047 ")
                first = False
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model: str) -> MergeCodec:
    return MergeCodec(model)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about AT_ONCE code points."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_texts(docs: DataFrame, model: str, check_every: int = CHECK_EVERY) -> DataFrame:
    """docs' other columns with n_tokens, ids (array of int) and decoded text in place of ``text``."""
    docs = without(docs, "n_tokens", "ids", "decoded")
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*others, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    at = docs.columns.index("text")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                done = {}
                for part in _parts(list(dict.fromkeys(texts))):
                    made.learn(part)
                    for text in part:
                        done[text] = made.checked(text, len(done) % check_every == 0)
                raw, decoded = [done[t][0] for t in texts], [done[t][1] for t in texts]
                kept = [c for i, c in enumerate(batch.columns) if i != at]
                lengths = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lengths), lists, pa.array(decoded, pa.string())], schema.names)

    return small_batches(docs).mapInArrow(encode, schema)
