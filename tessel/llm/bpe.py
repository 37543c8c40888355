"""Byte-level BPE by rank-synchronous merging of ragged arrays, and a codec that encodes each different chunk of text once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import regex

#: Fixed value: how the byte-level vocabulary splits texts.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as Unicode has it (the standard library's \s also takes U+001C to U+001F).
WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts fall into these without cutting a piece of PIECES.
SPACED = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
UNSPACED = re.compile(f"[^{WS}]+")
NONE = np.int32(2**31 - 1)
#: Bytes of pieces that one merge takes, unless a piece is longer; characters from which a text is taken in windows of so many chunks.
MERGE_BYTES, LONG_TEXT, WINDOW = 1 << 20, 1 << 20, 1 << 14


def _alphabet() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """Merges many pieces at once: each round takes every piece's lowest-ranked pair and applies it in all of them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.zeros(256, np.int32)
        self.last = np.zeros(256, np.int32)  # of a piece's last byte, where the vocabulary marks word ends
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        for letter, byte in _alphabet().items():
            self.first[byte], self.last[byte] = vocab[letter], vocab[letter + self.suffix]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        if len(vocab) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 symbols don't fit the pair keys")
        key = ((left << 16) | right).astype(np.uint32)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        #: Bytes that stand side by side in a symbol; where two others meet no merge ever crosses.
        self.meet = np.zeros((256, 256), bool)
        letter = _alphabet()
        for symbol in vocab:
            own = [letter[c] for c in symbol if c in letter]
            self.meet[own[:-1], own[1:]] = True

    def parts(self, piece: bytes) -> list[bytes]:
        """A long piece cut where no merge can cross, so that its parts merge independently to the same symbols."""
        raw = np.frombuffer(piece, np.uint8)
        edge = [0, *(np.flatnonzero(~self.meet[raw[:-1], raw[1:]]) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(edge, edge[1:], strict=False)]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each has. Pieces aren't empty."""
        return self.encode_raw(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def encode_raw(self, raw: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode of pieces that lie one after another, of those lengths."""
        sym = self.first[raw]
        if self.suffix and len(raw):
            ends = np.cumsum(lens) - 1
            sym[ends] = self.last[raw[ends]]
        seq = np.arange(len(lens))
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = self._rank(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(seq):
            start = np.cumsum(lens) - lens
            low = np.minimum.reduceat(rank, start)
            over = low == NONE
            if over.any():
                gone = np.repeat(over, lens)
                done.append((seq[over], lens[over], sym[gone]))
                stay = ~gone
                sym, rank, seq, lens, low = sym[stay], rank[stay], seq[~over], lens[~over], low[~over]
                if not len(seq):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, lens))
            if len(hit) > 1:  # of a run of overlapping equal pairs, every second one from the left
                new = np.diff(hit, prepend=-2) != 1
                hit = hit[(hit - np.maximum.accumulate(np.where(new, hit, 0))) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            rank[hit] = rank[hit + 1]  # NONE stays where a piece ends
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            owner = np.searchsorted(np.cumsum(lens), hit, side="right")
            lens = lens - np.bincount(owner, minlength=len(lens))
            sym, rank = sym[keep], rank[keep]
            at = hit - np.arange(len(hit))  # where the merged symbols are now
            last = np.zeros(len(sym), bool)
            ends = np.cumsum(lens)
            last[ends - 1] = True
            stale = np.zeros(len(sym), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            redo = np.flatnonzero(stale & ~last)
            rank[redo] = self._rank(sym[redo], sym[redo + 1])
            rank[ends - 1] = NONE
        if not done:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        seqs, sizes, syms = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(seqs)
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        return syms[spans(begin, sizes)], sizes


def spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices begin[i], begin[i]+1, ... of every span, one span after the other."""
    total = int(sizes.sum())
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


class _Known(dict):
    """Numbers what it hasn't seen."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n


class Codec:
    """Encodes texts; each different chunk is encoded once while it is remembered. The memory is emptied at ``most`` chunks or
    ``most_text`` characters: that costs time, not results. Long texts are taken by windows of chunks, so that beyond the text and
    its ids no more is held than for a window (or for one chunk that is longer)."""

    def __init__(self, walk: Callable[[str], Iterator[str]], split: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], ids: bool = True, most: int = 700_000, most_text: int = 12_000_000):
        self.walk, self.split, self.encode, self.ids, self.most, self.most_text = walk, split, encode, ids, most, most_text
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.held = 0
        self.size = np.empty(0, np.int64)
        self.begin = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def _look(self, chunks: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        if fresh := self.known.fresh:
            flat, sizes = self.encode(fresh)
            if self.ids:
                self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
                self.flat = np.concatenate([self.flat, flat])
            self.size = np.concatenate([self.size, sizes])
            self.held += sum(map(len, fresh))
            self.known.fresh = []
        return at

    def _long(self, text: str) -> tuple[np.ndarray, int]:
        chunks, total, out = self.walk(text), 0, []
        while some := list(islice(chunks, WINDOW)):
            if len(self.known) > self.most or self.held > self.most_text:
                self._forget()
            at = self._look(some)
            total += int(self.size[at].sum())
            if self.ids:
                out.append(self.flat[spans(self.begin[at], self.size[at])])
        return (np.concatenate(out) if out else np.empty(0, np.int32)), total

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (empty if only counts are wanted) and each text's number of ids."""
        if any(t and len(t) > LONG_TEXT for t in texts):
            got = [self._long(t) if t else (np.empty(0, np.int32), 0) for t in texts]
            return np.concatenate([ids for ids, _ in got]), np.array([n for _, n in got], np.int64)
        if len(self.known) > self.most or self.held > self.most_text:
            self._forget()
        parts = [self.split(t) if t else [] for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        at = self._look([c for p in parts for c in p])
        sizes = self.size[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.concatenate([[0], np.cumsum(n)])
        counts = np.diff(total[edge])
        return (self.flat[spans(self.begin[at], sizes)] if self.ids else np.empty(0, np.int32)), counts


def place(name: str) -> str:
    """A vocabulary's path: the name itself if that is a file, else where the installed vocabularies are."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Of the bytes of ASCII in PIECES: letters, digits, the separator of chunks, the space before a piece, others.
BYTE_KIND = np.zeros(256, np.uint8)
BYTE_KIND[65:91] = BYTE_KIND[97:123] = 1
BYTE_KIND[48:58], BYTE_KIND[10], BYTE_KIND[32] = 2, 3, 4
#: Fixed value: what an apostrophe before letters takes with it.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _endings(raw: np.ndarray, start: np.ndarray, letter: np.ndarray) -> None:
    """An apostrophe that starts a piece before letters takes its ending with it."""
    mark = np.flatnonzero((raw[:-2] == 39) & start[:-2] & letter[1:-1])
    for ending in ENDINGS:
        at = mark[(raw[mark + 1] == ending[0]) & (raw[mark + len(ending)] == ending[-1])]
        start[at + 1], start[at + 1 + len(ending)] = False, True


def spaced_pieces(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ASCII chunks without white space but one space before them: bytes, the lengths of the pieces of PIECES they fall into, and the chunk of each."""
    raw = np.frombuffer(("\n".join(chunks) + "\n\n\n").encode(), np.uint8)
    kind = BYTE_KIND[raw]
    start = np.ones(len(raw), bool)
    start[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 4) | (kind[1:] == 3)
    _endings(raw, start, kind == 1)
    begin = np.flatnonzero(start)
    own = kind[begin] != 3
    return raw[kind != 3], np.diff(np.append(begin, len(raw)))[own], np.cumsum(kind == 3)[begin[own]]


@lru_cache(2)
def byte_codec(path: str, ids: bool = True) -> Codec:
    """As the tokenizers library encodes with a byte-level .json vocabulary: its special strings inside texts are single tokens."""
    merger, pieces = RankMerger(place(path)), regex.compile(PIECES)
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(merger.special, key=len, reverse=True))) + ")") if merger.special else None

    def walk(text: str) -> Iterator[str]:
        at = 0
        for mark in special.finditer(text) if special else ():
            yield from (m[0] for m in SPACED.finditer(text[at : mark.start()]))
            yield mark[0]
            at = mark.end()
        yield from (m[0] for m in SPACED.finditer(text[at:] if at else text))

    def split(text: str) -> list[str]:
        if special is None or "<|" not in text and not special.search(text):
            return SPACED.findall(text)
        return list(walk(text))

    def merged(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The merger's result for pieces of bounded size at once; a longer piece by its independent parts."""
        flats, counts, some, held = [], [], [], 0

        def close() -> None:
            flat, sizes = merger.encode(some)
            flats.append(flat)
            counts.append(sizes)
            some.clear()

        for p in found:
            if some and held + len(p) > MERGE_BYTES:
                close()
                held = 0
            if len(p) > 1 << 14:
                flat, sizes = merger.encode(merger.parts(p))
                if some:
                    close()
                    held = 0
                flats.append(flat)
                counts.append(np.array([sizes.sum()]))
            else:
                some.append(p)
                held += len(p)
        if some:
            close()
        return (np.concatenate(flats), np.concatenate(counts)) if flats else (np.empty(0, np.int32), np.empty(0, np.int64))

    def by_regex(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, owner, marks = [], [], []
        for i, c in enumerate(chunks):
            if c in merger.special:
                marks.append(i)
            else:
                got = pieces.findall(c)
                found += got
                owner.append((i, len(got)))
        flat, sizes = merged([p.encode("utf-8", "surrogatepass") for p in found])
        own = np.repeat(np.array([i for i, _ in owner], np.int64), np.array([n for _, n in owner], np.int64)) if owner else np.empty(0, np.int64)
        total = np.bincount(own, weights=sizes, minlength=len(chunks)).astype(np.int64)
        if marks:
            total[marks] = 1
            out = np.empty(int(total.sum()), np.int32)
            mine = np.zeros(len(out), bool)
            mine[(np.cumsum(total) - total)[marks]] = True
            out[mine] = [merger.special[chunks[i]] for i in marks]
            out[~mine] = flat
            flat = out
        return flat, total

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        mine = np.fromiter((c.isascii() and "<|" not in c and len(c) < 1 << 12 and not c.isspace() and c not in merger.special for c in chunks), bool, len(chunks))
        if not mine.any():
            return by_regex(chunks)
        raw, lens, own = spaced_pieces([c for c, m in zip(chunks, mine.tolist(), strict=True) if m])
        flats, counts, ends, at = [], [], np.cumsum(lens), 0
        while at < len(lens):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + MERGE_BYTES, side="right")))
            flat, each = merger.encode_raw(raw[done : ends[to - 1]], lens[at:to])
            flats.append(flat)
            counts.append(each)
            at = to
        flat = np.concatenate(flats)
        sizes = np.bincount(np.flatnonzero(mine)[own], weights=np.concatenate(counts), minlength=len(chunks)).astype(np.int64)
        if mine.all():
            return flat, sizes
        others, sizes[~mine] = by_regex([c for c, m in zip(chunks, mine.tolist(), strict=True) if not m])
        out, plain = np.empty(int(sizes.sum()), np.int32), np.repeat(mine, sizes)
        out[plain], out[~plain] = flat, others
        return out, sizes

    return Codec(walk, split, encode, ids)


#: Of the bytes of lower-case ASCII: letters, digits, the separator of chunks, others.
KIND = np.zeros(256, np.uint8)
KIND[97:123], KIND[48:58], KIND[10] = 1, 2, 3


def ascii_pieces(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ASCII chunks without white space: lower-case bytes, the lengths of the pieces they fall into (runs of letters, single digits, runs of others, an apostrophe with its ending), and the chunk of each."""
    raw = np.frombuffer(("\n".join(chunks) + "\n\n\n").lower().encode(), np.uint8)
    kind = KIND[raw]
    start = np.ones(len(raw), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] >= 2)
    _endings(raw, start, kind == 1)
    begin = np.flatnonzero(start)
    own = kind[begin] != 3
    return raw[kind != 3], np.diff(np.append(begin, len(raw)))[own], np.cumsum(kind == 3)[begin[own]]


@lru_cache(2)
def library_codec(path: str, remember: int = 700_000) -> Codec:
    """Ids of the tokenizers library for a vocabulary that lower-cases, drops white space and marks word ends; ``remember``: chunks at once, 17 characters each.

    What stands between white space is encoded once and remembered: ASCII, where the library's normalisation is lower-casing, by
    the merger above; anything else, special strings and very long chunks by the library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t, merger = Tokenizer.from_file(place(path)), RankMerger(place(path))

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        mine = np.fromiter((c.isascii() and "<|" not in c and len(c) < 1 << 12 for c in chunks), bool, len(chunks))
        raw, lens, own = ascii_pieces([c for c, m in zip(chunks, mine.tolist(), strict=True) if m])
        flat, each = merger.encode_raw(raw, lens)
        sizes = np.bincount(np.flatnonzero(mine)[own], weights=each, minlength=len(chunks)).astype(np.int64)
        if mine.all():
            return flat, sizes
        got = [np.array(e.ids, np.int32) for e in t.encode_batch_fast([chunks[i] for i in np.flatnonzero(~mine)], add_special_tokens=False)]
        sizes[~mine] = list(map(len, got))
        out, plain = np.empty(int(sizes.sum()), np.int32), np.repeat(mine, sizes)
        out[plain], out[~plain] = flat, np.concatenate(got)
        return out, sizes

    return Codec(lambda text: (m[0] for m in UNSPACED.finditer(text)), UNSPACED.findall, encode, most=remember, most_text=remember * 120 // 7)


def release() -> None:
    """Drops what the codecs of earlier tasks of this worker remember, for tasks that need the memory."""
    byte_codec.cache_clear()
    library_codec.cache_clear()
