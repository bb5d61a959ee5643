"""Token ids of whole texts by a public tokenizer file, as little-endian unsigned 32-bit integers."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered in each of two generations: those met since the older one filled up, and those before.
KEPT_PIECES = 400_000
KEPT_BYTES = 64  # longer pieces aren't remembered
BLOCK_BYTES = 4 << 20  # of text that are cut at once, about
JOINED = 20_000  # new pieces that go to the library as lines of one text
FEED, SPACE = 0x0A, 0x20
#: A piece that can't stand in a text of one piece a line: blanks other than one leading space, controls, nothing.
ODD = re.compile(r"(?!\A) |[^\S ]|[\x00-\x1f\x7f\u180e\ufeff]|\A ?\Z")
#: A place inside a long text where it may be cut: before the space.
SAFE = re.compile(rb"[0-9A-Za-z](?= [0-9A-Za-z])")

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK = np.zeros(256, bool)
MARK[0x21:0x7F] = True
MARK &= ~LETTER
MARK[0x30:0x3A] = False
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = SOLID[0x80:] = True


def solid_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 certainly belong to no blank and no control character."""
    solid = SOLID[data]
    if not (data >= 0xC2).any():
        return solid
    ahead = np.r_[data[1:], np.zeros(2, np.uint8)]
    second, third = ahead[: len(data)], ahead[1 : len(data) + 1]
    two = (data == 0xC2) & ((second == 0x85) | (second == 0xA0))
    three = (data == 0xE1) & (((second == 0x9A) & (third == 0x80)) | ((second == 0xA0) & (third == 0x8E)))
    three |= (data == 0xE2) & (((second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))) | ((second == 0x81) & (third == 0x9F)))
    three |= (data == 0xE3) & (second == 0x80) & (third == 0x80)
    for at, wide in ((np.flatnonzero(two), 2), (np.flatnonzero(three), 3)):
        for k in range(wide):
            solid[at + k] = False
    return solid


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places at which the pre-tokenizer of a byte-level BPE file always cuts; texts begin at ``starts``.

    It cuts wherever a blank follows what is none, and before the last blank of a run if that is a space or a line
    feed, after which something solid follows; after such a line feed, too; and between a letter and a mark.
    """
    solid = solid_bytes(data)
    cut = np.zeros(len(data) + 1, bool)
    feed = data == FEED
    blank = feed | (data == SPACE)
    cut[1:-1] = blank[1:] & solid[:-1]
    before = np.r_[solid[1:], False]
    before[starts[starts > 0] - 1] = False  # what follows is another text
    cut[:-1] |= blank & before
    cut[1:] |= feed & before
    cut[1:-1] |= LETTER[data[:-1]] & MARK[data[1:]]
    cut[starts] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Encodes texts with the tokenizers library, remembering the ids of pieces that it has seen.

    Texts are cut where the pre-tokenizer always cuts, so the pieces' ids are the texts' ids; a block's distinct
    pieces are looked up, and only new ones go to the library. A text that holds an added token's string is one
    piece. Files of another kind of pre-tokenizer encode whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        said = json.loads(self.library.to_str())
        kind = said["pre_tokenizer"] or {}
        self.cutting = said["normalizer"] is None and kind.get("type") == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"]
        self.added = [x["content"] for x in said["added_tokens"]]
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.feed = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of new pieces: of those without blanks, as lines of one text."""
        found: dict[bytes, bytes] = {}
        plain = []
        for piece in pieces:
            text = piece.decode()
            if self.cutting and not ODD.search(text):
                plain.append((piece, text))
            else:
                found[piece] = self._ids([text])[0].tobytes()
        for at in range(0, len(plain), JOINED):
            part = plain[at : at + JOINED]
            ids = self._ids(["".join(f"\n{x}" for _, x in part)])[0] if len(self.feed) == 1 else self.feed
            ends = np.flatnonzero(ids == self.feed[0])
            if len(self.feed) == 1 and len(ends) == len(part):
                raw, places = ids.tobytes(), [*(4 * ends).tolist(), 4 * len(ids)]
                found.update((piece, raw[a + 4 : b]) for (piece, _), a, b in zip(part, places, places[1:]))
            else:
                found.update((piece, ids.tobytes()) for (piece, _), ids in zip(part, self._ids([x for _, x in part])))
        return [found[x] for x in pieces]

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.recent) > KEPT_PIECES:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        out = [recent.get(x) for x in pieces]
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            if (ids := older.get(pieces[i])) is None:
                new.append(i)
            else:
                out[i] = recent[pieces[i]] = ids
        for i, ids in zip(new, self._learn([pieces[i] for i in new])):
            out[i] = ids
            if len(pieces[i]) <= KEPT_BYTES:
                recent[pieces[i]] = ids
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts end to end, and where those of each text end. A null text counts as empty."""
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        whole = np.full(len(column), not self.cutting)
        for text in self.added:
            whole |= pc.match_substring(column, text).to_numpy(zero_copy_only=False)
        _, offsets, data = column.buffers()
        edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        sizes = np.zeros(len(column), np.int64)
        data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        out, at = [np.zeros(0, "<u4")], 0
        while at < len(data):
            stop = self._stop(data, edges, at, whole)
            inside = np.unique(edges[(edges >= at) & (edges < stop)]) - at
            starts = cuts(data[at:stop], inside)
            if starts[:1].tolist() != [0]:
                starts = np.r_[0, starts]
            owner = np.searchsorted(edges, starts + at, "right") - 1
            if whole.any():
                first = np.r_[True, owner[1:] != owner[:-1]]
                starts, owner = starts[first | ~whole[owner]], owner[first | ~whole[owner]]
            bounds = np.r_[starts, stop - at]
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[at:stop])])
            coded = held.dictionary_encode()
            found = self._known(coded.dictionary.to_pylist())
            width = np.fromiter(map(len, found), np.int64, len(found)) // 4
            ids, ahead = np.frombuffer(b"".join(found), "<u4"), np.cumsum(width) - width
            index = coded.indices.to_numpy()
            each = width[index]
            sizes += np.bincount(owner, each, len(sizes)).astype(np.int64)
            out.append(ids[np.repeat(ahead[index] - (np.cumsum(each) - each), each) + np.arange(each.sum())])
            at = stop
        return np.concatenate(out), np.cumsum(sizes)

    def _stop(self, data: np.ndarray, edges: np.ndarray, at: int, whole: np.ndarray) -> int:
        """Where a block from ``at`` ends: at the end of a text, or within one at a place that is always cut."""
        if at + BLOCK_BYTES >= len(data):
            return len(data)
        edge = int(edges[np.searchsorted(edges, at + BLOCK_BYTES, "right") - 1])
        if edge > at:
            return edge
        owner = int(np.searchsorted(edges, at, "right")) - 1
        if not whole[owner] and (found := SAFE.search(data, at + BLOCK_BYTES, int(edges[owner + 1]))):
            return found.end()
        return int(edges[owner + 1])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text counts as empty."""
        ids, ends = self.encode(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
